"""Token-ID output: concatenated ids with document boundaries in Elias-Fano code.

A segment is one binary file: a header, two monotone sequences in Elias-Fano code (the documents' ends within the segment
and their doc_ids) and the token ids of some whole documents one after another. A value of a sequence over n values below
u takes about 2 + log2(u / n) bits; a select structure (the place of every SAMPLE-th one bit) gives the i-th value without
decoding the rest, and a window of SAMPLE values at once. Tasks write the files to the shared folder, under names of their
own attempt, and return a row for each; that table of segments names the files that count. Readers fetch a file's codes,
find a document's bounds by select and fetch its ids alone; no table of 64-bit offsets is made on either side. The folder
may be any that Arrow's file systems reach (a mount, HDFS, S3, GCS).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, encoder, shared_dir, slices, stored, vocabulary

MAGIC = b"EFTOK1\0\0"
#: magic, documents, documents without id, ids, bytes an id, bytes of the code of ends and of doc_ids, least doc_id
HEADER = struct.Struct("<8sQQQQQQq")
EF_HEADER = struct.Struct("<QQQQ")
SAMPLE = 256
SEGMENT_IDS = 1 << 23


class EliasFano:
    """A non-decreasing sequence of integers from 0 up in near-minimal space, with access to each value."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        """Of a non-decreasing array of integers from 0 up; an empty one has no bits."""
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if low_bits:
            shifts = np.arange(low_bits, dtype=np.uint64)
            low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        return cls(n, low_bits, low, np.packbits(bits, bitorder="little"), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = EF_HEADER.pack(self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, n_low, n_high = EF_HEADER.unpack_from(data)
        at = EF_HEADER.size
        low = np.frombuffer(data, np.uint8, n_low, at)
        high = np.frombuffer(data, np.uint8, n_high, at + n_low)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", -(-n // SAMPLE), at + n_low + n_high))

    def select(self, i: int) -> int:
        """The place of the i-th one bit of the high part, from the sample before it."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        at = place // 8
        first = int(self.high[at]) >> (place % 8) << (place % 8)
        while (ones := first.bit_count()) <= left:
            left -= ones
            at += 1
            first = int(self.high[at])
        for _ in range(left):
            first &= first - 1
        return at * 8 + (first & -first).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        low = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            low |= (int(self.low[bit // 8]) >> (bit % 8) & 1) << k
        return (self.select(i) - i) << self.low_bits | low

    def window(self, first: int) -> np.ndarray:
        """Values first to first + SAMPLE (or to the end), where first is a multiple of SAMPLE: only their bits are read."""
        size = min(SAMPLE, self.n - first)
        if size <= 0:
            return np.zeros(0, np.int64)
        k = first // SAMPLE
        begin = int(self.samples[k])
        end = int(self.samples[k + 1]) if k + 1 < len(self.samples) else len(self.high) * 8
        bits = np.unpackbits(self.high[begin // 8 : -(-end // 8)], bitorder="little")
        ones = np.flatnonzero(bits[begin % 8 :])[:size] + begin
        out = (ones - np.arange(first, first + size)) << self.low_bits
        if self.low_bits:
            at = first * self.low_bits // 8
            low = np.unpackbits(self.low[at : at - (-size * self.low_bits // 8)], bitorder="little")[: size * self.low_bits]
            out |= low.reshape(size, -1).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out


class Segment:
    """A file of documents in the order of their ids; those without an id come first. Nothing but the two codes is held."""

    def __init__(self, file):
        self.file = file
        magic, self.n, self.unnamed, self.n_ids, self.id_bytes, n_ends, n_names, self.least = HEADER.unpack(file.read_at(HEADER.size, 0))
        if magic != MAGIC:
            raise ValueError("not a segment of token ids")
        codes = file.read_at(n_ends + n_names, HEADER.size)
        self.ends, self.names = EliasFano.from_bytes(codes[:n_ends]), EliasFano.from_bytes(codes[n_ends:])
        self.at = HEADER.size + n_ends + n_names

    def __len__(self) -> int:
        return self.n

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.names[i - self.unnamed] + self.least

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.id_bytes, self.at + start * self.id_bytes), f"<u{self.id_bytes}")

    def windows(self) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """doc_ids, starts and ends of SAMPLE documents at a time."""
        before, names = 0, self._names()
        for first in range(0, self.n, SAMPLE):
            ends = self.ends.window(first)
            yield [next(names) for _ in ends], np.concatenate([[before], ends[:-1]]), ends
            before = int(ends[-1])

    def _names(self) -> Iterator[int | None]:
        yield from (None for _ in range(self.unnamed))
        for first in range(0, self.names.n, SAMPLE):
            yield from (self.names.window(first) + self.least).tolist()


def opened(path: str) -> Segment:
    system, place = fs.FileSystem.from_uri(path)
    return Segment(system.open_input_file(place))


def write_segment(doc_ids: list[int | None], ids: list[np.ndarray], id_bytes: int) -> bytes:
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    ends = EliasFano.encode(np.cumsum([len(x) for x in ids])).to_bytes()
    names = EliasFano.encode(np.array([d - least for d in known], np.uint64)).to_bytes()
    flat = np.concatenate(ids) if ids else np.zeros(0)
    head = HEADER.pack(MAGIC, len(doc_ids), len(doc_ids) - len(known), len(flat), id_bytes, len(ends), len(names), least)
    return head + ends + names + flat.astype(f"<u{id_bytes}").tobytes()


@dataclass
class Ranges:
    """How documents go to tasks in ascending order: rows without doc_id first, over `unnamed` tasks, then ranges of doc_id
    at bounds; a doc_id that several bounds fall on is dealt over as many tasks by its rows."""

    unnamed: int
    bounds: list[int]

    @property
    def tasks(self) -> int:
        return self.unnamed + len(self.bounds) + 1

    def of(self, doc_id: Column, salt: Column) -> Column:
        """Among the distinct bounds, how many lie below a doc_id: first among every `step`-th, then among those between."""
        named = F.lit(self.unnamed)
        if self.bounds:
            values, first, times = np.unique(np.array(self.bounds, np.int64), return_index=True, return_counts=True)
            step = max(1, int(len(values) ** 0.5))
            coarse, fine = F.lit(values[step - 1 :: step]), F.lit(values)
            skipped = F.size(F.filter(coarse, lambda b: b < doc_id)) * step
            below = skipped + F.size(F.filter(F.slice(fine, skipped + 1, F.lit(step)), lambda b: b < doc_id))
            before = F.get(F.lit(np.append(first, len(self.bounds)).astype(np.int32)), below)
            several = F.get(F.lit(np.append(times, 1).astype(np.int32)), below)
            own = F.when(F.get(F.lit(np.append(values, 0)), below) == doc_id, F.pmod(salt, several)).otherwise(F.lit(0))
            named = (before + own + self.unnamed).cast("int")
        return F.when(doc_id.isNull(), F.pmod(salt, F.lit(max(1, self.unnamed))).cast("int")).otherwise(named)


def ranges(docs: DataFrame, partitions: int) -> Ranges:
    """Even ranges, from a scan of the doc_id column alone."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = ids.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    unnamed = -(-(n.rows - n.named) * partitions // max(1, n.rows))
    shares = [k / partitions for k in range(1, partitions)]
    found = ids.where("doc_id is not null").approxQuantile("doc_id", shares, 0.2 / partitions) if n.named else []
    return Ranges(unnamed, sorted(int(x) for x in found))


def write_tokens(docs: DataFrame, path: str, end_id: int, partitions: int, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """The table of segments (part, segment, before: ids of the part before it, n_ids, data) of all documents in ascending
    doc_id order.

    Documents go by ranges of doc_id to tasks; each task sorts its range (rows that share a doc_id by a hash of their
    text) and encodes it document by document; a segment ends after the document that fills it, so that memory is bounded
    by a segment and a batch. Null texts are empty, rows without doc_id come first. A task that is run again writes files
    of other names; those of its lost attempt are in no row.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/token-files/{uuid.uuid4().hex}"
    system, place = fs.FileSystem.from_uri(folder)
    system.create_dir(place, recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_text = encoder(path)
        id_bytes = 2 if max(encode_text.library.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, number, before, names, ids, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        system, place = fs.FileSystem.from_uri(folder)

        def segment() -> pa.RecordBatch:
            name = f"{part:06d}-{number:04d}-{TaskContext.get().taskAttemptId()}.eft"
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write(write_segment(names, ids, id_bytes))
            row = part, number, before, size, f"{folder}/{name}"
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        for batch in slices(batches, 512):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, own in zip(batch.column(0).to_pylist(), encode_text.batch(texts), strict=True):
                found = np.append(own.astype(f"<u{id_bytes}"), np.array([end_id], f"<u{id_bytes}"))
                names.append(doc_id)
                ids.append(found)
                size += len(found)
                if size >= segment_ids:
                    yield segment()
                    number, before, names, ids, size = number + 1, before + size, [], [], 0
        if names:
            yield segment()

    schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("file", pa.string())])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = ranges(docs, partitions)
    salt = F.xxhash64("text", F.monotonically_increasing_id())
    sent = rows.repartitionById(dealt.tasks, dealt.of(F.col("doc_id"), salt))
    ordered = sent.sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(ordered.mapInArrow(encode, "part int, segment int, before long, n_ids long, file string"), "token-segments")


def read_tokens(segments: DataFrame) -> DataFrame:
    """From a table of segments: doc_id, start (ids of all documents before), n_tokens, ids_crc32, all out of the files.

    What goes to the driver is one number for each part, as many as there were tasks.
    """
    totals = {r.part: r.n for r in segments.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    parts = sorted(totals)
    before = dict(zip(parts, accumulate([0, *(totals[p] for p in parts)]), strict=False))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, own, file in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                segment, base = opened(file), before[part] + own
                for doc_ids, starts, ends in segment.windows():
                    flat = segment.ids(int(starts[0]), int(ends[-1])).astype("<u4")
                    crcs = [zlib.crc32(flat[a:b]) for a, b in zip((starts - starts[0]).tolist(), (ends - starts[0]).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc_ids, starts + base, ends - starts, crcs)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    # Few rows with much behind each: a task for every file.
    rows = segments.select("part", "before", "file").repartition(max(1, len(parts)), "part", "before")
    return rows.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(docs: DataFrame, path: str | None = None, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Writes all documents' ids (whole texts, then end_id) as segments and returns what is read back from the files: per
    row doc_id, start, n_tokens, ids_crc32.

    Defined cases: a null or empty text holds end_id alone; rows without doc_id come first; rows that share a doc_id lie
    one after another, by a hash of their text within a task; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded(spark)
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return read_tokens(write_tokens(docs, path or vocabulary("word_bpe_49k.json"), end_id, n))
