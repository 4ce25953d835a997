"""Best-fit packing with certificates.

Documents become pieces of at most `capacity` tokens. Pieces are dealt by a hash of their row to partitions of about
`per_partition` pieces; each is packed by best-fit decreasing. Lower bounds from dual feasible functions certify a
partition's number of bins; partitions whose number lies above their bound have gaps: the pieces of their bins with
free space go into a pool that is dealt anew, so that documents of different partitions meet, and packed again, until the
pool's own bound certifies it, no partition has a gap, or a round saves no bin. Only lengths move: ids are counted and
hashed where the text is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, encoder, slices, stored, vocabulary

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, row_no long"
PACKED = f"{PIECE}, sequence_id long, offset long, free long, gap boolean"


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing of these lengths needs."""
    return lower_bound_of(np.bincount(lengths, minlength=capacity + 1), capacity)


def lower_bound_of(counts: np.ndarray, capacity: int) -> int:
    """The same of the number of pieces of each length from 0 to capacity: the best of the dual feasible functions f_t
    (larger than capacity - t count as whole bins, smaller than t not at all) and u_k (k + 1 parts to a bin, whole parts
    unchanged, others rounded down)."""
    if not counts.any():
        return 0
    sizes = np.arange(capacity + 1)
    many, mass = np.cumsum(counts), np.cumsum(counts * sizes)
    t = np.arange(0, capacity // 2 + 1)
    big = many[-1] - many[capacity - t]
    middle = mass[capacity - t] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    best = int(np.max(big + -(-middle // capacity)))
    for k in range(1, 20):
        parts = (k + 1) * sizes
        whole = parts % capacity == 0
        best = max(best, -(-int((counts * np.where(whole, sizes * k, parts // capacity * capacity)).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in falling order: each one's bin and offset, and each bin's free space."""
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, free = 0, []  # mask: bit r is set if some bin has r free
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        if rest := mask >> n:
            room = n + (rest & -rest).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                mask &= ~(1 << room)
        else:
            room, at = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = at, capacity - room
        free[at] = left = room - n
        if left:
            open_bins[left].append(at)
            mask |= 1 << left
    return bins, offsets, np.array(free, np.int64)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, row_no. Null texts hold end_id alone; row_no tells rows that
    share a doc_id apart."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).batch
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches, 512):
            out: list[tuple] = []
            for doc_id, found in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids = np.append(found.astype("<u4"), np.array([end_id], "<u4"))
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    out.append((doc_id, k, at, len(part), zlib.crc32(part.tobytes()), row))
                    row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    names = [c.split()[0] for c in PIECE.split(", ")]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE)


def _packed(dealt: DataFrame, capacity: int, exchange: int) -> DataFrame:
    """dealt: pieces with their part."""

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row_no"], ascending=[False, True], ignore_index=True)
        bins, offsets, free = best_fit_decreasing(group["length"].to_numpy(), capacity)
        number = (exchange << 29 | int(group["part"].iloc[0])) << 32
        gap = len(free) > lower_bound(group["length"].to_numpy(), capacity)
        return group.drop(columns="part").assign(sequence_id=bins + number, offset=offsets, free=free[bins], gap=gap)

    return dealt.groupBy("part").applyInPandas(pack, PACKED)


def _dealt(rows: DataFrame, n: int, per_partition: int, salt: int) -> DataFrame:
    parts = max(1, -(-n // per_partition))
    return rows.withColumn("part", F.pmod(F.xxhash64("row_no", F.lit(salt)), F.lit(parts)))


def pack(found: DataFrame, capacity: int, per_partition: int = 50_000) -> DataFrame:
    """found: pieces. Adds sequence_id and offset. Each round saves a bin or is the last."""
    found = stored(found, "pieces")
    done, pool, k = None, found, 0
    n, before = found.count(), None
    while True:
        packed = stored(_packed(_dealt(pool.select(*found.columns), n, per_partition, k), capacity, k), "packed")
        if before is not None and packed.where("offset = 0").count() >= before:
            return done
        done = packed if done is None else stored(kept.unionByName(packed), "packed")
        if n <= per_partition:
            return done
        loose = F.col("gap") & (F.col("free") > 0)
        pool, kept = done.where(loose), done.where(~loose)
        counts, before = _counts(pool, capacity)
        if before <= lower_bound_of(counts, capacity):
            return done
        n, k = int(counts.sum()), k + 1


def _counts(packed: DataFrame, capacity: int) -> tuple[np.ndarray, int]:
    """Pieces of each length, and sequences: a row for each length comes to the driver."""
    out, bins = np.zeros(capacity + 1, np.int64), 0
    for r in packed.groupBy("length").agg(F.count("*").alias("n"), F.count_if(F.col("offset") == 0).alias("bins")).collect():
        out[r["length"]], bins = r["n"], bins + r["bins"]
    return out, bins


def best_fit_packing(
    docs: DataFrame, path: str | None = None, capacity: int = 4096, end_id: int = 1, per_partition: int = 50_000
) -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is a piece of one id; repeated rows are packed each; a null doc_id stays null;
    other columns are ignored; an empty table gives no rows.
    """
    bounded(docs.sparkSession)
    done = pack(pieces(docs, path or vocabulary("word_bpe_49k.json"), capacity, end_id), capacity, per_partition)
    return done.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def bound(packed: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """Sequences used, and the least number that any packing of these pieces needs."""
    counts, bins = _counts(packed, capacity)
    return bins, lower_bound_of(counts, capacity)
