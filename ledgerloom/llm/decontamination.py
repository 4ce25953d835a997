"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by the size class of their shingle sets (powers of two). In a class of items with up to s shingles
an item is represented by its k smallest shingle hashes, k = misses(s) + 1 where misses(s) shingles may be absent at the
containment asked for. A document that contains an item lacks at most misses(q) of its q shingles, so it holds at least
k - misses(q) of those k: an inverted index over them finds every contained item, however long the document. Candidates
are verified by counting the item's shingles in the document's text, word by word.

A benchmark of up to INDEX_BYTES of text is one broadcast index, and documents are never moved. A larger one stays a table:
tasks look documents' shingle hashes up in a bitmap of fixed size, those that may be an item's meet the items' entries in
a join (salted, as a passage may be in very many documents), and the candidates are verified where a document and its
items come together. Either way documents are hashed in one scan, and what is broadcast has a bound.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import BITS, bitmap, test_bits
from .common import WordHashes, bounded, slices, stored

WORDS = re.compile(r"[^\W_]+")
WIDTH, PERCENT = 5, 80
#: Text of the items that an index may be broadcast for; it takes some thirty times as much memory.
INDEX_BYTES = 4 << 20
#: Parts that the documents with a shingle are dealt in.
SALT = 32
MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(WordHashes):
    """Of words as str."""


HASHES = _Hashes()


def words_of(text: str | None) -> list[str]:
    """Letters and digits in lower case; white space, punctuation and markup divide words."""
    return WORDS.findall(text.lower()) if text else []


def shingle_hashes(words: list[str], width: int) -> np.ndarray:
    if len(words) < width:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    out = h[: len(h) - width + 1] + np.uint64(width)
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : len(h) - width + 1 + k]
    return out


def shingles_of(words: list[str], width: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(width)), strict=False))


def least_hashes(words: list[str], width: int, percent: int) -> tuple[np.ndarray, int, int]:
    """Of an item: the hashes that stand for it, how many of them any containing document holds, and its shingles' width."""
    w = min(width, len(words))
    misses = lambda q: q - -(-percent * q // 100)
    hashes = np.unique(shingle_hashes(words, w))
    q = len(hashes)
    k = min(q, misses((2 << (q.bit_length() - 1)) - 1) + 1)
    return hashes[:k], max(1, k - misses(q)), w


class ItemIndex:
    """The searched items. An item with fewer words than `width` is one shingle of all its words."""

    def __init__(self, items: list[tuple[int, str | None]], width: int = WIDTH, percent: int = PERCENT):
        self.percent = percent
        self.items: list[tuple[int, int, set[tuple[str, ...]]]] = []
        entries: dict[int, list[tuple[int, int]]] = defaultdict(list)
        needed: list[int] = []
        for item_id, text in items:
            if not (words := words_of(text)):
                continue
            hashes, least, w = least_hashes(words, width, percent)
            for h in hashes.tolist():
                entries[w].append((h, len(self.items)))
            needed.append(least)
            self.items.append((item_id, w, shingles_of(words, w)))
        self.needed = np.array(needed, np.int64)
        self.by_width = {}
        for w, found in sorted(entries.items()):
            found.sort()
            self.by_width[w] = np.array([h for h, _ in found], np.uint64), np.array([i for _, i in found], np.int64)

    def search(self, text: str | None) -> list[tuple[int, int, int]]:
        """item_id, shingles of the item, and how many of them the text holds, for each contained item."""
        if not self.items or not (words := words_of(text)):
            return []
        hits = np.zeros(len(self.items), np.int64)
        for w, (hashes, places) in self.by_width.items():
            own = shingle_hashes(words, w)
            at = np.searchsorted(hashes, own)
            at[at == len(hashes)] = 0
            if len(own) and len(met := np.unique(own[hashes[at] == own])):
                first, last = np.searchsorted(hashes, met, "left"), np.searchsorted(hashes, met, "right")
                for a, b in zip(first, last, strict=True):
                    hits[places[a:b]] += 1
        out, seen = [], {}
        for i in np.flatnonzero(hits >= self.needed):
            item_id, w, shingles = self.items[i]
            if w not in seen:
                seen[w] = shingles_of(words, w)
            found = len(shingles & seen[w])
            if 100 * found >= self.percent * len(shingles):
                out.append((item_id, len(shingles), found))
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def item_index(benchmark: DataFrame, width: int, percent: int, index_bytes: int) -> ItemIndex | None:
    """The index of all items, unless they have more text than index_bytes."""
    rows = _items(benchmark)
    if (rows.agg(F.sum(F.octet_length("text") + 64).alias("n")).first().n or 0) > index_bytes:
        return None
    return ItemIndex([(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()], width, percent)


FOUND = "doc_id long, item_id long, n_shingles long, n_found long, containment double"


def _joined(docs: DataFrame, benchmark: DataFrame, width: int, percent: int) -> DataFrame:
    """docs: stored rows of row_no, doc_id, text. Per row and contained item: row_no and the columns of FOUND."""
    items = stored(_items(benchmark).withColumn("item_no", F.monotonically_increasing_id()), "items")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item_no, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words := words_of(text):
                    hashes, least, _ = least_hashes(words, width, percent)
                    out += [(h, item_no, least) for h in hashes.view(np.int64).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["h", "item_no", "least"])

    entries = stored(items.select("item_no", "text").mapInArrow(spread, "h long, item_no long, least int"), "entries")
    known = bitmap(entries, "h", F.shiftrightunsigned("h", 64 - BITS).cast("int"))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found = [], [np.zeros(0, np.uint64)]
            for row_no, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                for w in range(1, width + 1):
                    own = shingle_hashes(words, w)
                    own = np.unique(own[test_bits(known.value, (own >> np.uint64(64 - BITS)).astype(np.int64))])
                    found.append(own)
                    rows += [row_no] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate(found).view(np.int64))], ["row_no", "h"])

    met = docs.select("row_no", "text").mapInArrow(hits, "row_no long, h long").withColumn("salt", F.pmod(F.xxhash64("row_no"), F.lit(SALT)).cast("int"))
    salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    pairs = met.join(salted, ["h", "salt"]).groupBy("row_no", "item_no").agg(F.count("*").alias("n"), F.max("least").alias("least"))
    pairs = stored(pairs.where("n >= least").select("row_no", "item_no"), "candidates")
    asked = pairs.join(items, "item_no").select("row_no", "item_id", "text", F.lit(1).alias("kind"))
    own = docs.join(pairs.select("row_no").distinct(), "row_no", "left_semi")
    # A document comes right before its items; a task holds one document's shingles at a time.
    rows = own.select("row_no", F.col("doc_id").alias("item_id"), "text", F.lit(0).alias("kind")).unionByName(asked)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc_id, words, held = None, [], {}
        for batch in batches:
            out = []
            for row_no, item_id, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not kind:
                    doc_id, words, held = item_id, words_of(text), {}
                    continue
                item = words_of(text)
                w = min(width, len(item))
                if w not in held:
                    held[w] = shingles_of(words, w)
                shingles = shingles_of(item, w)
                both = len(shingles & held[w])
                if 100 * both >= percent * len(shingles):
                    out.append((row_no, doc_id, item_id, len(shingles), both, both / len(shingles)))
            if out:
                types = [*[pa.int64()] * 5, pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["row_no", "doc_id", "item_id", "n_shingles", "n_found", "containment"])

    sent = rows.repartition("row_no").sortWithinPartitions("row_no", "kind").select("row_no", "item_id", "text", "kind")
    return sent.mapInArrow(verify, f"row_no long, {FOUND}")


def contained_items(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Per row of docs and benchmark item contained in its text: doc_id, item_id, n_shingles, n_found, containment.

    Defined cases: null, empty and wordless texts and items give no rows; repeated rows give their rows again; other
    columns are ignored.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = item_index(benchmark, width, percent, index_bytes)
    if index is None:
        return _joined(stored(rows.withColumn("row_no", F.monotonically_increasing_id()), "documents"), benchmark, width, percent).drop("row_no")
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found += [(doc_id, *x, x[2] / x[1]) for x in sent.value.search(text.as_py())]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    types = [*[pa.int64()] * 4, pa.float64()]
    names = ["doc_id", "item_id", "n_shingles", "n_found", "containment"]
    return rows.mapInArrow(run, FOUND)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, percent: int = PERCENT, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """docs without the rows whose text contains an item; all columns stay as they are."""
    bounded(docs.sparkSession)
    index = item_index(benchmark, width, percent, index_bytes)
    if index is None:
        rows = stored(docs.withColumn("_row_no", F.monotonically_increasing_id()), "documents")
        texts = rows.select(F.col("_row_no").alias("row_no"), F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        found = _joined(texts, benchmark, width, percent).select(F.col("row_no").alias("_row_no")).distinct()
        return rows.join(found, "_row_no", "left_anti").select(*docs.columns)
    sent, at = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not sent.value.search(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


#: The same in SQL, over all pairs of equal shingles.
SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
bs AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS n,
         unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM b WHERE len(w) > 0
),
q AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ds AS (
  SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS s
  FROM d, (SELECT DISTINCT n FROM bs) WHERE len(w) >= n
)
SELECT doc_id, item_id, any_value(n_shingles) AS n_shingles, count(*) AS n_found,
       CAST(count(*) AS DOUBLE) / any_value(n_shingles) AS containment
FROM ds JOIN bs USING (n, s) JOIN q USING (item_id)
GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n_shingles)
"""
