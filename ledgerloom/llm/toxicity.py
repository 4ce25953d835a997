"""Toxicity by nearest labelled examples under TF-IDF cosine.

Examples are a bounded sample of labelled documents (`per_class` of each label, by a hash of the id; of equal texts one).
Terms are all words of the examples. A term weighs (1 + ln count) * idf * rf ** RELEVANCE: idf from its document frequency
over all documents, rf the relevance frequency of tf.rf weighting, log2(2 + toxic examples with it / clean examples with
it), which is smooth and leaves no word out; RELEVANCE 0 gives plain TF-IDF.

Examples lie in a block-max inverted index: similar ones share a block of BLOCK, and each term has its largest weight in
each block, so that a text's similarity to any example of a block has an upper bound. The blocks of the largest bounds are
compared first; then those whose bound reaches the k-th similarity found; no other block can hold a neighbour. The best
are compared again in double precision, so the neighbours are exact. Votes are weighted by closeness; a monotone map
fitted to the examples' own votes (each without itself) makes them probabilities. A text without any term has no
neighbours; its score is the share of toxic examples among such, drawn towards the share among all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded, one_thread, slices, stored, trimmed
from .near_duplicates import shingle_set

WORDS = re.compile(r"[^\W\d_]+")
PER_CLASS, NEIGHBOURS = 4000, 15
RELEVANCE = 2.0
#: Examples of a block; blocks that are compared before any bound is used.
BLOCK, OPENED = 64, 4
#: Terms of so many examples at least, and up to so many of them, have their weights in a row of a matrix; others in lists.
COMMON, ROWS = 32, 512
#: Texts that are searched together.
SEARCHED = 128
#: Document frequencies are added up in pieces of so many terms, first among SALTS groups of tasks.
PIECE, SALTS = 1024, 64

Vector = tuple[np.ndarray, np.ndarray]


#: Letters of Latin-1 as they are, anything else a space.
LETTERS = bytes(i if WORDS.match(chr(i)) else 32 for i in range(256))


def words_of(text: str | None) -> list[str]:
    """The matches of WORDS in lower case."""
    if not text:
        return []
    text = text.lower()
    try:
        return text.encode("latin-1").translate(LETTERS).decode("latin-1").split()
    except UnicodeEncodeError:
        return WORDS.findall(text)


def counts_of(text: str | None) -> Counter:
    return Counter(words_of(text))


def _places(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    size = ends - starts
    return np.arange(size.sum()) + np.repeat(starts - np.cumsum(size) + size, size)


class Index:
    """Examples' vectors, by example and by term, with the largest weight of each term in each block of examples."""

    def __init__(self, vectors: list[dict[int, float] | Vector], n_terms: int):
        pairs = [(np.fromiter(v, np.int64, len(v)), np.fromiter(v.values(), np.float64, len(v))) if isinstance(v, dict) else v for v in vectors]
        self.n, self.n_terms = len(pairs), n_terms
        self.ends = np.cumsum([0, *(len(t) for t, _ in pairs)])
        self.terms = np.concatenate([np.zeros(0, np.int32), *(t.astype(np.int32) for t, _ in pairs)])
        self.own = np.concatenate([np.zeros(0), *(w for _, w in pairs)])

    @cached_property
    def by_term(self) -> bool:
        """Lays the weights out by term, where something is searched: on the driver nothing is."""
        one_thread()
        order = np.argsort(self.terms, kind="stable")
        self.places = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(self.ends))[order]
        self.weights = self.own[order].astype(np.float32)
        self.first = np.searchsorted(self.terms[order], np.arange(self.n_terms + 1))
        size = np.diff(self.first)
        common = np.argsort(-size, kind="stable")[:ROWS]
        common = common[size[common] >= COMMON]
        self.row = np.full(self.n_terms, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.blocks = max(1, -(-self.n // BLOCK))
        matrix = np.zeros((len(common), self.blocks * BLOCK), np.float32)
        for r, t in enumerate(common):
            at = slice(self.first[t], self.first[t + 1])
            matrix[r, self.places[at]] = self.weights[at]
        self.tops = matrix.reshape(len(common), self.blocks, BLOCK).max(axis=2)
        self.parts = matrix.reshape(len(common), self.blocks, BLOCK).transpose(1, 0, 2)
        self.scratch = np.zeros(self.n_terms)
        return True

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("n", "n_terms", "ends", "terms", "own")}

    def example(self, i: int) -> Vector:
        at = slice(self.ends[i], self.ends[i + 1])
        return self.terms[at], self.own[at]

    def _rough(self, vectors: list[Vector], k: int, but: list[int] | None) -> np.ndarray:
        """Similarities of vectors x examples in single precision; minus infinity in blocks that can't hold the k nearest."""
        assert self.by_term
        asked = np.zeros((len(vectors), len(self.tops)), np.float32)
        rare = np.zeros((len(vectors), self.blocks * BLOCK), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            rows = self.row[terms]
            listed = rows < 0
            asked[i, rows[~listed]] = weights[~listed]
            starts, ends = self.first[terms[listed]], self.first[terms[listed] + 1]
            found = _places(starts, ends)
            rare[i] = np.bincount(self.places[found], np.repeat(weights[listed].astype(np.float32), ends - starts) * self.weights[found], rare.shape[1])
        rare[:, self.n :] = -np.inf
        if but is not None:
            rare[np.arange(len(but)), but] = -np.inf
        bounds = asked @ self.tops + rare.reshape(len(vectors), self.blocks, BLOCK).max(axis=2)
        out = np.full_like(rare, -np.inf)

        def compare(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                who, at = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                out[who, at] = asked[who] @ self.parts[b] + rare[who, at]

        opened = np.ones(bounds.shape, bool)
        if self.blocks > OPENED and k <= OPENED * BLOCK:
            best = np.argpartition(-bounds, OPENED, axis=1)[:, :OPENED]
            opened[:] = False
            np.put_along_axis(opened, best, True, 1)
            compare(opened)
            seen = np.take_along_axis(out.reshape(len(vectors), self.blocks, BLOCK), best[:, :, None], 1).reshape(len(vectors), -1)
            least = np.partition(seen, -k, axis=1)[:, -k]
            opened = (bounds >= least[:, None] - 1e-4) & (bounds > 0) & ~opened
        compare(opened)
        return out

    def nearest_of(self, vectors: list[Vector], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the k nearest examples with a similarity above 0, the nearest first, ties by number."""
        if not vectors or not self.n or not self.by_term:
            return [(np.zeros(0, np.int64), np.zeros(0)) for _ in vectors]
        rough, out = self._rough(vectors, k, but), []
        least = np.partition(rough, -k, axis=1)[:, -k] if rough.shape[1] > k else np.full(len(vectors), -np.inf)
        for i, (terms, weights) in enumerate(vectors):
            met = np.flatnonzero((rough[i] > 0) & (rough[i] >= least[i] - 1e-4))
            if not len(met):
                out.append((np.zeros(0, np.int64), np.zeros(0)))
                continue
            self.scratch[terms] = weights
            at = _places(self.ends[met], self.ends[met + 1])
            size = self.ends[met + 1] - self.ends[met]
            exact = np.add.reduceat(self.scratch[self.terms[at]] * self.own[at], np.cumsum(size) - size)
            self.scratch[terms] = 0
            best = np.lexsort((met, -np.round(exact, 12)))[:k]
            out.append((met[best], exact[best]))
        return out

    def nearest(self, vector: dict[int, float], k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        pair = np.fromiter(vector, np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector))
        return self.nearest_of([pair], k, None if but < 0 else [but])[0]


def in_blocks(vectors: list[Vector], n_terms: int) -> np.ndarray:
    """An order of examples in which similar ones are near: halves along the main direction of the commonest terms' weights,
    down to single blocks."""
    sizes = np.bincount(np.concatenate([np.zeros(0, np.int32), *(t for t, _ in vectors)]), minlength=n_terms)
    row = np.full(n_terms, -1)
    common = np.argsort(-sizes, kind="stable")[: ROWS // 2]
    row[common] = np.arange(len(common))
    matrix = np.zeros((len(vectors), len(common)), np.float32)
    for i, (terms, weights) in enumerate(vectors):
        matrix[i, row[terms][row[terms] >= 0]] = weights[row[terms] >= 0]
    out, todo = [], [np.arange(len(vectors))]
    while todo:
        own = todo.pop()
        if len(own) <= BLOCK:
            out.append(own)
            continue
        centred = matrix[own] - matrix[own].mean(axis=0)
        along = centred[0].copy()
        for _ in range(6):
            along = centred.T @ (centred @ along)
            along /= np.linalg.norm(along) or 1.0
        order = own[np.argsort(centred @ along, kind="stable")]
        half = -(-len(own) // (2 * BLOCK)) * BLOCK
        todo += [order[half:], order[:half]]
    return np.concatenate([np.zeros(0, np.int64), *out])


def monotone(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing step function nearest to y at x, by pooling adjacent violators: upper ends and values."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []
    for v, t, w in zip(x[order], y[order], weight[order], strict=True):
        pools.append([v, t * w, w])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            v2, a, b = pools.pop()
            pools[-1] = [v2, pools[-1][1] + a, pools[-1][2] + b]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])


def numbered(words: pa.Array) -> dict[str, int]:
    return dict(zip(words.to_pylist(), range(len(words)), strict=True))


@dataclass
class Scorer:
    """What tasks need to score texts; its size is bounded by the words of 2 * PER_CLASS examples (sorted, as an array)."""

    words: pa.Array
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    index: Index
    ends: np.ndarray
    values: np.ndarray
    bare: float
    k: int = NEIGHBOURS

    def __post_init__(self):
        self.done: dict[bytes, tuple[float, list[int]]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("done", "terms")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @cached_property
    def terms(self) -> dict[str, int]:
        """A word's number; made where texts are read."""
        return numbered(self.words)

    def pair(self, text: str | None) -> Vector:
        """Terms and weights (1 + ln count) * idf, of length 1."""
        found = Counter(map(self.terms.get, words_of(text)))
        found.pop(None, None)
        terms, counts = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.float64, len(found))
        order = np.argsort(terms)
        terms, weights = terms[order], (1 + np.log(counts[order])) * self.idf[terms[order]]
        return terms, weights / np.sqrt((weights**2).sum()) if found else weights

    def vector(self, text: str | None) -> dict[int, float]:
        return dict(zip(*(x.tolist() for x in self.pair(text)), strict=True))

    def vote(self, near: np.ndarray, similar: np.ndarray) -> float:
        weight = 1 / (1.05 - np.minimum(similar, 1))
        return float((weight * self.toxic[near]).sum() / weight.sum())

    def calibrated(self, vote: float) -> float:
        return float(self.values[min(np.searchsorted(self.ends, vote), len(self.values) - 1)]) if len(self.values) else self.bare

    def scores(self, texts: list[str | None]) -> list[tuple[float, list[int]]]:
        """Of each text the probability that the label is 1, and the ids of the three nearest examples."""
        keys = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        new = {key: t for key, t in zip(keys, texts, strict=True) if key not in self.done}
        found = self.index.nearest_of([self.pair(t) for t in new.values()], self.k) if new else []
        fresh = {key: (self.calibrated(self.vote(near, similar)), self.ids[near[:3]].tolist()) if len(near) else (self.bare, []) for key, (near, similar) in zip(new, found, strict=True)}
        out = [fresh[key] if key in fresh else self.done[key] for key in keys]
        if len(self.done) < 10_000:
            self.done.update(fresh)
        return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is divisible by 5; rows without an id have no label to learn from and count as held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, toxic) with the least hash of their five-word shingles: copies, and most near copies, share it.

    Documents of one key and label count once among those that have a term; else the words of a text with many near
    copies would pass for signs of its label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keys = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = shingle_set((text or "").encode(), 5)
                keys.append(int(own[0] >> np.uint64(1)) if len(own) else -1 - abs(doc_id))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], ["doc_id", "text", "toxic", "key"])

    return rows.select("doc_id", "text", "toxic").mapInArrow(run, "doc_id long, text string, toxic int, key long")


def _document_counts(docs: DataFrame, words: pa.Array) -> tuple[np.ndarray, int]:
    """In how many of all documents each term is, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast(words)
    n_terms = len(words)
    pieces = n_terms // PIECE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, total = numbered(sent.value).get, np.zeros(pieces * PIECE, np.int64)
        for batch in slices(batches):
            found = [t for text in batch.column(0).to_pylist() for t in set(map(get, words_of(text))) if t is not None]
            total += np.bincount(np.array(found, np.int64), minlength=len(total))
            total[n_terms] += batch.num_rows
        salt = TaskContext.get().partitionId() % SALTS
        arrays = [pa.array(range(pieces), pa.int32()), pa.array([salt] * pieces, pa.int32()), pa.array([x.tobytes() for x in total.reshape(-1, PIECE)], pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, ["piece", "salt", "counts"])

    def added(own: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in own.column("counts").to_pylist())
        return pa.table({"piece": own.column("piece")[:1], "salt": own.column("salt")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "piece int, salt int, counts binary"
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    rows = parts.groupBy("piece", "salt").applyInArrow(added, schema).groupBy("piece").applyInArrow(added, schema).collect()
    total = np.zeros(pieces * PIECE, np.int64)
    for r in rows:
        total[r.piece * PIECE : (r.piece + 1) * PIECE] = np.frombuffer(r.counts, np.int64)
    sent.destroy()
    return total[:n_terms], int(total[n_terms])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, relevance: float = RELEVANCE) -> Scorer:
    """Learns from labelled rows that aren't held out: at most per_class of each label, those with the least hash of the
    id, and of equal texts one; a doc_id with several labels has its highest. What comes to the
    driver is bounded: 2 * per_class ids, and the examples' words and weights."""
    bounded(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id").cast("long")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = None
    for label in (0, 1):
        own = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = own if picked is None else picked.unionByName(own)
    ids = docs.sparkSession.createDataFrame(picked.toPandas(), "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    drawn = stored(_keyed(texts.join(F.broadcast(ids), "doc_id")), "drawn")
    # At most 2 * per_class rows and their repetitions: of equal texts of a label the least doc_id is the example.
    by_text = Window.partitionBy(F.sha2("text", 256), "toxic").orderBy("doc_id")
    by_key = Window.partitionBy("key", "toxic").orderBy("doc_id")
    examples = drawn.withColumn("copy", F.row_number().over(by_text)).where("copy = 1").withColumn("counts", (F.row_number().over(by_key) == 1).cast("int"))
    examples = stored(examples.select("doc_id", "toxic", "text", "counts"), "examples")

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found, of = [], [[], []]
            for text, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = counts_of(text).keys()
                found += own
                of[y] += [n] * len(own)
                of[1 - y] += [0] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), *(pa.array(x, pa.int32()) for x in of)], ["term", "clean", "toxic"])

    n = {r.toxic: (r.n, r.m) for r in examples.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("counts").alias("m")).collect()}
    spread = examples.select("text", "toxic", "counts").mapInArrow(distinct_terms, "term string, clean int, toxic int")
    words = spread.groupBy("term").agg(F.sum("clean").cast("int").alias("clean"), F.sum("toxic").cast("int").alias("toxic")).toArrow().sort_by("term")
    terms = words["term"].combine_chunks()
    df, n_docs = _document_counts(docs, terms) if len(terms) else (np.zeros(0, np.int64), 0)
    even = n.get(1, (0, 0))[1] / max(1, n.get(0, (0, 0))[1])
    rf = np.log2(2 + words["toxic"].to_numpy() / np.maximum(1.0, even * words["clean"].to_numpy()))
    idf = np.log((1 + n_docs) / np.maximum(df, 1)) * rf**relevance
    scorer = Scorer(terms, idf, np.zeros(0, np.int64), np.zeros(0), Index([], len(terms)), np.zeros(0), np.zeros(0), 0.0)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [sent.value.pair(t) for t in batch.column(2).to_pylist()]
            arrays = [batch.column(0), batch.column(1), pa.array([t for t, _ in own], pa.list_(pa.int32())), pa.array([w for _, w in own], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "toxic", "terms", "weights"])

    made = examples.select("doc_id", "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, weights array<double>").toArrow()
    sent.destroy()
    return _fitted(docs.sparkSession, scorer, made, share, {k: x for k, (x, _) in n.items()})


def _fitted(spark: SparkSession, scorer: Scorer, made: pa.Table, share: dict[int, int], n: dict[int, int]) -> Scorer:
    """Index and calibration from the examples' vectors; a label's examples count for all its labelled rows."""
    made = made.sort_by([("toxic", "ascending"), ("doc_id", "ascending")]).combine_chunks()
    ids, toxic = made["doc_id"].to_numpy(), made["toxic"].to_numpy().astype(np.float64)
    terms, weights = (made[c].combine_chunks() for c in ("terms", "weights"))
    ends, terms, weights = terms.offsets.to_numpy(), terms.values.to_numpy(), weights.values.to_numpy()
    worth = np.array([share.get(int(y), 0) / max(1, n[int(y)]) for y in toxic])
    have = np.diff(ends) > 0
    prior = float((toxic * worth).sum() / max(1.0, worth.sum()))
    scorer.bare = float(((toxic * worth)[~have].sum() + 2 * prior) / (worth[~have].sum() + 2)) if len(toxic) else 0.0
    rows = [(terms[a:b], weights[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    place = np.flatnonzero(have)
    place = place[in_blocks([rows[i] for i in place], len(scorer.words))]
    rows, worth = [rows[i] for i in place], worth[place]
    scorer.ids, scorer.toxic = ids[place], toxic[place]
    scorer.index = Index(rows, len(scorer.words))
    trimmed()
    if not len(rows):
        return scorer
    sent = spark.sparkContext.broadcast(scorer)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.index
        for batch in slices(batches):
            own = batch.column(0).to_pylist()
            near = index.nearest_of([index.example(i) for i in own], sent.value.k, but=own)
            found = [(i, sent.value.vote(*pair)) for i, pair in zip(own, near, strict=True) if len(pair[0])]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.float64()), strict=True)], ["i", "vote"])

    parts = max(1, min(len(rows) // 512, spark.sparkContext.defaultParallelism))
    found = spark.range(0, len(rows), 1, parts).mapInArrow(votes, "i long, vote double").toArrow().sort_by("i")
    sent.destroy()
    kept = found["i"].to_numpy()
    if len(kept):
        scorer.ends, scorer.values = monotone(found["vote"].to_numpy(), scorer.toxic[kept], worth[kept])
    return scorer


def _scored(sent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SEARCHED):
            found = sent.value.scores(batch.column(2).to_pylist())
            scores = [s for s, _ in found]
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted", "evidence"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, evidence (ids of the nearest examples).

    Defined cases: null, empty and wordless texts, like all without a term, get the share of toxic examples among such,
    drawn towards the share among all; with no labels at all every score is 0; repeated rows are answered each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scored(sent), "doc_id long, held_out boolean, score double, predicted int, evidence array<long>")


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """docs without the rows that are predicted toxic; all columns stay as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SEARCHED):
            yield batch.filter(pa.array([s < 0.5 for s, _ in sent.value.scores(batch.column(at).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
