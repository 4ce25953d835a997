"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct shingles. Equal sets form classes; the smallest doc_id of a class stands for it.
A signature is `chunks` times `values` b-bit minimum hashes. Two signatures at distance d (values that differ) have, by
the pigeonhole principle, a chunk with at most d // chunks differing values; each chunk is indexed under every choice of
`errors` values left out, so all pairs with a distance under chunks * (errors + 1) meet in some bucket. With the defaults
(13 chunks of 6 values, 1 error) two sets with a similarity of 0.8 fail to meet with a chance of 1e-6; all candidates
are then confirmed on the full sets.

Buckets are never expanded into pairs. Each member is held against its bucket's smallest, the hub (a star); a hub's members
are dealt in blocks, and its set goes once to each block. Linked documents form components. Two members of a bucket share
its hub, so what is left to test are the members of a hub across components. They are dealt in blocks of bounded size by
their distance to the hub (1 - similarity is a metric, so members whose distances differ by more than the threshold can't
be linked); each pair of blocks near enough that holds such members meets once, and a task tests its members on their full
sets; it returns only links that join components. Pairs within a component need no test, so no link that could join two
components is lost. No key is dealt to one task: rows of hot keys stay where they are and meet a broadcast of fewer than
HOT rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap, place_of, test_bits
from .common import HOT, WORD_BYTES_RE, WORD_HASHES, bounded, hot_keys, hot_table, spread_join, stored, trimmed

CHUNKS, VALUES, ERRORS = 13, 6, 1
MIX = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 4096


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: words with A-Z in lower case, `width` at a time; of a text
    with fewer words the whole sequence; of one without words none."""
    words = WORD_BYTES_RE.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    out = h[: len(h) - width + 1]
    for k in range(1, width):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[k : len(h) - width + 1 + k]
    return np.unique(out)


class Signer:
    """Signatures of `chunks` x `values` minimum hashes of 16 bits each, and the keys of their buckets."""

    def __init__(self, chunks: int = CHUNKS, values: int = VALUES, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.shape = chunks, values
        self.times, self.plus = (draw.integers(0, 1 << 63, chunks * values, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
        self.weights = draw.integers(0, 1 << 63, (chunks, values), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = draw.integers(0, 1 << 63, (chunks, values), dtype=np.uint64)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.times), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(shingles), BLOCK):
            part = np.multiply.outer(self.times, shingles[at : at + BLOCK])
            part += self.plus[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return (least >> np.uint64(20)).astype(np.uint16)

    def keys(self, signatures: np.ndarray) -> np.ndarray:
        """Of n signatures, n x chunks * values keys: each chunk with each of its values left out."""
        terms = (signatures.reshape(-1, *self.shape).astype(np.uint64) + np.uint64(1)) * self.weights
        mixed = terms.sum(axis=2, keepdims=True) - terms
        mixed = (mixed ^ (mixed >> np.uint64(32))) * MIX + self.salts
        mixed ^= mixed >> np.uint64(29)
        return mixed.reshape(len(signatures), -1).view(np.int64)


SIGNER = Signer()


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, n_shingles, set_hash (null for an empty set), signature, row_no."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            sizes, hashes, signatures = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                hashes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(SIGNER.sign(s).tobytes() if len(s) else None)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "set_hash", "signature"])

    rows = _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature binary")
    return rows.withColumn("row_no", F.monotonically_increasing_id())


def _bucket_rows(reps: DataFrame) -> DataFrame:
    """Per class and key: key, node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                flat = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(part.num_rows, -1)
                keys = SIGNER.keys(flat)
                nodes = np.repeat(np.asarray(part.column(0)), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes)], ["key", "node"])

    return reps.select("node", "signature").mapInArrow(run, "key long, node long")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """Shingle sets of the documents that may be among nodes, by a bitmap of fixed size: node, shingles."""
    held = bitmap(nodes, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(test_bits(held.value, np.asarray(batch.column(2)))))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t.as_py(), width) for t in part.column(1)]
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["node", "shingles"])

    rows = _texts(docs).where(F.col("doc_id").isNotNull()).select("doc_id", "text", place_of(F.col("doc_id")).alias("place"))
    return rows.mapInArrow(run, "node long, shingles array<long>")


#: Members that a copy of their hub's set is sent for.
HUB_BLOCK = 512


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs (a, b) on their full sets: a, b, linked, apart (1 - similarity)."""
    counts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(HUB_BLOCK)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    dealt = spread_join(pairs, counts, "a", hot_keys(pairs, "a")).select("a", own.alias("block"), "b")
    members = dealt.join(sets.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "shingles")
    hubs = counts.join(sets.withColumnRenamed("node", "a"), "a")
    hubs = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "shingles")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []
        for batch in batches:
            lists = batch.column(3)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            out = []
            for k, (a, block, b) in enumerate(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                own = flat[ends[k] : ends[k + 1]]
                if hub != (a, block):
                    hub, held = (a, block), []
                if b is None:
                    held.append(own.copy())  # one, unless rows with other texts share its doc_id
                for of in held if b is not None else ():
                    at = np.searchsorted(of, own)
                    at[at == len(of)] = 0
                    both = int((of[at] == own).sum())
                    either = len(of) + len(own) - both
                    out.append((a, b, 100 * both >= percent * either, 1.0 - both / either))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("apart", pa.float64())])
    # A hub's set comes right before its members'; a task holds one such set at a time.
    met = hubs.unionByName(members).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return met.select("a", "block", "b", "shingles").mapInArrow(test, "a long, b long, linked boolean, apart double")


def components(links: DataFrame) -> DataFrame:
    """links (a, b): node, component (the smallest node reachable), by least labels of neighbours and label jumping."""
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    hot = hot_keys(both, "b")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("b"), "component"), "b", hot).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("nearest"))
        roots = labels.select(F.col("node").alias("nearest"), F.col("component").alias("_of"))
        moved = step.join(roots, "nearest").select("node", F.least("nearest", "_of").alias("component"), (F.least("nearest", "_of") < F.col("component")).alias("changed"))
        moved = stored(moved, "labels")
        labels = moved.select("node", "component")
        if not moved.where("changed").limit(1).count():
            return labels


BLOCK_BYTES = 6 << 20


def joining_links(part: pa.Table, lo: int, hi: int, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) across components among members (node, component, apart, block, shingles); of two blocks only those
    between them. Members of the largest component are only tested against."""
    nodes, names, apart, block = (part.column(c).to_numpy() for c in ("node", "component", "apart", "block"))
    lists = part.column("shingles").combine_chunks()
    flat = lists.flatten().to_numpy().view(np.uint64)  # as which they are sorted
    ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    sizes = np.diff(ends)
    _, home, counts = np.unique(names, return_inverse=True, return_counts=True)
    root = np.arange(len(counts))
    out = []
    small = np.argsort(counts[home], kind="stable")
    for x in small[home[small] != counts.argmax()]:
        own = flat[ends[x] : ends[x + 1]]
        mine = root[home]
        fits = (mine != mine[x]) & (np.abs(apart - apart[x]) <= 1 - percent / 100 + 1e-9)
        fits &= (100 * sizes >= percent * sizes[x]) & (100 * sizes[x] >= percent * sizes)
        if lo != hi:
            fits &= block != block[x]
        if not fits.any():
            continue
        others = np.flatnonzero(fits)
        starts = np.concatenate([[0], np.cumsum(sizes[others])])
        theirs = np.concatenate([flat[ends[y] : ends[y + 1]] for y in others])
        at = np.searchsorted(own, theirs)
        at[at == len(own)] = 0
        both = np.add.reduceat((own[at] == theirs).astype(np.int64), starts[:-1])
        for y in others[100 * both >= percent * (sizes[others] + sizes[x] - both)]:
            a, b = root[home[x]], root[home[y]]
            if a != b:
                root[root == a] = b
                out.append((int(min(nodes[x], nodes[y])), int(max(nodes[x], nodes[y]))))
    return out


#: Bands of distance to the hub that a block's members lie in.
BANDS = 10


def _left(tested: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components among the members of each hub: a, b."""
    named = lambda c: labels.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    hot = hot_keys(tested, "a")
    rows = spread_join(tested, named("a"), "a", hot, "left").join(named("b"), "b", "left")
    rows = rows.select("a", "b", "apart", F.coalesce("_a", "a").alias("_a"), F.coalesce("_b", "b").alias("_b"))
    hubs = rows.groupBy("a").agg(F.count("*").alias("n"), F.min(F.least("_a", "_b")).alias("x"), F.max(F.greatest("_a", "_b")).alias("y"))
    hubs = stored(hubs.where("n > 1 and x < y").select("a"), "hubs")
    members = spread_join(rows, hubs, "a", hot).select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("_b").alias("component"), "apart", (F.col("_a") != F.col("_b")).alias("minor")).distinct()
    # A kind is a band and whether its members lie outside the hub's component (minor). Members of that component, mostly
    # nearly all, need no test among themselves: their blocks meet those of minors only.
    kind = (F.floor(F.col("apart") * BANDS).cast("int") * 2 + F.col("minor").cast("int")).alias("kind")
    met = stored(members.join(sets, "node").withColumn("kind", kind), "members")
    size = F.size("shingles") * F.lit(8.0 / BLOCK_BYTES)
    sized = met.groupBy("hub", "kind").agg(F.ceil(F.sum(size)).cast("int").alias("blocks"))
    layout = sized.groupBy("hub").agg(F.collect_list(F.struct("kind", "blocks")).alias("kinds")).where(F.exists("kinds", lambda k: k["kind"] % 2 == 1))
    reach = int(np.ceil((100 - percent) * BANDS / 100 + 1e-6))
    near = lambda k: (F.abs(F.floor(k["kind"] / 2) - F.floor(F.col("kind") / 2)) <= reach) & ((F.col("kind") % 2 == 1) | (k["kind"] % 2 == 1))
    number = lambda kind, k: kind.cast("long") * F.lit(1 << 32) + k
    own = F.get(F.filter("kinds", lambda k: k["kind"] == F.col("kind")), F.lit(0))["blocks"]
    others = F.flatten(F.transform(F.filter("kinds", near), lambda k: F.transform(F.sequence(F.lit(0), k["blocks"] - 1), lambda i: number(k["kind"], i))))
    dealt = spread_join(met, layout, "hub", hot and hot.withColumnRenamed("a", "hub"))
    dealt = dealt.withColumn("block", number(F.col("kind"), F.pmod(F.xxhash64("node"), own))).withColumn("other", F.explode(others))
    pairs = dealt.select("hub", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "component", "apart", "shingles")

    def test(key: tuple, part: pa.Table) -> pa.Table:
        found = joining_links(part, key[1].as_py(), key[2].as_py(), percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return pairs.groupBy("hub", "lo", "hi").applyInArrow(test, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, row_no, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets; component_id is the smallest
    doc_id reachable. Defined cases: an empty set (null, empty or blank text) is linked with nothing; rows that share a
    doc_id are one node; a row without doc_id gets the component of the class of its text if a row with a doc_id is in
    it (else null) and isn't kept; ties go to the smallest doc_id; other columns are ignored.
    """
    bounded(docs.sparkSession)
    trimmed()
    rows = stored(sketch(docs, width), "sketches")
    sized = rows.where(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = sized.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.min_by("row_no", "doc_id").alias("row_no"))
    reps = stored(sized.select("row_no", "doc_id", "signature").join(classes, "row_no", "left_semi").withColumnRenamed("doc_id", "node"), "classes")
    spread = _bucket_rows(reps)
    shared = spread.groupBy("key").agg(F.count("*").alias("members"), F.min("node").alias("hub")).where("members > 1")
    shared = stored(shared, "buckets")
    hot = hot_table(shared.where(F.col("members") > max(1, reps.count() * CHUNKS * VALUES // HOT)), "key")
    star = spread_join(spread, shared.select("key", "hub"), "key", hot).where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    star = stored(star, "stars")
    nodes = star.select(F.col("a").alias("node")).unionByName(star.select(F.col("b").alias("node"))).distinct()
    sets = stored(_sets(docs, nodes, width), "sets")
    tested = stored(_confirmed(star, sets, percent).distinct(), "tested")
    links = tested.where("linked").select("a", "b")
    labels = components(links)
    more = stored(_left(tested, labels, sets, percent), "more-links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    found = classes.select("set_hash", "node").join(labels, "node", "left").select("set_hash", F.coalesce("component", "node").alias("_component"))
    sets_of = rows.where(F.col("set_hash").isNotNull())
    answered = spread_join(sets_of, found, "set_hash", hot_keys(sets_of, "set_hash"), "left")
    answered = answered.unionByName(rows.where(F.col("set_hash").isNull()).withColumn("_component", F.lit(None).cast("long")))
    whole = F.coalesce("_component", "doc_id")
    return answered.select("doc_id", "row_no", "n_shingles", whole.alias("component_id"), F.coalesce(F.col("doc_id") == whole, F.lit(False)).alias("kept"))


#: Two-word sets in SQL: pairs by common shingles, components by reachability.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w WHERE len(w) > 0
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id)
"""
