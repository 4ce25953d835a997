"""Sharding by vector bin packing.

Groups (equal texts) are vectors of bytes, words and rows. Groups of under a small share of a shard are bundled by a
hash of their text, so that what the driver packs is bounded; larger groups stand alone. A group above an even share of a
shard in some dimension can't stay whole in balanced shards; it is split by a hash of its rows in parts of about
1 / `parts_of_share` of a shard. Bundles are taken from the largest down and each goes, among the shards with room for it
in all dimensions (among all where there is none), to the one where the dot product of its vector with the residual
capacity is highest. Swaps between the shards of the most and the fewest bytes then even out all dimensions, bytes first
(law `bytes`).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

DIMENSIONS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each vector (bundles x dimensions); capacity is an even share of each dimension."""
    share = np.maximum(vectors.sum(axis=0) / shards, 1e-9)
    scaled = vectors / share
    order = np.lexsort((np.arange(len(vectors)), -scaled.max(axis=1)))
    residual, out = np.ones((shards, vectors.shape[1])), np.zeros(len(vectors), np.int64)
    for i in order:
        fits = (residual >= scaled[i] - 1e-12).all(axis=1)
        gain = residual @ scaled[i]
        if fits.any():
            gain[~fits] = -np.inf
        out[i] = best = int(np.argmax(gain))
        residual[best] -= scaled[i]
    return _evened(scaled, out, shards)


#: What a difference in bytes weighs beside one in words or rows.
FIRST = 20.0
NEAR = np.arange(-2, 3)


def _evened(scaled: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    """Moves or swaps bundles between the shards of the most and the fewest bytes as long as the weighted sum of their
    differences in all dimensions shrinks; of a bundle's partners those of the nearest sizes are tried."""
    weights = np.ones(scaled.shape[1])
    weights[0] = FIRST
    total = np.stack([np.bincount(at, scaled[:, d], shards) for d in range(scaled.shape[1])], axis=1)
    scaled = np.vstack([scaled, np.zeros(scaled.shape[1])])
    while True:
        a, b = int(total[:, 0].argmax()), int(total[:, 0].argmin())
        apart = total[a] - total[b]
        mine, theirs = np.flatnonzero(at == a), np.flatnonzero(at == b)
        # The last row of scaled is nothing: to swap with it is to move.
        theirs = np.concatenate([[len(scaled) - 1], theirs[np.argsort(scaled[theirs, 0], kind="stable")]])
        k = np.searchsorted(scaled[theirs, 0], scaled[mine, 0] - apart[0] / 2)
        partner = theirs[np.clip(k[:, None] + NEAR, 0, len(theirs) - 1)]
        moved = scaled[mine][:, None] - scaled[partner]
        after = np.abs(apart - 2 * moved) @ weights
        if not after.size or after.min() >= np.abs(apart) @ weights - 1e-9:
            return at
        i, j = np.unravel_index(after.argmin(), after.shape)
        at[mine[i]] = b
        if partner[i, j] < len(at):
            at[partner[i, j]] = a
        total[a] -= moved[i, j]
        total[b] += moved[i, j]


def shard(docs: DataFrame, shards: int = 16, bundles: int = 8192, parts_of_share: int = 2) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Texts are read once, into a table of their sizes. Bundles, at most `bundles` of small groups and as many again of
    large ones and their parts, come to the driver with their sums; slots are a bundle's first slot in its shard plus
    the row's place in the bundle, so no window is larger than a bundle.

    Defined cases: a null text has size 1, like an empty one; rows without doc_id are placed like others; repeated rows
    are rows of one group; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("text_hash"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"),
        ).withColumn("row_no", F.monotonically_increasing_id()),
        "shard-rows",
    )
    total = rows.agg(F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not total.rows:
        none = [F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")]
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), *none)
    # Groups that hold over 1 / bundles of some dimension: at most bundles of them for each dimension.
    vector = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    heavy = [F.col(d) > F.lit(total[d] / bundles) for d in DIMENSIONS]
    groups = rows.groupBy("text_hash", "text_crc32").agg(*vector).where(heavy[0] | heavy[1] | heavy[2])
    shares = F.greatest(*[F.col(d) / F.lit(max(1.0, total[d] / shards)) for d in DIMENSIONS])
    large = groups.select(
        "text_hash",
        "text_crc32",
        F.when(shares > 1, F.ceil(shares * parts_of_share)).otherwise(F.lit(1)).cast("long").alias("parts"),
        F.ceil(shares * (bundles / shards)).cast("long").alias("pieces"),
    )
    # What is placed as one: a group, or a part of it. What is numbered as one: a piece of that, about 1 / bundles of all.
    part, piece = F.pmod(F.xxhash64("row_no"), "parts"), F.pmod(F.xxhash64("row_no", F.lit(1)), "pieces")
    few = F.pmod("text_hash", F.lit(bundles))
    unit = F.when(F.col("parts").isNull(), few).otherwise(F.xxhash64("text_hash", "text_crc32", part))
    bundle = F.when(F.col("parts").isNull(), few).otherwise(F.xxhash64("text_hash", "text_crc32", part, piece))
    # large has at most 3 * bundles rows of 32 bytes, whatever the input.
    named = rows.join(F.broadcast(large), ["text_hash", "text_crc32"], "left").select("doc_id", "size", "text_crc32", "tokens", "row_no", unit.alias("unit"), bundle.alias("bundle"))
    sums = named.groupBy("unit", "bundle").agg(*vector).orderBy("unit", "bundle").toPandas()
    units = sums.groupby("unit", as_index=False)[list(DIMENSIONS)].sum()
    units["shard"] = place(units[list(DIMENSIONS)].to_numpy(np.float64), shards)
    sums = sums.merge(units[["unit", "shard"]], on="unit")
    sums["first"] = sums.groupby("shard")["rows"].cumsum() - sums["rows"]
    plan = spark.createDataFrame(sums[["bundle", "shard", "first"]], "bundle long, shard int, first long")
    within = Window.partitionBy("bundle").orderBy("row_no")
    return named.join(F.broadcast(plan), "bundle").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first") + F.row_number().over(within) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
