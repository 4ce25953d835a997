"""Membership by a bitmap of fixed size.

A bitmap has 2**BITS bits (2 MB) whatever the number of ids; an id sets the bit of its hash. It tells most rows that
cannot be members from those that may be, without moving them; the rest go through an exact join. With many more ids
than bits it lets everything through and the exact join alone decides.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def place_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITS)).cast("int")


def bitmap(ids: DataFrame, name: str, place: Column | None = None) -> Broadcast:
    """Of a column of ids: at most 2**BITS / 32 words come to the driver, each made by partial aggregates. place: of an id,
    below 2**BITS, where it isn't place_of()."""
    place = place_of(F.col(name)) if place is None else place
    words = (
        ids.select(F.shiftright(place, 5).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(32))).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return ids.sparkSession.sparkContext.broadcast(out)


def test_bits(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (words[places >> 5] >> (places & 31).astype(np.uint32)) & 1 == 1


def may_hold(found: Broadcast, key: Column) -> Column:
    """Whether an id may be a member; null for null ids."""

    @F.pandas_udf("boolean")
    def held(places: pd.Series) -> pd.Series:
        return pd.Series(test_bits(found.value, places.to_numpy()))

    return F.when(key.isNotNull(), held(place_of(key)))


def without(rows: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """rows whose id isn't among ids: rows that the bitmap clears stay where they are, the rest meet in a join."""
    marked = rows.withColumn("_may", F.coalesce(may_hold(bitmap(ids, name), F.col(name)), F.lit(False)))
    clear, rest = marked.where(~F.col("_may")).drop("_may"), marked.where(F.col("_may")).drop("_may")
    return clear.unionByName(rest.join(ids.select(name).distinct(), name, "left_anti").select(*rows.columns))
