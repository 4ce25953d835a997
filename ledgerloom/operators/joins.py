"""Joins with a rule: policies with fallback, calibration by prefix, as-of, and the report that gathers all sources."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evidence import DEFAULTS, Thresholds, evidence, look_index

def with_policy(requests: DataFrame, policies: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Each request with the policy of its tenant and route, else of any tenant ("*"), else the defaults."""
    own = policies.select("tenant_id", "route_id", F.struct(*defaults).alias("_own"))
    every = policies.where(F.col("tenant_id") == "*").select("route_id", F.struct(*defaults).alias("_every"))
    met = requests.join(own, ["tenant_id", "route_id"], "left").join(every, "route_id", "left")
    # A policy is taken whole; only its empty settings have defaults.
    found = F.coalesce("_own", "_every")
    return met.select(*requests.columns, *[F.coalesce(found[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def with_factor(requests: DataFrame, factors: DataFrame) -> DataFrame:
    """Each request (model, kind) with its calibration factor: of model and kind, of the model, of the longest prefix of
    the model, or 1. Prefixes are met by equality on each distinct model's beginnings, so nothing is compared in pairs."""
    exact = factors.where(F.col("kind") != "").select("model", "kind", F.col("factor").alias("_exact"))
    plain = factors.where(F.col("kind") == "").select("model", F.col("factor").alias("_plain"))
    models = requests.select("model").distinct()
    starts = models.select("model", F.explode(F.sequence(F.lit(0), F.length("model"))).alias("n")).select("model", F.substring("model", F.lit(1), F.col("n")).alias("start"), "n")
    longest = starts.join(plain.withColumnRenamed("model", "start"), "start").groupBy("model").agg(F.max_by("_plain", "n").alias("_prefix"))
    met = requests.join(exact, ["model", "kind"], "left").join(plain, "model", "left").join(longest, "model", "left")
    return met.select(*requests.columns, F.coalesce("_exact", "_plain", "_prefix", F.lit(1.0)).alias("factor"))


#: What is left of a ratio's weight is nothing beside a sum in double precision.
FADED = 1e-20


def ewma(seen: DataFrame, keys: Sequence[str], order: Sequence[str], alpha: float = 0.1) -> DataFrame:
    """Per key the running estimate after all ratios above 0 in order; the first replaces the initial value.

    The last of n ratios weighs alpha, each one before it 1 - alpha as much, and the first the rest, so a sum of weighted
    ratios by their place from the end does for the fold. Places whose weight has faded below a double's precision add
    nothing, so tasks pass on only the last ones."""
    rows = seen.where(F.col("ratio") > 0)
    last = int(math.log(FADED) / math.log1p(-alpha)) + 1 if 0 < alpha < 1 else 1
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    kept = rows.withColumn("_k", place).where(F.col("_k") <= last).select(*keys, "ratio", "_k")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    fade = F.pow(F.lit(1 - alpha), (F.col("_k") - 1).cast("double"))
    weight = F.when(F.col("_k") == F.col("n"), fade).otherwise(F.lit(alpha) * fade)
    met = kept.join(counts, list(keys))
    return met.groupBy(*keys).agg(F.sum(weight * F.col("ratio")).alias("factor"), F.first("n").alias("n"))


DUE = "model string, ts timestamp, id long"


def due(observed: DataFrame, interval_seconds: int = 900) -> DataFrame:
    """Which observations (model, ts, id) are calibrated: a model's first, then each that comes `interval_seconds` or more
    after the last one taken. What is taken depends on what was, so a model's rows are read in order, one at a time."""
    import pyarrow as pa

    def take(batches):
        model, last = None, None
        for batch in batches:
            keep = []
            for name, us in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.int64()).to_pylist(), strict=True):
                taken = name != model or us - last >= interval_seconds * 1_000_000
                model, last = (name, us) if taken else (model, last)
                keep.append(taken)
            yield batch.filter(pa.array(keep, pa.bool_()))

    rows = observed.select("model", F.col("ts").cast("timestamp").alias("ts"), F.col("id").cast("long").alias("id"))
    return rows.repartition("model").sortWithinPartitions("model", "ts", "id").mapInArrow(take, DUE)


def observed_ratios(counts: DataFrame) -> DataFrame:
    """What calibration learns from logged counts (model, codec, order columns, one_token: a message of one token, json and
    enc: messages of a payload's two forms, raw_json and raw_enc: the estimates): the model's overhead is that of its first
    count, and each count gives three ratios, of the model and json, of the model and the codec, and of the model alone."""
    first = F.first("one_token").over(Window.partitionBy("model").orderBy("ts", "id")) - 1
    rows = counts.withColumn("_base", first)
    ratio = lambda n, raw: (F.col(n) - F.col("_base")).cast("double") / F.nullif(F.col(raw), F.lit(0)).cast("double")
    made = [("json", ratio("json", "raw_json")), (F.col("codec"), ratio("enc", "raw_enc")), ("", ratio("json", "raw_json"))]
    each = F.explode(F.array(*[F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), r.alias("ratio")) for k, r in made]))
    return rows.select("model", "ts", "id", each.alias("x")).select("model", "x.kind", "ts", "id", "x.ratio")


def last_before(rows: DataFrame, events: DataFrame, keys: Sequence[str], at: str, value: str) -> DataFrame:
    """As-of: each row with the value of its key's last event strictly before it, or null. One window over both."""
    both = rows.withColumn("_v", F.lit(None).cast(dict(events.dtypes)[value])).withColumn("_row", F.lit(True))
    other = events.select(*keys, at, F.col(value).alias("_v")).withColumn("_row", F.lit(False))
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    met = both.unionByName(other, allowMissingColumns=True).withColumn(value, F.last("_v", ignorenulls=True).over(w))
    return met.where("_row").select(*rows.columns, value)


def ok_status() -> Column:
    return (F.col("status") >= 200) & (F.col("status") <= 299)


def audit_summary(entries: DataFrame, keys: Sequence[str], gates: Sequence[str] = ("min-size", "structural", "net-savings")) -> DataFrame:
    """Counts, tokens and mean savings of requests by keys."""
    encoded = F.col("sent") == "encoded"
    mean = F.sum(F.when(encoded, F.col("savings_pct"))).cast("double") / F.nullif(F.count_if(encoded), F.lit(0)).cast("double") / 100.0
    return entries.groupBy(*keys).agg(
        F.count("*").alias("requests"),
        F.count_if(encoded).alias("encoded"),
        F.count_if("fell_back").alias("fallbacks"),
        F.count_if(~ok_status()).alias("errors"),
        F.count_if(~F.col("tier1_ok")).alias("tier1_failed"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        *[F.count_if(F.col("failed_gate") == g).alias(f"gate_{g.replace('-', '_')}") for g in gates],
        F.round(F.coalesce(mean, F.lit(0.0)), 9).alias("mean_savings"),
    )


def audited(entries: DataFrame, drawn: Column) -> DataFrame:
    """Entries that are always logged (fallbacks, parse errors, failed checks) and those drawn."""
    return entries.where(F.col("fell_back") | F.col("parse_error") | ~F.coalesce(F.col("tier1_ok"), F.lit(True)) | drawn)


def counters(entries: DataFrame, tags: Sequence[str], measure: str, width: int, last: int) -> DataFrame:
    """Requests and a measure's sum by tags and by its histogram bucket."""
    bucket = F.least(F.floor(F.col(measure) / F.lit(width)), F.lit(last)).cast("long").alias("bucket")
    return entries.groupBy(*tags, bucket).agg(F.count("*").alias("requests"), F.sum(measure).cast("long").alias(measure))


def route_report(policies: DataFrame, transitions: DataFrame, samples: DataFrame, entries: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """A row for each route that any source names, by tenant and route."""
    keys = ["tenant_id", "route_id"]
    sources = [df.select(*keys) for df in (policies, transitions, samples, entries)]
    named = sources[0].unionByName(sources[1]).unionByName(sources[2]).unionByName(sources[3]).distinct()
    counted = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    found = evidence(samples, keys).select(*keys, "n", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"))
    audit = entries.groupBy(*keys).agg(F.count("*").alias("requests"), F.count_if(~ok_status()).alias("errors"))
    rows = named.join(policies.select(*keys, "state"), keys, "left")
    for side in (counted(samples, "samples"), found, counted(transitions, "transitions"), audit):
        rows = rows.join(side, keys, "left")
    look = F.lit(t.n_min).cast("long") + t.look_every * look_index(F.coalesce("n", F.lit(0).cast("long")), t)
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select(
        *keys, F.coalesce("state", F.lit("not in policy file")).alias("state"), none("samples"), "n", "lo", "hi",
        F.when(F.col("state") == "SHADOW", look).alias("next_look"), none("transitions"), none("requests"), none("errors"),
    ).orderBy(*keys)
