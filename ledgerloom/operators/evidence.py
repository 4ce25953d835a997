"""Evidence about a treatment from three-arm samples, and what follows from it.

A sample has arms A and C (plain) and B (encoded): booleans ab, cb, ac (which arms agree), token counts in_a … out_c,
latencies lat_a … lat_c and checks ok_a, ok_b (nullable). Sums stay integers (doubled or fourfold), so that they are
exact in any order; divisions come last.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    n_min: int = 200
    look_every: int = 100
    z: float = 2.5
    epsilon: float = 0.02
    alpha: float = 0.05
    window: int = 400
    max_samples: int = 4000
    prod_min: int = 50


DEFAULTS = Thresholds()


def whole(c: Column) -> Column:
    return c.cast("long")


def terms() -> dict[str, Column]:
    """What each sample adds to the sums."""
    ab, cb, ac = (whole(F.col(x)) for x in ("ab", "cb", "ac"))
    both = F.col("ok_a").isNotNull() & F.col("ok_b").isNotNull()
    return {
        "t2": ab + cb,
        "c1": ac,
        "d2": ab + cb - 2 * ac,
        "dd4": (ab + cb - 2 * ac) * (ab + cb - 2 * ac),
        "in_json2": F.col("in_a") + F.col("in_c"),
        "in_enc": F.col("in_b"),
        "out_json2": F.col("out_a") + F.col("out_c"),
        "out_enc": F.col("out_b"),
        "b": whole(both & F.col("ok_a") & ~F.col("ok_b")),
        "c": whole(both & ~F.col("ok_a") & F.col("ok_b")),
    }


def ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over.cast("double") / under.cast("double")).otherwise(F.lit(0.0))


def latency_ratio() -> Column:
    a, b, c = (F.col(f"lat_{x}") for x in "abc")
    return F.when((a > 0) & (b > 0) & (c > 0), b.cast("double") * 2.0 / (a + c).cast("double"))


def upper_medians(rows: DataFrame, keys: Sequence[str], value: Column, name: str) -> DataFrame:
    """Per key the value at half the number of values when sorted (the upper one of two middles).

    Equal values are counted first, so a key's values are never gathered: a running count over the distinct ones finds it.
    """
    counts = rows.select(*keys, value.alias(name)).where(F.col(name).isNotNull()).groupBy(*keys, name).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.select(*keys, name, "_c", upto.alias("_upto"), F.floor(F.sum("_c").over(w) / 2).alias("_half"))
    return ranked.where((F.col("_upto") > F.col("_half")) & (F.col("_upto") - F.col("_c") <= F.col("_half"))).select(*keys, name)


def valid(samples: DataFrame) -> DataFrame:
    """Paired samples without an error whose agreements are all known."""
    fine = [F.coalesce(F.col(f"err_{x}"), F.lit("")) == "" for x in "abc"]
    known = F.col("ab").isNotNull() & F.col("cb").isNotNull() & F.col("ac").isNotNull()
    return samples.where((F.col("kind") == "PAIRED") & fine[0] & fine[1] & fine[2] & known)


def sums(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of valid samples by keys: one partial aggregate per task, one row per key."""
    return samples.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in terms().items()])


def by_day(ts: str = "ts") -> Column:
    """The day of a sample; those without a time come first."""
    return F.coalesce(F.date_trunc("day", F.col(ts)), F.lit("0001-01-01").cast("timestamp"))


def running(samples: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int | None = None, piece: Column | None = None) -> DataFrame:
    """Each sample with the sums up to it, or over the last `rows` samples: the sums up to it less those up to `rows` before.

    A sample is added once, however wide the window. piece: a column that rises with the order (by_day() unless given); a
    key is summed piece by piece, and each piece begins with the sums of those before it, so that a key of very many
    samples is no single task. The sums `rows` before are met by the sample's number."""
    piece = by_day(order[0]) if piece is None else piece
    names = ["n", *terms()]
    dealt = samples.select("*", *[c.alias(f"_{name}") for name, c in terms().items()], F.lit(1).cast("long").alias("_n"), piece.alias("_piece"))
    upto = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = dealt.select(*samples.columns, "_piece", *[F.sum(f"_{c}").over(upto).alias(f"_{c}") for c in names])
    totals = dealt.groupBy(*keys, "_piece").agg(*[F.sum(f"_{c}").alias(c) for c in names])
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select(*keys, "_piece", *[F.coalesce(F.sum(c).over(earlier), F.lit(0).cast("long")).alias(f"_{c}_before") for c in names])
    summed = within.join(start, [*keys, "_piece"]).select(*samples.columns, *[(F.col(f"_{c}") + F.col(f"_{c}_before")).alias(c) for c in names])
    if rows is None:
        return summed
    gone = summed.select(*keys, (F.col("n") + rows).alias("n"), *[F.col(c).alias(f"_{c}") for c in names[1:]])
    met = summed.join(gone, [*keys, "n"], "left")
    return met.select(*samples.columns, F.least("n", F.lit(rows).cast("long")).alias("n"), *[(F.col(c) - F.coalesce(f"_{c}", F.lit(0).cast("long"))).alias(c) for c in names[1:]])


def stats(price_ratio: float = 4.0, z: float = DEFAULTS.z) -> list[Column]:
    """Means, standard error, bounds and savings from the sums."""
    n = F.col("n").cast("double")
    diff = F.col("d2").cast("double") / 2.0 / n
    spread = F.greatest(F.col("dd4").cast("double") / 4.0 / n - diff * diff, F.lit(0.0))
    se = F.greatest(F.sqrt(spread / n), F.lit(1.0) / n)
    in_json, out_json = F.col("in_json2").cast("double") / 2.0, F.col("out_json2").cast("double") / 2.0
    cost = lambda i, o: i + F.lit(price_ratio) * o
    return [
        (F.col("t2").cast("double") / 2.0 / n).alias("agree_treatment"),
        (F.col("c1").cast("double") / n).alias("agree_control"),
        diff.alias("diff"),
        se.alias("se"),
        (diff - F.lit(z) * se).alias("lo"),
        (diff + F.lit(z) * se).alias("hi"),
        F.when(in_json > 0, 1.0 - F.col("in_enc").cast("double") / in_json).otherwise(F.lit(0.0)).alias("input_savings"),
        F.when(out_json > 0, F.col("out_enc").cast("double") / out_json - 1.0).otherwise(F.lit(0.0)).alias("output_change"),
        F.when(cost(in_json, out_json) > 0, 1.0 - cost(F.col("in_enc").cast("double"), F.col("out_enc").cast("double")) / cost(in_json, out_json)).otherwise(F.lit(0.0)).alias("measured_savings"),
    ]


def evidence(samples: DataFrame, keys: Sequence[str], last: int | None = None, order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Statistics by keys of all valid samples, or of the last ones in order."""
    rows = valid(samples)
    if last is not None:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        rows = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= last).drop("_rn")
    middle = upper_medians(rows, keys, latency_ratio(), "latency_ratio")
    found = sums(rows, keys).join(middle, list(keys), "left")
    return found.select(*keys, "n", "b", "c", *stats(), F.coalesce("latency_ratio", F.lit(0.0)).alias("latency_ratio"))


# Exact tests, without lgamma, which Spark lacks.

#: Up to here factorials are a table; beyond, Stirling's series to 1 / n^5 is off by less than 1e-14.
TABLED = 256


def log_factorial(n: Column) -> Column:
    table = F.lit(np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, TABLED)))]))
    x = n.cast("double")
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    far = (x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series
    return F.when(n < TABLED, F.get(table, F.greatest(n, F.lit(0)).cast("int"))).otherwise(far)


def _terms(first: Column, n: Column, p: Column, up: bool) -> Column:
    """Sum of binomial probabilities from first to n, or down to 0, each term from the one before. Away from the middle
    terms shrink, so the first is the largest and doesn't vanish unless the sum does."""
    start = F.exp(log_factorial(n) - log_factorial(first) - log_factorial(n - first) + first.cast("double") * F.ln(p) + (n - first).cast("double") * F.ln(1 - p))
    zero = F.struct(start.alias("term"), start.alias("sum"))

    def step(a: Column, k: Column) -> Column:
        times = (n - k + 1).cast("double") / k.cast("double") * p / (1 - p) if up else (k + 1).cast("double") / (n - k).cast("double") * (1 - p) / p
        return F.struct((a["term"] * times).alias("term"), (a["sum"] + a["term"] * times).alias("sum"))

    none = F.array().cast("array<bigint>")
    rest = F.when(first < n, F.sequence(first + 1, n)).otherwise(none) if up else F.when(first > 0, F.sequence(first - 1, F.lit(0).cast("long"))).otherwise(none)
    return F.least(F.aggregate(rest, zero, step, lambda a: a["sum"]), F.lit(1.0))


def binomial_cdf(k: Column, n: Column, p: Column) -> Column:
    """Probability of k or fewer of n."""
    low = k.cast("double") <= n.cast("double") * p
    return F.when(k >= n, F.lit(1.0)).when(k < 0, F.lit(0.0)).when(low, _terms(k, n, p, False)).otherwise(1.0 - _terms(k + 1, n, p, True))


def binomial_upper_tail(k: Column, n: Column, p: Column) -> Column:
    """Probability of k or more of n."""
    high = k.cast("double") > n.cast("double") * p
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).when(high, _terms(k, n, p, True)).otherwise(1.0 - _terms(k - 1, n, p, False))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant pairs; 1 without any."""
    b, c = whole(b), whole(c)
    return F.when(b + c == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * binomial_cdf(F.least(b, c), b + c, F.lit(0.5))))


# Looks and states.


def look_index(n: Column, t: Thresholds = DEFAULTS) -> Column:
    every = max(t.look_every, 1)
    return F.when(n < t.n_min, F.lit(0).cast("long")).otherwise(F.floor((n - t.n_min) / F.lit(every)).cast("long") + 1)


def looks(samples: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "id"), t: Thresholds = DEFAULTS) -> DataFrame:
    """The cumulative statistics at each look: where the look index goes up."""
    rows = running(valid(samples), keys, order)
    at = rows.where((F.col("n") >= t.n_min) & ((F.col("n") - t.n_min) % max(t.look_every, 1) == 0))
    return at.select(*keys, *order, "n", look_index(F.col("n"), t).alias("look"), "b", "c", *stats(z=t.z))


def shadow_step(t: Thresholds = DEFAULTS, min_savings: float = 0.15) -> Column:
    """Next state and reason of a route in SHADOW from n, lo, hi, b, c, mcnemar_p, measured_savings; first match wins."""
    n, lo, hi = F.col("n"), F.col("lo"), F.col("hi")
    rules = [
        (n < t.n_min, "SHADOW", "collecting"),
        (hi < -t.epsilon, "OFF", "rejected"),
        ((F.col("mcnemar_p") <= t.alpha) & (F.col("b") > F.col("c")), "SHADOW", "Tier 1 regression"),
        ((lo > -t.epsilon) & (F.col("measured_savings") >= min_savings), "ENABLED", "promoted"),
        (lo > -t.epsilon, "SHADOW", "measured savings"),
        ((F.lit(t.max_samples) > 0) & (n >= t.max_samples), "OFF", "inconclusive"),
    ]
    return _cased(rules, "SHADOW", "straddle")


def enabled_step(t: Thresholds = DEFAULTS) -> Column:
    """Of a route in ENABLED, from its last samples."""
    rules = [
        ((F.col("n") >= t.n_min) & (F.col("hi") < -t.epsilon), "SHADOW", "demoted"),
        ((F.col("mcnemar_p") <= t.alpha) & (F.col("b") > F.col("c")), "SHADOW", "Tier 1 regression"),
    ]
    return _cased(rules, "ENABLED", "holding")


def _cased(rules: list[tuple[Column, str, str]], state: str, reason: str) -> Column:
    made = lambda s, r: F.struct(F.lit(s).alias("state"), F.lit(r).alias("reason"))
    out = made(state, reason)
    for when, s, r in reversed(rules):
        out = F.when(when, made(s, r)).otherwise(out)
    return out


def replay(samples: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "id"), t: Thresholds = DEFAULTS, min_savings: float = 0.15) -> DataFrame:
    """Per key the first look at which a route in SHADOW changes its state, else its last look."""
    rows = looks(samples, keys, order, t).withColumn("mcnemar_p", mcnemar(F.col("b"), F.col("c")))
    rows = rows.withColumn("next", shadow_step(t, min_savings)).select("*", "next.state", "next.reason").drop("next")
    first = F.when(F.col("state") != "SHADOW", F.col("look"))
    w = Window.partitionBy(*keys)
    picked = F.coalesce(F.min(first).over(w), F.max("look").over(w))
    return rows.withColumn("_at", picked).where(F.col("look") == F.col("_at")).drop("_at")


def since_last_transition(samples: DataFrame, transitions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Samples strictly after their key's last transition; keys without one keep all."""
    last = transitions.groupBy(*keys).agg(F.max("ts").alias("_since"))
    return samples.join(last, list(keys), "left").where(F.col("_since").isNull() | (F.col("ts") > F.col("_since"))).drop("_since")


def last_transition(transitions: DataFrame, policies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the last transition, kept if the policy of that very key has its version and starts in SHADOW or ENABLED."""
    rows = transitions.groupBy(*keys).agg(F.max_by(F.struct("to_state", "policy_version", "ts"), F.struct("ts", "id")).alias("t"))
    met = rows.join(policies, list(keys)).where((F.col("t.policy_version") == F.col("version")) & F.col("state").isin("SHADOW", "ENABLED"))
    return met.select(*keys, F.col("t.to_state").alias("restored"), F.col("t.ts").alias("since"))


def resumed(policies: DataFrame, transitions: DataFrame, keys: Sequence[str], states: Sequence[str] = ("OFF", "SHADOW", "ENABLED", "MANUAL")) -> DataFrame:
    """Each policy with the state its route starts in after a restart and since when evidence counts: those of its last
    transition if that was made under the policy's version and the file leaves the route in SHADOW or ENABLED, else the
    file's state and no time. Transitions name states by their place in `states`."""
    back = last_transition(transitions, policies, keys)
    named = F.element_at(F.array(*[F.lit(s) for s in states]), (F.col("restored") + 1).cast("int"))
    return policies.join(back.select(*keys, named.alias("_named"), "since"), list(keys), "left").select(
        *keys, "version", F.coalesce("_named", "state").alias("state"), F.col("_named").isNotNull().alias("restored"), "since"
    )


def last_shown(rows: DataFrame, keys: Sequence[str], order: Sequence[str], n: int = 5) -> DataFrame:
    """The last n rows of each key, newest first by place 1 to n, as reports list transitions."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def sampled(exchanges: DataFrame, drawn: Column) -> DataFrame:
    """Exchanges that shadow arms are run for: of a route in SHADOW or ENABLED, answered with 200, with a block that the
    gates let pass, and drawn below the route's rate (drawn: a number from 0 up to 1)."""
    wanted = F.col("state").isin("SHADOW", "ENABLED") & (F.col("status") == 200) & F.col("any_transform")
    return exchanges.where(wanted & (drawn < F.col("shadow_sample_rate")))

def breaker(exchanges: DataFrame, keys: Sequence[str], t: Thresholds = DEFAULTS) -> DataFrame:
    """Production circuit breaker: encoded attempts (sent = encoded or fell back) fail far more often than the others.

    exchanges: sent, fell_back, tier1_ok (nullable). The baseline is smoothed by one failure in two.
    """
    encoded = F.col("fell_back") | (F.col("sent") == "encoded")
    failed = F.col("fell_back") | ~F.coalesce(F.col("tier1_ok"), F.lit(True))
    counts = exchanges.groupBy(*keys).agg(
        F.count_if(encoded).alias("enc_n"), F.count_if(encoded & failed).alias("enc_fail"), F.count_if(~encoded).alias("base_n"), F.count_if(~encoded & failed).alias("base_fail")
    )
    p0 = (F.col("base_fail") + 1).cast("double") / (F.col("base_n") + 2).cast("double")
    rows = counts.withColumn("p0", p0).withColumn("tail", binomial_upper_tail(F.col("enc_fail"), F.col("enc_n"), F.col("p0")))
    rate = F.col("enc_fail").cast("double") / F.greatest(F.col("enc_n"), F.lit(1)).cast("double")
    trips = (F.col("enc_n") >= t.prod_min) & (rate > F.col("p0") + t.epsilon) & (F.col("tail") < t.alpha)
    return rows.withColumn("trips", trips)


# The same rules on plain numbers, for state that is kept between rows.


def log_choose(n: int) -> np.ndarray:
    from math import lgamma

    return np.array([lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) for k in range(n + 1)])


def mcnemar_p(b: int, c: int) -> float:
    n = b + c
    if not n:
        return 1.0
    chances = np.exp(log_choose(n)[: min(b, c) + 1] - n * np.log(2.0))
    return float(min(1.0, 2 * chances.sum()))


def upper_tail(k: int, n: int, p: float) -> float:
    if k <= 0:
        return 1.0
    i = np.arange(k, n + 1)
    return float(min(1.0, np.exp(log_choose(n)[k:] + i * np.log(p) + (n - i) * np.log1p(-p)).sum())) if k <= n else 0.0


class Tally:
    """Sums of samples, added one at a time or taken from the last ones."""

    def __init__(self, rows: Sequence[dict] = (), price_ratio: float = 4.0):
        self.n = self.d2 = self.dd4 = self.b = self.c = 0
        self.in_json2 = self.in_enc = self.out_json2 = self.out_enc = 0
        self.price = price_ratio
        for r in rows:
            self.add(r)

    def add(self, r: dict) -> None:
        d = int(r["ab"]) + int(r["cb"]) - 2 * int(r["ac"])
        self.n, self.d2, self.dd4 = self.n + 1, self.d2 + d, self.dd4 + d * d
        self.in_json2 += int(r["in_a"] + r["in_c"])
        self.out_json2 += int(r["out_a"] + r["out_c"])
        self.in_enc, self.out_enc = self.in_enc + int(r["in_b"]), self.out_enc + int(r["out_b"])
        if not pd.isna(r["ok_a"]) and not pd.isna(r["ok_b"]):
            self.b += bool(r["ok_a"]) and not r["ok_b"]
            self.c += bool(r["ok_b"]) and not r["ok_a"]

    def bounds(self, z: float) -> tuple[float, float]:
        diff = self.d2 / 2 / self.n
        se = max((max(self.dd4 / 4 / self.n - diff * diff, 0) / self.n) ** 0.5, 1 / self.n)
        return diff - z * se, diff + z * se

    def savings(self) -> float:
        json = self.in_json2 / 2 + self.price * self.out_json2 / 2
        return 1 - (self.in_enc + self.price * self.out_enc) / json if json > 0 else 0.0


def next_state(state: str, tally: Tally, t: Thresholds = DEFAULTS, min_savings: float = 0.15) -> tuple[str, str]:
    """The rules of shadow_step and enabled_step."""
    if state == "SHADOW":
        if tally.n < t.n_min:
            return state, "collecting"
        lo, hi = tally.bounds(t.z)
        if hi < -t.epsilon:
            return "OFF", "rejected"
        if mcnemar_p(tally.b, tally.c) <= t.alpha and tally.b > tally.c:
            return state, "Tier 1 regression"
        if lo > -t.epsilon:
            return ("ENABLED", "promoted") if tally.savings() >= min_savings else (state, "measured savings")
        return ("OFF", "inconclusive") if 0 < t.max_samples <= tally.n else (state, "straddle")
    if state == "ENABLED":
        if tally.n >= t.n_min and tally.bounds(t.z)[1] < -t.epsilon:
            return "SHADOW", "demoted"
        if tally.n and mcnemar_p(tally.b, tally.c) <= t.alpha and tally.b > tally.c:
            return "SHADOW", "Tier 1 regression"
        return state, "holding"
    return state, "not evaluated"
