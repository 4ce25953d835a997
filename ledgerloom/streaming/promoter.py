"""Promotion and circuit breaking as stateful streams.

State is a row of counts for each key, plus the last `window` samples of an enabled route, packed as integers. Rows of a
micro-batch are taken in order of time; a sample that isn't strictly after its route's last transition is no evidence.
The number of samples seen since then is kept with the state, so a restarted query goes on at the same look.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.evidence import DEFAULTS, Tally, Thresholds, next_state, upper_tail, valid

TRANSITION = "tenant_id long, route_id string, ts timestamp, id long, n long, from_state string, to_state string, reason string"
STATE = "state string, since_us long, seen long, sums string, recent string"
SUMS = ("n", "d2", "dd4", "b", "c", "in_json2", "in_enc", "out_json2", "out_enc")
FIELDS = ("ab", "cb", "ac", "in_a", "in_b", "in_c", "out_a", "out_b", "out_c")


def _packed(r: dict) -> list[int]:
    return [int(r[f]) for f in FIELDS] + [-1 if pd.isna(r[f]) else int(r[f]) for f in ("ok_a", "ok_b")]


def _unpacked(values: Sequence[int]) -> dict:
    r = dict(zip((*FIELDS, "ok_a", "ok_b"), values, strict=True))
    return r | {f: None if r[f] < 0 else bool(r[f]) for f in ("ok_a", "ok_b")}


class Route:
    """What is known of a route."""

    def __init__(self, saved: tuple | None, start: str = "SHADOW"):
        state, self.since, self.seen, sums, recent = saved or (start, -1, 0, "[]", "[]")
        self.state, self.recent, self.tally = state, json.loads(recent), Tally()
        for name, v in zip(SUMS, json.loads(sums)):
            setattr(self.tally, name, v)

    def saved(self) -> tuple:
        return self.state, self.since, self.seen, json.dumps([getattr(self.tally, s) for s in SUMS]), json.dumps(self.recent)

    def take(self, r: dict, at: int, t: Thresholds, min_savings: float) -> tuple | None:
        """Adds a sample; (n, from, to, reason) if it brings a transition."""
        if at <= self.since or self.state not in ("SHADOW", "ENABLED"):
            return None
        self.seen += 1
        if self.state == "SHADOW":
            self.tally.add(r)
            tally = self.tally
        else:
            self.recent = [*self.recent[-t.window + 1 :], _packed(r)]
        if self.seen < t.n_min or (self.seen - t.n_min) % max(t.look_every, 1):
            return None
        if self.state == "ENABLED":
            tally = Tally(map(_unpacked, self.recent))
        to, reason = next_state(self.state, tally, t, min_savings)
        if to == self.state:
            return None
        out = (tally.n, self.state, to, reason)
        self.state, self.since, self.seen, self.tally, self.recent = to, at, 0, Tally(), []
        return out


def _tuples(batch: pd.DataFrame) -> Iterator[tuple[int, ...]]:
    """A batch's samples as packed integers; of a trigger's rows only these are held."""
    flags = [batch[f].map(lambda v: -1 if pd.isna(v) else int(v)) for f in ("ok_a", "ok_b")]
    return zip(*[batch[f].astype("int64") for f in FIELDS], *flags, strict=True)


#: Where routes start that have no state yet: (tenant, route) to state and the time, in microseconds, since when samples count.
Start = dict[tuple, tuple[str, int | None]]


def starts(resumed: DataFrame) -> Start:
    """From evidence.resumed(): a row for each route of a policy file."""
    micros = F.unix_micros(F.col("since").cast("timestamp")).alias("us")
    return {(r.tenant_id, r.route_id): (r.state, r.us) for r in resumed.select("tenant_id", "route_id", "state", micros).collect()}


def promotions(samples: DataFrame, t: Thresholds = DEFAULTS, min_savings: float = 0.15, start: Start | None = None) -> DataFrame:
    """Transitions of each (tenant_id, route_id) of a stream of samples; append mode.

    A trigger's rows of a route are put in order in memory, a few numbers each, so give the source maxFilesPerTrigger.
    start: states after a restart without a checkpoint; other routes begin in SHADOW."""

    def first(*key) -> tuple | None:
        found = (start or {}).get(key)
        return found and (found[0], -1 if found[1] is None else found[1], 0, "[]", "[]")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        route, out = Route(state.get if state.exists else first(*key)), []
        rows = sorted((ts.value // 1000, i, values) for batch in batches for ts, i, values in zip(batch["ts"], batch["id"], _tuples(batch), strict=True))
        for at, i, values in rows:
            if found := route.take(_unpacked(values), at, t, min_savings):
                out.append((*key, pd.Timestamp(at * 1000), i, *found))
        state.update(route.saved())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITION.split(", ")])

    grouped = valid(samples).groupBy("tenant_id", "route_id")
    return grouped.applyInPandasWithState(run, TRANSITION, STATE, "append", GroupStateTimeout.NoTimeout)


TRIP = "tenant_id long, route_id string, model string, ts timestamp, id long, enc_n long, enc_fail long, p0 double"


def trips(exchanges: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Each time that a key's breaker trips; counts of encoded calls begin anew then, the baseline stays."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        enc_n, enc_fail, base_n, base_fail = state.get if state.exists else (0, 0, 0, 0)
        out, rows = [], []
        for batch in batches:
            fell, ok = batch["fell_back"].astype(bool), batch["tier1_ok"].map(lambda v: pd.isna(v) or bool(v))
            rows += zip(batch["ts"], batch["id"], fell | (batch["sent"] == "encoded"), fell | ~ok, strict=True)
        for ts, i, encoded, failed in sorted(rows):
            if not encoded:
                base_n, base_fail = base_n + 1, base_fail + bool(failed)
                continue
            enc_n, enc_fail = enc_n + 1, enc_fail + bool(failed)
            p0 = (base_fail + 1) / (base_n + 2)
            if enc_n >= t.prod_min and enc_fail / enc_n > p0 + t.epsilon and upper_tail(enc_fail, enc_n, p0) < t.alpha:
                out.append((*key, ts, i, enc_n, enc_fail, p0))
                enc_n = enc_fail = 0
        state.update((enc_n, enc_fail, base_n, base_fail))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRIP.split(", ")])

    grouped = exchanges.select("tenant_id", "route_id", "model", "ts", "id", "fell_back", "sent", "tier1_ok").groupBy("tenant_id", "route_id", "model")
    return grouped.applyInPandasWithState(run, TRIP, "enc_n long, enc_fail long, base_n long, base_fail long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(exchanges: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Requests and fallbacks of each route in windows of event time; late rows are waited for so long."""
    return (
        exchanges.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "route_id")
        .agg(F.count("*").alias("requests"), F.count_if("fell_back").alias("fallbacks")).select("w.start", "w.end", "route_id", "requests", "fallbacks")
    )
