"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming import promoter
from .evidence_queries import CDF, EXCHANGES, REASON_SQL, STATE_SQL, TAIL
from .registry import query
from .samples import SAMPLES, VALID_CTE


def _stream(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # As a pattern, as a stream's plain path has to be a folder; the table may be a file.
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 64).parquet(f"{sf_dir}/event[s].parquet")
    return spark.sql(sql.replace("FROM events", "FROM {events}"), events=events)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share; only a driver that runs its tasks itself may leave it unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = "/tmp/ledgerloom-shared"
    return shared.rstrip("/")


def _finished(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    place = f"{shared_folder(spark)}/streams/{name}-{uuid.uuid4().hex}"
    run = out.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


def _next_sql(begin: str) -> str:
    """The statistics of the samples after row `begin` up to row rn, from running sums, and the state that follows."""
    names = ("d2", "dd4", "b", "c", "in_json2", "in_enc", "out_json2", "out_enc")
    diffs = ", ".join(f"p.{x} - coalesce(q.{x}, 0) AS {x}" for x in names)
    return f"""SELECT s.*, p.rn, p.ts AS at_ts, p.id AS at_id, p.rn - {begin} AS m, {diffs}"""


#: Each route's transitions one after another: from the last one's row on, the first look at which the state changes.
PROMOTIONS = f"""WITH RECURSIVE {VALID_CTE.strip()},
o AS (SELECT *, row_number() OVER w AS rn FROM v WINDOW w AS (PARTITION BY tenant_id, route_id ORDER BY ts, id)),
p AS (SELECT tenant_id, route_id, ts, id, rn, sum(d2) OVER w AS d2, sum(d2 * d2) OVER w AS dd4, sum(b1) OVER w AS b, sum(c0) OVER w AS c, sum(in_json2) OVER w AS in_json2, sum(in_b) OVER w AS in_enc, sum(out_json2) OVER w AS out_json2, sum(out_b) OVER w AS out_enc
  FROM o WINDOW w AS (PARTITION BY tenant_id, route_id ORDER BY rn)),
st AS (
  SELECT DISTINCT tenant_id, route_id, 'SHADOW' AS state, 0::BIGINT AS start, NULL::TIMESTAMP AS ts, NULL::BIGINT AS id, NULL::BIGINT AS n, NULL::VARCHAR AS from_state, NULL::VARCHAR AS reason FROM v
  UNION ALL
  SELECT tenant_id, route_id, w.state, w.start, w.ts, w.id, w.n, w.from_state, w.reason FROM (
    SELECT tenant_id, route_id, arg_min(struct_pack(state := state2, start := (SELECT count(*) FROM o x WHERE x.tenant_id = g.tenant_id AND x.route_id = g.route_id AND x.ts <= g.at_ts), ts := at_ts, id := at_id, n := m, from_state := from_state, reason := reason2), rn) AS w FROM (
      SELECT tenant_id, route_id, state AS from_state, rn, at_ts, at_id, m, {{state}} AS state2, {{reason}} AS reason2 FROM (
        SELECT *, CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * {CDF.format(k="least(b, c)::BIGINT", n="(b + c)::BIGINT", p="0.5::DOUBLE")}) END AS mcnemar_p FROM (
          SELECT *, d2 / 2.0::DOUBLE / m - 2.5::DOUBLE * se AS lo, d2 / 2.0::DOUBLE / m + 2.5::DOUBLE * se AS hi,
            1 - (in_enc + 4::DOUBLE * out_enc) / (in_json2 / 2.0::DOUBLE + 4::DOUBLE * (out_json2 / 2.0::DOUBLE)) AS measured_savings FROM (
            SELECT *, greatest(sqrt(greatest(dd4 / 4.0::DOUBLE / m - (d2 / 2.0::DOUBLE / m) * (d2 / 2.0::DOUBLE / m), 0::DOUBLE) / m), 1 / m::DOUBLE) AS se FROM (
              {_next_sql("greatest(s.start, CASE WHEN s.state = 'ENABLED' THEN p.rn - 400 ELSE 0 END)")}
              FROM st s JOIN p ON p.tenant_id = s.tenant_id AND p.route_id = s.route_id AND p.rn - s.start >= 200 AND (p.rn - s.start - 200) % 100 = 0
              LEFT JOIN p q ON q.tenant_id = p.tenant_id AND q.route_id = p.route_id AND q.rn = greatest(s.start, CASE WHEN s.state = 'ENABLED' THEN p.rn - 400 ELSE 0 END)
              WHERE s.state IN ('SHADOW', 'ENABLED'))))) ) g WHERE state2 <> from_state GROUP BY tenant_id, route_id)
)
SELECT tenant_id, route_id, ts, id, n, from_state, state AS to_state, reason FROM st WHERE from_state IS NOT NULL"""
_STATE = {
    "state": "CASE WHEN state = 'ENABLED' THEN CASE WHEN m >= 200 AND hi < -0.02 OR mcnemar_p <= 0.05 AND b > c THEN 'SHADOW' ELSE 'ENABLED' END ELSE " + STATE_SQL.replace("n <", "m <").replace("n >=", "m >=") + " END",
    "reason": "CASE WHEN state = 'ENABLED' THEN CASE WHEN m >= 200 AND hi < -0.02 THEN 'demoted' WHEN mcnemar_p <= 0.05 AND b > c THEN 'Tier 1 regression' ELSE 'holding' END ELSE " + REASON_SQL.replace("n <", "m <").replace("n >=", "m >=") + " END",
}


@query(PROMOTIONS.format(**_STATE))
def promoter_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, promoter.promotions(_stream(spark, sf_dir, SAMPLES)), "promoter")


#: Each key's trips one after another: counts of encoded calls since the last trip, of the others since the beginning.
TRIPS = f"""WITH RECURSIVE x AS ({EXCHANGES}),
o AS (SELECT *, fell_back OR sent = 'encoded' AS enc, fell_back OR NOT coalesce(tier1_ok, TRUE) AS bad, row_number() OVER (PARTITION BY tenant_id, route_id, model ORDER BY ts, id) AS rn FROM x),
p AS (SELECT tenant_id, route_id, model, ts, id, rn, enc, sum(enc::INT) OVER w AS en, sum((enc AND bad)::INT) OVER w AS ef, sum((NOT enc)::INT) OVER w AS bn, sum((NOT enc AND bad)::INT) OVER w AS bf FROM o
  WINDOW w AS (PARTITION BY tenant_id, route_id, model ORDER BY rn)),
st AS (
  SELECT DISTINCT tenant_id, route_id, model, 0::BIGINT AS start, 0::BIGINT AS en0, 0::BIGINT AS ef0, NULL::TIMESTAMP AS ts, NULL::BIGINT AS id, NULL::BIGINT AS enc_n, NULL::BIGINT AS enc_fail, NULL::DOUBLE AS p0 FROM x
  UNION ALL
  SELECT tenant_id, route_id, model, w.rn, w.en, w.ef, w.ts, w.id, w.enc_n, w.enc_fail, w.p0 FROM (
    SELECT tenant_id, route_id, model, arg_min(struct_pack(rn := rn, en := en, ef := ef, ts := at_ts, id := at_id, enc_n := enc_n, enc_fail := enc_fail, p0 := p0), rn) AS w FROM (
      SELECT * FROM (
        SELECT p.*, p.ts AS at_ts, p.id AS at_id, (p.en - s.en0)::BIGINT AS enc_n, (p.ef - s.ef0)::BIGINT AS enc_fail, (p.bf + 1)::DOUBLE / (p.bn + 2) AS p0
        FROM st s JOIN p ON p.tenant_id = s.tenant_id AND p.route_id = s.route_id AND p.model = s.model AND p.rn > s.start AND p.enc)
      WHERE CASE WHEN enc_n >= 50 AND enc_fail / enc_n::DOUBLE > p0 + 0.02 THEN {TAIL} < 0.05 ELSE FALSE END) GROUP BY ALL)
)
SELECT tenant_id, route_id, model, ts, id, enc_n, enc_fail, p0 FROM st WHERE ts IS NOT NULL"""


@query(TRIPS)
def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _finished(spark, promoter.trips(_stream(spark, sf_dir, EXCHANGES)), "breaker")


@query(
    f"""WITH x AS ({EXCHANGES}) SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS "end", route_id, count(*) AS requests, count_if(fell_back) AS fallbacks FROM x
    WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM x) - INTERVAL 2 HOUR GROUP BY ALL"""
)
def audit_windows_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that the watermark has closed."""
    return _finished(spark, promoter.windowed_counts(_stream(spark, sf_dir, EXCHANGES)), "windows")
