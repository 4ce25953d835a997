"""Evidence, looks, states, breakers and transitions over samples derived from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import joins
from .registry import derived, query
from .samples import MORE, SAMPLES, STATS, VALID_CTE

KEYS = ("tenant_id", "route_id")
SUMS = "count(*) AS n, sum(t2) AS t2, sum(c1) AS c1, sum(d2) AS d2, sum(d2 * d2) AS dd4, sum(in_json2) AS in_json2, sum(in_b) AS in_enc, sum(out_json2) AS out_json2, sum(out_b) AS out_enc, sum(b1) AS b, sum(c0) AS c"
OVER = SUMS.replace(") AS", ") OVER w AS")
ROUNDED = ("agree_treatment", "agree_control", "diff", "se", "lo", "hi", "input_savings", "output_change", "measured_savings")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, SAMPLES, "events")


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in ROUNDED if c in df.columns})


def _stats_sql(source: str, columns: str) -> str:
    """Statistics rounded to nine places over a CTE's sums."""
    shown = ", ".join(f"round({c}, 9) AS {c}" for c in ROUNDED)
    return f"SELECT {columns}, {shown} FROM (SELECT *, {MORE} FROM (SELECT *, {STATS} FROM {source}))"


@query(
    f"WITH {VALID_CTE}, s AS (SELECT tenant_id, route_id, {SUMS}, list_sort(list(lat) FILTER (lat IS NOT NULL)) AS l FROM v GROUP BY ALL)"
    + _stats_sql("s", "tenant_id, route_id, n, b, c, round(coalesce(l[len(l) // 2 + 1], 0), 9) AS latency_ratio")
)
def evidence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.evidence(samples(spark, sf_dir), KEYS)).withColumn("latency_ratio", F.round("latency_ratio", 9))


@query(
    f"""WITH {VALID_CTE}, l AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, route_id ORDER BY ts DESC, id DESC) AS rn FROM v),
    s AS (SELECT tenant_id, route_id, {SUMS}, list_sort(list(lat) FILTER (lat IS NOT NULL)) AS l FROM l WHERE rn <= 400 GROUP BY ALL)"""
    + _stats_sql("s", "tenant_id, route_id, n, b, c, round(coalesce(l[len(l) // 2 + 1], 0), 9) AS latency_ratio")
)
def evidence_last_400(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.evidence(samples(spark, sf_dir), KEYS, last=400)).withColumn("latency_ratio", F.round("latency_ratio", 9))


@query(
    f"""WITH {VALID_CTE}, s AS (SELECT tenant_id, route_id, id, {OVER} FROM v
    WINDOW w AS (PARTITION BY tenant_id, route_id ORDER BY ts, id ROWS BETWEEN 399 PRECEDING AND CURRENT ROW))"""
    + _stats_sql("s", "tenant_id, route_id, id, n, b, c")
)
def rolling_window_400(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.running(E.valid(samples(spark, sf_dir)), KEYS, ("ts", "id"), 400)
    return rounded(rows.select(*KEYS, "id", "n", "b", "c", *E.stats()))


LOOKS = f"""WITH {VALID_CTE}, r AS (SELECT tenant_id, route_id, ts, id, {OVER} FROM v
    WINDOW w AS (PARTITION BY tenant_id, route_id ORDER BY ts, id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, (n - 200) // 100 + 1 AS look FROM r WHERE n >= 200 AND (n - 200) % 100 = 0)"""


@query(LOOKS + _stats_sql("s", "tenant_id, route_id, id, n, look, b, c"))
def look_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.looks(samples(spark, sf_dir), KEYS).drop("ts"))


CDF = "list_sum(list_transform(range(0, {k} + 1), lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) + i * ln({p}) + ({n} - i) * ln(1 - {p}))))"
P_SQL = f"CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * {CDF.format(k='least(b, c)::BIGINT', n='(b + c)::BIGINT', p='0.5::DOUBLE')}) END"
STATE_SQL = """CASE WHEN n < 200 THEN 'SHADOW' WHEN hi < -0.02 THEN 'OFF' WHEN mcnemar_p <= 0.05 AND b > c THEN 'SHADOW'
 WHEN lo > -0.02 AND measured_savings >= 0.15 THEN 'ENABLED' WHEN lo > -0.02 THEN 'SHADOW' WHEN n >= 4000 THEN 'OFF' ELSE 'SHADOW' END"""
REASON_SQL = """CASE WHEN n < 200 THEN 'collecting' WHEN hi < -0.02 THEN 'rejected' WHEN mcnemar_p <= 0.05 AND b > c THEN 'Tier 1 regression'
 WHEN lo > -0.02 AND measured_savings >= 0.15 THEN 'promoted' WHEN lo > -0.02 THEN 'measured savings' WHEN n >= 4000 THEN 'inconclusive' ELSE 'straddle' END"""


@query(f"WITH {VALID_CTE}, s AS (SELECT tenant_id, route_id, sum(b1)::BIGINT AS b, sum(c0)::BIGINT AS c FROM v GROUP BY ALL) SELECT tenant_id, route_id, b, c, round({P_SQL}, 9) AS mcnemar_p FROM s")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.sums(E.valid(samples(spark, sf_dir)), KEYS)
    return found.select(*KEYS, "b", "c", F.round(E.mcnemar(F.col("b"), F.col("c")), 9).alias("mcnemar_p"))


@query(
    f"""{LOOKS}, x AS (SELECT *, {MORE} FROM (SELECT *, {STATS} FROM s)), y AS (SELECT *, {P_SQL} AS mcnemar_p FROM x),
    z AS (SELECT *, {STATE_SQL} AS state, {REASON_SQL} AS reason FROM y),
    f AS (SELECT *, coalesce(min(CASE WHEN state <> 'SHADOW' THEN look END) OVER k, max(look) OVER k) AS picked FROM z WINDOW k AS (PARTITION BY tenant_id, route_id))
    SELECT tenant_id, route_id, id, n, look, state, reason, round(lo, 9) AS lo, round(hi, 9) AS hi, round(mcnemar_p, 9) AS mcnemar_p FROM f WHERE look = picked"""
)
def promotion_replay_first_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.replay(samples(spark, sf_dir), KEYS)
    return found.select(*KEYS, "id", "n", "look", "state", "reason", F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round("mcnemar_p", 9).alias("mcnemar_p"))


@query(
    f"""WITH {VALID_CTE}, l AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, route_id ORDER BY ts DESC, id DESC) AS rn FROM v),
    s AS (SELECT tenant_id, route_id, {SUMS} FROM l WHERE rn <= 400 GROUP BY ALL), x AS (SELECT *, {MORE} FROM (SELECT *, {STATS} FROM s)),
    y AS (SELECT *, {P_SQL} AS mcnemar_p FROM x)
    SELECT tenant_id, route_id, n, CASE WHEN n >= 200 AND hi < -0.02 OR mcnemar_p <= 0.05 AND b > c THEN 'SHADOW' ELSE 'ENABLED' END AS state,
      CASE WHEN n >= 200 AND hi < -0.02 THEN 'demoted' WHEN mcnemar_p <= 0.05 AND b > c THEN 'Tier 1 regression' ELSE 'holding' END AS reason FROM y"""
)
def next_state_enabled_demote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.evidence(samples(spark, sf_dir), KEYS, last=400).withColumn("mcnemar_p", E.mcnemar(F.col("b"), F.col("c")))
    return rows.withColumn("next", E.enabled_step()).select(*KEYS, "n", "next.state", "next.reason")


#: Exchanges: about a third encoded, of which more fail on some routes.
EXCHANGES = """
SELECT event_id AS id, ts, user_id % 3 AS tenant_id, event_type AS route_id, CASE WHEN event_id % 2 = 0 THEN 'm1' ELSE 'm2' END AS model, event_id % 37 = 4 AS fell_back,
       CASE WHEN event_id % 3 = 0 THEN 'encoded' ELSE 'original' END AS sent, CASE WHEN event_id % 7 <> 0 THEN event_id % (CASE WHEN event_type = 'error' THEN 9 ELSE 40 END) <> 3 END AS tier1_ok,
       CASE WHEN event_id % 19 = 0 THEN 500 ELSE 200 END AS status, 100 + event_id % 400 AS input_tokens, 20 + event_id % 50 AS output_tokens,
       CASE WHEN event_id % 5 = 0 THEN 'min-size' WHEN event_id % 7 = 0 THEN 'structural' WHEN event_id % 11 = 0 THEN 'net-savings' END AS failed_gate, (event_id % 60) AS savings_pct, event_id % 53 = 1 AS parse_error
FROM events
"""
TAIL = "CASE WHEN enc_fail <= 0 THEN 1 ELSE coalesce(list_sum(list_transform(range(enc_fail, enc_n + 1), lambda i: exp(lgamma(enc_n + 1) - lgamma(i + 1) - lgamma(enc_n - i + 1) + i * ln(p0) + (enc_n - i) * ln(1 - p0)))), 0) END"


@query(
    f"""WITH x AS ({EXCHANGES}), e AS (SELECT *, fell_back OR sent = 'encoded' AS enc, fell_back OR NOT coalesce(tier1_ok, TRUE) AS bad FROM x),
    s AS (SELECT tenant_id, route_id, model, count_if(enc)::BIGINT AS enc_n, count_if(enc AND bad)::BIGINT AS enc_fail, count_if(NOT enc)::BIGINT AS base_n, count_if(NOT enc AND bad)::BIGINT AS base_fail FROM e GROUP BY ALL),
    p AS (SELECT *, (base_fail + 1)::DOUBLE / (base_n + 2) AS p0 FROM s), t AS (SELECT *, {TAIL} AS tail FROM p)
    SELECT tenant_id, route_id, model, enc_n, enc_fail, base_n, base_fail, round(p0, 9) AS p0, round(tail, 8) AS tail, enc_n >= 50 AND enc_fail / enc_n::DOUBLE > p0 + 0.02 AND tail < 0.05 AS trips FROM t"""
)
def binomial_tail_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.breaker(derived(spark, sf_dir, EXCHANGES, "events"), ("tenant_id", "route_id", "model"))
    return found.withColumns({"p0": F.round("p0", 9), "tail": F.round("tail", 8)})


TRANSITIONS = """
SELECT event_id AS id, ts, user_id % 3 AS tenant_id, event_type AS route_id, concat('v', CAST(event_id % 2 AS VARCHAR(4))) AS policy_version, event_id % 3 AS to_state
FROM events WHERE event_id % 401 = 17
"""
POLICIES = """
SELECT DISTINCT user_id % 3 AS tenant_id, event_type AS route_id, 'v1' AS version, CASE WHEN event_type = 'view' THEN 'OFF' ELSE 'SHADOW' END AS state FROM events WHERE user_id % 3 <> 2
"""


@query(
    f"""WITH t AS ({TRANSITIONS}), p AS ({POLICIES}), l AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, route_id ORDER BY ts DESC, id DESC) AS rn FROM t)
    SELECT tenant_id, route_id, to_state AS restored, ts AS since FROM l JOIN p USING (tenant_id, route_id) WHERE rn = 1 AND policy_version = version AND state IN ('SHADOW', 'ENABLED')"""
)
def transition_last_per_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_transition(derived(spark, sf_dir, TRANSITIONS, "events"), derived(spark, sf_dir, POLICIES, "events"), KEYS)


@query(
    f"""WITH {VALID_CTE}, t AS (SELECT tenant_id, route_id, max(ts) AS since FROM ({TRANSITIONS}) GROUP BY ALL),
    k AS (SELECT v.* FROM v LEFT JOIN t USING (tenant_id, route_id) WHERE since IS NULL OR v.ts > since), s AS (SELECT tenant_id, route_id, {SUMS} FROM k GROUP BY ALL)"""
    + _stats_sql("s", "tenant_id, route_id, n, b, c")
)
def evidence_since_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = E.since_last_transition(samples(spark, sf_dir), derived(spark, sf_dir, TRANSITIONS, "events"), KEYS)
    return rounded(E.evidence(kept, KEYS).drop("latency_ratio"))


@query(
    f"""WITH p AS ({POLICIES}), t AS ({TRANSITIONS}), {VALID_CTE}, x AS ({EXCHANGES}),
    keys AS (SELECT tenant_id, route_id FROM p UNION SELECT tenant_id, route_id FROM t UNION SELECT tenant_id, route_id FROM samples UNION SELECT tenant_id, route_id FROM x),
    sm AS (SELECT tenant_id, route_id, count(*) AS samples FROM samples GROUP BY ALL), vv AS (SELECT tenant_id, route_id, {SUMS} FROM v GROUP BY ALL),
    tr AS (SELECT tenant_id, route_id, count(*) AS transitions FROM t GROUP BY ALL),
    au AS (SELECT tenant_id, route_id, count(*) AS requests, count_if(status < 200 OR status > 299) AS errors FROM x GROUP BY ALL),
    st AS (SELECT *, {MORE} FROM (SELECT *, {STATS} FROM vv))
    SELECT tenant_id, route_id, coalesce(state, 'not in policy file') AS state, coalesce(samples, 0) AS samples, n, round(lo, 9) AS lo, round(hi, 9) AS hi,
      CASE WHEN state = 'SHADOW' THEN 200 + 100 * CASE WHEN coalesce(n, 0) < 200 THEN 0 ELSE (n - 200) // 100 + 1 END END AS next_look,
      coalesce(transitions, 0) AS transitions, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors
    FROM keys LEFT JOIN p USING (tenant_id, route_id) LEFT JOIN sm USING (tenant_id, route_id) LEFT JOIN st USING (tenant_id, route_id) LEFT JOIN tr USING (tenant_id, route_id) LEFT JOIN au USING (tenant_id, route_id)"""
)
def route_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda sql: derived(spark, sf_dir, sql, "events")
    return joins.route_report(of(POLICIES), of(TRANSITIONS), samples(spark, sf_dir), of(EXCHANGES))


@query(
    f"""WITH x AS ({EXCHANGES}) SELECT tenant_id, route_id, count(*) AS requests, count_if(sent = 'encoded') AS encoded, count_if(fell_back) AS fallbacks,
    count_if(status < 200 OR status > 299) AS errors, count_if(tier1_ok = FALSE) AS tier1_failed, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens,
    count_if(failed_gate = 'min-size') AS gate_min_size, count_if(failed_gate = 'structural') AS gate_structural, count_if(failed_gate = 'net-savings') AS gate_net_savings,
    round(coalesce(sum(CASE WHEN sent = 'encoded' THEN savings_pct END)::DOUBLE / nullif(count_if(sent = 'encoded'), 0) / 100, 0), 9) AS mean_savings FROM x GROUP BY ALL"""
)
def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.audit_summary(derived(spark, sf_dir, EXCHANGES, "events"), KEYS)


@query(f"WITH x AS ({EXCHANGES}) SELECT id FROM x WHERE fell_back OR parse_error OR tier1_ok = FALSE OR (id * 48271) % 100 < 5")
def audit_sample_always(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.audited(derived(spark, sf_dir, EXCHANGES, "events"), (F.col("id") * 48271) % 100 < 5).select("id")


@query(
    f"""WITH x AS ({EXCHANGES}) SELECT route_id, sent, status, least(input_tokens // 64, 7) AS bucket, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens FROM x GROUP BY ALL"""
)
def metrics_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.counters(derived(spark, sf_dir, EXCHANGES, "events"), ("route_id", "sent", "status"), "input_tokens", 64, 7)


@query(f"WITH {VALID_CTE}, l AS (SELECT route_id, list_sort(list(lat) FILTER (lat IS NOT NULL)) AS l FROM v GROUP BY ALL) SELECT route_id, round(coalesce(l[len(l) // 2 + 1], 0), 9) AS latency_ratio FROM l")
def latency_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = E.upper_medians(E.valid(samples(spark, sf_dir)), ["route_id"], E.latency_ratio(), "latency_ratio")
    return found.withColumn("latency_ratio", F.round("latency_ratio", 9))


POLICY_TABLE = """
SELECT * FROM (VALUES ('0', 'click', 'v1', 300), ('*', 'click', 'v2', 200), ('*', 'view', 'v3', 150), ('1', 'error', 'v4', 100)) AS p(tenant_id, route_id, version, min_tokens)
"""


@query(
    f"""WITH p AS ({POLICY_TABLE}) SELECT event_id, coalesce(a.version, b.version, 'default') AS version, coalesce(a.min_tokens, b.min_tokens, 200) AS min_tokens
    FROM events e LEFT JOIN p a ON a.tenant_id = CAST(e.user_id % 3 AS VARCHAR) AND a.route_id = e.event_type LEFT JOIN p b ON b.tenant_id = '*' AND b.route_id = e.event_type"""
)
def policy_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived(spark, sf_dir, "SELECT event_id, CAST(user_id % 3 AS STRING) AS tenant_id, event_type AS route_id FROM events", "events")
    met = joins.with_policy(requests, spark.sql(POLICY_TABLE), {"version": "default", "min_tokens": 200})
    return met.select("event_id", "version", "min_tokens")


FACTORS = """
SELECT * FROM (VALUES ('brand#1', 'exact', 1.25), ('brand#1', '', 1.1), ('brand#', '', 0.9), ('brand#2', '', 1.05), ('br', '', 0.5)) AS f(model, kind, factor)
"""


@query(
    f"""WITH f AS ({FACTORS}), m AS (SELECT p_partkey, lower(p_brand) AS model, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'other' END AS kind FROM part),
    px AS (SELECT p_partkey, arg_max(factor, length(f.model)) AS factor FROM m JOIN f ON f.kind = '' AND starts_with(m.model, f.model) GROUP BY p_partkey)
    SELECT m.p_partkey, round(coalesce(a.factor::DOUBLE, b.factor::DOUBLE, px.factor::DOUBLE, 1), 9) AS factor FROM m LEFT JOIN f a ON a.model = m.model AND a.kind = m.kind
    LEFT JOIN f b ON b.model = m.model AND b.kind = '' LEFT JOIN px USING (p_partkey)"""
)
def calibration_prefix_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = derived(spark, sf_dir, "SELECT p_partkey, lower(p_brand) AS model, CASE WHEN p_partkey % 2 = 0 THEN 'exact' ELSE 'other' END AS kind FROM part", "part")
    met = joins.with_factor(requests, spark.sql(FACTORS).withColumn("factor", F.col("factor").cast("double")))
    return met.select("p_partkey", F.round("factor", 9).alias("factor"))


@query(
    """WITH RECURSIVE o AS (SELECT event_type AS model, (50 + event_id % 101)::DOUBLE / 100 AS ratio, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
    r AS (SELECT model, ratio AS factor, k FROM o WHERE k = 1 UNION ALL SELECT r.model, 0.9::DOUBLE * r.factor + 0.1::DOUBLE * o.ratio, o.k FROM r JOIN o ON o.model = r.model AND o.k = r.k + 1)
    SELECT model, round(arg_max(factor, k), 6) AS factor, max(k) AS n FROM r GROUP BY model"""
)
def calibration_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = derived(spark, sf_dir, "SELECT event_type AS model, ts, event_id AS id, CAST(50 + event_id % 101 AS DOUBLE) / 100.0D AS ratio FROM events", "events")
    return joins.ewma(seen, ["model"], ["ts", "id"]).withColumn("factor", F.round("factor", 6))


@query(
    """WITH m AS (SELECT conv_id, turn, role, text FROM conversations), c AS (SELECT conv_id, turn, 'call' || (turn % 4) AS call_id, 'tool_' || (turn % 6) AS name FROM m WHERE role = 'user')
    SELECT m.conv_id, m.turn, (SELECT c.name FROM c WHERE c.conv_id = m.conv_id AND c.call_id = 'call' || ((m.turn - 1) % 4) AND c.turn < m.turn ORDER BY c.turn DESC LIMIT 1) AS tool FROM m WHERE m.role = 'assistant'"""
)
def tool_name_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = derived(spark, sf_dir, "SELECT conv_id, turn, concat('call', turn % 4) AS call_id, concat('tool_', turn % 6) AS name FROM conversations WHERE role = 'user'", "conversations")
    results = derived(spark, sf_dir, "SELECT conv_id, turn, concat('call', (turn - 1) % 4) AS call_id FROM conversations WHERE role = 'assistant'", "conversations")
    return joins.last_before(results, calls, ["conv_id", "call_id"], "turn", "name").select("conv_id", "turn", F.col("name").alias("tool"))
