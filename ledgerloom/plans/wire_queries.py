"""Requests, responses, arms, calibration and logs derived from events, and generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import joins
from ..operators import records as R
from ..operators import wire as W
from ..sources import generated as G
from .evidence_queries import KEYS, POLICIES, TRANSITIONS
from .record_queries import COUNTED, RECORDS, RESAMPLES, records, rounded
from .registry import derived, query, table

CONTRACT = {
    "schemas": {"pay": {"type": "object", "required": ["amount"], "properties": {"amount": {"type": "number"}}}},
    "output_schema": {"type": "object", "required": ["ok"]}, "max_amount": "100", "scopes": {"pay": "pay:write"},
}


@query(
    """SELECT event_id, event_id % 8 IN (0, 4) AS ok, CASE event_id % 8 WHEN 1 THEN 'rule' WHEN 2 THEN 'contract' WHEN 3 THEN 'schema' WHEN 5 THEN 'contract' WHEN 6 THEN 'authz' WHEN 7 THEN 'schema' END AS step,
    CASE WHEN event_id % 8 = 1 THEN 'max-amount' END AS rule FROM events"""
)
def validate_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses in either format that pass or fail as a whole: amounts, undeclared tools, arguments, output, scopes."""
    k = F.col("event_id") % 8
    args = F.when(k == 1, '{"amount":100.01}').when(k == 3, '{"amount":"much"}').otherwise(F.concat(F.lit('{"amount":'), (F.col("user_id") % 100).cast("string"), F.lit("}")))
    name = F.when(k == 2, "drop").otherwise("pay")
    text = F.when(k == 4, '{"ok":true}').when(k == 7, '{"fine":true}').otherwise("plain words")
    quoted = lambda c: F.to_json(F.struct(c.alias("x")))
    inner = lambda c: F.substring(quoted(c), F.lit(6), F.length(quoted(c)) - 6)
    one = F.when(k.isin(4, 5, 7), F.concat(F.lit('{"content":[{"type":"text","text":'), inner(text), F.lit("}]}"))).otherwise(
        F.concat(F.lit('{"content":[{"type":"tool_use","id":"c1","name":"'), name, F.lit('","input":'), args, F.lit("}]}"))
    )
    two = F.when(k.isin(4, 5, 7), F.concat(F.lit('{"choices":[{"message":{"content":'), inner(text), F.lit("}}]}"))).otherwise(
        F.concat(F.lit('{"choices":[{"message":{"tool_calls":[{"id":"c1","function":{"name":"'), name, F.lit('","arguments":'), inner(args), F.lit("}}]}}]}"))
    )
    scopes = F.when(k == 6, '{"scopes":["pay:read"]}').otherwise('{"scopes":["pay:*"]}')
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("user_id") % 2 == 0, one).otherwise(two).alias("body"), scopes.alias("context"), F.array(F.lit("pay")).alias("tools"), (k == 5).alias("asked")
    )
    found = W.validated(rows, CONTRACT, declared="tools", wants_output="asked")
    return found.select("event_id", "ok", F.get("violations", F.lit(0))["step"].alias("step"), F.get("violations", F.lit(0))["rule"].alias("rule"))


@query("SELECT event_id, CASE WHEN user_id % 4 > 0 THEN 't' || (user_id % 4) END AS tenant_id, CASE WHEN user_id % 4 > 0 THEN event_type END AS subject, CASE WHEN user_id % 4 > 0 THEN user_id % 3 END AS scopes FROM events")
def identify_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    tenant = F.when(u % 4 > 0, F.concat(F.lit("t"), (u % 4).cast("string"))).otherwise("")
    headers = F.create_map(F.lit("X-TP-Tenant"), tenant, F.lit("x-tp-subject"), F.col("event_type"), F.lit("X-Tp-Scopes"), F.repeat(F.lit(" a:read "), (u % 3).cast("int")), F.lit("tenant_id"), F.lit("forged"))
    rows = table(spark, sf_dir, "events").select("event_id", W.identified(headers, "trusted-headers").alias("who"))
    return rows.select("event_id", "who.tenant_id", "who.subject", F.when(F.col("who").isNotNull(), F.size("who.scopes").cast("long")).alias("scopes"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{"model":"m","n":' || user_id || ',"stream":false}' WHEN 1 THEN '{ "n": ' || user_id || ' }' END AS body FROM events""")
def non_streaming_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("event_id") % 3, F.col("user_id").cast("string")
    body = F.when(k == 0, F.concat(F.lit('{"stream": true, "stream_options": {"usage": true}, "n": '), n, F.lit(', "model": "m"}'))).when(k == 1, F.concat(F.lit('{ "n": '), n, F.lit(" }"))).otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", W.non_streaming(body).alias("body"))


@query(
    """SELECT event_id AS id, CASE WHEN event_id % 4 < 2 THEN '3' END AS codec_version, CASE WHEN event_id % 4 < 2 THEN 0.25::DOUBLE END AS est_savings, sha256('body' || event_id) AS sent_sha256,
    CASE WHEN event_id % 5 = 0 THEN 'min-size' END AS failed_gate, CASE WHEN event_id % 7 = 0 THEN '{"password":"[REDACTED]","user":' || user_id || '}' END AS request_redacted FROM events"""
)
def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    gate = F.struct((e % 5 != 0).alias("transform"), F.when(e % 5 == 0, "min-size").otherwise("").alias("failed_gate"), F.lit("small").alias("reason"), F.lit(10).alias("json_tokens"), F.lit(8).alias("enc_tokens"))
    none = lambda name, kind="string": F.lit(None).cast(kind).alias(name)
    rows = table(spark, sf_dir, "events").select(
        e.alias("id"), F.col("ts").alias("time"), F.lit("t").alias("tenant_id"), F.col("event_type").alias("route_id"), F.lit("v1").alias("version"), F.lit("ENABLED").alias("state"), none("subject"),
        F.lit("anthropic").alias("provider"), F.lit("m").alias("model"), F.lit(200).alias("status"), F.lit(5).alias("latency_ms"), F.when(e % 4 == 0, "encoded").otherwise("original").alias("sent"),
        (e % 4 == 1).alias("fell_back"), F.lit("toonx").alias("codec"), F.lit("3").alias("codec_version"), F.concat(F.lit("body"), e.cast("string")).alias("sent_body"), F.lit(0.25).alias("net_savings"),
        F.array(gate).alias("blocks"), none("usage"), none("tier1"), (e % 7 == 0).alias("enable_raw_payload_logging"),
        F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"password":"x"}')).alias("request_body"), none("parse_error"),
    )
    found = W.audit_entries(rows).withColumn("id", F.regexp_extract(F.col("sent_sha256"), "$", 0))
    ids = rows.select("id", F.sha2("sent_body", 256).alias("sent_sha256"))
    shown = found.drop("id").join(ids, "sent_sha256")
    return shown.select("id", "codec_version", "est_savings", "sent_sha256", F.get("gates", F.lit(0))["failed_gate"].alias("failed_gate"), "request_redacted")


@query(
    """SELECT event_id, event_id % 5 > 0 AS valid, CASE WHEN event_id % 5 > 0 THEN event_id % 3 <> 1 END AS agree_ab, CASE WHEN event_id % 5 > 0 THEN TRUE END AS agree_ac, CASE WHEN event_id % 5 > 0 THEN event_id % 3 <> 1 END AS agree_cb,
    100 + user_id AS in_a, 20 AS lat_b, CASE WHEN event_id % 5 = 0 THEN 'HTTP 500' ELSE '' END AS err_c FROM events"""
)
def three_arm_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples made of logged calls: the plain arms agree but for case, the encoded one differs now and then."""
    e = F.col("event_id")
    arm = lambda name, text, ms, status: F.struct(
        F.lit(name).alias("arm"), status.alias("status"), F.lit(ms).alias("latency_ms"), F.lit(None).cast("string").alias("error"),
        F.to_json(F.struct(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content"), F.struct((F.col("user_id") + 100).alias("input_tokens"), F.lit(7).alias("output_tokens")).alias("usage"))).alias("body"),
    )
    fine = F.lit(200)
    arms = F.array(arm("A", F.lit("All  done"), 10, fine), arm("B", F.when(e % 3 == 1, "Nothing done").otherwise("all done"), 20, fine), arm("C", F.lit("ALL done"), 30, F.when(e % 5 == 0, 500).otherwise(200)))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(arms).alias("x")).select("event_id", "x.*")
    return W.samples(rows, "event_id").select(
        "event_id", "valid", F.col("agreement.agree").alias("agree_ab"), F.col("control_agreement.agree").alias("agree_ac"), F.col("agreement_cb.agree").alias("agree_cb"), "in_a", "lat_b", "err_c"
    )


@query("SELECT event_id FROM events WHERE user_id % 4 IN (1, 2) AND event_id % 19 <> 0 AND event_id % 3 > 0 AND ((event_id * 48271) % 1009) / 1009::DOUBLE < CASE WHEN event_type = 'view' THEN 0.5::DOUBLE ELSE 0.05::DOUBLE END")
def shadow_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.element_at(F.array(*[F.lit(s) for s in ("OFF", "SHADOW", "ENABLED", "MANUAL")]), (F.col("user_id") % 4 + 1).cast("int")).alias("state"),
        F.when(e % 19 == 0, 500).otherwise(200).alias("status"), (e % 3 > 0).alias("any_transform"), F.when(F.col("event_type") == "view", 0.5).otherwise(0.05).alias("shadow_sample_rate"),
    )
    return E.sampled(rows, ((e * 48271) % 1009).cast("double") / 1009.0).select("event_id")


@query(
    f"""WITH t AS ({TRANSITIONS}), p AS ({POLICIES}), l AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, route_id ORDER BY ts DESC, id DESC) AS rn FROM t),
    b AS (SELECT tenant_id, route_id, list_extract(['OFF', 'SHADOW', 'ENABLED', 'MANUAL'], to_state + 1) AS named, ts AS since FROM l JOIN p USING (tenant_id, route_id) WHERE rn = 1 AND policy_version = version AND state IN ('SHADOW', 'ENABLED'))
    SELECT tenant_id, route_id, version, coalesce(named, state) AS state, named IS NOT NULL AS restored, since FROM p LEFT JOIN b USING (tenant_id, route_id)"""
)
def resumed_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda sql: derived(spark, sf_dir, sql, "events")
    return E.resumed(of(POLICIES), of(TRANSITIONS), KEYS)


@query(f"WITH t AS ({TRANSITIONS}) SELECT tenant_id, route_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, route_id ORDER BY ts DESC, id DESC) AS place FROM t) WHERE place <= 5")
def last_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.last_shown(derived(spark, sf_dir, TRANSITIONS, "events"), KEYS, ("ts", "id")).select(*KEYS, "id", "place")


@query(
    """WITH RECURSIVE o AS (SELECT event_type AS model, ts, event_id AS id FROM events),
    s AS (SELECT model, min(struct_pack(ts := ts, id := id)) AS x FROM o GROUP BY model UNION ALL
      SELECT o.model, min(struct_pack(ts := o.ts, id := o.id)) FROM s JOIN o ON o.model = s.model AND o.ts >= s.x.ts + INTERVAL 15 MINUTE GROUP BY o.model)
    SELECT model, x.id AS id FROM s"""
)
def calibration_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most one calibration of a model in a quarter of an hour."""
    return joins.due(table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), "ts", F.col("event_id").alias("id"))).select("model", "id")


CALIBRATIONS = """
SELECT event_type AS model, ts, event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'toonx' ELSE 'tabular' END AS codec, 8 + event_id % 3 AS one_token, 208 + event_id % 50 AS json, 148 + event_id % 40 AS enc, 190 + event_id % 31 AS raw_json, event_id % 140 AS raw_enc FROM events
"""


@query(
    f"""WITH c AS ({CALIBRATIONS}), b AS (SELECT *, first_value(one_token) OVER (PARTITION BY model ORDER BY ts, id) - 1 AS base FROM c)
    SELECT model, 'json' AS kind, id, round((json - base) / raw_json::DOUBLE, 9) AS ratio FROM b UNION ALL SELECT model, codec, id, round((enc - base) / nullif(raw_enc, 0)::DOUBLE, 9) FROM b
    UNION ALL SELECT model, '', id, round((json - base) / raw_json::DOUBLE, 9) FROM b"""
)
def calibration_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a calibration teaches: ratios of the plain form, of the codec and of the model, the message's overhead taken off."""
    found = joins.observed_ratios(derived(spark, sf_dir, CALIBRATIONS, "events"))
    return rounded(found, "ratio").select("model", "kind", "id", "ratio")


# Records.


@query(f"WITH r AS ({RECORDS}) SELECT question_id, row_number() OVER (ORDER BY first) AS place FROM (SELECT question_id, min(ordinal) AS first FROM r GROUP BY 1)")
def first_seen_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_seen(records(spark, sf_dir), "question_id")


PLACE_SQL = "CASE format WHEN 'json-compact' THEN 0 WHEN 'json-compact-2' THEN 1 WHEN 'toonx' THEN 2 ELSE 6 END"


@query(f"WITH r AS ({RECORDS}) SELECT DISTINCT format, {PLACE_SQL} AS place FROM r")
def format_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("format").distinct().withColumn("place", R.format_place(F.col("format")))


@query(
    f"""WITH r AS ({RECORDS}), u AS (SELECT *, 0 AS run FROM r WHERE ordinal % 3 > 0 UNION ALL SELECT *, 1 FROM r WHERE ordinal % 3 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY model, question_id, format ORDER BY run DESC, ordinal DESC) AS rn FROM u WHERE error IS NULL) SELECT model, question_id, format, run, correct FROM k WHERE rn = 1"""
)
def runs_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs one after the other: the later run's success counts."""
    every = records(spark, sf_dir)
    both = R.runs_together(every.where("ordinal % 3 > 0"), every.where("ordinal % 3 = 0"))
    return R.counted(both).select("model", "question_id", "format", F.col("ordinal.run").alias("run"), "correct")


GRADED = f"SELECT model, question_id, CASE WHEN question_id % 5 = 0 THEN 'timeout' END AS error, question_id % 7 AS errors, question_id % 5 + 1 AS complete FROM ({RECORDS}) WHERE ordinal % 4 = 1 GROUP BY ALL"


@query(
    f"""WITH r AS ({RECORDS}), j AS ({GRADED}), w AS (SELECT model, question_id FROM r WHERE error IS NULL AND format IN ('json-compact', 'toonx') GROUP BY ALL HAVING count(DISTINCT format) = 2)
    SELECT model, question_id FROM w EXCEPT SELECT model, question_id FROM j WHERE error IS NULL"""
)
def judge_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.judge_jobs(records(spark, sf_dir), derived(spark, sf_dir, GRADED, "events"), ("json-compact", "toonx"), ("model", "question_id"))


@query(f"WITH r AS ({RECORDS}) SELECT model, question_id, format, error FROM r WHERE error IS NOT NULL")
def failed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.failed_calls(records(spark, sf_dir))


THREE = ("json-compact", "json-compact-2", "toonx")


@query(
    f"""WITH {COUNTED} SELECT a.model, a.question_id, a.correct AS correct_0, b.correct AS correct_1, c.correct AS correct_2, c.input_tokens AS input_tokens_2
    FROM k a JOIN k b ON a.model = b.model AND a.question_id = b.question_id AND a.format = 'json-compact' AND b.format = 'json-compact-2' JOIN k c ON a.model = c.model AND a.question_id = c.question_id AND c.format = 'toonx'"""
)
def three_arm_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.arms_together(records(spark, sf_dir), THREE).select("model", "question_id", "correct_0", "correct_1", "correct_2", "input_tokens_2")


@query(
    f"""WITH {COUNTED}, j AS ({GRADED}) SELECT j.model, j.question_id, errors, a.output_tokens AS output_tokens_0, b.output_tokens AS output_tokens_1 FROM j
    LEFT JOIN k a ON a.model = j.model AND a.question_id = j.question_id AND a.format = 'json-compact' LEFT JOIN k b ON b.model = j.model AND b.question_id = j.question_id AND b.format = 'toonx'"""
)
def judged_with_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.judged_with_arms(derived(spark, sf_dir, GRADED, "events"), records(spark, sf_dir), ("json-compact", "toonx"))
    return found.select("model", "question_id", "errors", "output_tokens_0", "output_tokens_1")


JUDGED_ARMS = f"SELECT model, question_id, format, (question_id * 7 + length(format)) % 5 AS errors, question_id % 5 + 1 AS complete FROM ({RECORDS}) WHERE format IN ('json-compact', 'json-compact-2', 'toonx') GROUP BY ALL HAVING count(*) > 2"
_ITEM = "(question_id * 3 + ascii(right(model, 1)) - 48)"
_MIXED = f"({_ITEM} + 1) * 48271 % {R.DRAWS} * (r * 7919 + 104729) % {R.DRAWS}"


@query(
    f"""WITH r AS ({RECORDS}), j AS ({JUDGED_ARMS}), t AS (SELECT model, question_id, {', '.join(f"max(CASE WHEN format = '{f}' THEN (errors > 0)::INT END) AS w{k}, max(CASE WHEN format = '{f}' THEN complete END) AS c{k}" for k, f in enumerate(THREE))} FROM j GROUP BY ALL),
    e AS (SELECT *, unnest([model, 'all models']) AS scope FROM t),
    u AS (SELECT scope, r, w2 - w0 AS d, ({_MIXED} * ({_MIXED}) % {R.DRAWS} * 31 + {_ITEM} * 69621 + r * 16807) % {R.DRAWS} AS u FROM e, range(0, {RESAMPLES}) q(r)),
    v AS (SELECT scope, r, sum(d * w) / sum(w)::DOUBLE AS d FROM (SELECT *, {' + '.join(f'(u >= {p})::INT' for p in R.POISSON)} AS w FROM u) WHERE w > 0 GROUP BY ALL),
    b AS (SELECT scope, l[floor(0.025::DOUBLE * (len(l) - 1) + 0.5::DOUBLE)::BIGINT + 1] AS lo, l[floor(0.975::DOUBLE * (len(l) - 1) + 0.5::DOUBLE)::BIGINT + 1] AS hi FROM (SELECT scope, list_sort(list(d) FILTER (d IS NOT NULL)) AS l FROM v GROUP BY scope)),
    s AS (SELECT scope, count(*) AS tasks, {', '.join(f'round(avg(w{k}), 9) AS error_share_{k}, round(avg(c{k}), 9) AS completeness_{k}' for k in range(3))} FROM e GROUP BY scope),
    c AS (SELECT scope, count(*) AS calls, count_if(error IS NOT NULL) AS failed FROM (SELECT *, unnest([model, 'all models']) AS scope FROM r WHERE format IN ('json-compact', 'json-compact-2', 'toonx')) GROUP BY scope)
    SELECT s.*, round(lo, 9) AS rise_lo, round(hi, 9) AS rise_hi, hi <= 0.15 AS keeps_margin, calls, failed FROM s JOIN b USING (scope) JOIN c USING (scope)"""
)
def free_form_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = (F.col("question_id") * 3 + F.ascii(F.substring("model", F.lit(-1), F.lit(1))) - 48).cast("long")
    found = R.free_form_report(derived(spark, sf_dir, JUDGED_ARMS, "events"), records(spark, sf_dir), THREE, RESAMPLES, item)
    shares = [f"{c}_{k}" for k in range(3) for c in ("error_share", "completeness")]
    return rounded(found, *shares, "rise_lo", "rise_hi").select("scope", "tasks", *shares, "rise_lo", "rise_hi", "keeps_margin", "calls", "failed")


@query(f"WITH r AS ({RECORDS}), q AS (SELECT DISTINCT question_id FROM r) SELECT question_id FROM q ORDER BY (question_id * 48271 + 5 * 7919) % 1009, question_id LIMIT 40")
def sample_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.sample_by_id(records(spark, sf_dir).select("question_id").distinct(), "question_id", 40, (F.col("question_id") * 48271 + 5 * 7919) % 1009)


# Generated tables.


def _draw(k: int) -> str:
    return f"(id * 7919 + seed * 104729 + {k} * 48271 + id * seed * 31) % {G.DRAWN}"


def _pick(words: tuple, k: int) -> str:
    return f"list_extract({list(words)!r}, {_draw(k)} % {len(words)} + 1)"


def _q(sql: str) -> str:
    return f"""'"' || {sql} || '"'"""


_TITLE = f"{_pick(G.TERMS, 1)} || ' ' || {_pick(G.TERMS, 2)} || ' guide ' || (id + 1)"
SHAPES = {
    "orders": {
        "amount": f"regexp_replace(CAST(CAST({_draw(1)} + 100 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2))::VARCHAR, '\\.?0+$', '')", "customer": _q(f"{_pick(G.NAMES, 2)} || ' ' || {_pick(G.SURNAMES, 3)}"),
        "date": _q(f"strftime(DATE '2023-01-01' + CAST({_draw(4)} % 500 AS INTEGER), '%Y-%m-%d')"), "id": "(id + 1001)", "items": f"({_draw(5)} % 9 + 1)", "status": _q(_pick(G.STATES, 6)),
    },
    "logs": {
        "latency_ms": f"({_draw(2)} % 900 + 5)", "level": _q(_pick(G.LEVELS, 3)), "message": _q(f"{_pick(G.TERMS, 4)} || ' ' || {_pick(G.TERMS, 5)} || ' ' || {_pick(G.TERMS, 6)}"),
        "service": _q(f"{_pick(G.TERMS, 7)} || '-service'"), "time": _q(f"strftime(make_timestamp((1700000000 + id * 37 + {_draw(1)} % 30) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"), "trace_id": _q(f"'t' || lpad(CAST({_draw(8)} AS VARCHAR), 6, '0')"),
    },
    "search": {
        "doc_id": _q(f"'D-' || lpad(CAST({_draw(3)} AS VARCHAR), 6, '0')"), "rank": "(id + 1)", "score": "regexp_replace('0.' || lpad(CAST(9999 - (id * 7) % 9000 AS VARCHAR), 4, '0'), '0+$', '')",
        "title": _q(_TITLE), "url": _q(f"'https://' || lower({_pick(G.PLACES, 4)}) || '.example/' || replace({_TITLE}, ' ', '-')"),
    },
    "employees": {
        "active": f"CASE WHEN {_draw(4)} % 10 > 0 THEN 'true' ELSE 'false' END", "department": _q(_pick(G.DEPARTMENTS, 5)), "email": _q(f"lower({_pick(G.NAMES, 1)} || '.' || {_pick(G.SURNAMES, 2)} || id || '@example.com')"),
        "id": "(id + 5001)", "location": _q(_pick(G.PLACES, 6)), "manager_id": f"CASE WHEN id = 0 THEN 'null' ELSE CAST(5001 + {_draw(3)} % greatest(id, 1) AS VARCHAR) END", "name": _q(f"{_pick(G.NAMES, 1)} || ' ' || {_pick(G.SURNAMES, 2)}"),
        "salary": f"(45000 + {_draw(7)} % 150 * 1000)", "start_date": _q(f"strftime(DATE '2015-01-01' + CAST({_draw(8)} % 4000 AS INTEGER), '%Y-%m-%d')"),
    },
}
SIZES, SEED, SEEDS = (30, 120), 1, 3


def _shape_sql(name: str) -> str:
    fields = SHAPES[name]
    record = " || ',' || ".join(f"""'"{k}":' || {fields[k]}""" for k in sorted(fields))
    return f"SELECT '{name}' AS dataset, n AS rows, seed, id, '{{' || {record} || '}}' AS record FROM (VALUES {', '.join(f'({s}::BIGINT)' for s in SIZES)}) b(n), range({SEED}, {SEED + SEEDS}) c(seed), range(0, {max(SIZES)}) d(id) WHERE id < n"


GENERATED = " UNION ALL ".join(map(_shape_sql, SHAPES))


@query(GENERATED)
def generated_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeded synthetic tables of every name, size and seed."""
    return G.generate(spark, list(SHAPES), SIZES, SEED, SEEDS)


@query(f"WITH g AS ({GENERATED}) SELECT dataset, rows, seed, json_extract_string(record, '$.department') AS value, count(*) AS answer FROM g WHERE dataset = 'employees' GROUP BY ALL")
def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a table have each value of a field."""
    return G.questions(G.generate(spark, ["employees"], SIZES, SEED, SEEDS), "department")
