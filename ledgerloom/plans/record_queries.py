"""Benchmark analytics over records derived from events, and questions over orders."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import scoring
from ..functions.lazy import arrow_udf
from ..operators import records as R
from ..operators.evidence import mcnemar
from .evidence_queries import CDF
from .registry import derived, query, table

RECORDS = """
SELECT event_id AS ordinal, concat('m', CAST(user_id % 3 AS VARCHAR(4))) AS model, (event_id * 7) % 400 AS question_id, concat('set', CAST((event_id * 7) % 400 % 4 AS VARCHAR(4))) AS dataset,
       concat('kind', CAST((event_id * 7) % 400 % 3 AS VARCHAR(4))) AS kind,
       CASE (event_id + user_id) % 4 WHEN 0 THEN 'json-compact' WHEN 1 THEN 'json-compact-2' WHEN 2 THEN 'toonx' ELSE 'tabular' END AS format,
       (event_id * 7919 + user_id * 31) % 100 < 84 AS correct, 400 + (event_id * 13) % 97 - CASE WHEN (event_id + user_id) % 4 >= 2 THEN 130 ELSE 0 END AS input_tokens, 30 + event_id % 41 AS output_tokens,
       100 + event_id % 900 AS latency_ms, event_id % 97 = 5 AS empty, CASE WHEN event_id % 23 = 2 THEN 'timeout' WHEN event_id % 101 = 3 THEN 'HTTP 410' END AS error
FROM events
"""
GRADED_SQL = f"WITH j AS (SELECT model, question_id, CASE WHEN question_id % 5 = 0 THEN 'timeout' END AS error, question_id % 7 + 1 AS errors, question_id % 5 + 1 AS complete FROM ({RECORDS}) WHERE ordinal % 4 = 1 GROUP BY ALL)"
COUNTED = f"r AS ({RECORDS}), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, question_id, format ORDER BY ordinal DESC) AS rn FROM r WHERE error IS NULL) WHERE rn = 1)"
PAIRS = f"""{COUNTED}, pr AS (SELECT a.model, a.question_id, a.dataset, a.kind, a.correct AS ca, b.correct AS cb, a.input_tokens AS ia, b.input_tokens AS ib, a.output_tokens AS oa, b.output_tokens AS ob
  FROM k a JOIN k b ON a.model = b.model AND a.question_id = b.question_id AND a.format = 'json-compact' AND b.format = 'toonx')"""
SUMS = "count(*) AS n, count_if(ca) AS ok_a, count_if(cb) AS ok_b, count_if(ca AND NOT cb) AS lost, count_if(NOT ca AND cb) AS won, sum(ia)::BIGINT AS ia, sum(ib)::BIGINT AS ib, sum(oa)::BIGINT AS oa, sum(ob)::BIGINT AS ob"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir, RECORDS, "events")


def toonx_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pairs(records(spark, sf_dir), "toonx")


@query(f"WITH {COUNTED} SELECT model, question_id, format, ordinal, correct FROM k")
def last_record_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counted(records(spark, sf_dir)).select("model", "question_id", "format", "ordinal", "correct")


@query(
    f"""WITH r AS ({RECORDS}), t AS (SELECT model, question_id, format, count(*) AS calls, bool_or(error IS NULL) AS ok, count_if(empty) AS empties, count_if(error = 'HTTP 410') AS gone FROM r GROUP BY ALL)
    SELECT model, format, sum(calls)::BIGINT AS calls, count(*) AS tried, count_if(NOT ok) AS failed, sum(empties)::BIGINT AS empties, sum(gone)::BIGINT AS gone FROM t GROUP BY ALL"""
)
def calls_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.calls(records(spark, sf_dir))


@query(f"WITH {PAIRS}, s AS (SELECT model, {SUMS} FROM pr GROUP BY ALL) SELECT model, n, ok_a, ok_b, lost, won, round((ok_b - ok_a) / n::DOUBLE, 9) AS change FROM s")
def verify_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired_sums(toonx_pairs(spark, sf_dir), ["model"]).select("model", "n", "ok_a", "ok_b", "lost", "won", F.round(R.accuracy_change(), 9).alias("change"))


TOKEN_COLUMNS = "round(1 - ib / ia::DOUBLE, 9) AS input_saving, round(ob / oa::DOUBLE - 1, 9) AS output_change, round(1 - (ib + 4::DOUBLE * ob) / (ia + 4::DOUBLE * oa), 9) AS net_saving"


def _tokens() -> list:
    return [F.round(R.input_saving(), 9).alias("input_saving"), F.round(R.output_change(), 9).alias("output_change"), F.round(R.net_saving(), 9).alias("net_saving")]


@query(f"WITH {PAIRS}, s AS (SELECT model, {SUMS} FROM pr GROUP BY ALL) SELECT model, n, {TOKEN_COLUMNS} FROM s")
def verify_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired_sums(toonx_pairs(spark, sf_dir), ["model"]).select("model", "n", *_tokens())


@query(f"WITH {PAIRS}, s AS (SELECT model, dataset, {SUMS} FROM pr GROUP BY ALL) SELECT model, dataset, n, {TOKEN_COLUMNS} FROM s")
def savings_by_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.paired_sums(toonx_pairs(spark, sf_dir), ["model", "dataset"]).select("model", "dataset", "n", *_tokens())


@query(
    f"""WITH {PAIRS}, s AS (SELECT model, {SUMS} FROM pr GROUP BY ALL), t AS (SELECT * FROM (VALUES (1, 1.0::DOUBLE), (3, 1.0::DOUBLE), (10, 1.0::DOUBLE), (3, 0.1::DOUBLE), (10, 0.1::DOUBLE)) AS t(turns, resent))
    SELECT model, turns, resent, round(1 - ((1 + resent * (turns - 1)) * ib + 4 * ob) / ((1 + resent * (turns - 1)) * ia + 4 * oa), 9) AS net FROM s, t"""
)
def multi_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.multi_turn(R.paired_sums(toonx_pairs(spark, sf_dir), ["model"]), ["model"]).withColumn("net", F.round("net", 9))


RESAMPLES = 2000


def _resampled(rows: str, resamples: int = RESAMPLES) -> str:
    """CTEs: a resample's sums over paired rows (model, question_id, ca, cb, ia, ib, oa, ob) by model and k."""
    mixed = f"(question_id + 1) * 48271 % {R.DRAWS} * (r * 7919 + 104729) % {R.DRAWS}"
    weight = " + ".join(f"(u >= {p})::INT" for p in R.POISSON)
    return f"""{rows}_u AS (SELECT *, ({mixed} * ({mixed}) % {R.DRAWS} * 31 + question_id * 69621 + r * 16807) % {R.DRAWS} AS u FROM {rows}, range(0, {resamples}) q(r)),
      {rows}_s AS (SELECT model, k, r, sum(w)::BIGINT AS n, sum(ca::INT * w)::BIGINT AS ok_a, sum(cb::INT * w)::BIGINT AS ok_b, sum(ia * w)::BIGINT AS ia, sum(ib * w)::BIGINT AS ib, sum(oa * w)::BIGINT AS oa, sum(ob * w)::BIGINT AS ob
        FROM (SELECT *, {weight} AS w FROM {rows}_u) WHERE w > 0 GROUP BY ALL)"""


METRIC_SQL = {
    "change": "(ok_b - ok_a) / n::DOUBLE", "input_change": "ib / ia::DOUBLE - 1", "output_change": "ob / oa::DOUBLE - 1",
    "net_saving": "1 - (ib + 4::DOUBLE * ob) / (ia + 4::DOUBLE * oa)", "cost": "(ib + 4::DOUBLE * ob) / (ia + 4::DOUBLE * oa) - 1",
}


def _bounds_sql(rows: str, metrics: tuple[str, ...]) -> str:
    """CTE: bounds of metrics by model and k."""
    lists = ", ".join(f"list_sort(list({METRIC_SQL[m]})) AS {m}" for m in metrics)
    at = lambda m, p: f"{m}[floor({p}::DOUBLE * (len({m}) - 1) + 0.5::DOUBLE)::BIGINT + 1]"
    bounds = ", ".join(f"{at(m, p)} AS {m}_{side}" for m in metrics for side, p in (("lo", 0.025), ("hi", 0.975)))
    return f"{rows}_b AS (SELECT model, k, {bounds} FROM (SELECT model, k, {lists} FROM {rows}_s GROUP BY ALL))"


def _arm_sql(arm: str, base: str = R.BASE) -> str:
    return f"""SELECT a.model, a.question_id, a.correct AS ca, b.correct AS cb, a.input_tokens AS ia, b.input_tokens AS ib, a.output_tokens AS oa, b.output_tokens AS ob, a.latency_ms AS la, b.latency_ms AS lb, '{arm}' AS k
      FROM k a JOIN k b ON a.model = b.model AND a.question_id = b.question_id AND a.format = '{base}' AND b.format = '{arm}'"""


METRICS = tuple(R.METRICS)
VERDICT_SQL = "CASE WHEN change_lo > -0.03 THEN 'non-inferior' WHEN change_hi < -0.03 THEN 'worse than JSON' ELSE 'inconclusive' END"
BOOTSTRAP = f"{COUNTED}, ar AS ({_arm_sql('toonx')}), {_resampled('ar')}, {_bounds_sql('ar', METRICS)}"
BOUNDS = [f"{m}_{side}" for m in METRICS for side in ("lo", "hi")]


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in names})


@query(f"WITH {BOOTSTRAP} SELECT b.model, n, {', '.join(f'round({c}, 9) AS {c}' for c in BOUNDS)} FROM ar_b b JOIN (SELECT model, count(*) AS n FROM ar GROUP BY model) USING (model)")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the changes of accuracy, input, output and cost."""
    return rounded(R.bootstrap(toonx_pairs(spark, sf_dir), ["model"], RESAMPLES), *BOUNDS)


@query(f"WITH {BOOTSTRAP} SELECT model, {VERDICT_SQL} AS verdict FROM ar_b")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bootstrap(toonx_pairs(spark, sf_dir), ["model"], RESAMPLES, {"change": R.accuracy_change}).select("model", R.verdict().alias("verdict"))


ARMS = (R.AGAIN, "toonx", "tabular")


@query(
    f"""WITH {COUNTED}, ar AS ({' UNION ALL '.join(_arm_sql(a) for a in ARMS)}), {_resampled('ar')}, {_bounds_sql('ar', METRICS)},
    sm AS (SELECT model, k, {SUMS}, median(CASE WHEN la > 0 THEN lb / la::DOUBLE END) AS latency_ratio FROM ar GROUP BY ALL),
    fr AS (SELECT model, count_if(NOT ok) / count(*)::DOUBLE AS fail_rate FROM (SELECT model, question_id, format, bool_or(error IS NULL) AS ok FROM r WHERE coalesce(error, '') <> 'HTTP 410' GROUP BY ALL) GROUP BY model)
    SELECT model, k AS format, n, round(ok_a / n::DOUBLE, 9) AS accuracy_a, round(ok_b / n::DOUBLE, 9) AS accuracy_b, round((lost + won) / n::DOUBLE, 9) AS flips,
      {', '.join(f'round({METRIC_SQL[m]}, 9) AS {m}, round({m}_lo, 9) AS {m}_lo, round({m}_hi, 9) AS {m}_hi' for m in METRICS)},
      CASE WHEN k = '{R.AGAIN}' THEN 'noise floor' WHEN fail_rate > 0.1 THEN 'no verdict' ELSE {VERDICT_SQL} END AS verdict, round(latency_ratio, 9) AS latency_ratio, round(fail_rate, 9) AS fail_rate
    FROM sm JOIN ar_b USING (model, k) JOIN fr USING (model)"""
)
def verify_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole comparison of each model's arms with the plain form."""
    shown = R.verify_report(records(spark, sf_dir), ARMS, RESAMPLES)
    return rounded(shown, "accuracy_a", "accuracy_b", "flips", *METRICS, *BOUNDS, "latency_ratio", "fail_rate")


@query(
    f"""WITH {PAIRS}, s AS (SELECT model, {SUMS} FROM pr GROUP BY ALL),
    nz AS (SELECT a.model, count_if(a.correct <> b.correct) / count(*)::DOUBLE AS noise FROM k a JOIN k b ON a.model = b.model AND a.question_id = b.question_id AND a.format = 'json-compact' AND b.format = 'json-compact-2' GROUP BY a.model),
    z AS (SELECT model, lost, won, 1 - ib / ia::DOUBLE AS reduction, (ok_a - ok_b) / n::DOUBLE AS drop, noise,
      CASE WHEN lost + won = 0 THEN 1 ELSE least(1, 2 * {CDF.format(k="least(lost, won)::BIGINT", n="(lost + won)::BIGINT", p="0.5::DOUBLE")}) END AS p FROM s JOIN nz USING (model))
    SELECT model, round(reduction, 9) AS reduction, round(p, 8) AS p, round(noise, 9) AS noise,
      CASE WHEN reduction < 0.15 THEN 'NO-GO' WHEN p <= 0.05 AND lost > won THEN 'NO-GO' WHEN drop > noise + 1e-9 AND lost > won THEN 'HOLD' ELSE 'GO' END AS verdict FROM z"""
)
def live_go_nogo(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = records(spark, sf_dir)
    sums = R.paired_sums(R.pairs(every, "toonx"), ["model"])
    again = R.paired_sums(R.pairs(every, R.AGAIN), ["model"]).select("model", R.share(F.col("lost") + F.col("won"), F.col("n")).alias("noise"))
    rows = sums.join(again, "model").withColumns({"reduction": R.input_saving(), "drop": -R.accuracy_change(), "p": mcnemar(F.col("lost"), F.col("won"))})
    return rows.select("model", F.round("reduction", 9).alias("reduction"), F.round("p", 8).alias("p"), F.round("noise", 9).alias("noise"), R.live_verdict().alias("verdict"))


FORMATS = ("json-compact", "toonx", "tabular")


@query(f"WITH {COUNTED} SELECT kind, " + ", ".join(f"round(count_if(correct AND format = '{f}') / nullif(count_if(format = '{f}'), 0)::DOUBLE, 9) AS \"{f}\"" for f in FORMATS) + " FROM k GROUP BY kind")
def accuracy_by_kind_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.counted(records(spark, sf_dir)).groupBy("kind").pivot("format", list(FORMATS)).agg(F.round(F.avg(F.col("correct").cast("int")), 9))


@query(
    f"WITH {COUNTED}, w AS (SELECT model, question_id, " + ", ".join(f"any_value(correct) FILTER (format = '{f}') AS \"{f}\"" for f in FORMATS)
    + " FROM k WHERE format <> 'json-compact-2' GROUP BY ALL) SELECT *, coalesce(greatest(" + ", ".join(f'"{f}"' for f in FORMATS) + ") <> least(" + ", ".join(f'"{f}"' for f in FORMATS) + "), FALSE) AS differs FROM w"
)
def datapoints_pivot_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.discordant(records(spark, sf_dir), FORMATS)


@query(f"WITH {COUNTED} SELECT m.model, q.question_id, f.format FROM (SELECT DISTINCT model FROM r) m, (SELECT DISTINCT question_id FROM r) q, (SELECT DISTINCT format FROM r) f EXCEPT SELECT model, question_id, format FROM k")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the product of targets, questions and formats that have no success yet."""
    every = records(spark, sf_dir)
    targets = F.explode(F.array(*[F.struct(F.lit(f"m{i}").alias("model"), F.lit(f).alias("format")) for i in range(3) for f in (*FORMATS, R.AGAIN)]))
    jobs = every.select("question_id").distinct().select("question_id", targets.alias("t")).select("t.model", "question_id", "t.format")
    return R.unfinished(jobs, R.counted(every), ["model", "question_id", "format"])


@query(
    f"""WITH r AS ({RECORDS}), q AS (SELECT question_id, kind, min(ordinal) AS seen FROM r GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY (question_id * 48271) % 1009, question_id) AS rn, min(seen) OVER (PARTITION BY kind) AS first FROM q)
    SELECT question_id, kind FROM n ORDER BY rn, first LIMIT 50"""
)
def sample_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = records(spark, sf_dir).groupBy("question_id", "kind").agg(F.min("ordinal").alias("seen"))
    return R.round_robin(questions, "kind", (F.col("question_id") * 48271) % 1009, 50, "question_id", "seen").select("question_id", "kind")


TURNS = "SELECT u.conv_id, u.turn, u.text AS a, v.text AS b FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with the next one, as two replies to compare."""
    return derived(spark, sf_dir, TURNS, "conversations")


@query(f"WITH t AS ({TURNS}) SELECT conv_id, turn, sha256(trim(regexp_replace(lower(a), '\\s+', ' ', 'g'))) AS norm_sha, trim(regexp_replace(lower(a), '\\s+', ' ', 'g')) = trim(regexp_replace(lower(b), '\\s+', ' ', 'g')) AS agree FROM t")
def text_normalize_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = C.normal_text(F.col("a")), C.normal_text(F.col("b"))
    return turns(spark, sf_dir).select("conv_id", "turn", F.sha2(a, 256).alias("norm_sha"), (a == b).alias("agree"))


@query(
    f"""WITH t AS ({TURNS}), s AS (SELECT conv_id, turn, list_filter(string_split(trim(regexp_replace(lower(a), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS x, list_filter(string_split(trim(regexp_replace(lower(b), '\\s+', ' ', 'g')), ' '), lambda x: x <> '') AS y FROM t),
    wx AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(x) AS w FROM s) GROUP BY ALL), wy AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(y) AS w FROM s) GROUP BY ALL),
    m AS (SELECT conv_id, turn, sum(least(wx.c, wy.c)) AS met FROM wx JOIN wy USING (conv_id, turn, w) GROUP BY ALL)
    SELECT conv_id, turn, round(CASE WHEN len(x) + len(y) = 0 THEN 1 ELSE 2 * coalesce(met, 0)::DOUBLE / (len(x) + len(y)) END, 9) AS f1 FROM s LEFT JOIN m USING (conv_id, turn)"""
)
def word_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).select("conv_id", "turn", F.round(C.word_f1(F.col("a"), F.col("b")), 9).alias("f1"))


@query("SELECT event_id, event_type || ' ' || user_id AS clean FROM events")
def clean_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"))
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("<think>so\nso</think>The answer follows.\nAnswer: **"), said, F.lit("**."))).otherwise(F.concat(F.lit(' "'), said, F.lit('"\n')))
    return table(spark, sf_dir, "events").select("event_id", C.clean_reply(reply).alias("clean"))


JUDGED = """
SELECT doc_id, concat('m', CAST(doc_id % 3 AS VARCHAR(4))) AS model, CASE WHEN doc_id % 2 = 0 THEN 'toonx' ELSE 'json-compact' END AS format, toxic AS errors, quality AS complete, doc_id % 61 AS task, concat('L', CAST(doc_id % 4 AS VARCHAR(4))) AS label FROM labels
"""


@query(f"WITH j AS ({JUDGED}) SELECT coalesce(model, 'all models') AS model, format, count(*) AS tasks, round(count_if(errors > 0) / count(*)::DOUBLE, 9) AS error_share, round(sum(complete)::DOUBLE / count(*), 9) AS completeness FROM j GROUP BY GROUPING SETS ((model, format), (format))")
def freeform_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.judged_share(derived(spark, sf_dir, JUDGED, "labels"))


@query(f"WITH j AS ({JUDGED}) SELECT format, count_if(errors > 0) AS wrong, count(*) AS tasks, round(count_if(errors > 0) / count(*)::DOUBLE, 9) AS error_share FROM j GROUP BY format")
def judge_error_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, JUDGED, "labels").groupBy("format").agg(F.count_if(F.col("errors") > 0).alias("wrong"), F.count("*").alias("tasks"))
    return rows.withColumn("error_share", F.round(R.share(F.col("wrong"), F.col("tasks")), 9))


TASKS = f"SELECT task, label, max(complete) AS said FROM ({JUDGED}) GROUP BY task, label"


@query(f"WITH t AS ({TASKS}) SELECT a.task, a.label AS l1, b.label AS l2, a.said = b.said AS same FROM t a JOIN t b ON a.task = b.task AND a.label < b.label")
def judge_same_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.label_pairs(derived(spark, sf_dir, TASKS, "labels"), ["task"], "label", "said")


@query(
    """WITH c AS (SELECT o_custkey, count(*) AS n, count_if(o_orderstatus = 'F') AS fulfilled, max(CAST(o_totalprice AS DECIMAL(18,2))) AS top, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS total FROM orders GROUP BY 1 HAVING count(*) BETWEEN 2 AND 5),
    m AS (SELECT o.o_custkey, arg_max(o_orderkey, CAST(o_totalprice AS DECIMAL(18,2))) AS best, count_if(CAST(o_totalprice AS DECIMAL(18,2)) = top) AS ties FROM orders o JOIN c USING (o_custkey) GROUP BY 1)
    SELECT o_custkey, n, fulfilled, CASE WHEN ties = 1 THEN best END AS best, CAST(total AS VARCHAR) AS total FROM c JOIN m USING (o_custkey)"""
)
def questions_count_argmax_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold answers per customer of two to five orders: a count, the order of the unique greatest amount, the exact sum."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    sums = rows.groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("fulfilled"), F.max_by("o_orderkey", "price").alias("b"), F.max("price").alias("top"), F.sum("price").alias("total")
    ).where(F.col("n").between(2, 5))
    # Counts and maxima first, so that no customer's amounts are gathered; those with few orders then meet their ties.
    ties = rows.join(sums.select("o_custkey", F.col("top").alias("price")), ["o_custkey", "price"]).groupBy("o_custkey").agg(F.count("*").alias("ties"))
    return sums.join(ties, "o_custkey").select("o_custkey", "n", "fulfilled", F.when(F.col("ties") == 1, F.col("b")).alias("best"), F.col("total").cast("string").alias("total"))


@arrow_udf("boolean")
def is_correct(replies: pd.Series, answers: pd.Series, numeric: pd.Series) -> pd.Series:
    return pd.Series([scoring.correct(r, a, n) for r, a, n in zip(replies, answers, numeric, strict=True)])


@arrow_udf("boolean")
def answered(replies: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([scoring.answers_met(r, scoring.listed(a)) for r, a in zip(replies, answers, strict=True)])


@arrow_udf("boolean")
def same_values(replies: pd.Series, answers: pd.Series) -> pd.Series:
    return pd.Series([scoring.same_values(scoring.listed(r), scoring.listed(a)) for r, a in zip(replies, answers, strict=True)])


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS correct FROM orders")
def score_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that give the amount plainly, with marks and words around it, or wrongly."""
    amount = F.col("o_totalprice").cast("decimal(18,2)")
    k = F.col("o_orderkey") % 3
    reply = F.when(k == 0, amount.cast("string")).when(k == 1, F.concat(F.lit("It is $"), F.format_number(amount, 2))).otherwise((amount + F.lit(1).cast("decimal(18,2)")).cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", is_correct(reply, amount.cast("string"), F.lit(True)).alias("correct"))


@query("SELECT n_nationkey, n_nationkey % 3 <> 1 AS correct FROM nation")
def wtq_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of values in another order and with citations, or with one missing."""
    k = F.col("n_nationkey") % 3
    number = F.col("n_nationkey").cast("string")
    want = F.concat("n_name", F.lit("|1,000|"), number)
    got = F.when(k == 0, F.concat(number, F.lit(".0|“"), F.col("n_name"), F.lit("”[1]|1,000"))).when(k == 1, F.col("n_name")).otherwise(F.concat(F.lit("1,000|"), F.upper("n_name"), F.lit("|"), number))
    return table(spark, sf_dir, "nation").select("n_nationkey", same_values(got, want).alias("correct"))


@query()
def question_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about each customer's orders payload, each with its answer."""
    from ..functions.questions import payload_questions
    from .payload_queries import order_payloads

    @arrow_udf("array<struct<kind string, text string, answer string>>")
    def asked(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([payload_questions(t, s) for t, s in zip(texts, seeds, strict=True)])

    rows = order_payloads(spark, sf_dir).select("o_custkey", F.explode(asked("json", F.col("o_custkey").cast("string"))).alias("q"))
    return rows.select("o_custkey", "q.kind", "q.text", "q.answer")


RANK_SQL = "CASE WHEN change_lo > -0.03 THEN 3 WHEN change_hi < -0.03 THEN 1 ELSE 2 END"


@query(
    f"""WITH {COUNTED}, vt AS ({_arm_sql('tabular', 'toonx')}), vb AS ({_arm_sql('tabular')}), bb AS ({_arm_sql('toonx')}),
    {_resampled('vt')}, {_bounds_sql('vt', ('cost',))}, {_resampled('vb')}, {_bounds_sql('vb', ('change',))}, {_resampled('bb')}, {_bounds_sql('bb', ('change',))},
    m AS (SELECT vt_b.model, cost_hi < 0 AS cheaper, x.rank < y.rank AS worse FROM vt_b JOIN (SELECT model, {RANK_SQL} AS rank FROM vb_b) x USING (model) JOIN (SELECT model, {RANK_SQL} AS rank FROM bb_b) y USING (model))
    SELECT 'tabular' AS variant, count_if(cheaper) AS cheaper, count_if(worse) AS worse, count_if(cheaper) >= 3 AND count_if(worse) = 0 AS adopted FROM m"""
)
def primer_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a variant adopted: cheaper on three models by the whole interval, ranked worse on none."""
    said = R.primer_adopted(R.primer_report(records(spark, sf_dir), "tabular", "toonx", RESAMPLES), keys=())
    return said.select(F.lit("tabular").alias("variant"), "cheaper", "worse", "adopted")


@query(f"WITH {COUNTED} SELECT coalesce(dataset, 'all') AS dataset, " + ", ".join(f"sum(input_tokens) FILTER (format = '{f}')::BIGINT AS \"{f}\"" for f in FORMATS) + " FROM k GROUP BY ROLLUP (dataset)")
def format_token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.format_tokens(records(spark, sf_dir), FORMATS)


@query(f"WITH r AS ({RECORDS}), q AS (SELECT DISTINCT question_id, kind FROM r WHERE question_id % 2 = 0) SELECT question_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY question_id) AS rn FROM q) WHERE rn <= 7")
def limit_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the questions that a list names, the first seven of each kind."""
    every = records(spark, sf_dir).select("question_id", "kind").distinct()
    wanted = spark.range(0, 400, 2).select(F.col("id").alias("question_id"))
    return R.limited(every.join(wanted, "question_id", "left_semi"), "kind", "question_id", 7)


@query(f"WITH r AS ({RECORDS}) SELECT model, format, count(*) AS sent, count_if(error IS NOT NULL) AS failed, count_if(error IS NULL AND correct) AS correct, count_if(format IN ('toonx', 'tabular')) AS encoded FROM r GROUP BY ALL")
def drive_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).groupBy("model", "format").agg(
        F.count("*").alias("sent"), F.count_if(~R.succeeded()).alias("failed"), F.count_if(R.succeeded() & F.col("correct")).alias("correct"), F.count_if(F.col("format").isin("toonx", "tabular")).alias("encoded")
    )
