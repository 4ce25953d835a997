"""Payloads made from the orders, parts and events tables: encoding, gates, token reports, wire data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.codecs.toon import PRIMER as BASE
from ..functions.codecs.toonx import SENTENCES
from ..functions.rendering import CSV_PRIMER
from ..operators import payloads as P
from ..operators import wire as W
from .registry import derived, query, table

PRIMER = P.Policy().primer_tokens
PAYLOADS = r"""
p AS (SELECT o_custkey, count(*) AS n_rows,
  '[' || string_agg('{"amount":' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ',"day":"' || strftime(o_orderdate, '%Y-%m-%d') || '","id":' || o_orderkey || ',"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}', ',' ORDER BY o_orderkey) || ']' AS json,
  '["amount","day","id","priority","status"]' || chr(10) || string_agg('[' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ',"' || strftime(o_orderdate, '%Y-%m-%d') || '",' || o_orderkey || ',"' || o_orderpriority || '","' || o_orderstatus || '"]', chr(10) ORDER BY o_orderkey) AS encoded
  FROM orders GROUP BY o_custkey),
g AS (SELECT *, (strlen(json) + 3) // 4 AS json_tokens, (strlen(encoded) + 3) // 4 AS enc_tokens FROM p),
b AS (SELECT *, CASE WHEN strlen(json) < 200 OR json_tokens < 200 THEN 'min-size' WHEN enc_tokens >= json_tokens THEN 'net-savings' END AS failed_gate FROM g)
"""


def order_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload for each customer: the customer's orders."""
    values = {
        "id": F.col("o_orderkey").cast("string"),
        "amount": F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        "day": C.json_string(F.date_format("o_orderdate", "yyyy-MM-dd")),
        "priority": C.json_string(F.col("o_orderpriority")),
        "status": C.json_string(F.col("o_orderstatus")),
    }
    return P.grouped_payloads(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", values)


@query(f"WITH {PAYLOADS} SELECT o_custkey, n_rows, sha256(json) AS json_sha, sha256(encoded) AS encoded_sha FROM p")
def tabular_encode_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_payloads(spark, sf_dir).select("o_custkey", "n_rows", F.sha2("json", 256).alias("json_sha"), F.sha2("encoded", 256).alias("encoded_sha"))


@query(
    f"""WITH {PAYLOADS}, d AS (SELECT *, CASE WHEN failed_gate IS NULL AND (json_tokens - enc_tokens - {PRIMER})::DOUBLE / json_tokens < 0.15 THEN 'net-savings' ELSE failed_gate END AS gate FROM b)
    SELECT o_custkey, n_rows, json_tokens, enc_tokens, gate AS failed_gate, gate IS NULL AS transform, sha256(encoded) AS encoded_sha FROM d"""
)
def gates_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's payload through the gates, a request of its own."""
    blocks = P.decided(P.gated(order_payloads(spark, sf_dir)), "o_custkey")
    return blocks.select("o_custkey", "n_rows", "json_tokens", "enc_tokens", "failed_gate", "transform", F.sha2("encoded", 256).alias("encoded_sha"))


@query(
    f"""WITH {PAYLOADS}, s AS (SELECT o_custkey % 200 AS request_id, count(*) AS blocks, count_if(failed_gate IS NULL) AS passed,
    coalesce(sum(CASE WHEN failed_gate IS NULL THEN json_tokens END), 0)::BIGINT AS json_tokens, coalesce(sum(CASE WHEN failed_gate IS NULL THEN enc_tokens END), 0)::BIGINT AS enc_tokens FROM b GROUP BY 1),
    n AS (SELECT *, CASE WHEN json_tokens > 0 THEN (json_tokens - enc_tokens - {PRIMER})::DOUBLE / json_tokens ELSE 0 END AS net FROM s)
    SELECT request_id, blocks, passed, json_tokens, enc_tokens, round(net, 9) AS net_savings, passed > 0 AND net >= 0.15 AS apply FROM n"""
)
def gates_request_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = P.gated(order_payloads(spark, sf_dir)).withColumn("request_id", F.col("o_custkey") % 200)
    return P.request_rollup(blocks, "request_id")


@query(
    f"""WITH {PAYLOADS}, f AS (SELECT *, failed_gate IS NULL AND (json_tokens - enc_tokens - {PRIMER})::DOUBLE / json_tokens >= 0.15 AS fine FROM b)
    SELECT o_custkey % 7 AS api, count(*) AS payloads, count_if(fine) AS eligible,
    round(CASE WHEN coalesce(sum(CASE WHEN fine THEN json_tokens END), 0) > 0 THEN 1 - sum(CASE WHEN fine THEN enc_tokens + {PRIMER} END)::DOUBLE / sum(CASE WHEN fine THEN json_tokens END)::DOUBLE ELSE 0 END, 9) AS weighted_eligible,
    round(1 - sum(CASE WHEN fine THEN enc_tokens + {PRIMER} ELSE json_tokens END)::DOUBLE / sum(json_tokens)::DOUBLE, 9) AS weighted_all FROM f GROUP BY 1"""
)
def payload_weighted_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coverage(P.gated(order_payloads(spark, sf_dir)).withColumn("api", F.col("o_custkey") % 7), "api")


@query(
    f"""WITH {PAYLOADS} SELECT o_custkey % 7 AS api, count_if(failed_gate IS NULL) AS passes, count_if(failed_gate = 'min-size') AS min_size, count_if(failed_gate = 'net-savings') AS net_savings FROM b GROUP BY 1"""
)
def payload_coverage_by_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.gated(order_payloads(spark, sf_dir)).select((F.col("o_custkey") % 7).alias("api"), F.coalesce("failed_gate", F.lit("passes")).alias("g"))
    found = rows.groupBy("api").pivot("g", ["passes", "min-size", "net-savings"]).agg(F.count(F.lit(1))).fillna(0)
    return found.withColumnsRenamed({"min-size": "min_size", "net-savings": "net_savings"})


@query(
    f"""WITH {PAYLOADS} SELECT CASE WHEN grouping(o_custkey % 5) = 1 THEN 'all' ELSE 'set' || (o_custkey % 5) END AS dataset, count(*) AS payloads, sum(json_tokens)::BIGINT AS json_tokens, sum(enc_tokens)::BIGINT AS enc_tokens,
    round(100 * (sum(enc_tokens)::DOUBLE / sum(json_tokens)::DOUBLE - 1), 9) AS percent FROM b GROUP BY ROLLUP (o_custkey % 5)"""
)
def token_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.gated(order_payloads(spark, sf_dir)).withColumn("k", F.col("o_custkey") % 5)
    sums = rows.rollup("k").agg(F.count("*").alias("payloads"), F.sum("json_tokens").alias("json_tokens"), F.sum("enc_tokens").alias("enc_tokens"), F.grouping("k").alias("g"))
    percent = F.round(100.0 * (F.col("enc_tokens").cast("double") / F.col("json_tokens").cast("double") - 1.0), 9)
    return sums.select(F.when(F.col("g") == 1, F.lit("all")).otherwise(F.concat(F.lit("set"), F.col("k").cast("string"))).alias("dataset"), "payloads", "json_tokens", "enc_tokens", percent.alias("percent"))


@query("SELECT doc_id, (strlen(text) + 3) // 4 AS tokens, CAST(floor((strlen(text) + 3) // 4 * 1.07::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS estimate FROM documents")
def token_heuristic_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = C.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("tokens"), C.calibrated(n, F.lit(1.07)).alias("estimate"))


@query(
    """WITH r AS (SELECT n_regionkey, n_nationkey, n_name, CASE WHEN n_nationkey % 3 <> 0 THEN '"' || n_name || '"' ELSE 'null' END AS name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS VARCHAR) ELSE 'null' END AS even FROM nation)
    SELECT n_regionkey, '["even","id","name"]' || chr(10) || string_agg('[' || even || ',' || n_nationkey || ',' || name || ']', chr(10) ORDER BY n_nationkey) AS encoded FROM r GROUP BY 1"""
)
def tabular_union_fill_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a key get a null cell under the union of all rows' keys."""
    rows = table(spark, sf_dir, "nation")
    row = F.to_json(F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey")).alias("even"), F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name")))
    payload = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("j")))).alias("r"))
    text = F.concat(F.lit("["), F.array_join(F.transform("r", lambda r: r["j"]), ","), F.lit("]"))
    return payload.select("n_regionkey", P.encode_payload("tabular", union=True)(text)["encoded"].alias("encoded"))


@query(
    """SELECT event_id, CASE event_id % 5 WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN FALSE ELSE TRUE END AS ok, CASE event_id % 5 WHEN 1 THEN 'row 1 lacks ''a''' WHEN 2 THEN 'column ''a'' mixes number and string' WHEN 3 THEN 'row 0 has a nested ''a''' END AS reason FROM events"""
)
def table_check_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ['[{"a":%s},{"a":null}]', '[{"a":%s},{"b":1}]', '[{"a":%s},{"a":"x"}]', '[{"a":[%s]}]', '[{"a":%s,"b":"x"},{"a":2,"b":"y"}]']
    picked = F.element_at(F.array(*[F.lit(x) for x in forms]), (F.col("event_id") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.replace(picked, F.lit("%s"), F.col("user_id").cast("string")).alias("j"))
    return rows.select("event_id", P.table_check("j").alias("t")).select("event_id", "t.ok", "t.reason")


CONST = ("o_orderstatus", "o_orderpriority")


@query(
    """SELECT o_custkey, count(*) AS n_rows, concat_ws(',', CASE WHEN count(DISTINCT o_orderstatus) = 1 AND count(o_orderstatus) = count(*) AND count(*) >= 3 THEN 'o_orderstatus' END,
    CASE WHEN count(DISTINCT o_orderpriority) = 1 AND count(o_orderpriority) = count(*) AND count(*) >= 3 THEN 'o_orderpriority' END) AS constant FROM orders GROUP BY 1"""
)
def constant_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.constant_columns(table(spark, sf_dir, "orders"), "o_custkey", CONST)


@query(
    r"""WITH h AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages), e AS (SELECT host, count(url) AS n, min(url) AS a, max(url) AS b FROM h GROUP BY host),
    l AS (SELECT *, len(list_filter(range(1, length(a) + 1), lambda i: a[1:i] = b[1:i])) AS same FROM e), s AS (SELECT *, regexp_extract(a[1:same], '^(https?://.*/)', 1) AS start FROM l)
    SELECT host, n, CASE WHEN n >= 3 AND length(start) > instr(a, '://') + 2 THEN start ELSE '' END AS prefix FROM s"""
)
def url_prefix_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), "url")
    return P.url_prefixes(rows, "host", "url")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no FROM orders)
    SELECT o_custkey, row_no, 'part1' AS part, concat_ws('|', o_orderkey, o_orderstatus) AS cells FROM r UNION ALL SELECT o_custkey, row_no, 'part2', o_orderpriority FROM r"""
)
def split_wide_part_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.vertical_parts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", ("o_orderkey", "o_orderstatus", "o_orderpriority"), width=2)


@query("SELECT event_id, replace(props, ' ', '') AS canonical FROM events")
def canonical_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.canonical_json("props").alias("canonical"))


NUMBERS = "CASE event_id % 9 WHEN 0 THEN '-0' WHEN 1 THEN '01' WHEN 2 THEN '1.' WHEN 3 THEN '1e+5' WHEN 4 THEN '.5' WHEN 5 THEN '-12.50E-3' WHEN 6 THEN '+1' WHEN 7 THEN concat(CAST(event_id AS VARCHAR(20)), '') ELSE 'NaN' END"


@query(f"SELECT event_id, {NUMBERS} AS literal FROM events WHERE regexp_matches({NUMBERS}, '^-?(0|[1-9][0-9]*)(\\.[0-9]+)?([eE][+-]?[0-9]+)?$')")
def number_literal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir, f"SELECT event_id, {NUMBERS} AS literal FROM events", "events")
    return rows.where(C.is_number_literal(F.col("literal")))


@query(
    """SELECT n_regionkey, 'id,name' || chr(10) || string_agg(n_nationkey || ',' || n_name, chr(10) ORDER BY n_nationkey) AS csv FROM nation GROUP BY 1"""
)
def csv_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.to_csv(F.struct("n_nationkey", "n_name"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("r"))
    return rows.select("n_regionkey", F.concat(F.lit("id,name\n"), F.array_join(F.transform("r", lambda r: r["l"]), "\n")).alias("csv"))


@query(
    """WITH s AS (SELECT user_id, event_type, list_distinct(list(props)) AS l FROM events GROUP BY ALL)
    SELECT a.user_id, round(CASE WHEN len(list_distinct(list_concat(a.l, b.l))) = 0 THEN 1 ELSE len(list_intersect(a.l, b.l))::DOUBLE / len(list_distinct(list_concat(a.l, b.l))) END, 9) AS jaccard
    FROM s a JOIN s b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'view'"""
)
def json_leaves_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field agreement of two payloads: the leaves they share."""
    leaves = table(spark, sf_dir, "events").select("user_id", "event_type", F.explode(P.json_leaves("props")).alias("leaf"))
    sets = leaves.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.collect_set("leaf")).where((F.size("click") > 0) & (F.size("view") > 0))
    return sets.select("user_id", F.round(C.jaccard(F.col("click"), F.col("view")), 9).alias("jaccard"))


#: The notation of flat tables whose cells need no quotes: all columns in each row, or those that all of three or more
#: rows share once ahead of them, whichever takes fewer bytes.
TOONX = """
o AS (SELECT o_custkey, o_orderkey, [CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), strftime(o_orderdate, '%Y-%m-%d'), CAST(o_orderkey AS VARCHAR), o_orderpriority, o_orderstatus] AS c FROM orders),
f AS (SELECT o_custkey, count(*) AS n, [count(*) >= 3 AND count(DISTINCT c[1]) = 1, count(*) >= 3 AND count(DISTINCT c[2]) = 1, count(*) >= 3 AND count(DISTINCT c[3]) = 1, count(*) >= 3 AND count(DISTINCT c[4]) = 1, count(*) >= 3 AND count(DISTINCT c[5]) = 1] AS same, any_value(c) AS one FROM o GROUP BY 1),
h AS (SELECT *, ['amount', 'day', 'id', 'priority', 'status'] AS names, list_filter([1, 2, 3, 4, 5], lambda i: NOT same[i]) AS kept, list_filter([1, 2, 3, 4, 5], lambda i: same[i]) AS told FROM f),
x AS (SELECT o_custkey, any_value(n) AS n, any_value(len(told)) AS told, any_value(array_to_string(names, ',')) AS head, any_value(array_to_string(list_transform(kept, lambda i: names[i]), ',')) AS short_head,
  any_value('all rows: ' || array_to_string(list_transform(told, lambda i: names[i] || '=' || one[i]), ',')) AS line,
  string_agg(chr(10) || '  ' || array_to_string(c, ','), '' ORDER BY o_orderkey) AS whole, string_agg(chr(10) || '  ' || array_to_string(list_transform(kept, lambda i: c[i]), ','), '' ORDER BY o_orderkey) AS short FROM o JOIN h USING (o_custkey) GROUP BY o_custkey),
y AS (SELECT *, told > 0 AND strlen(short_head) + strlen(line) + 1 + strlen(short) < strlen(head) + strlen(whole) AS factored FROM x),
e AS (SELECT o_custkey, factored, '[' || n || ']{' || CASE WHEN factored THEN short_head || '}:' || chr(10) || '  ' || line || short ELSE head || '}:' || whole END AS encoded FROM y)
"""


@query(f"WITH {TOONX} SELECT o_custkey, TRUE AS ok, sha256(encoded) AS encoded_sha, strlen(encoded) AS bytes FROM e")
def toonx_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_payloads(spark, sf_dir).select("o_custkey", P.encode_payload("toonx")("json").alias("e"))
    return rows.select("o_custkey", "e.ok", F.sha2("e.encoded", 256).alias("encoded_sha"), F.octet_length("e.encoded").alias("bytes"))


@query(f"WITH {PAYLOADS} SELECT o_custkey, sha256(json) AS json_sha FROM p")
def toonx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded, every payload is what it was."""
    return order_payloads(spark, sf_dir).select("o_custkey", F.sha2(P.round_trip("toonx")("json")["decoded"], 256).alias("json_sha"))


@query(f"WITH {PAYLOADS} SELECT o_custkey, sha256(json) AS json_sha FROM p")
def tabular_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_payloads(spark, sf_dir).select("o_custkey", F.sha2(P.decode_payload("tabular")("encoded"), 256).alias("json_sha"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(f"WITH {TOONX} SELECT o_custkey % 50 AS request_id, {_literal(BASE)} || CASE WHEN bool_or(factored) THEN {_literal(SENTENCES['consts'])} ELSE '' END AS primer FROM e GROUP BY 1")
def toonx_features_primer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_payloads(spark, sf_dir).select((F.col("o_custkey") % 50).alias("request_id"), P.encode_payload("toonx")("json")["encoded"].alias("encoded"))
    return P.primers(rows, "request_id")


_ROW = """chr(10) || '  {' || chr(10) || '    "id": ' || n_nationkey || ',' || chr(10) || '    "name": "' || n_name || '"' || chr(10) || '  }'"""


@query(
    f"""SELECT n_regionkey, '[' || string_agg({_ROW}, ',' ORDER BY n_nationkey) || chr(10) || ']' AS pretty, '[' || string_agg('{{"name":"' || n_name || '","id":' || n_nationkey || '}}', ',' ORDER BY n_nationkey) || ']' AS as_sent,
    '[' || string_agg('{{"id":' || n_nationkey || ',"name":"' || n_name || '"}}', ',' ORDER BY n_nationkey) || ']' AS compact FROM nation GROUP BY 1"""
)
def render_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A payload pretty-printed, as its source sent it, and in canonical form."""
    row = F.concat(F.lit('{"name": "'), F.col("n_name"), F.lit('",\n "id": '), F.col("n_nationkey").cast("string"), F.lit("}"))
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("j")))).alias("r"))
    text = F.concat(F.lit("[ "), F.array_join(F.transform("r", lambda r: r["j"]), " , "), F.lit("]"))
    made = lambda name, order=False: P.render_payload(name, order)(text)["text"]
    return lists.select("n_regionkey", made("json-pretty").alias("pretty"), made("gateway", True).alias("as_sent"), made("json-compact").alias("compact"))


@query(
    """SELECT n_regionkey, 'items[' || count(*) || ']:' || string_agg(chr(10) || '  - id: ' || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN chr(10) || '    name: ' || n_name ELSE '' END, '' ORDER BY n_nationkey) AS encoded
    FROM nation GROUP BY 1 HAVING count(DISTINCT n_nationkey % 2) = 2"""
)
def toon_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of different keys, which the public notation writes as a list."""
    row = F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name")))
    lists = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", row.alias("j")))).alias("r"), F.count_distinct(F.col("n_nationkey") % 2).alias("k")).where("k = 2")
    text = F.concat(F.lit('{"items":['), F.array_join(F.transform("r", lambda r: r["j"]), ","), F.lit("]}"))
    return lists.select("n_regionkey", P.encode_payload("toon")(text)["encoded"].alias("encoded"))


EVALUATED = f"""{PAYLOADS}, {TOONX.strip()},
ev AS (SELECT o_custkey, json_tokens, (strlen(e.encoded) + 3) // 4 AS enc, (strlen({_literal(BASE)} || CASE WHEN factored THEN {_literal(SENTENCES['consts'])} ELSE '' END) + 3) // 4 AS pr, strlen(json) AS size FROM g JOIN e USING (o_custkey)),
ew AS (SELECT *, (json_tokens - enc - pr)::DOUBLE / json_tokens AS savings FROM ev),
ex AS (SELECT *, CASE WHEN size < 200 OR json_tokens < 200 THEN 'min-size' WHEN enc >= json_tokens OR savings < 0.15 THEN 'net-savings' END AS gate FROM ew)"""


@query(f"WITH {EVALUATED} SELECT o_custkey, json_tokens, enc AS enc_tokens, pr AS primer_tokens, gate AS failed_gate, gate IS NULL AS eligible, round(savings, 9) AS savings FROM ex")
def payload_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each payload by itself through the gates of the indented codec, its own primer counted."""
    rows = P.evaluated(order_payloads(spark, sf_dir).select("o_custkey", "json"), "toonx")
    return rows.select("o_custkey", "json_tokens", "enc_tokens", "primer_tokens", "failed_gate", "eligible", F.round("savings", 9).alias("savings"))


@query(
    f"""WITH {EVALUATED} SELECT o_custkey % 7 AS api, count(*) AS payloads, count_if(gate IS NULL) AS eligible, round(median(CASE WHEN gate IS NULL THEN savings END), 9) AS median_savings, round(avg(CASE WHEN gate IS NULL THEN savings END), 9) AS mean_savings,
    round(1 - sum(CASE WHEN gate IS NULL THEN enc + pr END)::DOUBLE / sum(CASE WHEN gate IS NULL THEN json_tokens END)::DOUBLE, 9) AS weighted_eligible, round(1 - sum(CASE WHEN gate IS NULL THEN enc + pr ELSE json_tokens END)::DOUBLE / sum(json_tokens)::DOUBLE, 9) AS weighted_all FROM ex GROUP BY 1"""
)
def payload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = P.evaluated(order_payloads(spark, sf_dir).select((F.col("o_custkey") % 7).alias("api"), F.col("o_custkey").alias("name"), "json"), "toonx")
    rows = P.payload_report(found, "api", "name")["by_api"]
    return rows.withColumns({c: F.round(c, 9) for c in ("median_savings", "mean_savings", "weighted_eligible", "weighted_all")})


@query(
    f"""WITH {EVALUATED}, t AS (SELECT o_custkey, ex.json_tokens, enc + pr AS toonx, enc_tokens + {PRIMER} AS tabular, (strlen(json) + 36 * n_rows + 4) // 4 AS pretty, (strlen(head) + strlen(whole) - 2 * n + 3) // 4 + {(len(CSV_PRIMER) + 3) // 4} AS csv FROM ex JOIN g USING (o_custkey) JOIN x USING (o_custkey))
    SELECT CASE WHEN grouping(o_custkey % 5) = 1 THEN 'all' ELSE 'set' || (o_custkey % 5) END AS dataset, sum(pretty)::BIGINT AS pretty, sum(json_tokens)::BIGINT AS compact, sum(toonx)::BIGINT AS toonx, sum(tabular)::BIGINT AS tabular, sum(csv)::BIGINT AS csv, round(100 * (sum(pretty)::DOUBLE / sum(json_tokens)::DOUBLE - 1), 9) AS pretty_percent, round(100 * (sum(csv)::DOUBLE / sum(json_tokens)::DOUBLE - 1), 9) AS csv_percent,
    round(100 * (sum(toonx)::DOUBLE / sum(json_tokens)::DOUBLE - 1), 9) AS toonx_percent, round(100 * (sum(tabular)::DOUBLE / sum(json_tokens)::DOUBLE - 1), 9) AS tabular_percent FROM t GROUP BY ROLLUP (o_custkey % 5)"""
)
def token_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each data set in five forms, primers counted, with changes against the plain one in percent."""
    rows = P.token_report(order_payloads(spark, sf_dir).withColumn("dataset", F.concat(F.lit("set"), (F.col("o_custkey") % 5).cast("string"))), "dataset", ("json-pretty", "json-compact", "toonx", "tabular", "csv"))
    rows = rows.withColumnsRenamed({"json-compact": "compact", "json-pretty": "pretty", "json-pretty_percent": "pretty_percent"})
    return rows.withColumns({c: F.round(c, 9) for c in ("pretty_percent", "toonx_percent", "tabular_percent", "csv_percent")})


# Wire data.


@query(
    f"""WITH {PAYLOADS} SELECT o_custkey, 'tool_result' AS kind, sha256(json) AS data_sha FROM p WHERE o_custkey % 3 = 0 UNION ALL
    SELECT o_custkey, 'marked_data', sha256(json) FROM p WHERE o_custkey % 3 = 1"""
)
def datablocks_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with data: tool results that aren't errors, and marked texts."""
    rows = order_payloads(spark, sf_dir)
    k = F.col("o_custkey") % 3
    kind = F.when(k == 0, "tool_result").when(k == 1, "marked_data").otherwise("text")
    blocks = rows.select("o_custkey", kind.alias("kind"), F.when(k < 2, F.col("json")).alias("data"), F.lit(False).alias("is_error"))
    bad = blocks.withColumns({"is_error": F.lit(True), "kind": F.lit("tool_result")})
    return W.data_blocks(blocks.unionByName(bad)).select("o_custkey", "kind", F.sha2("data", 256).alias("data_sha"))


@query(f"WITH {PAYLOADS} SELECT o_custkey, 'json' AS label, sha256(json) AS data_sha, 13::BIGINT AS start FROM p")
def detect_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_payloads(spark, sf_dir)
    text = F.concat(F.lit("See:\n```json\n"), F.col("json"), F.lit("\n```\nand\n```python\nx = []\n```\n"))
    spans = rows.select("o_custkey", text.alias("text")).select("o_custkey", F.explode(W.data_spans("text")).alias("s"))
    return spans.select("o_custkey", "s.label", F.sha2("s.data", 256).alias("data_sha"), F.col("s.start").alias("start"))


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, max(turn) AS output_tokens FROM conversations GROUP BY conv_id")
def sse_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams of deltas, one event a line, folded into their text and last usage."""
    delta = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.col("text")).alias("delta")))
    usage = F.to_json(F.struct(F.lit("message_delta").alias("type"), F.struct(F.col("turn").alias("output_tokens")).alias("usage")))
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("event: x\ndata: "), delta, F.lit("\n\ndata:"), usage, F.lit("\n")).alias("l"))
    bodies = lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"]), "\n").alias("body"))
    return W.assembled(bodies, "conv_id", "body")


@query(f"WITH {PAYLOADS} SELECT o_custkey, sha256('{{\"messages\":[{{\"content\":[{{\"content\":' || to_json(encoded)::VARCHAR || ',\"tool_use_id\":\"t1\",\"type\":\"tool_result\"}}],\"role\":\"user\"}}],\"model\":\"m\",\"system\":\"primer\"}}') AS body_sha FROM p")
def render_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request with its tool result replaced by the encoding, and the primer as system text."""
    rows = order_payloads(spark, sf_dir)
    made = lambda **fields: F.named_struct(*[x for k, v in fields.items() for x in (F.lit(k), v)])
    part = made(type=F.lit("tool_result"), tool_use_id=F.lit("t1"), content=F.col("json"))
    body = F.to_json(made(model=F.lit("m"), messages=F.array(made(role=F.lit("user"), content=F.array(part)))))
    return rows.select("o_custkey", F.sha2(W.rendered(body, F.lit(0), F.lit(0), F.col("encoded"), F.lit("primer")), 256).alias("body_sha"))


@query("SELECT event_id, '{\"a\":[{\"api_key\":\"[REDACTED]\",\"n\":' || user_id || '}],\"password\":\"[REDACTED]\"}' AS redacted FROM events")
def redact_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"password":{"x":1},"a":[{"api_key":"'), F.col("event_type"), F.lit('","n":'), F.col("user_id").cast("string"), F.lit("}]}"))
    return table(spark, sf_dir, "events").select("event_id", W.redacted(text).alias("redacted"))


@query(
    """SELECT event_id, event_type || ':read' AS scope, list_contains(CASE WHEN user_id % 2 = 0 THEN ['click:*', 'view:read'] ELSE ['error:read'] END, event_type || ':read')
    OR list_contains(CASE WHEN user_id % 2 = 0 THEN ['click:*', 'view:read'] ELSE ['error:read'] END, event_type || ':*') AS allowed FROM events"""
)
def scope_authz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scopes = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("click:*"), F.lit("view:read"))).otherwise(F.array(F.lit("error:read")))
    wanted = F.concat("event_type", F.lit(":read"))
    return table(spark, sf_dir, "events").select("event_id", wanted.alias("scope"), C.has_scope(scopes, wanted).alias("allowed"))


@query("SELECT o_orderkey, o_totalprice <= 250000 AS allowed FROM orders")
def max_amount_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", W.within_amount(F.col("o_totalprice").cast("decimal(38,18)"), "250000").alias("allowed"))


@query(f"WITH {PAYLOADS}, l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY strlen(json) DESC, o_custkey) AS rn FROM p WHERE strlen(json) <= 1048576) SELECT o_custkey % 200 AS request_id, o_custkey, sha256(json) AS json_sha FROM l WHERE rn = 1")
def calibration_largest_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = order_payloads(spark, sf_dir).withColumn("request_id", F.col("o_custkey") % 200)
    return P.largest_blocks(blocks, "request_id", "json", "o_custkey").select("request_id", "o_custkey", F.sha2("json", 256).alias("json_sha"))


@query(
    """SELECT event_id, regexp_replace(CAST(CAST(event_id * 37 % 100000 AS DECIMAL(18,2)) / 100 AS DECIMAL(18,2))::VARCHAR, '\\.?0+$', '') AS money, 'part' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0') AS part,
    CASE WHEN event_id % 3 = 0 THEN 'json' ELSE 'toonx; est_savings=0.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') END AS representation FROM events"""
)
def display_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    cents = e * 37 % 100000
    codec = F.when(e % 3 != 0, F.lit("toonx"))
    return table(spark, sf_dir, "events").select("event_id", C.money(cents).alias("money"), C.part_name(e % 12 + 1, F.lit(12)).alias("part"), C.representation(codec, (e % 1000).cast("double") / 1000).alias("representation"))


@query(r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) IN ('thther.example.org', 'm.ththth.example.net') AS allowed FROM pages")
def endpoint_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", C.allowed_host(F.col("url"), ["thther.example.org", "m.ththth.example.net"]).alias("allowed"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 100 + user_id + event_id % 7 + event_id % 3 ELSE 100 + user_id END AS input_tokens, event_id % 11 AS output_tokens, event_id % 7 AS cached_tokens FROM events")
def response_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of responses in either format: one counts cached input apart, the other within."""
    e, u = F.col("event_id"), F.col("user_id") + 100
    one = F.to_json(F.struct(F.struct(u.alias("input_tokens"), (e % 7).alias("cache_read_input_tokens"), (e % 3).alias("cache_creation_input_tokens"), (e % 11).alias("output_tokens")).alias("usage")))
    two = F.to_json(F.struct(F.struct(u.alias("prompt_tokens"), (e % 11).alias("completion_tokens"), F.struct((e % 7).alias("cached_tokens")).alias("prompt_tokens_details")).alias("usage")))
    return table(spark, sf_dir, "events").select("event_id", W.usage(F.when(e % 2 == 0, one).otherwise(two)).alias("u")).select("event_id", "u.*")


@query(
    """SELECT event_id, event_id % 3 <> 1 AS agree, event_id % 3 <> 1 AND event_id % 2 = 0 AS exact_match, event_id % 3 <> 1 AS tool_calls_equal, CASE WHEN event_id % 3 = 1 THEN 0.5::DOUBLE ELSE 1 END AS field_agreement, event_id % 2 = 0 AS text_equal FROM events"""
)
def compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms with the same call written differently, or another argument; the same structured output; other texts."""
    from ..operators.agreement import compared

    e, u = F.col("event_id"), F.col("user_id").cast("string")
    args = F.concat(F.lit('{"id":'), u, F.lit(',"type":"'), F.col("event_type"), F.lit('"}'))
    other = F.concat(F.lit('{ "type": "'), F.col("event_type"), F.lit('", "id": '), F.when(e % 3 == 1, F.lit("-1")).otherwise(u), F.lit("}"))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("Done  now").alias("a_text"), F.when(e % 2 == 0, F.lit("done now")).otherwise(F.lit("done")).alias("b_text"),
        F.array(F.lit("list")).alias("a_names"), F.array(F.lit("list")).alias("b_names"), F.array(args).alias("a_args"), F.array(other).alias("b_args"),
        F.lit('{"ok":true}').alias("a_structured"), F.lit('{"ok": true}').alias("b_structured"),
    )
    return compared(rows, "a", "b").select("event_id", "agreement.*")
