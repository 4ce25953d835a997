"""Logs, policies, tables and manifests: each is written to the shared folder, read back by its reader and returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import records as S
from .evidence_queries import EXCHANGES, TRANSITIONS
from .record_queries import COUNTED, GRADED_SQL, RECORDS
from .registry import derived, query, table
from .samples import SAMPLES
from .stream_queries import shared_folder


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/logs/{name}-{uuid.uuid4().hex}"


@query(f"WITH {COUNTED} SELECT model, question_id, format, ordinal, input_tokens, correct FROM k")
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run's log read strictly; the last success of each question counts."""
    from ..operators.records import counted

    path = place(spark, "records")
    rows = derived(spark, sf_dir, RECORDS, "events")
    S.append_lines(rows.withColumnsRenamed({"ordinal": "seed"}).withColumn("question_id", F.col("question_id").cast("string")), path)
    back = S.read_strict(spark, path, S.RECORD).withColumn("ordinal", F.col("seed"))
    return counted(back).select("model", F.col("question_id").cast("long").alias("question_id"), "format", "ordinal", "input_tokens", "correct")


@query(f"SELECT CAST(id AS VARCHAR) AS id, kind, route_id, ab AS agree, ac AS control, in_a, in_b, lat_b, ok_a, coalesce(err_a, '') AS err_a FROM ({SAMPLES})")
def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "pairs")
    rows = derived(spark, sf_dir, SAMPLES, "events")
    S.append_lines(
        rows.select(
            F.col("id").cast("string").alias("id"), "kind", "route_id", F.struct(F.col("ab").alias("agree")).alias("agreement"), F.struct(F.col("ac").alias("agree")).alias("control_agreement"),
            F.struct(F.col("in_a").cast("int").alias("InputTokens")).alias("usage_a"), F.struct(F.col("in_b").cast("int").alias("InputTokens")).alias("usage_b"), F.col("lat_b").alias("latency_b_ms"), F.col("ok_a").alias("tier1_a"), "err_a",
        ), path,
    )
    back = S.read_strict(spark, path, S.PAIR)
    return back.select(
        "id", "kind", "route_id", F.col("agreement.agree").alias("agree"), F.col("control_agreement.agree").alias("control"), F.col("usage_a.InputTokens").alias("in_a"), F.col("usage_b.InputTokens").alias("in_b"),
        F.col("latency_b_ms").alias("lat_b"), F.col("tier1_a").alias("ok_a"), F.coalesce("err_a", F.lit("")).alias("err_a"),
    )


@query(
    f"""WITH t AS ({TRANSITIONS}) SELECT tenant_id, route_id, to_state, id FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, route_id ORDER BY id DESC) AS rn FROM t WHERE id % 4 > 0) WHERE rn = 1"""
)
def read_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of several files with broken lines: the last readable transition of each route, by its place."""
    path = place(spark, "transitions")
    rows = derived(spark, sf_dir, TRANSITIONS, "events")
    line = F.to_json(F.struct(F.col("tenant_id").cast("string").alias("tenant_id"), "route_id", F.col("id").cast("string").alias("time"), F.col("to_state").cast("int").alias("to")))
    rows.repartitionByRange(3, "id").sortWithinPartitions("id").select(F.when(F.col("id") % 4 > 0, line).otherwise(F.substring(line, 1, 20)).alias("value")).write.text(path)
    back = S.read_tolerant(spark, path, S.TRANSITION)
    last = back.groupBy("tenant_id", "route_id").agg(F.max_by(F.struct("to", "time"), "ordinal").alias("t"))
    return last.select(F.col("tenant_id").cast("long").alias("tenant_id"), "route_id", F.col("t.to").cast("long").alias("to_state"), F.col("t.time").cast("long").alias("id"))


@query(f"SELECT route_id, status, sent, count(*) AS requests, sum(input_tokens)::BIGINT AS input_tokens, count_if(failed_gate = 'min-size') AS small FROM ({EXCHANGES}) GROUP BY ALL")
def read_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "audit")
    rows = derived(spark, sf_dir, EXCHANGES, "events")
    gate = F.array(F.struct("failed_gate"))
    S.append_lines(rows.select("route_id", F.col("status").cast("int").alias("status"), "sent", gate.alias("gates"), F.struct(F.col("input_tokens").cast("int").alias("InputTokens")).alias("usage")), path)
    back = S.read_tolerant(spark, path, S.AUDIT)
    return back.groupBy("route_id", "status", "sent").agg(
        F.count("*").alias("requests"), F.sum("usage.InputTokens").cast("long").alias("input_tokens"), F.count_if(F.get("gates", F.lit(0))["failed_gate"] == "min-size").alias("small")
    )


@query(f"{GRADED_SQL} SELECT model, question_id, errors, complete FROM j WHERE error IS NULL")
def read_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "judged")
    rows = derived(spark, sf_dir, GRADED_SQL.removeprefix("WITH j AS (").strip().removesuffix(")"), "events")
    grades = F.create_map(F.lit("toonx"), F.struct(F.transform(F.sequence(F.lit(1), F.greatest(F.col("errors"), F.lit(1)).cast("int")), lambda i: F.concat(F.lit("e"), i.cast("string"))).alias("errors"), F.col("complete").cast("int").alias("complete")))
    S.append_lines(rows.select("model", F.col("question_id").cast("string").alias("question_id"), grades.alias("grades"), "error"), path)
    back = S.read_strict(spark, path, S.JUDGED).where("error IS NULL")
    return back.select("model", F.col("question_id").cast("long").alias("question_id"), F.size("grades.toonx.errors").cast("long").alias("errors"), F.col("grades.toonx.complete").cast("long").alias("complete"))


@query(
    """SELECT CASE WHEN n_nationkey % 3 = 0 THEN '*' ELSE 't' || (n_nationkey % 3) END AS tenant_id, n_name AS route_id, CASE n_nationkey % 3 WHEN 0 THEN 'SHADOW' WHEN 1 THEN 'ENABLED' ELSE 'OFF' END AS state,
    CASE WHEN n_nationkey % 2 = 0 THEN 100 + n_nationkey ELSE 200 END AS min_payload_tokens, 'STRICT' AS schema_mode, 0.15::DOUBLE AS min_net_savings FROM nation"""
)
def read_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A policy file with defaults, any-tenant routes and states in any case."""
    path = place(spark, "policies")
    k = F.col("n_nationkey")
    route = F.to_json(
        F.struct(
            F.when(k % 3 > 0, F.concat(F.lit("t"), (k % 3).cast("string"))).alias("tenant_id"), F.col("n_name").alias("route_id"), F.when(k % 3 == 0, "shadow").when(k % 3 == 1, "Enabled").alias("state"),
            F.when(k % 2 == 0, k + 100).alias("min_payload_tokens"),
        )
    )
    whole = table(spark, sf_dir, "nation").agg(F.concat(F.lit('{"routes":['), F.array_join(F.collect_list(route), ","), F.lit("]}")).alias("value"))
    whole.write.text(path)
    return S.read_policies(spark, path).select("tenant_id", "route_id", "state", "min_payload_tokens", "schema_mode", "min_net_savings")


@query(
    """SELECT 'n' || n_regionkey AS name, count(*) AS rows, '[' || string_agg('{"key":"' || n_nationkey || '","name":"' || n_name || '|x"}', ',' ORDER BY n_nationkey) || ']' AS json FROM nation GROUP BY n_regionkey"""
)
def read_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped tables, one file each, as the JSON that a tool would return."""
    path = place(spark, "tables")
    line = F.concat_ws("\t", F.col("n_nationkey").cast("string"), F.concat("n_name", F.lit("\\px")))
    rows = table(spark, sf_dir, "nation").groupBy(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("name")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("r"))
    rows.select("name", F.concat(F.lit("key\tname\n"), F.array_join(F.transform("r", lambda x: x["l"]), "\n")).alias("value")).write.partitionBy("name").text(path)
    found = S.table_json(S.read_tables(spark, f"{path}/name=*"))
    return found.select(F.regexp_extract("path", "name=([^/]+)/", 1).alias("name"), "rows", "json")


@query("SELECT n_name AS name, sha256(n_name || ' body') AS sha256, n_name || ' body' AS body FROM nation")
def read_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads that a written manifest registers, checked by its checksums."""
    path = place(spark, "manifest")
    bodies = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat("n_name", F.lit(" body")).alias("body"))
    S.write_manifest(bodies, path)
    return S.registered(bodies, spark.read.json(path), ["name"]).select("name", "sha256", "body")


@query("SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS k, n_name AS data FROM nation")
def read_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of the data lines of stream files, in order."""
    from pyspark.sql import Window

    path = place(spark, "streams")
    line = F.concat(F.lit("event: x\ndata: "), F.col("n_name"), F.lit(" \n\n: note"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("r"))
    rows.select("n_regionkey", F.array_join(F.transform("r", lambda x: x["l"]), "\n").alias("value")).write.partitionBy("n_regionkey").text(path)
    back = S.read_sse(spark, f"{path}/n_regionkey=*")
    k = F.row_number().over(Window.partitionBy("path").orderBy("pos")) - 1
    return back.select(F.regexp_extract("path", "n_regionkey=([0-9]+)", 1).cast("long").alias("n_regionkey"), k.cast("long").alias("k"), "data")


@query("SELECT n_regionkey, n_name FROM nation")
def dump_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "dump")
    S.dump(table(spark, sf_dir, "nation").select("n_regionkey", "n_name"), path, "n_regionkey")
    return spark.read.json(path).select(F.col("n_regionkey").cast("long").alias("n_regionkey"), "n_name")


@query("SELECT n_nationkey, n_nationkey % 5 NOT IN (2, 4) AS correct FROM nation")
def score_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that give two values in any order, one in a sentence, a number, a long list of guesses, half of what is wanted."""
    from .record_queries import answered

    k, name = F.col("n_nationkey") % 5, F.lower("n_name")
    two = F.concat(F.col("n_name"), F.lit("|harbour"))
    want = F.when(k.isin(0, 4), two).when(k == 3, F.concat(F.lit("1"), F.col("n_nationkey").cast("string"))).otherwise(F.col("n_name"))
    reply = (
        F.when(k == 0, F.concat(F.lit("Answer: Harbour, "), name)).when(k == 1, F.concat(F.lit("It is "), name, F.lit(", I think."))).when(k == 2, F.concat(F.repeat(F.lit("maybe this one, "), 9), name))
        .when(k == 3, F.concat(F.lit("That makes 1"), F.col("n_nationkey").cast("string"), F.lit(".0 in all"))).otherwise(name)
    )
    return table(spark, sf_dir, "nation").select("n_nationkey", answered(reply, want).alias("correct"))


@query("SELECT p_partkey, p_partkey % 4 IN (0, 1) AS correct FROM part")
def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies in other case, within a short sentence, in a long one, or of something else."""
    from .record_queries import is_correct

    k, brand = F.col("p_partkey") % 4, F.col("p_brand")
    reply = F.when(k == 0, F.upper(brand)).when(k == 1, F.concat(F.lit("It is "), F.lower(brand), F.lit(" here"))).when(k == 2, F.concat(F.repeat(F.lit("perhaps "), 6), brand)).otherwise("none of them")
    return table(spark, sf_dir, "part").select("p_partkey", is_correct(reply, brand, F.lit(False)).alias("correct"))
