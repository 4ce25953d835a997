"""Reading and writing logs, policies, tables and manifests."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

USAGE = "struct<InputTokens int, OutputTokens int, CachedInputTokens int>"
AGREEMENT = "struct<agree boolean, exact_match boolean, tool_calls_equal boolean, field_agreement double, text_equal boolean>"
PAIR = (
    "id string, time string, kind string, tenant_id string, route_id string, model string, codec string, codec_version string, "
    f"agreement {AGREEMENT}, control_agreement {AGREEMENT}, agreement_cb {AGREEMENT}, usage_a {USAGE}, usage_b {USAGE}, usage_c {USAGE}, "
    "latency_a_ms bigint, latency_b_ms bigint, latency_c_ms bigint, tier1_a boolean, tier1_b boolean, tier1_c boolean, err_a string, err_b string, err_c string"
)
#: States are written as numbers: 0 OFF, 1 SHADOW, 2 ENABLED, 3 MANUAL.
STATES = ("OFF", "SHADOW", "ENABLED", "MANUAL")
TRANSITION = (
    "time string, tenant_id string, route_id string, policy_version string, from int, to int, reason string, stats struct<N int, AgreeTreatment double, AgreeControl double, "
    "Diff double, SE double, B int, C int, McNemarP double, MeasuredSavings double, InputSavings double, OutputChange double, LatencyRatio double>"
)
AUDIT = (
    "time string, tenant_id string, route_id string, policy_version string, route_state string, subject string, provider string, model string, status int, latency_ms bigint, "
    "sent string, fell_back boolean, codec string, codec_version string, sent_sha256 string, est_savings double, "
    "gates array<struct<transform boolean, failed_gate string, reason string, json_tokens int, enc_tokens int>>, "
    f"usage {USAGE}, tier1 struct<ok boolean, violations array<struct<step string, tool string, call_id string, rule string, message string>>>, request_redacted string, parse_error string"
)
RECORD = (
    "provider string, model string, dataset string, rows int, seed bigint, question_id string, kind string, question string, format string, answer string, reply string, correct boolean, "
    "input_tokens int, output_tokens int, reasoning_tokens int, reasoning_estimated boolean, latency_ms bigint, started string, finish_reason string, representation string, empty boolean, error string"
)
JUDGED = (
    "provider string, model string, question_id string, kind string, judge string, labels map<string,string>, grades map<string,struct<errors array<string>, complete int>>, "
    "same map<string,boolean>, reply string, input_tokens int, output_tokens int, latency_ms bigint, error string"
)


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; any line that can't be read is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """By Spark's own file systems, so that any store will do."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their place (ordinal: file, block, row; files in order of their names); a missing file is empty,
    lines that can't be read are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).withColumn("ordinal", F.lit(None).cast(PLACE))
    fields = T._parse_datatype_string(schema).add("_bad", "string")
    rows = spark.read.schema(fields).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    # The _bad column has to be read with others.
    return rows.withColumn("ordinal", place()).where(F.col("_bad").isNull()).drop("_bad")


PLACE = "struct<file string, block bigint, row bigint>"


def place() -> Column:
    """Where a row of a file source stands: rows rise within a block, blocks within a file. Spark deals files to tasks by
    their size, so a row's number alone says nothing about the order of files."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, each a row: path, pos (from 0 within its file), line. Files are split in blocks like any table;
    the window that numbers a file's lines spills."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), place().alias("p"), F.col("value").alias("line"))
    pos = F.row_number().over(Window.partitionBy("path").orderBy("p")) - 1
    return rows.select("path", pos.alias("pos"), F.regexp_replace("line", "\r$", "").alias("line"))


#: Settings of a route with their defaults.
SETTINGS = {
    "version": "1", "codec": "", "schema_mode": "STRICT", "state": "OFF", "min_payload_tokens": 200, "min_net_savings": 0.15, "output_price_ratio": 4.0,
    "shadow_sample_rate": 0.05, "audit_sample_rate": 0.01, "allow_fallback_retry": False, "auto_detect_data": False, "allow_union": False, "validate": False,
    "enable_raw_payload_logging": False,
}
OTHER = {"tenant_id", "route_id", "tool_schemas", "output_schema", "rules", "redact_keys"}
MODES = ("STRICT", "UNION")


class PolicyError(ValueError):
    """A policy file doesn't hold what it may hold."""


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Routes of a policy file, {"routes": [...]}. The schema is closed: unknown settings are an error, as are states and
    modes of other names (any case) and negative price ratios. An empty tenant is any tenant ("*")."""
    texts = [r.value for r in spark.read.text(path, wholetext=True).collect()]
    from ..functions import jsonlex as J

    rows = []
    for text in texts:
        found = J.parse(text)
        if not isinstance(found, dict) or set(found) - {"routes"}:
            raise PolicyError("a policy file holds routes only")
        for r in found.get("routes") or []:
            if unknown := set(r) - set(SETTINGS) - OTHER:
                raise PolicyError(f"unknown settings: {sorted(unknown)}")
            if not r.get("route_id"):
                raise PolicyError("a route has no route_id")
            row = {k: _typed(r.get(k), v) for k, v in SETTINGS.items()}
            row["state"], row["schema_mode"] = str(row["state"]).upper(), str(row["schema_mode"]).upper()
            if row["state"] not in STATES or row["schema_mode"] not in MODES:
                raise PolicyError(f"{r['route_id']}: {row['state']} or {row['schema_mode']} is no state or mode")
            if row["output_price_ratio"] < 0:
                raise PolicyError("a price ratio is negative")
            rows.append({"tenant_id": r.get("tenant_id") or "*", "route_id": r["route_id"], **row, "rules": list(r.get("rules") or []), "redact_keys": list(r.get("redact_keys") or [])})
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(["tenant_id string", "route_id string", *(f"{k} {kinds[type(v)]}" for k, v in SETTINGS.items()), "rules array<string>", "redact_keys array<string>"])
    return spark.createDataFrame(rows, schema)


def _typed(given: object, default: object) -> object:
    if given is None or given == "":
        return default
    if isinstance(default, bool) != isinstance(given, bool):
        raise PolicyError(f"{given!r} isn't like {default!r}")
    return type(default)(given)


def read_sse(spark: SparkSession, path: str) -> DataFrame:
    """Payloads of `data:` lines of stream files, in order: path, pos, data."""
    rows = read_lines(spark, path)
    return rows.where(F.startswith("line", F.lit("data:"))).select("path", "pos", F.trim(F.substr("line", F.lit(6))).alias("data"))


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Escaped TSV tables, a row for each cell: path, row (0 is the header), col, cell; short rows are filled up."""
    cells = read_lines(spark, path).withColumnRenamed("pos", "row")
    cells = cells.withColumn("cells", F.split("line", "\t"))
    width = F.max(F.size("cells")).over(Window.partitionBy("path"))
    wide = cells.withColumn("width", width).withColumn("cells", F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells"))))
    flat = wide.select("path", "row", F.posexplode("cells").alias("col", "cell"))
    return flat.withColumn("cell", unescaped(F.col("cell")))


def unescaped(text: Column) -> Column:
    """Escapes of line breaks, bars and backslashes undone."""
    return F.replace(F.replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit("\\p"), F.lit("|")), F.lit("\x00"), F.lit("\\"))


def read_manifest(spark: SparkSession, path: str, items: str, schema: str) -> DataFrame:
    """The list `items` of JSON documents, a row each."""
    return spark.read.schema(f"{items} array<struct<{schema}>>").option("multiLine", True).json(path).select(F.explode(items).alias("i")).select("i.*")


def registered(payloads: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Payloads that a manifest names, with its checksum; one that is missing or differs is an error when rows are read."""
    met = manifest.select(*keys, F.col("sha256").alias("_want")).join(payloads.withColumn("sha256", F.sha2("body", 256)), list(keys), "left")
    wrong = F.raise_error(F.concat(F.lit("checksum differs or payload is missing: "), F.concat_ws("/", *keys)))
    return met.withColumn("body", F.when(F.col("sha256") == F.col("_want"), F.col("body")).otherwise(wrong)).drop("_want")


def append_lines(rows: DataFrame, path: str) -> None:
    """JSON lines, appended; nulls are left out as zero values are in the logs."""
    rows.write.mode("append").json(path)


def write_manifest(payloads: DataFrame, path: str, body: str = "body") -> None:
    """Name, size and checksum of each payload."""
    payloads.withColumns({"sha256": F.sha2(body, 256), "bytes": F.octet_length(body)}).drop(body).write.mode("overwrite").json(path)


def dump(rows: DataFrame, path: str, by: str) -> None:
    """A folder for each value of `by`."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def markdown(rows: DataFrame, limit: int = 1000) -> str:
    """A report's table as text; reports are aggregates of a few rows."""
    found = rows.limit(limit).collect()
    shown = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [rows.columns, ["---"] * len(rows.columns), *([shown(v) for v in r] for r in found)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def table_json(cells: DataFrame) -> DataFrame:
    """Tables read by read_tables() as tools return them: path, rows, json (an array of objects, keys in the order of the
    columns, every cell a string). Column names that repeat are numbered."""
    from ..functions.columns import json_string

    seen = F.row_number().over(Window.partitionBy("path", "cell").orderBy("col"))
    heads = cells.where("row = 0").withColumn("_n", seen)
    heads = heads.select("path", "col", json_string(F.when(F.col("_n") > 1, F.concat_ws("_", "cell", F.col("_n").cast("string"))).otherwise(F.col("cell"))).alias("_key"))
    named = cells.where("row > 0").join(heads, ["path", "col"]).select("path", "row", "col", F.concat("_key", F.lit(":"), json_string(F.col("cell"))).alias("_cell"))
    lines = named.groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct("col", "_cell"))).alias("c"))
    lines = lines.select("path", "row", F.concat(F.lit("{"), F.array_join(F.transform("c", lambda x: x["_cell"]), ","), F.lit("}")).alias("line"))
    whole = lines.groupBy("path").agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.struct("row", "line"))).alias("r"))
    return whole.select("path", "rows", F.concat(F.lit("["), F.array_join(F.transform("r", lambda x: x["line"]), ","), F.lit("]")).alias("json"))


def load_questions(spark: SparkSession, folder: str, split: str, n: int = 0, min_rows: int = 0, seed: int = 0) -> DataFrame:
    """Questions of a split with their tables: id, question, answers, canon, table, rows, json, in order of id.

    The question file is tab-separated with a header; a question names its table as a .csv whose escaped form lies beside
    it as .tsv. Tables of fewer than min_rows rows are left out; n > 0 draws a sample by a hash of the seed and the id."""
    from ..operators.records import sample_by_id

    lines = read_lines(spark, f"{folder.rstrip('/')}/tagged/data/{split}.tagged")
    head = lines.where("pos = 0").select(F.split("line", "\t").alias("h")).first()
    columns = {c: i for i, c in enumerate(head.h)} if head else {}
    if lacking := [c for c in ("id", "utterance", "context", "targetValue", "targetCanon") if c not in columns]:
        raise ValueError(f"the question file has no column {', '.join(lacking)}")
    fields = lines.where("pos > 0").select(F.split("line", "\t").alias("f")).where(F.size("f") >= len(columns))
    field = lambda c: F.get("f", F.lit(columns[c]))
    listed = lambda c: F.transform(F.split(field(c), "\\|"), unescaped)
    asked = fields.select(
        field("id").alias("id"), field("utterance").alias("question"), listed("targetValue").alias("answers"), listed("targetCanon").alias("canon"),
        F.concat(F.regexp_replace(field("context"), "\\.csv$", ""), F.lit(".tsv")).alias("table"),
    )
    tables = table_json(read_tables(spark, f"{folder.rstrip('/')}/csv/*")).withColumn("table", F.regexp_extract("path", "(csv/[^/]+/[^/]+|csv/[^/]+)$", 1))
    met = asked.join(tables.where(F.col("rows") >= min_rows).select("table", "rows", "json"), "table")
    return sample_by_id(met, "id", n, F.xxhash64(F.lit(seed), "id"))


def question_sets(items: DataFrame) -> DataFrame:
    """Loaded questions as data sets of one table and one question each."""
    return items.select(
        F.concat(F.lit("wtq-"), "id").alias("dataset_id"), F.lit("wtq").alias("dataset"), "rows", F.lit("lookup_table").alias("tool"), F.lit("{}").alias("tool_args"), F.col("json").alias("raw"),
        F.col("id").alias("question_id"), F.lit("wtq").alias("kind"), "question", F.array_join("answers", " | ").alias("answer"), "answers", "canon",
    )


def payload_sets(payloads: DataFrame, manifest: DataFrame | None = None, seed: str = "1") -> DataFrame:
    """Questions over payloads (set, api, name, url, body): those a manifest registers, by its checksums, or where there is
    none those that the gates would encode. A row for each question: dataset_id, question_id, kind, question, answer."""
    from ..functions.lazy import arrow_udf
    from ..functions.questions import payload_questions
    from ..operators.payloads import evaluated

    @arrow_udf("array<struct<kind string, text string, answer string>>")
    def asked(texts: pd.Series, seeds: pd.Series) -> pd.Series:
        return pd.Series([payload_questions(t, s) for t, s in zip(texts, seeds, strict=True)])

    keys = ["set", "api", "name"]
    if manifest is not None:
        kept = registered(payloads, manifest, keys)
    else:
        kept = evaluated(payloads.withColumnRenamed("body", "json"), "toonx").where("eligible").withColumnRenamed("json", "body")
    name = F.concat_ws("-", F.lit("payload"), "api", "name")
    rows = kept.select(*keys, name.alias("dataset_id"), F.posexplode(asked("body", F.concat_ws("/", F.lit(seed), *keys))).alias("_k", "q"))
    return rows.select(*keys, "dataset_id", F.concat("dataset_id", F.lit("-q"), (F.col("_k") + 1).cast("string")).alias("question_id"), F.col("q.kind").alias("kind"), F.col("q.text").alias("question"), F.col("q.answer").alias("answer"))


def free_form_sets(payloads: DataFrame, seed: str = "1") -> DataFrame:
    """One open task for each payload (set, api, name, body): payloads in the order of a hash take the kinds in turn."""
    from ..functions.lazy import arrow_udf
    from ..functions.questions import task_of

    @arrow_udf("struct<id string, kind string, text string>")
    def asked(texts: pd.Series, names: pd.Series, places: pd.Series) -> pd.DataFrame:
        found = [task_of(t, n, int(p), f"{seed}/{n}") or {} for t, n, p in zip(texts, names, places, strict=True)]
        return pd.DataFrame([[q.get(c) for c in ("id", "kind", "text")] for q in found], columns=["id", "kind", "text"])

    # Payload sets are benchmarks of some dozens; the window numbers them.
    order = Window.orderBy(F.xxhash64(F.lit(seed), "set", "api", "name"), "set", "api", "name")
    rows = payloads.withColumn("_k", F.row_number().over(order) - 1)
    found = rows.select("set", "api", "name", asked("body", F.concat_ws("-", "api", "name"), "_k").alias("q"))
    return found.where(F.col("q.id").isNotNull()).select("set", "api", "name", F.col("q.id").alias("question_id"), F.col("q.kind").alias("kind"), F.col("q.text").alias("question"))


class TableStore:
    """Samples as a table of JSON lines that grows."""

    def __init__(self, path: str, schema: str = PAIR):
        self.path, self.schema = path, schema

    def add(self, rows: DataFrame) -> None:
        append_lines(rows, self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return read_tolerant(spark, self.path, self.schema)


def log_sink(path: str):
    """A sink for a stream's batches (foreachBatch): appends them as JSON lines, a batch that comes again only once."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={number}")

    return put


def report_json(sections: dict[str, DataFrame], limit: int = 1000) -> str:
    """A report's sections, each an aggregate of a few rows, as one JSON document."""
    import json

    return json.dumps({name: [json.loads(x) for x in rows.limit(limit).toJSON().collect()] for name, rows in sections.items()}, ensure_ascii=False, sort_keys=True)


#: Reports by name: their sections in order, with the title of each.
REPORTS = {
    "tokens": {"token_report": "Tokens by data set"},
    "format_tokens": {"format_token_report": "Input tokens by format"},
    "live": {"live_go_nogo": "Go or no-go"},
    "verify": {"verify_report": "Accuracy and tokens", "multi_turn": "Multi-turn projection", "savings_by_dataset": "Input savings by data set", "primer_rule": "Primer variant", "calls_table": "Calls"},
    "promotion": {"promotion_replay_first_change": "Promotion replay"},
    "datapoints": {"datapoints_pivot_flag": "Questions", "failed_calls": "Failed calls"},
    "free_form": {"free_form_report": "Quality, agreement and tokens"},
    "payloads": {"overall": "All payloads", "by_api": "By API", "payloads": "Payloads"},
}


def report_text(name: str, sections: dict[str, DataFrame], limit: int = 1000) -> str:
    """A report as text: the sections that are given, in the report's order, each a titled table."""
    titles = REPORTS[name]
    return "\n\n".join(f"### {titles[k]}\n\n{markdown(sections[k], limit)}" for k in titles if k in sections) + "\n"
