"""Requests, responses and streams as rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonlex as J
from ..functions import messages as M
from ..functions.extensions import COMPARATORS
from ..functions.lazy import arrow_udf
from .agreement import compared

if "default" not in COMPARATORS:
    COMPARATORS.register("default", compared)

BLOCKS = "array<struct<msg int, part int, kind string, role string, text string, tool string, call_id string, data string, is_error boolean>>"


@arrow_udf(BLOCKS)
def request_blocks(bodies: pd.Series) -> pd.Series:
    """Blocks of a request; null if it can't be read."""

    def one(body):
        try:
            return None if body is None else list(M.blocks_of(body))
        except (J.JsonError, AttributeError, TypeError, KeyError):
            return None

    return bodies.map(one)


def blocks(requests: DataFrame, request: str, body: str) -> DataFrame:
    """A row for each block of each request."""
    return requests.select(request, F.explode(request_blocks(body)).alias("b")).select(request, "b.*")


def data_blocks(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin("tool_result", "marked_data") & F.col("data").isNotNull() & ~F.col("is_error"))


def marked(rows: DataFrame, header: Column) -> DataFrame:
    """Texts that the header names, as "3,5:1" (message, or message:part), as marked data; other items are skipped."""
    items = F.transform(F.split(header, ","), lambda x: F.trim(x))
    whole = F.col("msg").cast("string")
    named = F.array_contains(items, F.concat_ws(":", whole, F.col("part").cast("string"))) | (F.array_contains(items, whole) & (F.col("part") == 0))
    return rows.withColumn("kind", F.when((F.col("kind") == "text") & named, F.lit("marked_data")).otherwise(F.col("kind")))


@arrow_udf("array<struct<start bigint, end bigint, label string, data string>>")
def data_spans(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [dict(zip(("start", "end", "label", "data"), s, strict=True)) for s in M.data_spans(t)])


@arrow_udf("struct<text string, calls string, output_tokens bigint>")
def stream_text(bodies: pd.Series) -> pd.DataFrame:
    found = [M.assemble(b) for b in bodies]
    return pd.DataFrame([(f["text"], json.dumps(f["calls"]), f["usage"].get("output_tokens", f["usage"].get("completion_tokens"))) for f in found], columns=["text", "calls", "output_tokens"])


def assembled(bodies: DataFrame, key: str, body: str) -> DataFrame:
    return bodies.select(key, stream_text(body).alias("s")).select(key, "s.text", "s.output_tokens")


@arrow_udf("string")
def rendered(bodies: pd.Series, msgs: pd.Series, parts: pd.Series, texts: pd.Series, primers: pd.Series) -> pd.Series:
    """Requests with one result's text replaced and the primer added."""
    return pd.Series([M.with_result(*x) for x in zip(bodies, msgs, parts, texts, primers, strict=True)])


@arrow_udf("string")
def redacted(texts: pd.Series) -> pd.Series:
    return texts.map(M.redacted)


def within_amount(amount: Column, limit: str) -> Column:
    return amount <= F.lit(limit).cast("decimal(38,18)")


def checked(calls: DataFrame, contract: dict, context: dict) -> DataFrame:
    """calls (request_id, name, args) with violations; a request passes if none of its calls has any."""

    @arrow_udf("array<struct<step string, message string>>")
    def found(names: pd.Series, args: pd.Series) -> pd.Series:
        return pd.Series([[{"step": s, "message": m} for s, m in M.violations({"name": n, "args": a}, contract, context)] for n, a in zip(names, args, strict=True)])

    return calls.withColumn("violations", found("name", "args"))


USAGE = "struct<usage struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, prompt_tokens bigint, completion_tokens bigint, prompt_tokens_details struct<cached_tokens bigint>>>"


def usage(body: Column) -> Column:
    """Input (with what was cached), output and cached tokens of a response in either format."""
    u = F.from_json(body, USAGE)["usage"]
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    read = zero(u["cache_read_input_tokens"])
    prompt = u["prompt_tokens"]
    return F.struct(
        F.coalesce(prompt, zero(u["input_tokens"]) + read + zero(u["cache_creation_input_tokens"])).alias("input_tokens"),
        zero(F.coalesce(u["completion_tokens"], u["output_tokens"])).alias("output_tokens"),
        F.when(prompt.isNotNull(), zero(u["prompt_tokens_details"]["cached_tokens"])).otherwise(read).alias("cached_tokens"),
    )


VIOLATIONS = "array<struct<step string, tool string, call_id string, rule string, message string>>"


def validated(responses: DataFrame, contract: dict, context: dict | None = None, declared: str | None = None, wants_output: str | None = None) -> DataFrame:
    """responses (body, and columns that tell the declared tools, the caller's context and whether output was asked for)
    with violations and ok: all calls and the output pass, or the response fails as a whole."""

    @arrow_udf(VIOLATIONS)
    def found(bodies: pd.Series, tools: pd.Series, contexts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for body, names, own, asked in zip(bodies, tools, contexts, wanted, strict=True):
            try:
                response = M.response_of(body)
            except (J.JsonError, AttributeError, TypeError) as e:
                out.append([{"step": "contract", "tool": None, "call_id": None, "rule": None, "message": f"response: {e}"}])
                continue
            caller = json.loads(own) if own else context or {}
            out.append(M.validated(response, contract, caller, None if names is None else set(names), bool(asked)))
        return pd.Series(out)

    tools = F.col(declared) if declared else F.lit(None).cast("array<string>")
    caller = F.col("context") if "context" in responses.columns else F.lit(None).cast("string")
    rows = responses.withColumn("violations", found("body", tools, caller, F.col(wants_output) if wants_output else F.lit(False)))
    return rows.withColumn("ok", F.size("violations") == 0)


@arrow_udf("string")
def non_streaming(bodies: pd.Series) -> pd.Series:
    """Requests that don't stream; null for what is no request."""

    def one(body):
        try:
            return None if body is None else M.non_streaming(body)
        except J.JsonError:
            return None

    return bodies.map(one)


def identified(headers: Column, mode: str, key: bytes = b"", now: float = 0.0) -> Column:
    """The security context of a request's headers (a map), or null."""

    @arrow_udf("struct<tenant_id string, subject string, scopes array<string>, resource_constraints map<string, array<string>>>")
    def found(texts: pd.Series) -> pd.DataFrame:
        fields = ["tenant_id", "subject", "scopes", "resource_constraints"]
        got = [M.identified(json.loads(t) if t else {}, mode, key, now) or dict.fromkeys(fields) for t in texts]
        return pd.DataFrame([[g[f] for f in fields] for g in got], columns=fields)

    who = found(F.to_json(headers))
    return F.when(who["tenant_id"].isNotNull(), who)


RESPONSE = "struct<text string, names array<string>, args array<string>, structured string, input_tokens bigint, output_tokens bigint>"


@arrow_udf(RESPONSE)
def response_parts(bodies: pd.Series) -> pd.DataFrame:
    """What is compared of a response; nulls for what can't be read."""

    def one(body):
        try:
            r = M.response_of(body)
        except (J.JsonError, AttributeError, TypeError):
            return [None] * 6
        n_in, n_out, _ = M.usage_of({"usage": r["usage"]})
        return [r["text"], [c["name"] for c in r["calls"]], [c["args"] for c in r["calls"]], r["structured"], int(n_in), int(n_out)]

    return pd.DataFrame([one(b) if b is not None else [None] * 6 for b in bodies], columns=["text", "names", "args", "structured", "input_tokens", "output_tokens"])


def samples(arms: DataFrame, key: str, comparator: str = "default") -> DataFrame:
    """Three-arm samples from logged calls: arms (key, arm A, B or C, status, body, latency_ms, error) give, for each key,
    the agreements of A with B, A with C and C with B, usage, latency and errors; agreements are null unless all arms have
    an answer. One shuffle brings a key's arms together."""
    answered = (F.col("status") == 200) & F.col("body").isNotNull()
    failed = F.coalesce(F.col("error"), F.when(~answered, F.concat(F.lit("HTTP "), F.col("status").cast("string"))), F.lit(""))
    one = F.struct(F.when(answered, F.col("body")).alias("body"), "latency_ms", failed.alias("err"))
    wide = arms.groupBy(key).pivot("arm", ["A", "B", "C"]).agg(F.first(one))
    rows = wide.select(key, *[F.col(f"{x}.{f}").alias(f"{f}_{x.lower()}") for x in "ABC" for f in ("body", "latency_ms", "err")])
    parsed = rows.withColumns({f"p_{x}": response_parts(f"body_{x}") for x in "abc"})
    flat = parsed.select("*", *[F.col(f"p_{x}.{f}").alias(f"{x}_{f}") for x in "abc" for f in ("text", "names", "args", "structured", "input_tokens", "output_tokens")])
    valid = F.lit(True)
    for x in "abc":
        valid = valid & F.col(f"p_{x}.text").isNotNull() & (F.coalesce(F.col(f"err_{x}"), F.lit("missing")) == "")
    compare = COMPARATORS[comparator]
    for name, (x, y) in {"agreement": "ab", "control_agreement": "ac", "agreement_cb": "cb"}.items():
        flat = compare(flat, x, y).withColumnRenamed("agreement", f"_{name}")
    names = ("agreement", "control_agreement", "agreement_cb")
    return flat.select(
        key, valid.alias("valid"), *[F.when(valid, F.col(f"_{n}")).alias(n) for n in names],
        *[F.col(f"{x}_{f}_tokens").alias(f"{short}_{x}") for f, short in (("input", "in"), ("output", "out")) for x in "abc"],
        *[F.col(f"latency_ms_{x}").alias(f"lat_{x}") for x in "abc"], *[F.coalesce(f"err_{x}", F.lit("missing")).alias(f"err_{x}") for x in "abc"],
    )


def audit_entries(exchanges: DataFrame) -> DataFrame:
    """Audit rows of exchanges: who, which policy, what was sent and its checksum, gates, usage and checks. Estimated
    savings and the codec's version are told only if something encoded was sent; a request is kept, redacted, only where
    its policy says so."""
    tried = (F.col("sent") == "encoded") | F.col("fell_back")
    gate = lambda b: F.struct(
        b["transform"].alias("transform"), F.when(b["failed_gate"] != "", b["failed_gate"]).alias("failed_gate"), F.when(b["failed_gate"] != "", b["reason"]).alias("reason"),
        b["json_tokens"].alias("json_tokens"), b["enc_tokens"].alias("enc_tokens"),
    )
    return exchanges.select(
        "time", "tenant_id", "route_id", F.col("version").alias("policy_version"), F.col("state").alias("route_state"), "subject", "provider", "model", "status", "latency_ms", "sent", "fell_back",
        "codec", F.when(tried, F.col("codec_version")).alias("codec_version"), F.sha2("sent_body", 256).alias("sent_sha256"), F.when(tried, F.col("net_savings")).alias("est_savings"),
        F.transform("blocks", gate).alias("gates"), "usage", "tier1", F.when(F.col("enable_raw_payload_logging"), redacted("request_body")).alias("request_redacted"), "parse_error",
    )


@arrow_udf("string")
def encoded_by(texts: pd.Series, codecs: pd.Series) -> pd.Series:
    """Payloads in the codec that each row names; null where it doesn't fit or there is no such codec."""
    from ..functions.codecs import CODECS

    def one(text, name):
        try:
            return CODECS[name].encode(J.parse(text)) if text is not None and name in CODECS else None
        except ValueError:
            return None

    return pd.Series([one(t, c) for t, c in zip(texts, codecs, strict=True)])
