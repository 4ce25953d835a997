"""Payloads: encoding grouped rows with column expressions, any payload with Arrow UDFs, and the gates in between."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import extensions
from ..functions import jsonlex as J
from ..functions.codecs import CODECS, Ineligible
from ..functions.codecs.tabular import PRIMER, as_table
from ..functions.columns import tokens
from ..functions.lazy import arrow_udf


@dataclass(frozen=True)
class Policy:
    """What a route asks for."""

    state: str = "ENABLED"
    min_tokens: int = 200
    min_savings: float = 0.15
    primer_tokens: int = (len(PRIMER) + 3) // 4


#: A payload is one cell; beyond this many bytes grouping fails instead of cutting it.
MOST_BYTES = 256 << 20


def grouped_payloads(rows: DataFrame, key: str, order: str, values: dict[str, Column], most_bytes: int = MOST_BYTES) -> DataFrame:
    """Per key: n_rows, json (an array of objects) and encoded (the tabular form) of its rows in order.

    values: each column's JSON text. Columns go in byte order, as in canonical JSON. A payload of more than most_bytes is
    an error.
    """
    names = sorted(values, key=str.encode)
    flat = F.concat(F.lit("["), F.concat_ws(",", *[values[n] for n in names]), F.lit("]"))
    named = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(J.quoted(n) + ":"), values[n]) for n in names]), F.lit("}"))
    lists = rows.select(key, F.struct(F.col(order).alias("o"), named.alias("j"), flat.alias("t")).alias("r")).groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("r"), F.sum(F.octet_length("r.j")).alias("_bytes"))
    too_long = F.raise_error(F.concat(F.lit(f"a payload has more than {most_bytes} bytes: "), F.col(key).cast("string")))
    lists = lists.withColumn("r", F.when(F.col("_bytes") > most_bytes, too_long).otherwise(F.col("r")))
    head = J.write(names)
    return lists.select(
        key,
        F.size("r").cast("long").alias("n_rows"),
        F.concat(F.lit("["), F.array_join(F.transform("r", lambda r: r["j"]), ","), F.lit("]")).alias("json"),
        F.concat(F.lit(head + "\n"), F.array_join(F.transform("r", lambda r: r["t"]), "\n")).alias("encoded"),
    )


def counted(text: Column, counter: str = "heuristic") -> Column:
    """A text's tokens by a registered counter: the heuristic is an expression, others are Arrow UDFs."""
    if counter == "heuristic":
        return tokens(text)
    count = extensions.COUNTERS[counter]

    @arrow_udf("bigint")
    def counts(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else count(t) for t in texts], dtype="Int64")

    return counts(text)


def gated(blocks: DataFrame, policy: Policy = Policy(), counter: str = "heuristic") -> DataFrame:
    """blocks with json_tokens, enc_tokens and the gate that stops each block, if any."""
    rows = blocks.withColumns({"json_tokens": counted(F.col("json"), counter), "enc_tokens": counted(F.col("encoded"), counter)})
    gate = (
        F.when(F.col("encoded").isNull(), "structural")
        .when(F.lit(policy.state) == "OFF", "opt-in")
        .when((F.octet_length("json") < policy.min_tokens) | (F.col("json_tokens") < policy.min_tokens), "min-size")
        .when(F.col("enc_tokens") >= F.col("json_tokens"), "net-savings")
    )
    return rows.withColumn("failed_gate", gate)


def net_savings(json_tokens: Column, enc_tokens: Column, policy: Policy) -> Column:
    return F.when(json_tokens > 0, (json_tokens - enc_tokens - policy.primer_tokens).cast("double") / json_tokens.cast("double")).otherwise(F.lit(0.0))


def request_rollup(blocks: DataFrame, request: str, policy: Policy = Policy()) -> DataFrame:
    """Per request: tokens of the blocks that pass, the primer once, and whether the whole is worth it."""
    passed = F.col("failed_gate").isNull()
    sums = blocks.groupBy(request).agg(
        F.count("*").alias("blocks"), F.count_if(passed).alias("passed"),
        F.coalesce(F.sum(F.when(passed, F.col("json_tokens"))), F.lit(0).cast("long")).alias("json_tokens"),
        F.coalesce(F.sum(F.when(passed, F.col("enc_tokens"))), F.lit(0).cast("long")).alias("enc_tokens"),
    )
    net = net_savings(F.col("json_tokens"), F.col("enc_tokens"), policy)
    return sums.withColumn("net_savings", F.round(net, 9)).withColumn("apply", (F.col("passed") > 0) & (net >= policy.min_savings))


def decided(blocks: DataFrame, request: str, policy: Policy = Policy()) -> DataFrame:
    """Blocks with the last gate: a request that isn't worth it rejects every block that passed until then."""
    w = Window.partitionBy(request)
    passed = F.col("failed_gate").isNull()
    total = lambda c: F.sum(F.when(passed, F.col(c))).over(w)
    poor = passed & (net_savings(total("json_tokens"), total("enc_tokens"), policy) < policy.min_savings)
    return blocks.withColumn("failed_gate", F.when(poor, F.lit("net-savings")).otherwise(F.col("failed_gate"))).withColumn("transform", F.col("failed_gate").isNull())


# Any payload, by Arrow UDFs. Python runs on every row it is given, so filter or null out rows before.

ENCODED = "struct<ok boolean, reason string, canonical string, encoded string>"


def encode_payload(name: str, union: bool = False):
    """A UDF: canonical text and encoding of a JSON payload, or why not. Null in, null out."""
    codec = CODECS[name]

    def one(text: str | None):
        if text is None:
            return None, None, None, None
        try:
            value = J.parse(text)
        except J.JsonError as e:
            return False, f"parse: {e}", None, None
        whole = J.write(value)
        try:
            codec.check(value, union)
            return True, None, whole, codec.both(value, whole, union)[0]
        except Ineligible as e:
            return False, str(e), whole, None

    @arrow_udf(ENCODED)
    def encode(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["ok", "reason", "canonical", "encoded"])

    return encode


def round_trip(name: str):
    """A UDF: a payload's encoding and the canonical JSON that it was decoded to, in one pass; nulls if it doesn't fit."""
    codec = CODECS[name]

    def one(text: str | None):
        try:
            value = J.parse(text) if text is not None else None
            made, back = codec.both(value, J.write(value)) if text is not None else (None, None)
        except ValueError:
            return None, None
        return made, J.write(codec.decode(made)) if back is None and made is not None else back

    @arrow_udf("struct<encoded string, decoded string>")
    def trip(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["encoded", "decoded"])

    return trip


def decode_payload(name: str):
    """A UDF: canonical JSON of an encoded text; null if it doesn't decode."""
    codec = CODECS[name]

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else J.write(codec.decode(text))
        except (Ineligible, J.JsonError):
            return None

    @arrow_udf("string")
    def decode(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return decode


def render_payload(name: str, keeps_order: bool = False):
    """A UDF: a payload's text in a benchmark's format and its primer; nulls where the format can't hold it."""
    from ..functions.rendering import render

    def one(text: str | None):
        try:
            return (None, None) if text is None else render(name, text, keeps_order)
        except ValueError:
            return None, None

    @arrow_udf("struct<text string, primer string>")
    def rendered(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in texts], columns=["text", "primer"])

    return rendered


def evaluated(payloads: DataFrame, codec: str, policy: Policy = Policy(), counter: str = "heuristic") -> DataFrame:
    """Each payload (json) by itself through all gates of a codec: eligible, failed_gate, reason, json_tokens, enc_tokens,
    primer_tokens, pretty_tokens and savings (null if nothing was encoded)."""
    count = lambda c: counted(c, counter)
    rows = payloads.withColumn("_e", encode_payload(codec)("json"))
    gone = policy.__class__(policy.state, policy.min_tokens, policy.min_savings, 0)
    blocks = gated(rows.withColumns({"json": F.coalesce("_e.canonical", "json"), "encoded": F.col("_e.encoded")}), gone, counter)
    primer = F.when(F.col("encoded").isNotNull(), count(render_payload(codec)("json")["primer"])).otherwise(F.lit(0).cast("long"))
    blocks = blocks.withColumn("primer_tokens", primer).withColumn("pretty_tokens", F.coalesce(count(render_payload("json-pretty")("json")["text"]), F.lit(0).cast("long")))
    j, e = F.col("json_tokens"), F.col("enc_tokens") + F.col("primer_tokens")
    savings = F.when((j > 0) & (F.col("enc_tokens") > 0), (j - e).cast("double") / j.cast("double"))
    gate = F.when(F.col("failed_gate").isNotNull(), F.col("failed_gate")).when(savings < policy.min_savings, F.lit("net-savings"))
    return blocks.withColumns({"failed_gate": gate, "savings": savings, "eligible": gate.isNull(), "reason": F.col("_e.reason")}).drop("_e")


def payload_report(evaluated_: DataFrame, api: str, name: str) -> dict[str, DataFrame]:
    """The three parts of a report on evaluated payloads: overall, by API, and each payload."""
    j, e = F.col("json_tokens").cast("double"), (F.col("enc_tokens") + F.col("primer_tokens")).cast("double")
    fine = F.col("eligible")
    own = lambda c: F.sum(F.when(fine, c))
    parts = [
        F.count("*").alias("payloads"), F.count_if(fine).alias("eligible"), F.median(F.when(fine, F.col("savings"))).alias("median_savings"), F.avg(F.when(fine, F.col("savings"))).alias("mean_savings"),
        (1.0 - own(e) / own(j)).alias("weighted_eligible"), (1.0 - F.sum(F.when(fine, e).otherwise(j)) / F.sum(j)).alias("weighted_all"),
    ]
    each = evaluated_.select(api, name, "json_tokens", "enc_tokens", "pretty_tokens", "savings", "failed_gate", "reason")
    return {"overall": evaluated_.agg(*parts), "by_api": evaluated_.groupBy(api).agg(*parts), "payloads": each}


def token_report(payloads: DataFrame, dataset: str, formats: Sequence[str], counter: str = "heuristic", base: str = "json-compact") -> DataFrame:
    """Per data set, and for all, the tokens of its payloads (json) in each format with its primer, and each format's
    change against the base in percent; a payload that a format can't hold makes that format's sum null."""
    sent = lambda f: render_payload(f)("json")
    rows = payloads.select(dataset, *[(counted(sent(f)["text"], counter) + counted(sent(f)["primer"], counter)).alias(f) for f in formats])
    whole = lambda f: F.when(F.count(f"`{f}`") == F.count("*"), F.sum(f"`{f}`")).alias(f)
    sums = rows.rollup(dataset).agg(*[whole(f) for f in formats]).withColumn(dataset, F.coalesce(dataset, F.lit("all")))
    change = lambda f: (100.0 * (F.col(f"`{f}`").cast("double") / F.col(f"`{base}`").cast("double") - 1.0)).alias(f"{f}_percent")
    return sums.select("*", *[change(f) for f in formats if f != base])


def _safe(f):
    def one(text):
        try:
            return None if text is None else f(text)
        except ValueError:
            return None

    return one


@arrow_udf("string")
def canonical_json(texts: pd.Series) -> pd.Series:
    """Null for what isn't strict JSON."""
    return texts.map(_safe(J.canonical))


@arrow_udf("array<string>")
def json_leaves(texts: pd.Series) -> pd.Series:
    """`path=value` of all primitive values."""
    return texts.map(_safe(lambda t: J.leaves(J.parse(t), "out")))


@arrow_udf("struct<ok boolean, reason string>")
def table_check(texts: pd.Series) -> pd.DataFrame:
    def one(text):
        if text is None:
            return None, None
        try:
            as_table(J.parse(text), primitives_only=True)
            return True, None
        except ValueError as e:
            return False, str(e)

    return pd.DataFrame([one(t) for t in texts], columns=["ok", "reason"])


FEATURES = ("absent", "paths", "json", "list", "consts", "prefix", "split")


@arrow_udf(f"struct<{', '.join(f'{x} boolean' for x in FEATURES)}>")
def toonx_features(texts: pd.Series) -> pd.DataFrame:
    found = [CODECS["toonx"].features(t or "") for t in texts]
    return pd.DataFrame([[getattr(f, x) for x in FEATURES] for f in found], columns=list(FEATURES))


def primers(blocks: DataFrame, request: str) -> DataFrame:
    """Per request the primer that its encoded blocks need: the base, and a sentence for each feature any block uses."""
    from ..functions.codecs.toonx import SENTENCES
    from ..functions.codecs.toon import PRIMER as BASE

    used = blocks.withColumn("f", toonx_features("encoded")).groupBy(request).agg(*[F.bool_or(f"f.{x}").alias(x) for x in FEATURES])
    return used.select(request, F.concat(F.lit(BASE), *[F.when(F.col(x), F.lit(SENTENCES[x])).otherwise(F.lit("")) for x in FEATURES]).alias("primer"))


class LeafRows:
    """Rows of a payload's primitive values, for LATERAL json_leaf_rows(text): path and value."""

    def eval(self, text: str | None):
        for leaf in _safe(lambda t: J.leaves(J.parse(t), "out"))(text) or []:
            path, _, value = leaf.partition("=")
            yield path, value


class QuestionRows:
    """Rows of questions about a payload, for LATERAL payload_questions(text, seed): kind, text and answer."""

    def eval(self, text: str | None, seed: str):
        from ..functions.questions import payload_questions

        for q in _safe(lambda t: payload_questions(t, seed))(text) or []:
            yield q["kind"], q["text"], q["answer"]


def register_sql(spark) -> None:
    """canonical_json, json_leaves, table_check, encode_x, decode_x for each codec x and render_payload_f for each format f
    (dashes as underscores), and the table functions json_leaf_rows and payload_questions, for use in SQL text."""
    from ..functions.rendering import FORMATS

    spark.udtf.register("json_leaf_rows", F.udtf(LeafRows, returnType="path string, value string"))
    spark.udtf.register("payload_questions", F.udtf(QuestionRows, returnType="kind string, text string, answer string"))
    for name in FORMATS:
        spark.udf.register(f"render_payload_{name.replace('-', '_')}", render_payload(name).udf())
    for name, f in {"canonical_json": canonical_json, "json_leaves": json_leaves, "table_check": table_check}.items():
        spark.udf.register(name, f.udf())
    for name in CODECS:
        spark.udf.register(f"encode_{name}", encode_payload(name).udf())
        spark.udf.register(f"decode_{name}", decode_payload(name).udf())


# Relational forms of what the codecs do inside a payload.


def constant_columns(rows: DataFrame, key: str, columns: Sequence[str], least: int = 3) -> DataFrame:
    """Per key the columns that have one value in each of `least` or more rows."""
    same = [((F.count_distinct(c) == 1) & (F.count(c) == F.count("*")) & (F.count("*") >= least)).alias(c) for c in columns]
    found = rows.groupBy(key).agg(F.count("*").alias("n_rows"), *same)
    return found.select(key, "n_rows", F.concat_ws(",", *[F.when(F.col(c), F.lit(c)) for c in columns]).alias("constant"))


def url_prefixes(rows: DataFrame, key: str, url: str, least: int = 3) -> DataFrame:
    """Per key the start that all URLs share, up to a slash beyond the scheme: that of the least and the greatest."""
    ends = rows.groupBy(key).agg(F.count(url).alias("n"), F.min(url).alias("a"), F.max(url).alias("b"))
    places = F.sequence(F.lit(1), F.greatest(F.length("a"), F.lit(1)))
    same = F.size(F.filter(places, lambda i: F.substring("a", F.lit(1), i) == F.substring("b", F.lit(1), i)))
    start = F.regexp_extract(F.substring("a", F.lit(1), same), r"^(https?://.*/)", 1)
    cut = F.when((F.col("n") >= least) & (F.length(start) > F.locate("://", "a") + 2), start).otherwise(F.lit(""))
    return ends.select(key, "n", cut.alias("prefix"))


def vertical_parts(rows: DataFrame, payload: str, order: str, columns: Sequence[str], width: int = 7) -> DataFrame:
    """Long form of wide tables, one for each payload, cut into parts of at most `width` columns: payload, row number
    (the same in all parts of a payload, so that they join on it), the part's name and its values."""
    parts = [columns[k : k + width] for k in range(0, len(columns), width)]
    cells = [F.struct(F.lit(f"part{k + 1}").alias("part"), F.concat_ws("|", *[F.col(c).cast("string") for c in p]).alias("cells")) for k, p in enumerate(parts)]
    numbered = rows.withColumn("row_no", F.row_number().over(Window.partitionBy(payload).orderBy(order)))
    return numbered.select(payload, "row_no", F.explode(F.array(*cells)).alias("p")).select(payload, "row_no", "p.part", "p.cells")


def coverage(blocks: DataFrame, group: str, policy: Policy = Policy()) -> DataFrame:
    """Per group: payloads, how many are eligible, and token-weighted savings of those and of all."""
    j, e = F.col("json_tokens"), F.col("enc_tokens") + policy.primer_tokens
    fine = F.col("failed_gate").isNull() & (net_savings(F.col("json_tokens"), F.col("enc_tokens"), policy) >= policy.min_savings)
    share = lambda cost, base: F.round(F.when(base > 0, 1.0 - cost.cast("double") / base.cast("double")).otherwise(F.lit(0.0)), 9)
    own = lambda c: F.coalesce(F.sum(F.when(fine, c)), F.lit(0).cast("long"))
    return blocks.groupBy(group).agg(
        F.count("*").alias("payloads"), F.count_if(fine).alias("eligible"),
        share(own(e), own(j)).alias("weighted_eligible"), share(F.sum(F.when(fine, e).otherwise(j)), F.sum(j)).alias("weighted_all"),
    )




def largest_blocks(blocks: DataFrame, request: str, body: str, order: str, most: int = 1 << 20) -> DataFrame:
    """Per request its largest block of up to `most` bytes, the first among equals: what calibration counts."""
    size = F.octet_length(body)
    kept = blocks.where(size <= most).groupBy(request).agg(F.max_by(F.struct(order, body), F.struct(size.alias("size"), (-F.col(order)).alias("o"))).alias("b"))
    return kept.select(request, f"b.{order}", f"b.{body}")
