"""Secret scans in Spark SQL: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two first-order Markov chains over the characters of ALPHABET, one of random strings and one of ordinary identifiers,
are trained by counting the character pairs of labelled samples. A candidate (a run of 20 or more such characters that
touches no base span) is a secret if the ratio of its likelihoods exceeds `threshold` thousandths of a nat for each
pair. Ratios are whole thousandths, so that sums don't depend on their order. Everything is Spark SQL expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed patterns. Of assign, the second group holds the value.
ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Words that ordinary identifiers are made of.
WORDS = (
    "account action address after allow array async atom author average back backup balance base batch before begin binary block border "
    "bottom bound branch buffer build button byte cache call cancel center chain change channel char check child class clean clear click "
    "client clone close cluster code collect color column commit compare compile component compress compute config connect console "
    "container content context control convert copy core count create current cursor custom data date debug decode default define delete "
    "depth detail device digest direct disable display document domain download driver edit element email enable encode end engine entity "
    "entry environment error event example exception execute exist expand export extend external factory field file filter final find "
    "first flag float flush folder format frame function generate global graph group handle handler header height hidden history host "
    "image import index info initial inner input insert instance integer interface internal interval invalid item iterator join kernel "
    "label language last layer layout length level library limit line link list listener load local location lock logger lookup manager "
    "margin master match matrix maximum member memory menu merge message method minimum model module mouse name native network node number "
    "object offset open operator option order output owner package page panel parameter parent parse partition password path pattern "
    "payload pending pixel player plugin point policy pool port position prefix previous print private process profile progress project "
    "property provider proxy public query queue random range read record reference refresh region register release remote remove render "
    "repeat replace report request require reset resolve resource response result return role root route row rule sample scale schedule "
    "schema scope screen script search section select send sequence server service session setting shape share shift simple size socket "
    "sort source split stack start state status step stop storage store stream string style submit suffix switch symbol sync system table "
    "target task template test text thread time title token tool total track transaction transform tree trigger type union unique update "
    "upload user utility valid value variable vector version view virtual visible wait warning width window word worker wrapper write"
)
THRESHOLD = 250


SPANS = "array<struct<start:int,kind:string,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def matched(text: Column, pattern: str, groups: int, value: int, kind: str, least: int) -> Column:
    """Leftmost non-overlapping matches of a pattern (with `groups` groups of its own) as an array of (start, kind,
    end), from 0, in code points; those whose group `value` is shorter than `least` are dropped.

    The text is cut into gaps and matches; places are sums of the lengths before. The n pieces are summed in some
    sqrt(n) runs, first the runs' lengths and then within each run, so that no list of n spans grows one by one.
    """
    cutter = F.lit(rf"(?s)(.*?)(?:({pattern})|\z)")
    cut = lambda group: F.regexp_extract_all(text, cutter, F.lit(group))
    cuts = F.arrays_zip(cut(1).alias("gap"), cut(2).alias("hit"), cut(2 + value).alias("value"))
    sized = lambda pieces: F.transform(
        pieces, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("hit"), (F.length(p["value"]) >= least).alias("kept"))
    )

    def in_runs(pieces: Column) -> Column:
        run = F.ceil(F.sqrt(F.size(pieces).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / run).cast("int")), lambda k: F.slice(pieces, k * run + 1, run))

    def with_starts(runs: Column) -> Column:
        length = lambda run: F.aggregate(run, F.lit(0), lambda n, p: n + p["gap"] + p["hit"])
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        step = lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts"))
        return F.arrays_zip(runs.alias("run"), F.aggregate(F.transform(runs, length), begin, step, lambda a: a["starts"]).alias("start"))

    def spans(run: Column) -> Column:
        def step(a: Column, p: Column) -> Column:
            begin = a["at"] + p["gap"]
            end = begin + p["hit"]
            span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
            found = F.when((p["hit"] > 0) & p["kept"], F.concat(a["found"], F.array(span))).otherwise(a["found"])
            return F.struct(end.alias("at"), found.alias("found"))

        start = F.struct(run["start"].alias("at"), F.array().cast(SPANS).alias("found"))
        return F.aggregate(run["run"], start, step, lambda a: a["found"])

    return _let(_let(sized(cuts), in_runs), lambda runs: F.flatten(F.transform(with_starts(runs), spans)))


def _below(places: Column, value: Column) -> Column:
    """How many of some sorted places lie below a value, by halving."""
    start = F.struct(F.lit(0).alias("low"), F.size(places).alias("high"))

    def step(a: Column, _: Column) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        right = (a["low"] < a["high"]) & (F.get(places, middle) < value)
        return F.struct(F.when(right, middle + 1).otherwise(a["low"]).alias("low"), F.when(right | (a["low"] >= a["high"]), a["high"]).otherwise(middle).alias("high"))

    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(places) + F.lit(1.0))).cast("int"))
    return F.aggregate(rounds, start, step, lambda a: a["low"])


def _free(runs: Column, base: Column) -> Column:
    """The runs that touch no base span: as many base spans begin before a run's end as end by its start."""
    starts, ends = (F.array_sort(F.transform(base, lambda b: b[c])) for c in ("start", "end"))
    free = lambda places: F.filter(
        runs, lambda r: _below(places["starts"], r["end"]) == _below(places["ends"], r["start"] + 1)
    )
    return F.when(F.size(base) == 0, runs).otherwise(_let(F.struct(starts.alias("starts"), ends.alias("ends")), free))


def _none() -> Column:
    return F.array().cast(SPANS)


def _samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """Labelled samples: random strings from digests in three alphabets, identifiers of two to four words in four styles."""
    rows = spark.range(0, n, 1, 1)
    digest = F.sha2(F.concat(F.lit("s"), F.col("id").cast("string")), 256)
    coded = F.rtrim(F.base64(F.unhex(digest)), F.lit("="))
    shown = F.when(F.col("id") % 3 == 0, digest).when(F.col("id") % 3 == 1, coded).otherwise(F.translate(coded, "+/", "-_"))
    words = F.split(F.lit(WORDS), " ")
    size = F.size(words)
    pick = lambda k: F.get(words, ((F.col("id") * (7919 * k + 104729) + 31 * k) % size).cast("int"))
    made = F.slice(F.array(*[pick(k) for k in range(1, 5)]), F.lit(1), (F.col("id") % 3 + 2).cast("int"))
    camel = F.concat(pick(1), F.array_join(F.transform(F.slice(made, 2, 3), F.initcap), ""))
    style = F.col("id") % 4
    name = F.when(style == 0, camel).when(style == 1, F.array_join(made, "_")).when(style == 2, F.array_join(made, "-")).otherwise(F.upper(F.array_join(made, "_")))
    numbered = F.when(F.col("id") % 5 == 0, F.concat(name, (F.col("id") % 100).cast("string"))).otherwise(name)
    return rows.select(F.explode(F.array(F.struct(F.lit(1).alias("secret"), shown.alias("s")), F.struct(F.lit(0).alias("secret"), numbered.alias("s")))).alias("x")).select("x.*")


def train(spark: SparkSession, samples: DataFrame | None = None) -> list[int]:
    """Log-likelihood ratios, in thousandths, of each pair of ALPHABET's characters, row by row, from labelled samples
    (secret 0 or 1, s); other characters and nulls are passed over."""
    samples = (_samples(spark) if samples is None else samples).select(F.col("secret").cast("int").alias("secret"), F.col("s").cast("string").alias("s"))
    samples = samples.where(F.col("secret").isin(0, 1) & (F.length("s") > 1))
    size = len(ALPHABET)
    at = F.explode(F.sequence(F.lit(1), F.length("s") - 1))
    pairs = samples.select("secret", "s", at.alias("i")).select("secret", F.substring("s", F.col("i"), F.lit(1)).alias("a"), F.substring("s", F.col("i") + 1, F.lit(1)).alias("b"))
    known = F.instr(F.lit(ALPHABET), F.col("a")) * F.instr(F.lit(ALPHABET), F.col("b")) > 0
    counts = pairs.where(known).groupBy("secret", "a", "b").agg(F.count("*").alias("n")).collect()
    table = np.zeros((2, size, size))
    for r in counts:
        table[r.secret, ALPHABET.index(r.a), ALPHABET.index(r.b)] = r.n
    chance = np.log((table + 1) / (table.sum(axis=2, keepdims=True) + size))
    return [round(1000 * x) for x in (chance[1] - chance[0]).ravel().tolist()]


def scored(token: Column, ratios: list[int]) -> Column:
    """Sum over a token's character pairs, in thousandths."""
    table, size = F.lit(np.array(ratios, np.int32)), len(ALPHABET)
    codes = F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.call_function("locate", c, F.lit(ALPHABET)) - 1)
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).cast("long").alias("sum"))

    def step(a: Column, c: Column) -> Column:
        more = F.when(a["last"] >= 0, F.get(table, a["last"] * size + c)).otherwise(F.lit(0))
        return F.struct(c.alias("last"), (a["sum"] + more).cast("long").alias("sum"))

    return F.aggregate(F.filter(codes, lambda c: c >= 0), start, step, lambda a: a["sum"])


def secret_spans(docs: DataFrame, threshold: int = THRESHOLD, samples: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, base (spans of the patterns) and spans (all), arrays of (start, kind, end) by start, then kind.

    Each pattern first tests whether it matches at all; only texts in which it does are cut into spans.
    """
    ratios = train(docs.sparkSession, samples)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    t = F.col("_text")
    assign = F.when(t.rlike(ASSIGN), matched(t, ASSIGN, 2, 2, "assign", 12)).otherwise(_none())
    access = F.when(t.rlike(ACCESS), matched(t, ACCESS, 0, 0, "access", 18)).otherwise(_none())
    hexed = F.when(t.rlike(r"[0-9a-f]{16}"), matched(t, HEX, 0, 0, "hex", 16)).otherwise(_none())
    runs = F.when(t.rlike(CANDIDATE), matched(t, CANDIDATE, 0, 0, "random", 20)).otherwise(_none())
    order = F.array(*[F.lit(k) for k in KINDS])
    sorted_ = lambda spans: F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], F.array_position(order, s["kind"]).alias("k"), s["end"], s["kind"]))),
        lambda s: F.struct(s["start"], s["kind"], s["end"]),
    )
    found = rows.select("doc_id", "_text", F.concat(assign, access, hexed).alias("_base"), runs.alias("_runs"))
    own = lambda s: F.substring(t, s["start"] + 1, s["end"] - s["start"])
    likely = lambda s: scored(own(s), ratios) > F.lit(threshold).cast("long") * (s["end"] - s["start"] - 1)
    more = F.when(F.size("_runs") > 0, F.filter(_free(F.col("_runs"), F.col("_base")), likely)).otherwise(_none())
    return found.withColumn("_more", more).select("doc_id", sorted_(F.col("_base")).alias("base"), sorted_(F.concat("_base", "_more")).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secrets(docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans. samples: labelled strings (secret, s) to train from.

    Defined cases: a null text is empty and has no spans; repeated rows are answered each; a null doc_id stays null;
    other columns are ignored.
    """
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    found = secret_spans(docs, samples=samples)
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _spans_sql(kind: str, pattern: str, value: int, least: int) -> str:
    cut = lambda group: f"regexp_extract_all(t, '{cutter}', {group})"
    cutter = rf"(?s)(.*?)(?:({pattern})|\z)".replace("'", "''")
    return f"""
{kind}_p AS (SELECT rid, unnest(range(1, len({cut(1)}) + 1)) AS k, unnest({cut(1)}) AS gap, unnest({cut(2)}) AS hit, unnest({cut(2 + value)}) AS val FROM d),
{kind}_s AS (SELECT rid, '{kind}' AS kind, hit, val, sum(length(gap) + length(hit)) OVER (PARTITION BY rid ORDER BY k) AS b FROM {kind}_p),
{kind}_x AS (SELECT rid, kind, hit, b - length(hit) AS a, b FROM {kind}_s WHERE hit <> '' AND length(val) >= {least})"""


#: The same in SQL, training included.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
{_spans_sql("assign", ASSIGN, 2, 12)},
{_spans_sql("access", ACCESS, 0, 18)},
{_spans_sql("hex", HEX, 0, 16)},
{_spans_sql("random", CANDIDATE, 0, 20)},
base AS (SELECT rid, kind, a, b, 1 AS o FROM assign_x UNION ALL SELECT rid, kind, a, b, 2 FROM access_x UNION ALL SELECT rid, kind, a, b, 3 FROM hex_x),
r AS (SELECT id, sha256('s' || id) AS digest, rtrim(base64(unhex(sha256('s' || id))), '=') AS coded, string_split('{WORDS}', ' ') AS w FROM range(0, 3000) q(id)),
m AS (SELECT id, list_transform(range(1, 5), lambda k: w[(id * (7919 * k + 104729) + 31 * k) % len(w) + 1]) AS p FROM r),
n AS (SELECT id, p[1:id % 3 + 2] AS made, p[1] || array_to_string(list_transform(p[2:id % 3 + 2][1:3], lambda x: upper(x[1]) || x[2:]), '') AS camel FROM m),
s AS (
  SELECT 1 AS secret, CASE id % 3 WHEN 0 THEN digest WHEN 1 THEN coded ELSE translate(coded, '+/', '-_') END AS s FROM r UNION ALL
  SELECT 0, CASE id % 4 WHEN 0 THEN camel WHEN 1 THEN array_to_string(made, '_') WHEN 2 THEN array_to_string(made, '-') ELSE upper(array_to_string(made, '_')) END || CASE WHEN id % 5 = 0 THEN CAST(id % 100 AS VARCHAR) ELSE '' END FROM n
),
g AS (SELECT secret, s[i:i] AS x, s[i + 1:i + 1] AS y, count(*) AS c FROM (SELECT secret, s, unnest(range(1, length(s))) AS i FROM s) GROUP BY ALL),
tot AS (SELECT secret, x, sum(c) AS c FROM g GROUP BY ALL),
ab AS (SELECT unnest(string_split('{ALPHABET}', '')) AS x),
llr AS (
  SELECT u.x, v.x AS y, round(1000 * (ln((coalesce(g1.c, 0) + 1) / (coalesce(t1.c, 0) + {len(ALPHABET)})::DOUBLE) - ln((coalesce(g0.c, 0) + 1) / (coalesce(t0.c, 0) + {len(ALPHABET)})::DOUBLE)))::BIGINT AS v
  FROM ab u, ab v LEFT JOIN g g1 ON g1.secret = 1 AND g1.x = u.x AND g1.y = v.x LEFT JOIN g g0 ON g0.secret = 0 AND g0.x = u.x AND g0.y = v.x
  LEFT JOIN tot t1 ON t1.secret = 1 AND t1.x = u.x LEFT JOIN tot t0 ON t0.secret = 0 AND t0.x = u.x
),
free AS (SELECT * FROM random_x q WHERE NOT EXISTS (SELECT 1 FROM base z WHERE z.rid = q.rid AND z.a < q.b AND q.a < z.b)),
fp AS (SELECT rid, a, b, hit, unnest(range(1, length(hit))) AS i FROM free),
more AS (SELECT rid, 'random' AS kind, a, b, 4 AS o FROM fp JOIN llr ON llr.x = hit[i:i] AND llr.y = hit[i + 1:i + 1] GROUP BY rid, a, b HAVING sum(v) > {THRESHOLD} * (b - a - 1)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(bs, '')) AS base_sha256, coalesce(es, '') AS spans
FROM d LEFT JOIN (SELECT rid, count_if(o = 1) AS n_assign, count_if(o = 2) AS n_access, count_if(o = 3) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS bs FROM base GROUP BY rid) USING (rid)
LEFT JOIN (SELECT rid, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, o) AS es FROM every GROUP BY rid) USING (rid)
"""
