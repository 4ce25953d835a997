"""Quality rules as a short-circuit cascade.

Each rule is a condition that rejects a document. On a sample, all rules are timed row by row and their rejections counted
in one pass; the rules then run in order of rejections per second, each only on documents that no earlier rule rejected
(CASE evaluates its branches lazily). The order changes how long it takes, never the verdict. What the query returns for
every document (the measures) is made for every document; rules pay only for what they read beyond that. Everything is
Spark SQL expressions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """`rejects` is SQL over the columns of measured()."""

    name: str
    rejects: str


#: Each threshold stands with its rule; whole numbers, so that any engine decides alike.
RULES = (
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("dup_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words"),
    Rule("capitals", r"100 * length(regexp_replace(_text, '[^A-Z]+', '')) > 50 * word_chars"),
    Rule("letters", r"100 * size(filter(_words, w -> w rlike '\\p{L}')) < 30 * n_words"),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(hashes: Column) -> Column:
    """Positions in windows whose hash occurs twice or more: windows by hash, then those with an equal neighbour by
    place, each adding what reaches beyond the last."""
    pairs = F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

    def repeated(sorted_: Column) -> Column:
        near = lambda k: F.coalesce(F.get(sorted_, k)["x"], F.lit(None).cast("long"))
        held = F.filter(sorted_, lambda p, k: p["x"].eqNullSafe(near(k - 1)) | p["x"].eqNullSafe(near(k + 1)))
        return F.array_sort(F.transform(held, lambda p: p["i"]))

    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, i: F.struct((a["n"] + (i + F.lit(WINDOW) - F.greatest(i, a["end"]))).cast("long").alias("n"), (i + F.lit(WINDOW)).alias("end"))
    return F.aggregate(_let(pairs, repeated), start, step, lambda a: a["n"])


def measured(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the base measures, and what the rules read (_text, _words, n_lines)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    split = first.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    lined = split.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # Hashes of words are bound once a row; as a column they would be put into the lambda that reads them, once a window.
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - F.lit(WINDOW - 1), F.lit(1)))
    of = lambda hashes: F.transform(starts, lambda i: F.xxhash64(F.slice(hashes, i, F.lit(WINDOW))))
    windows = _let(F.transform("_words", lambda w: F.xxhash64(w)), of)
    cut = lined.withColumn("_windows", F.when(F.size("_words") >= WINDOW, windows))
    none = F.lit(0).cast("long")
    repeats = F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), _covered(F.col("_windows"))).otherwise(none)
    return cut.select(
        "doc_id",
        "_text",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words")))


@dataclass(frozen=True)
class Estimate:
    """seconds: of one evaluation over the sample."""

    rule: Rule
    seconds: float
    rejected: int

    @property
    def gain(self) -> float:
        """Rejections per second; one more than were seen, so that cost decides among rules that rejected nothing."""
        return (self.rejected + 1) / self.seconds


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000, seed: int = 1, repeats: int = 5) -> list[Estimate]:
    """Rules by rejections per second on a sample of about sample_rows rows, best first; names break ties.

    One job evaluates every rule `repeats` times a row, with the clock read before and after each; what reading the clock
    takes is measured alike and taken off.
    """
    n = docs.count()
    rows = docs.select("doc_id", "text").sample(min(1.0, sample_rows / max(1, n)), seed)
    sample = stored(measured(rows).where(~F.col("base_failed")), "rule-sample")
    clock = lambda k: F.expr("cast(reflect('java.lang.System', 'nanoTime') AS bigint)").alias(f"t{k}")
    steps = [clock(0), clock(1)]
    for k, rule in enumerate(rules):
        steps += [F.coalesce(F.expr(rule.rejects), F.lit(False)).alias(f"r{k}"), clock(k + 2)]
    timed = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(repeats)))).select("_again", F.struct(*steps).alias("x"))
    took = lambda k: F.sum(F.col(f"x.t{k + 1}") - F.col(f"x.t{k}")).alias(f"s{k}")
    rejected = [F.count_if((F.col("_again") == 1) & F.col(f"x.r{k}")).alias(f"n{k}") for k in range(len(rules))]
    found = timed.agg(*[took(k) for k in range(len(rules) + 1)], *rejected).first()
    seconds = lambda k: max((found[f"s{k + 1}"] or 0) - (found["s0"] or 0), 1) / 1e9 / repeats
    out = [Estimate(rule, seconds(k), found[f"n{k}"]) for k, rule in enumerate(rules)]
    return sorted(out, key=lambda e: (-e.gain, e.rule.name))


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, else null."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(out)
    return out


def quality(docs: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule.

    rules: in their order; ordered by an estimate on a sample if not given. Defined cases: a null or empty text has no
    words and fails the base; repeated rows are answered each; other columns are ignored; an empty table gives no rows.
    """
    if rules is None:
        rules = [e.rule for e in estimate(docs)]
    failed = F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(rules))
    judged = measured(docs).withColumn("failed_rule", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (
  SELECT doc_id, t, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
),
win AS (
  SELECT doc_id, unnest(range(1, n_words - 6)) AS i,
         unnest(list_transform(range(1, n_words - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s
  FROM m WHERE n_words >= 8
),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 8) r(k) GROUP BY doc_id),
v AS (
  SELECT m.*, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM m LEFT JOIN rep USING (doc_id)
),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 5 * word_chars OR 100 * n_dup_lines > 50 * n_lines
            OR word_chars > 12 * n_words OR word_chars < 2 * n_words
            OR 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 50 * word_chars
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 30 * n_words) AS kept
FROM f
"""
