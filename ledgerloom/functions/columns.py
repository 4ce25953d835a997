"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JSON_NUMBER = r"\A-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?\z"


def tokens(text: Column) -> Column:
    """The heuristic estimate: a token for four bytes, rounded up."""
    return F.shiftright(F.octet_length(text) + 3, 2).cast("long")


def calibrated(count: Column, factor: Column) -> Column:
    return F.floor(count * factor + F.lit(0.5)).cast("long")


def is_number_literal(text: Column) -> Column:
    return text.rlike(JSON_NUMBER)


def json_string(text: Column) -> Column:
    """A JSON string: the two escapes every text may need, and \\u00xx of control characters by to_json's writer."""
    plain = F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))
    whole = F.to_json(F.struct(text.alias("s")))
    return F.when(text.rlike(r"[\x00-\x1f]"), F.substring(whole, F.lit(6), F.length(whole) - 6)).otherwise(plain)


def normal_text(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def normal_key(key: Column) -> Column:
    return F.translate(F.lower(key), "_-", "")


def has_scope(scopes: Column, wanted: Column) -> Column:
    return F.array_contains(scopes, wanted) | F.array_contains(scopes, F.concat(F.substring_index(wanted, ":", 1), F.lit(":*")))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are equal."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / either.cast("double"))


def clean_reply(reply: Column) -> Column:
    """Without thoughts; the last line if the reply speaks of an answer; without that word and outer marks."""
    bare = lambda c, marks: F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")
    out = bare(F.regexp_replace(reply, r"(?s)<think>.*?</think>", ""), r"\s")
    last = F.element_at(F.split(out, "\n"), -1)
    out = bare(F.when(F.lower(out).contains("answer"), last).otherwise(out), r"\s")
    out = F.regexp_replace(F.regexp_replace(out, "^Answer:", ""), "^answer:", "")
    return bare(out, " \t\r\n*`\"'.")


def word_f1(a: Column, b: Column) -> Column:
    """F1 of two texts' words as multisets: their sorted words are walked side by side, once.

    Both lists are bound to a lambda's argument, so that they are made once a row."""

    def in_order(text: Column) -> Column:
        return F.array_sort(F.filter(F.split(normal_text(text), " "), lambda w: w != ""))

    def of(both: Column) -> Column:
        x, y = both["x"], both["y"]
        total = F.size(x) + F.size(y)

        def step(s: Column, _: Column) -> Column:
            p, q = F.get(x, s["i"]), F.get(y, s["j"])
            left, right = p <= q, q <= p
            move = lambda c, when: (s[c] + F.when(when, 1).otherwise(0)).alias(c)
            return F.struct(move("i", left), move("j", right), move("n", left & right))

        start = F.struct(*[F.lit(0).alias(c) for c in "ijn"])
        met = F.aggregate(F.sequence(F.lit(1), F.greatest(total, F.lit(1))), start, step, lambda s: s["n"])
        return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * met.cast("double") / total.cast("double"))

    return F.get(F.transform(F.array(F.struct(in_order(a).alias("x"), in_order(b).alias("y"))), of), F.lit(0))


def median(values: Column) -> Column:
    """The mean of the two middle values as an aggregate; 0 of none."""
    return F.coalesce(F.median(values), F.lit(0.0))


def money(cents: Column) -> Column:
    """Whole cents as the shortest decimal."""
    text = (cents.cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def part_name(number: Column, parts: Column) -> Column:
    """part1, part2, …, with as many digits as the number of parts has."""
    return F.concat(F.lit("part"), F.lpad(number.cast("string"), F.length(parts.cast("string")), F.lit("0")))


def representation(codec: Column, savings: Column) -> Column:
    """What was sent: the codec with its estimated savings, or json."""
    thousandths = F.round(savings * 1000).cast("long")
    shown = F.concat(codec, F.lit("; est_savings="), F.floor(thousandths / 1000).cast("string"), F.lit("."), F.lpad((thousandths % 1000).cast("string"), 3, "0"))
    return F.when(codec.isNull() | (codec == ""), F.lit("json")).otherwise(shown)


def allowed_host(url: Column, hosts: list[str]) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)).isin(hosts)
