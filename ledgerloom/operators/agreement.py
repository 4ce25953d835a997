"""How far two responses agree."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonlex as J
from ..functions.columns import jaccard, normal_text
from ..functions.lazy import arrow_udf


def _canonical(text: str | None) -> str:
    """Empty for none; what isn't JSON is itself, marked."""
    if text is None:
        return ""
    try:
        return J.canonical(text)
    except J.JsonError:
        return f"\0invalid:{text}"


def _leaves(prefix: str, text: str) -> list[str]:
    try:
        return J.leaves(J.parse(text), prefix)
    except J.JsonError:
        return [f"{prefix}=\0invalid"]


@arrow_udf("struct<calls array<string>, structured string, leaves array<string>>")
def parts(names: pd.Series, args: pd.Series, structured: pd.Series) -> pd.DataFrame:
    """Per response: sorted keys of its tool calls (name and canonical arguments), canonical output, and all leaves."""
    out = []
    for ns, xs, s in zip(names, args, structured, strict=True):
        calls = list(zip(ns, xs, strict=True)) if ns is not None else []
        leaves = {leaf for n, x in calls for leaf in _leaves(f"call:{n}", x or "")} | set(_leaves("out", s) if s is not None else [])
        out.append((sorted(f"{n}\0{_canonical(x)}" for n, x in calls), _canonical(s), sorted(leaves)))
    return pd.DataFrame(out, columns=["calls", "structured", "leaves"])


def compared(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with columns {a,b}_text, _names, _args (arrays, one item a call) and _structured: adds `agreement`.

    agree asks for the same calls, and the same structured output if either has one, else the same normalized text;
    exact_match for all three; field_agreement is the share of leaves in common.
    """
    got = pairs.withColumns({f"_{x}": parts(f"{x}_names", f"{x}_args", f"{x}_structured") for x in (a, b)})
    of = lambda x, f: F.col(f"_{x}.{f}")
    text = lambda x: normal_text(F.coalesce(f"{x}_text", F.lit("")))
    calls, out, same = of(a, "calls") == of(b, "calls"), of(a, "structured") == of(b, "structured"), text(a) == text(b)
    either: Column = F.col(f"{a}_structured").isNotNull() | F.col(f"{b}_structured").isNotNull()
    found = F.struct(
        (calls & F.when(either, out).otherwise(same)).alias("agree"), (calls & out & same).alias("exact_match"), calls.alias("tool_calls_equal"),
        jaccard(of(a, "leaves"), of(b, "leaves")).alias("field_agreement"), same.alias("text_equal"),
    )
    return got.withColumn("agreement", found).drop(f"_{a}", f"_{b}")
