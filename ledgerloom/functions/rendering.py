"""A tool result's text in each format that a benchmark sends, and the primer that goes with it."""

from __future__ import annotations

import csv
import io

from . import jsonlex as J
from .codecs import CODECS
from .codecs.tabular import as_table
from .codecs.toonx import TOONX

#: Fixed texts: the short primer of one arm, and that of CSV.
SHORT_PRIMER = (
    'Some tool results are in TOON: "key[N]{a,b}:" is a table of N rows with fields a and b, one comma-separated row per line; '
    '"key[N]: x,y" is a list of values; "key: value" is a field and nested objects are indented. '
    "Read the data as given; there is no need to convert it."
)
CSV_PRIMER = "Some tool results are CSV: the first line is the column names and each following line is one record."

FORMATS = ("json-pretty", "json-compact", "json-compact-2", "gateway", "toon", "toonx", "toonx-p2", "tabular", "csv")


def compact(text: str) -> str:
    """Without white space outside of strings; keys keep their order."""
    out, at = [], 0
    for m in J.STRINGS.finditer(text):
        out += ["".join(text[at : m.start()].split()), m[0]]
        at = m.end()
    return "".join([*out, "".join(text[at:].split())])


def csv_text(value: object) -> str:
    columns, rows = as_table(value, primitives_only=True)
    out = io.StringIO()
    write = csv.writer(out, lineterminator="\n").writerow
    write(columns)
    for row in rows:
        write(["" if row[c] is None else str(row[c]) if isinstance(row[c], str) else J.write(row[c]) for c in columns])
    return out.getvalue().rstrip("\n")


def render(name: str, text: str, keeps_order: bool = False) -> tuple[str, str]:
    """The text to send and its primer, which may be empty; Ineligible if the format can't hold the payload. keeps_order:
    a payload that came from elsewhere is sent with its own order of keys."""
    value = J.parse(text)
    if name in ("json-compact", "json-compact-2", "gateway"):
        return (compact(text) if keeps_order else J.write(value)), ""
    if name == "json-pretty":
        return J.pretty(value), ""
    if name == "csv":
        return csv_text(value), CSV_PRIMER
    if name == "toonx-p2":
        made = TOONX.encode(value)
        return made, TOONX.primer_for([made], SHORT_PRIMER)
    if name not in CODECS:
        raise ValueError(f"no format {name!r}")
    made = CODECS[name].encode(value)
    return made, CODECS[name].primer_for([made])
