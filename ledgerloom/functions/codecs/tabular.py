"""A flat table as lines of JSON arrays: the sorted column names, then a row each."""

from __future__ import annotations

from .. import jsonlex as J
from . import Ineligible, register

#: Fixed text, sent ahead of encoded payloads.
PRIMER = (
    "Some tool results are encoded as tables to save space. A table's first line is a JSON array of column names; each "
    "following line is a JSON array of one row's values in the same column order. A null value means the field is null."
)


def as_table(value: object, union: bool = False, primitives_only: bool = False) -> tuple[list[str], list[dict]]:
    """Columns in byte order and rows of an array of objects.

    All rows have the first one's keys, or with union some of all rows' keys; within a column, values that aren't null
    are of one kind.
    """
    if not isinstance(value, list):
        raise Ineligible("top-level value is not an array")
    if not value:
        raise Ineligible("empty array")
    for i, row in enumerate(value):
        if not isinstance(row, dict):
            raise Ineligible(f"row {i} is not an object")
        if not row:
            raise Ineligible(f"row {i} is empty")
        if "" in row:
            raise Ineligible(f"row {i} has an empty key")
    keys = {k for row in value for k in row} if union else set(value[0])
    columns = sorted(keys, key=str.encode)
    kinds: dict[str, str] = {}
    for i, row in enumerate(value):
        if not union and len(row) != len(columns):
            raise Ineligible(f"row {i} has {len(row)} keys, not {len(columns)}")
        for c in columns:
            if c not in row:
                if union:
                    continue
                raise Ineligible(f"row {i} lacks {c!r}")
            kind = J.kind_of(row[c])
            if primitives_only and kind in ("array", "object"):
                raise Ineligible(f"row {i} has a nested {c!r}")
            if kind != "null" and kinds.setdefault(c, kind) != kind:
                raise Ineligible(f"column {c!r} mixes {kinds[c]} and {kind}")
    return columns, value


class Tabular:
    name, version, primer = "tabular", "1", PRIMER

    def check(self, value: object, union: bool = False) -> None:
        as_table(value, union, True)

    def encode(self, value: object, union: bool = False) -> str:
        columns, rows = as_table(value, union, True)
        return "\n".join([J.write(columns), *(J.write([row.get(c) for c in columns]) for row in rows)])

    def both(self, value: object, canonical: str, union: bool = False) -> tuple[str, None]:
        return self.encode(value, union), None

    def decode(self, text: str) -> object:
        lines = [x.removesuffix("\r") for x in text.split("\n")]
        try:
            head, *rows = map(J.parse, lines)
        except J.JsonError as e:
            raise Ineligible(f"a line is no JSON: {e}") from None
        if not isinstance(head, list) or not head or not all(J.kind_of(c) == "string" and c for c in head):
            raise Ineligible("the first line isn't an array of names")
        if any(a.encode() >= b.encode() for a, b in zip(head, head[1:])):
            raise Ineligible("names aren't sorted or repeat")
        if not rows:
            raise Ineligible("no rows")
        for row in rows:
            if not isinstance(row, list) or len(row) != len(head):
                raise Ineligible("a row doesn't fit the names")
            if any(isinstance(x, (list, dict)) for x in row):
                raise Ineligible("a row holds a container")
        return [dict(zip(head, row, strict=True)) for row in rows]

    def lossless(self, union: bool) -> bool:
        return not union

    def primer_for(self, blocks: list[str]) -> str:
        return self.primer


TABULAR = register(Tabular())
