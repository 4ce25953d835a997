"""Token-Oriented Object Notation, as its public specification has it, with commas between cells.

Objects, arrays of primitives, tables of rows that share their keys and hold primitives only, and lists for all other
arrays: an item to a dash, of an object the first field beside the dash and the rest below it. Fields that hold primitives
come first, then arrays, then objects, each in byte order of their keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import Decimal
from functools import cache

from .. import jsonlex as J
from . import Ineligible, register, verified
from .scalars import key, read_key, read_scalar, scalar

#: Fixed text, sent ahead of encoded payloads.
PRIMER = (
    'Some tool results are encoded in TOON (Token-Oriented Object Notation). "key[N]{a,b}:" introduces an array of N objects with '
    "fields a and b, followed by one indented line per object with comma-separated values in that field order. "
    '"key[N]: x,y" is an array of primitives. "key: value" is an object field; nested objects are indented. '
    "Strings are quoted only when needed."
)


def float_exact(text: str) -> bool:
    """The text is the shortest plain notation of its double."""
    f = float(text)
    if f in (float("inf"), float("-inf")) or f == 0 and text.startswith("-"):
        return False
    plain = format(Decimal(repr(f)), "f")
    return (plain.rstrip("0").rstrip(".") if "." in plain else plain) == text


def _leaves(v: object) -> Iterator[object]:
    if isinstance(v, dict):
        yield from v
        for x in v.values():
            yield from _leaves(x)
    elif isinstance(v, list):
        for x in v:
            yield from _leaves(x)
    else:
        yield v


def _rank(v: object) -> int:
    return isinstance(v, list) + 2 * isinstance(v, dict)


def _array(name: str, items: list, depth: int) -> Iterator[str]:
    pad = "  " * depth
    if not any(isinstance(x, (list, dict)) for x in items):
        yield f"{pad}{name}[{len(items)}]:" + (" " + ",".join(map(scalar, items)) if items else "")
        return
    names = J.in_key_order(items[0]) if isinstance(items[0], dict) else []
    flat = names and all(isinstance(r, dict) and r.keys() == items[0].keys() and not any(map(_rank, r.values())) for r in items)
    if not flat:
        yield f"{pad}{name}[{len(items)}]:"
        for x in items:
            yield from _item(x, depth + 1)
        return
    yield f"{pad}{name}[{len(items)}]{{{','.join(key(k) for k in names)}}}:"
    for r in items:
        yield f"{pad}  " + ",".join(scalar(r[k]) for k in names)


def _item(v: object, depth: int) -> Iterator[str]:
    """An item of a list; what it holds stands as if the dash weren't there."""
    pad = "  " * depth
    if isinstance(v, dict):
        if not v:
            raise Ineligible("an item is an empty object")
        first, *rest = _object(v, depth + 1)
        yield f"{pad}- {first.lstrip(' ')}"
        yield from rest
    elif isinstance(v, list):
        first, *rest = _array("", v, depth)
        yield f"{pad}- {first.lstrip(' ')}"
        yield from rest
    else:
        yield f"{pad}- {scalar(v)}"


def _object(value: dict, depth: int) -> Iterator[str]:
    for k in sorted(value, key=lambda k: (_rank(value[k]), k.encode())):
        v, pad = value[k], "  " * depth
        if isinstance(v, list):
            yield from _array(key(k), v, depth)
        elif isinstance(v, dict):
            yield f"{pad}{key(k)}:"
            yield from _object(v, depth + 1)
        else:
            yield f"{pad}{key(k)}: {scalar(v)}"


@cache
def _reader() -> type:
    from .toonx import Reader

    class ListReader(Reader):
        """Reads lists of anything, and objects without fields."""

        def after_key(self, line: str, at: int, depth: int) -> object:
            if line[at:] == ":" and self.peek(depth + 1) is None:
                return {}
            return super().after_key(line, at, depth)

        def item(self, line: str, depth: int) -> object:
            if not line.startswith("- "):
                raise Ineligible("an item has no dash")
            text = line[2:]
            if text.startswith("["):
                return self.after_key(text, 0, depth)
            try:
                name, end = read_key(text, 0, True)
            except (Ineligible, J.JsonError):
                return read_scalar(text)
            if text[end : end + 1] not in (":", "["):
                return read_scalar(text)
            out = {name: self.after_key(text, end, depth + 1)}
            more = self.object(depth + 1) if self.peek(depth + 1) is not None else {}
            if name in more:
                raise Ineligible(f"{name!r} is there twice")
            return out | more

        def document(self) -> object:
            v = self.after_key(self.take(0), 0, 0) if self.lines[0].startswith("[") else self.object(0)
            if self.at < len(self.lines):
                raise Ineligible(f"line {self.at + 1} is left over")
            return v

    return ListReader


class Toon:
    name, version, primer = "toon", "spec", PRIMER

    def check(self, value: object, union: bool = False) -> None:
        if not isinstance(value, (list, dict)):
            raise Ineligible("top-level value is not an object or array")
        for v in _leaves(value):
            if isinstance(v, J.Num):
                if not float_exact(v):
                    raise Ineligible(f"number {v} does not survive float64 formatting")
            elif isinstance(v, str) and (m := re.search(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", v)):
                raise Ineligible(f"string contains control character U+{ord(m[0]):04X}")

    def encode(self, value: object, union: bool = False) -> str:
        return self.both(value, J.write(value))[0]

    def both(self, value: object, canonical: str, union: bool = False) -> tuple[str, str]:
        self.check(value)
        return verified(self, "\n".join(_object(value, 0) if isinstance(value, dict) else _array("", value, 0)), canonical)

    def decode(self, text: str) -> object:
        if text == "":
            return {}
        try:
            return _reader()(text).document()
        except J.JsonError as e:
            raise Ineligible(str(e)) from None

    def lossless(self, union: bool) -> bool:
        return not union

    def primer_for(self, blocks: list[str]) -> str:
        return self.primer


TOON = register(Toon())
