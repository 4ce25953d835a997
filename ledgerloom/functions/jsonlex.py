"""JSON whose numbers keep their text.

A value is None, a bool, a Num (a number's text), a str, a list or a dict. Parsing is strict: repeated keys, anything
after the document, NaN and more than MAX_DEPTH nested containers are errors. canonical() writes it compactly with keys
in the order of their UTF-8 bytes; equal documents have equal canonical text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

MAX_DEPTH = 512
NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_SURROGATE = re.compile("[\ud800-\udfff]")
_ESCAPED = re.compile(r'["\\\x00-\x1f]')
_SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


class JsonError(ValueError):
    """A text isn't a strict JSON document."""


class Num(str):
    """The text of a number."""

    __slots__ = ()


def _object(pairs: list[tuple[str, object]]) -> dict:
    out = {}
    for k, v in pairs:
        k = _SURROGATE.sub("�", k)
        if k in out:
            raise JsonError(f"repeated key {k!r}")
        out[k] = _SURROGATE.sub("�", v) if type(v) is str else v
    return out


def _constant(name: str) -> object:
    raise JsonError(f"{name} is no JSON value")


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=Num, parse_float=Num, parse_constant=_constant)


def _clean(v: object) -> object:
    """Lone surrogates in arrays and at the top give way to U+FFFD, as in objects."""
    if type(v) is str:
        return _SURROGATE.sub("�", v)
    todo = [v]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            todo += x.values()
        elif isinstance(x, list):
            for i, y in enumerate(x):
                if type(y) is str:
                    x[i] = _SURROGATE.sub("�", y)
                else:
                    todo.append(y)
    return v


def depth_of(v: object) -> int:
    most, todo = 0, [(v, 1)]
    while todo:
        x, d = todo.pop()
        if isinstance(x, (dict, list)):
            most = max(most, d)
            todo += [(y, d + 1) for y in (x.values() if isinstance(x, dict) else x)]
    return most


def parse(text: str | bytes) -> object:
    try:
        if isinstance(text, bytes):
            text = text.decode("utf-8")
        v = _DECODER.decode(text)
        # Halves of surrogate pairs come from escapes or stand in the text themselves.
        if "\\u" in text or _SURROGATE.search(text):
            v = _clean(v)
    except (ValueError, RecursionError) as e:
        raise e if isinstance(e, JsonError) else JsonError(str(e)) from None
    if text.count("[") + text.count("{") > MAX_DEPTH and depth_of(v) > MAX_DEPTH:
        raise JsonError("too deep")
    return v


def in_key_order(d: dict) -> list[str]:
    return sorted(d, key=lambda k: k.encode())


def quoted(s: str) -> str:
    if not _ESCAPED.search(s):
        return f'"{s}"'
    return '"' + _ESCAPED.sub(lambda m: _SHORT.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


@lru_cache(maxsize=1 << 12)
def _heads(keys: tuple[str, ...]) -> list[tuple[str, str]]:
    """Keys in order, each with its JSON text and a colon; rows of a table share them."""
    return [(k, quoted(k) + ":") for k in sorted(keys, key=lambda k: k.encode())]


def _write(v: object, put) -> None:
    if isinstance(v, str):
        if isinstance(v, Num):
            if not NUMBER.fullmatch(v):
                raise JsonError(f"{v!r} is no number")
            put(v)
        else:
            put(quoted(v))
    elif isinstance(v, dict):
        mark = "{"
        for k, head in _heads(tuple(v)):
            put(mark + head)
            _write(v[k], put)
            mark = ","
        put("}" if v else "{}")
    elif isinstance(v, list):
        mark = "["
        for x in v:
            put(mark)
            _write(x, put)
            mark = ","
        put("]" if v else "[]")
    else:
        put({None: "null", True: "true", False: "false"}[v])


def write(v: object) -> str:
    out: list[str] = []
    _write(v, out.append)
    return "".join(out)


#: Strings of a JSON text.
STRINGS = re.compile(r'"(?:[^"\\]|\\.)*"')


def pretty(v: object, pad: str = "") -> str:
    """With two blanks a level; empty containers stay on their line."""
    if isinstance(v, (list, dict)) and v:
        inner = pad + "  "
        parts = [f"{quoted(k)}: {pretty(v[k], inner)}" for k in in_key_order(v)] if isinstance(v, dict) else [pretty(x, inner) for x in v]
        first, last = "{}" if isinstance(v, dict) else "[]"
        return f"{first}\n{inner}" + f",\n{inner}".join(parts) + f"\n{pad}{last}"
    return write(v)


def canonical(text: str | bytes) -> str:
    return write(parse(text))


def kind_of(v: object) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "bool"
    return "number" if isinstance(v, Num) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"


def is_data(text: str | None) -> bool:
    """A text that is wholly a JSON array or object; repeated keys are allowed here."""
    if not text or not (t := text.strip(" \t\r\n")).startswith(("[", "{")):
        return False
    try:
        json.JSONDecoder(parse_constant=_constant).decode(t)
    except (ValueError, RecursionError):
        return False
    return True


def leaves(v: object, prefix: str) -> list[str]:
    """Sorted distinct `path=value` of all primitive values; empty containers have none."""
    out, todo = set(), [(prefix, v)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [(f"{path}/{k}", y) for k, y in x.items()]
        elif isinstance(x, list):
            todo += [(f"{path}/{i}", y) for i, y in enumerate(x)]
        else:
            out.add(f"{path}={write(x)}")
    return sorted(out)


def largest_table(v: object, levels: int = 3) -> list[str] | None:
    """Path of the array of objects with the most rows, up to `levels` keys deep; the first in key order among equals."""
    best: tuple[int, list[str] | None] = (0, None)

    def look(x: object, path: list[str]) -> None:
        nonlocal best
        if isinstance(x, list):
            if x and all(isinstance(r, dict) for r in x) and len(x) > best[0]:
                best = len(x), path
        elif isinstance(x, dict) and len(path) < levels:
            for k in in_key_order(x):
                if "." not in k:
                    look(x[k], [*path, k])

    look(v, [])
    return best[1]


def at_path(v: object, path: list[str]) -> object:
    for k in path:
        v = v[k] if isinstance(v, dict) else None
    return v


def with_rows(v: object, path: list[str], n: int) -> object:
    """The document with the array at path cut to its first n items."""
    if not path:
        return v[:n]
    return {k: with_rows(x, path[1:], n) if k == path[0] else x for k, x in v.items()}
