"""How scalars and keys are written in the indented notations, and read back."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from .. import jsonlex as J
from . import Ineligible

LOOKS_NUMERIC = re.compile(r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
SPECIAL = re.compile(r"[:\\\"\[\]{},\x00-\x1f]")
#: Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"


@lru_cache(maxsize=1 << 14)
def needs_quotes(s: str) -> bool:
    if s == "" or s != s.strip(WHITE) or s in ("true", "false", "null"):
        return True
    return bool(s[0] == "-" or SPECIAL.search(s) or LOOKS_NUMERIC.fullmatch(s) or re.match("0[0-9]", s))


def scalar(v: object) -> str:
    if isinstance(v, str) and not isinstance(v, J.Num):
        return J.quoted(v) if needs_quotes(v) else v
    return J.write(v)


def cell(v: object) -> str:
    """A scalar, or compact JSON of a container."""
    return J.write(v) if isinstance(v, (list, dict)) else scalar(v)


def bare(key: str, dots: bool) -> bool:
    letter = lambda c: c == "_" or c.isalpha() or unicodedata.category(c)[0] == "L"
    return bool(key) and letter(key[0]) and all(letter(c) or c.isdecimal() or (dots and c == ".") for c in key[1:])


def key(k: str, dots: bool = True) -> str:
    return k if bare(k, dots) else J.quoted(k)


def read_scalar(text: str) -> object:
    """The value of a written cell that isn't empty."""
    return J.parse(text) if text[:1] in ("[", "{") else _read(text)


@lru_cache(maxsize=1 << 14)
def _read(text: str) -> object:
    if text[:1] == '"':
        v = J.parse(text)
        if J.kind_of(v) != "string":
            raise Ineligible("not a string")
        return v
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    if J.NUMBER.fullmatch(text):
        return J.Num(text)
    if not text or needs_quotes(text):
        raise Ineligible(f"{text!r} should be in quotes")
    return text


STRING = re.compile(r'"(?:[^"\\]|\\.)*"')


#: What may hold a comma begins a cell with one of these.
OPENING = re.compile(r'["\[{]')


def _json_end(text: str, at: int) -> int:
    depth = 0
    while at < len(text):
        c = text[at]
        if c == '"':
            m = STRING.match(text, at)
            if not m:
                raise Ineligible("a string has no end")
            at = m.end()
            continue
        depth += (c in "[{") - (c in "]}")
        at += 1
        if not depth:
            return at
    raise Ineligible("JSON has no end")


def cells_of(text: str) -> list[str]:
    """Cells between commas that are outside of strings and JSON."""
    if not OPENING.search(text):
        return text.split(",")
    out, at = [], 0
    while True:
        start = at
        if text[at : at + 1] == '"':
            m = STRING.match(text, at)
            if not m:
                raise Ineligible("a string has no end")
            at = m.end()
        elif text[at : at + 1] in ("[", "{"):
            at = _json_end(text, at)
        else:
            found = text.find(",", at)
            at = len(text) if found < 0 else found
        out.append(text[start:at])
        if at == len(text):
            return out
        if text[at] != ",":
            raise Ineligible("a cell goes on after its end")
        at += 1


def read_key(text: str, at: int, dots: bool) -> tuple[str, int]:
    """A key from place `at`, and where it ends."""
    if text[at : at + 1] == '"':
        m = STRING.match(text, at)
        if not m:
            raise Ineligible("a key has no end")
        return J.parse(m[0]), m.end()
    end = at
    while end < len(text) and text[end] not in (':[{}],="' if dots else ':[{}],=".'):
        end += 1
    if not bare(text[at:end], dots):
        raise Ineligible(f"{text[at:end]!r} is no key")
    return text[at:end], end
