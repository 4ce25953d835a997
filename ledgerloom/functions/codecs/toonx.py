"""Indented notation in which every array of objects is a table.

Arrays of objects become a header of columns and a line for each row; absent keys are empty cells, nested objects may
become columns of dotted paths, containers in cells are compact JSON. Values that all rows share and common beginnings
of URLs may be written once. Of the four layouts (flattened or not, shared values factored out or not) the one of the
fewest bytes is used, the first among equals. Arrays of objects with more than MAX_WIDTH varying columns are cut into
tables part1, part2, … of the same rows. Every encoding is decoded again and must give the same document.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, fields

from .. import jsonlex as J
from . import Ineligible, register, verified
from .scalars import bare, cell, cells_of, key, read_key, read_scalar, scalar
from .toon import PRIMER

MAX_WIDTH, ROW_NUMBER, MIN_FACTOR_ROWS = 8, "#", 3

#: Fixed texts, each sent only where a payload uses what it tells.
SENTENCES = {
    "absent": " In an array of objects, an empty value means the field is absent.",
    "paths": " A field named a.b is field b of the nested object a.",
    "json": " A value starting with [ or { is JSON.",
    "list": ' "key[N]:" followed by "- " lines is a list of N items.',
    "consts": ' A line "all rows: a=x" under a table header means every row also has field a with value x.',
    "prefix": ' A line "starts with: a=p" under a table header means every text value of field a starts with p, which is left out of the rows: put p back in front.',
    "split": " A wide array may be split into tables part1, part2 and so on: they hold the same rows in the same order, and column # is the row number.",
}

Path = tuple[str, ...]


@dataclass
class Features:
    """What a text uses beyond the plain notation."""

    absent: bool = False
    paths: bool = False
    json: bool = False
    list: bool = False
    consts: bool = False
    prefix: bool = False
    split: bool = False


def path_order(p: Path) -> bytes:
    return "\0".join(p).encode()


def flat(row: dict, flatten: bool, before: Path = ()) -> Iterator[tuple[Path, object]]:
    for k, v in row.items():
        if flatten and isinstance(v, dict) and v:
            yield from flat(v, True, (*before, k))
        else:
            yield (*before, k), v


def shared(rows: list[dict[Path, object]], p: Path) -> bool:
    """Every row, of three or more, has the same value at p."""
    if len(rows) < MIN_FACTOR_ROWS or p not in rows[0]:
        return False
    first = rows[0][p]
    if not isinstance(first, (list, dict)):
        return all(p in r and type(r[p]) is type(first) and r[p] == first for r in rows)
    want = J.write(first)
    return all(p in r and J.write(r[p]) == want for r in rows)


def url_start(rows: list[dict[Path, object]], p: Path) -> str:
    """The URL that all strings at p begin with, up to a slash; a rest of digits only would read as a number."""
    first = next((v for r in rows if (v := r.get(p)) is not None), None)
    if not isinstance(first, str) or not first.startswith("http"):
        return ""
    kinds = {J.kind_of(r.get(p)) for r in rows}
    texts = [r[p].encode() for r in rows if J.kind_of(r.get(p)) == "string"]
    if len(rows) < MIN_FACTOR_ROWS or not kinds <= {"string", "null"} or len(texts) < 2:
        return ""
    # What the least and the greatest share, all share. A start ends in one of its slashes beyond the scheme's.
    start = os.path.commonprefix([min(texts), max(texts)])
    if not re.match(rb"http[^:]*://", start):
        return ""
    ends = [m.end() for m in re.finditer(rb"/", start) if m.end() > start.index(b"://") + 3]
    fit = [e for e in ends if not any(t[e:].isdigit() for t in texts)]
    return start[: max(fit)].decode() if fit else ""


def column(p: Path) -> str:
    return ".".join(key(k, dots=False) for k in p)


@dataclass
class Layout:
    columns: list[Path]
    rows: list[str]
    consts: list[tuple[Path, str]] = field(default_factory=list)
    starts: list[tuple[Path, str]] = field(default_factory=list)

    @property
    def header(self) -> str:
        return ",".join(map(column, self.columns))

    @property
    def lines(self) -> list[str]:
        told = (("all rows: ", self.consts), ("starts with: ", self.starts))
        return [label + ",".join(f"{column(p)}={v}" for p, v in items) for label, items in told if items] + self.rows

    @property
    def size(self) -> int:
        return len(self.header.encode()) + sum(len(x.encode()) + 1 for x in self.lines)


def layout(cells: list[dict[Path, object]], factor: bool) -> Layout:
    columns = sorted({p for r in cells for p in r}, key=path_order)
    consts = [p for p in columns if factor and shared(cells, p)]
    if len(consts) == len(columns):
        consts.pop()
    columns = [p for p in columns if p not in set(consts)]
    starts = {p: s for p in columns if factor and (s := url_start(cells, p))}

    def shown(row: dict[Path, object], p: Path) -> str:
        if p not in row:
            return ""
        v = row[p]
        return cell(v.removeprefix(starts[p]) if p in starts and J.kind_of(v) == "string" else v)

    lines = [",".join([shown(r, p) for p in columns]) for r in cells]
    return Layout(columns, lines, [(p, cell(cells[0][p])) for p in consts], [(p, scalar(s)) for p, s in starts.items()])


def table_of(rows: list) -> Layout | None:
    """The smallest of the four layouts, the first among equals; those that can't differ from another aren't made."""
    if not all(isinstance(r, dict) and r for r in rows):
        return None
    nested = any(isinstance(v, dict) and v for r in rows for v in r.values())
    made = []
    for flatten in (False, True) if nested else (False,):
        cells = [dict(flat(r, flatten)) for r in rows]
        made.append(layout(cells, False))
        if any(shared(cells, p) or url_start(cells, p) for p in made[-1].columns):
            made.append(layout(cells, True))
    return min(made, key=lambda t: t.size)


def array_lines(name: str, items: list, depth: int) -> Iterator[str]:
    pad = "  " * depth
    head = f"{pad}{name}[{len(items)}]"
    if not items:
        yield f"{head}:"
    elif not any(isinstance(x, (list, dict)) for x in items):
        yield f"{head}: {','.join(map(scalar, items))}"
    elif (t := table_of(items)) is not None:
        yield f"{head}{{{t.header}}}:"
        yield from (f"{pad}  {x}" for x in t.lines)
    else:
        yield f"{head}:"
        yield from (f"{pad}  - {cell(x)}" for x in items)


def object_lines(value: dict, depth: int = 0) -> Iterator[str]:
    for k in J.in_key_order(value):
        v, name, pad = value[k], key(k), "  " * depth
        if isinstance(v, list):
            yield from array_lines(name, v, depth)
        elif isinstance(v, dict):
            yield f"{pad}{name}:" if v else f"{pad}{name}: {{}}"
            yield from object_lines(v, depth + 1)
        else:
            yield f"{pad}{name}: {scalar(v)}"


# Wide tables.


def part_name(k: int, n: int) -> str:
    return f"part{k + 1:0{len(str(n))}d}"


def groups_of(columns: list[Path], size: int) -> list[list[Path]]:
    """Groups of up to `size` columns: top-level ones first, then those under one key together where they fit."""
    families: dict[str, list[Path]] = {}
    for p in columns:
        families.setdefault(p[0] if len(p) > 1 else "", []).append(p)
    out: list[list[Path]] = [[]]
    for name in sorted(families, key=str.encode):
        left = families[name]
        if len(out[-1]) + len(left) <= size:
            out[-1] += left
            continue
        cuts = [left[k : k + size] for k in range(0, len(left), size)]
        out = [g for g in out if g] + cuts
    return [g for g in out if g]


def put(row: dict, p: Path, v: object) -> None:
    for k in p[:-1]:
        row = row.setdefault(k, {})
    row[p[-1]] = v


def split_wide(v: object) -> object:
    if isinstance(v, dict):
        return {k: split_wide(x) if isinstance(x, (list, dict)) else x for k, x in v.items()}
    if not isinstance(v, list):
        return v
    if len(v) < 2 or not all(isinstance(r, dict) and r and ROW_NUMBER not in r for r in v):
        return [split_wide(x) for x in v]
    rows = [dict(flat(r, True)) for r in v]
    columns = sorted({p for r in rows for p in r}, key=path_order)
    consts = [p for p in columns if shared(rows, p)]
    vary = [p for p in columns if p not in set(consts)]
    if len(vary) <= MAX_WIDTH:
        return [split_wide(x) for x in v]
    groups = groups_of(vary, MAX_WIDTH - 1)
    out = {}
    for g, own in enumerate(groups):
        part = []
        for i, r in enumerate(rows):
            part.append({ROW_NUMBER: J.Num(i + 1)})
            for p in own if g else [*own, *consts]:
                if p in r:
                    put(part[-1], p, r[p])
        out[part_name(g, len(groups))] = part
    return out


def merged(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, v in b.items():
        if k not in out:
            out[k] = v
        elif isinstance(out[k], dict) and isinstance(v, dict) and out[k] and v:
            out[k] = merged(out[k], v)
        else:
            raise Ineligible(f"two parts hold {k!r}")
    return out


def join_parts(v: object, used: Features) -> object:
    if isinstance(v, list):
        return [join_parts(x, used) for x in v]
    if not isinstance(v, dict):
        return v
    parts = [v.get(part_name(g, len(v))) for g in range(len(v))]
    numbered = lambda p: isinstance(p, list) and len(p) > 1 and all(isinstance(r, dict) and r.get(ROW_NUMBER) == str(i + 1) and isinstance(r[ROW_NUMBER], J.Num) for i, r in enumerate(p))
    if len(parts) < 2 or not all(map(numbered, parts)) or len(set(map(len, parts))) > 1:
        return {k: join_parts(x, used) for k, x in v.items()}
    used.split = True
    rows: list[dict] = [{} for _ in parts[0]]
    for part in parts:
        rows = [merged(row, {k: x for k, x in r.items() if k != ROW_NUMBER}) for row, r in zip(rows, part, strict=True)]
    if not all(rows):
        raise Ineligible("a row holds its number only")
    return rows


# Reading.

COUNT = re.compile(r"\[(0|[1-9][0-9]*)\]")


class Reader:
    def __init__(self, text: str):
        self.lines, self.at, self.used = text.split("\n"), 0, Features()

    def peek(self, depth: int) -> str | None:
        """The next line's text if it stands at this depth."""
        if self.at == len(self.lines):
            return None
        pad, line = "  " * depth, self.lines[self.at]
        return line[len(pad) :] if line.startswith(pad) and line[len(pad) : len(pad) + 1] != " " else None

    def take(self, depth: int) -> str:
        if (line := self.peek(depth)) is None:
            raise Ineligible(f"line {self.at + 1} is missing or stands at another depth")
        self.at += 1
        return line

    def document(self) -> object:
        v = self.after_key(self.take(0), 0, 0) if self.lines[0].startswith("[") else self.object(0)
        if self.at < len(self.lines):
            raise Ineligible(f"line {self.at + 1} is left over")
        # Without the word there is no part to join.
        return join_parts(v, self.used) if any("part" in line for line in self.lines) else v

    def object(self, depth: int) -> dict:
        out: dict = {}
        while (line := self.peek(depth)) is not None:
            self.at += 1
            name, end = read_key(line, 0, True)
            if name in out:
                raise Ineligible(f"{name!r} is there twice")
            out[name] = self.after_key(line, end, depth)
        if not out:
            raise Ineligible("an object has no fields")
        return out

    def after_key(self, line: str, at: int, depth: int) -> object:
        rest = line[at:]
        if rest == ":":
            return self.object(depth + 1)
        if rest == ": {}":
            return {}
        if rest.startswith(": "):
            if rest[2:3] in ("[", "{"):
                raise Ineligible("a field holds JSON")
            return read_scalar(rest[2:])
        m = COUNT.match(rest)
        if not m:
            raise Ineligible(f"{line!r} is no field")
        n, rest = int(m[1]), rest[m.end() :]
        if n == 0 and rest == ":":
            return []
        if n and rest == ":":
            self.used.list = True
            return [self.item(self.take(depth + 1), depth + 1) for _ in range(n)]
        if n and rest.startswith(": "):
            cells = cells_of(rest[2:])
            if len(cells) != n or any(c[:1] in ("[", "{") for c in cells):
                raise Ineligible("an array's items don't fit its count")
            return [read_scalar(c) for c in cells]
        if n and rest.startswith("{") and rest.endswith("}:"):
            return self.table(rest[1:-2], n, depth + 1)
        raise Ineligible(f"{line!r} is no array")

    def item(self, line: str, depth: int) -> object:
        if not line.startswith("- "):
            raise Ineligible("an item has no dash")
        if line[2:3] in ("[", "{"):
            self.used.json = True
        return read_scalar(line[2:])

    def path(self, text: str, at: int) -> tuple[Path, int]:
        out = []
        while True:
            if text[at : at + 1] == ROW_NUMBER:
                name, at = ROW_NUMBER, at + 1
            else:
                name, at = read_key(text, at, False)
            out.append(name)
            if text[at : at + 1] != ".":
                self.used.paths |= len(out) > 1
                return tuple(out), at
            at += 1

    def assigned(self, text: str) -> list[tuple[Path, object]]:
        out, at = [], 0
        while True:
            p, at = self.path(text, at)
            if text[at : at + 1] != "=":
                raise Ineligible("an assignment has no value")
            value = cells_of(text[at + 1 :])[0]
            self.used.json |= value[:1] in ("[", "{")
            out.append((p, read_scalar(value)))
            at += 1 + len(value)
            if at == len(text):
                return out
            at += 1

    def table(self, header: str, n: int, depth: int) -> list[dict]:
        columns, at = [], 0
        while True:
            p, at = self.path(header, at)
            columns.append(p)
            if at == len(header):
                break
            if header[at] != ",":
                raise Ineligible("a header goes on after a column")
            at += 1
        consts: list[tuple[Path, object]] = []
        starts: dict[Path, str] = {}
        if (line := self.peek(depth)) is not None and line.startswith("all rows: "):
            consts, self.used.consts = self.assigned(self.take(depth)[10:]), True
        if (line := self.peek(depth)) is not None and line.startswith("starts with: "):
            starts, self.used.prefix = dict(self.assigned(self.take(depth)[13:])), True
        if len({*columns, *(p for p, _ in consts)}) < len(columns) + len(consts) or not {*starts} <= {*columns} or not all(J.kind_of(s) == "string" for s in starts.values()):
            raise Ineligible("columns repeat or a start has no column")
        return [self.row(self.take(depth), columns, consts, starts) for _ in range(n)]

    def row(self, line: str, columns: list[Path], consts: list, starts: dict) -> dict:
        cells = cells_of(line)
        if len(cells) != len(columns):
            raise Ineligible(f"a row has {len(cells)} cells, not {len(columns)}")
        out: dict = {}
        for p, text in zip(columns, cells, strict=True):
            if text == "":
                self.used.absent = True
                continue
            self.used.json |= text[:1] in ("[", "{")
            v = read_scalar(text)
            self.place(out, p, starts[p] + v if p in starts and J.kind_of(v) == "string" else v)
        for p, v in consts:
            self.place(out, p, v)
        if not out:
            raise Ineligible("a row is empty")
        return out

    @staticmethod
    def place(row: dict, p: Path, v: object) -> None:
        for k in p[:-1]:
            row = row.setdefault(k, {})
            if not isinstance(row, dict):
                raise Ineligible("a path goes through a value")
        if p[-1] in row:
            raise Ineligible("a path is there twice")
        row[p[-1]] = v


class Toonx:
    name, version, primer = "toonx", "3", PRIMER + "".join(SENTENCES.values())

    def check(self, value: object, union: bool = False) -> None:
        if not isinstance(value, (list, dict)):
            raise Ineligible("top-level value is not an object or array")
        if not value:
            raise Ineligible("empty array" if isinstance(value, list) else "empty object")

    def encode(self, value: object, union: bool = False) -> str:
        return self.both(value, J.write(value))[0]

    def both(self, value: object, canonical: str, union: bool = False) -> tuple[str, str]:
        self.check(value)
        cut = split_wide(value)
        return verified(self, "\n".join(object_lines(cut) if isinstance(cut, dict) else array_lines("", cut, 0)), canonical)

    def read(self, text: str) -> tuple[object, Features]:
        reader = Reader(text)
        try:
            return reader.document(), reader.used
        except J.JsonError as e:
            raise Ineligible(str(e)) from None

    def decode(self, text: str) -> object:
        return self.read(text)[0]

    def lossless(self, union: bool) -> bool:
        return not union

    def features(self, text: str) -> Features:
        """Of a text that doesn't decode, all."""
        try:
            return self.read(text)[1]
        except ValueError:
            return Features(*[True] * len(fields(Features)))

    def primer_for(self, blocks: list[str], base: str = PRIMER) -> str:
        found = [self.features(b) for b in blocks]
        return base + "".join(s for name, s in SENTENCES.items() if any(getattr(f, name) for f in found))


TOONX = register(Toonx())
__all__ = ["TOONX", "Features", "bare"]
