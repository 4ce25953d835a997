"""Questions with known answers about a payload's table: lookups, counts, largest values."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

from . import jsonlex as J

LONGEST, MOST = 60, 4
#: Fixed order of preference for the column that names a row.
NAMING = ("id", "name", "login", "title", "full_name", "slug", "number", "key", "tag_name")


def flat_row(row: dict, before: str = "") -> dict[str, object]:
    """Dotted paths of scalars; arrays, empty objects and keys with dots are left out."""
    out = {}
    for k, v in row.items():
        if "." in k or isinstance(v, list):
            continue
        if isinstance(v, dict):
            out |= flat_row(v, f"{before}{k}.")
        else:
            out[before + k] = v
    return out


def shown(v: object) -> str:
    return str(v) if isinstance(v, str) else J.write(v)


def usable(v: object) -> bool:
    """Short, on one line, without outer blanks."""
    if v is None or isinstance(v, (list, dict)):
        return False
    s = shown(v)
    return 0 < len(s.encode()) <= LONGEST and s == s.strip() and "\n" not in s


def naming_column(columns: list[str], rows: list[dict]) -> str | None:
    """The best column whose values are usable and differ in all rows."""
    fit = [c for c in columns if all(usable(r.get(c)) and not isinstance(r[c], bool) for r in rows) and len({shown(r[c]) for r in rows}) == len(rows)]

    def rank(c: str) -> int:
        if c in NAMING:
            return NAMING.index(c)
        return 50 if c.endswith(("id", "name")) else 100 + c.count(".")

    return min(fit, key=lambda c: (rank(c), c.encode()), default=None)


def chooser(seed: str) -> Callable[[str, int], int]:
    """A number below n for a purpose, by a hash, so that the same payload gives the same questions anywhere."""
    return lambda purpose, n: int.from_bytes(hashlib.sha256(f"{seed}/{purpose}".encode()).digest()[:8], "big") % n


def questions(table: list[dict], where: str, seed: str) -> list[dict[str, str]]:
    """Up to MOST questions: kind, text, answer."""
    rows = [flat_row(r) for r in table]
    columns = sorted({c for r in rows for c in r}, key=str.encode)
    if not rows or (name := naming_column(columns, rows)) is None:
        return []
    draw = chooser(seed)
    have = {c: [i for i, r in enumerate(rows) if r.get(c) is not None] for c in columns if c != name}
    whole = [c for c, i in have.items() if len(i) == len(rows)]
    sparse = [c for c, i in have.items() if 0 < len(i) < len(rows)]
    whole.sort(key=lambda c: ("." not in c, draw(f"order {c}", 1 << 32)))

    def lookup(kind: str, c: str, i: int) -> Iterator[dict[str, str]]:
        v = rows[i].get(c)
        if v is None or usable(v):
            text = f'Look at {where}: which value of "{c}" belongs to the entry with "{name}" {shown(rows[i][name])}? Say none where it has no "{c}".'
            yield {"kind": kind, "text": text, "answer": "none" if v is None else shown(v)}

    def lookups() -> Iterator[dict[str, str]]:
        for c in whole:
            yield from lookup("lookup-nested" if "." in c else "lookup", c, draw(f"row {c}", len(rows)))

    def sparse_lookup() -> Iterator[dict[str, str]]:
        if sparse:
            c = sparse[draw("sparse", len(sparse))]
            without = [i for i in range(len(rows)) if i not in set(have[c])]
            side = without if draw("side", 2) else have[c]
            yield from lookup("lookup-sparse", c, side[draw("sparse row", len(side))])

    def count() -> Iterator[dict[str, str]]:
        fit = [c for c in have if all(usable(rows[i][c]) for i in have[c]) and 2 <= len({shown(rows[i][c]) for i in have[c]}) <= 6]
        if fit:
            c = fit[draw("count", len(fit))]
            v = shown(rows[have[c][draw("value", len(have[c]))]][c])
            n = sum(shown(rows[i][c]) == v for i in have[c])
            yield {"kind": "count-where", "text": f'Count the entries of {where} with the value {v} for "{c}".', "answer": str(n)}

    def largest() -> Iterator[dict[str, str]]:
        for c in sorted((c for c in whole if all(isinstance(r[c], J.Num) for r in rows)), key=lambda c: draw(f"largest {c}", 1 << 32)):
            values = [Fraction(str(r[c])) for r in rows]
            if values.count(max(values)) == 1:
                yield {"kind": "argmax", "text": f'Give the "{name}" of the entry of {where} with the greatest "{c}".', "answer": shown(rows[values.index(max(values))][name])}
                return

    more = lookups()
    out = [q for q in [next(more, None), *sparse_lookup(), *count(), *largest()] if q]
    return (out + list(more))[:MOST]


def payload_questions(text: str, seed: str, rows: int = 20, least: int = 5, most_tokens: int = 16000) -> list[dict[str, str]]:
    """Of a payload's largest table, cut to 20 rows and halved until its document has few enough tokens."""
    document = J.parse(text)
    path = J.largest_table(document)
    if path is None:
        return []
    n = min(rows, len(J.at_path(document, path)))
    while n > least and (len(J.write(J.with_rows(document, path, n)).encode()) + 3) // 4 > most_tokens:
        n = max(least, n // 2)
    table = J.at_path(document, path)[:n]
    return questions(table, f'the "{".".join(path)}" list' if path else "the result", seed)


#: Open tasks by kind, asked in turn. Fixed texts.
TASKS = {
    "summary": "Summarize this data for a colleague in 3 to 5 bullet points. Name specific items and include concrete values.",
    "highlights": "Which 3 items in {where} stand out most? For each, explain in one or two sentences why, quoting its values.",
    "describe": 'Describe the item in {where} whose "{name}" is {a} in a short paragraph, covering its most important fields and their values.',
    "compare": 'Compare the items in {where} whose "{name}" is {a} and {b}. List the fields where they differ, with both values.',
}


def free_form_task(kind: str, table: list[dict], where: str, seed: str) -> str | None:
    """A task's text; those about single items need two rows or more and a column that names them."""
    if kind in ("summary", "highlights"):
        return TASKS[kind].format(where=where)
    rows = [flat_row(r) for r in table]
    name = naming_column(sorted({c for r in rows for c in r}, key=str.encode), rows) if len(rows) > 1 else None
    if name is None:
        return None
    draw = chooser(seed)
    a = draw("a", len(rows))
    b = (a + 1 + draw("b", len(rows) - 1)) % len(rows)
    return TASKS[kind].format(where=where, name=name, a=shown(rows[a][name]), b=shown(rows[b][name]))


def task_of(text: str, name: str, place: int, seed: str) -> dict[str, str] | None:
    """The open task of a payload that comes at a place among all: kinds in turn, a summary where the kind doesn't fit."""
    document = J.parse(text)
    path = J.largest_table(document)
    if path is None:
        return None
    where = f'the "{".".join(path)}" list' if path else "the result"
    kind = list(TASKS)[place % len(TASKS)]
    asked = free_form_task(kind, J.at_path(document, path), where, seed)
    if asked is None:
        kind, asked = "summary", TASKS["summary"]
    return {"id": f"freeform-{name}-{kind}", "kind": f"freeform-{kind}", "text": asked}


def judge_input(answers: dict[str, str], seed: str) -> list[tuple[str, str, str]]:
    """Answers under shuffled labels A, B, …: label, format, answer."""
    draw = chooser(seed)
    order = sorted(answers, key=lambda f: (draw(f, 1 << 62), f))
    return [(chr(65 + i), f, answers[f]) for i, f in enumerate(order)]


def parse_judgement(reply: str, labels: list[str]) -> dict[str, object]:
    """Grades by label and which pairs are the same, from the reply's outer braces; ValueError if it lacks any."""
    start, end = reply.find("{"), reply.rfind("}")
    if start < 0 or end < start:
        raise ValueError("no object in the reply")
    found = J.parse(reply[start : end + 1])
    grades = {}
    for label in labels:
        g = (found.get("grades") or {}).get(label)
        if not isinstance(g, dict) or not isinstance(g.get("errors"), list) or str(g.get("complete")) not in set("12345"):
            raise ValueError(f"no grade of {label}")
        grades[label] = {"errors": [shown(e) for e in g["errors"]], "complete": int(g["complete"])}
    wanted = {f"{a}={b}" for i, a in enumerate(labels) for b in labels[i + 1 :]}
    same = found.get("same") or {}
    if set(same) != wanted or not all(isinstance(v, bool) for v in same.values()):
        raise ValueError("pairs are missing")
    return {"grades": grades, "same": dict(same)}
