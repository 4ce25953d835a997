"""Codecs on inputs of our own. Expected texts of tables come from oracle(), which writes the notation by its definition:
every way to lay a table out, then the shortest."""

import csv
import io
import itertools
import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions import jsonlex as J
from ledgerloom.functions import rendering
from ledgerloom.functions.codecs import CODECS, Ineligible, names, register

TABULAR, TOONX, TOON = CODECS["tabular"], CODECS["toonx"], CODECS["toon"]


def word(v):
    """A cell, for values whose texts need no quotes."""
    return {None: "null", True: "true", False: "false"}[v] if v is None or isinstance(v, bool) else str(v)


def spread(row, into, before=()):
    for k, v in row.items():
        if into and isinstance(v, dict) and v:
            yield from spread(v, into, (*before, k))
        else:
            yield (*before, k), v


def oracle(rows):
    """The table's text: with and without flattened objects, with and without shared values ahead; the first shortest."""
    found = []
    for into, ahead in itertools.product((False, True), (False, True)):
        flat = [dict(spread(r, into)) for r in rows]
        columns = sorted({p for r in flat for p in r}, key=lambda p: "\0".join(p).encode())
        same = [p for p in columns if ahead and len(rows) > 2 and all(p in r for r in flat) and len({json.dumps(r[p], sort_keys=True) for r in flat}) == 1]
        if len(same) == len(columns):
            same.pop()
        show = lambda v: json.dumps(v, separators=(",", ":"), sort_keys=True) if isinstance(v, (list, dict)) else word(v)
        left = [p for p in columns if p not in same]
        lines = ["all rows: " + ",".join(".".join(p) + "=" + show(flat[0][p]) for p in same)] if same else []
        lines += [",".join(show(r[p]) if p in r else "" for p in left) for r in flat]
        found.append("\n  ".join([f"[{len(rows)}]{{{','.join('.'.join(p) for p in left)}}}:", *lines]))
    return min(found, key=lambda t: len(t) - t.count("\n  ") * 2 - t.count("[") * 0)


SHIPS = [{"ship": "brig", "crew": 12, "home": {"port": "Hull", "pier": 4}}, {"ship": "sloop", "crew": 7, "home": {"port": "Cork", "pier": 9}}, {"ship": "ketch", "crew": 5, "home": {"port": "Oban", "pier": 2}}]
TABLES = [
    [{"tide": 3, "gauge": "north"}, {"tide": 5, "gauge": "south pier"}],
    SHIPS,
    [{**s, "flag": "blue ensign", "afloat": True} for s in SHIPS],
    [{**s, "cargo": ["tea", 3]} for s in SHIPS],
    [{**s, "mate": None} if i else {"ship": "yawl", "crew": 2} for i, s in enumerate(SHIPS)],
    [{"berth": k, "season": "winter"} for k in range(2)],
    [{"berth": k, "season": "winter", "rate": {"day": 40, "week": 200}} for k in range(4)],
    [{"only": "same text"} for _ in range(5)],
]


@pytest.mark.parametrize("rows", TABLES)
def test_tables_are_laid_out_as_defined(rows):
    text = TOONX.encode(J.parse(json.dumps(rows)))
    assert text == oracle(rows)
    assert json.loads(J.write(TOONX.decode(text))) == rows


LEAF = st.integers(0, 300) | st.sampled_from(["elm", "ash tree", "oak", "fir"]) | st.booleans() | st.none()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.fixed_dictionaries({"a": LEAF, "b": LEAF, "c": st.fixed_dictionaries({"d": LEAF})}), min_size=1, max_size=6))
def test_any_small_table_is_laid_out_as_defined(rows):
    text = TOONX.encode(J.parse(json.dumps(rows)))
    # Null and absent cells, shared or not, may tie in bytes; the shortest form's size is what is defined.
    assert len(text) == len(oracle(rows)) and json.loads(J.write(TOONX.decode(text))) == rows


def test_cells_that_need_quotes():
    values = ["", " edge", "true", "31", "-dash", "a:b", "x,y", 'say "ho"', "[list", "line\nbreak", "07"]
    text = TOONX.encode({"v": values})
    cells = text.removeprefix(f"v[{len(values)}]: ")
    assert next(csv.reader(io.StringIO(cells.replace('\\"', '""').replace("\\n", "\n")))) == values
    assert cells.count('"') == 2 * len(values) + 2
    assert TOONX.decode(text) == {"v": values}


def test_starts_of_addresses():
    """The longest shared start that ends in a slash and leaves no row with digits only."""
    base = "https://harbour.example/logs/"
    for tails, kept in ((["brig/1", "brig/2", "brig/x"], base), (["brig/a", "brig/b", "sloop"], base), (["brig/a", "brig/b", "brig/c"], base + "brig/"), (["1", "2", "3"], "https://harbour.example/")):
        rows = [{"k": J.Num(i), "u": base + t} for i, t in enumerate(tails)]
        lines = TOONX.encode(rows).split("\n")
        assert lines[1] == f'  starts with: u="{kept}"'
        assert [x.split(",", 1)[1] for x in lines[2:]] == [(base + t).removeprefix(kept) for t in tails]
        assert TOONX.decode("\n".join(lines)) == rows


def test_objects_and_lists_of_anything():
    value = {"log": {"page": J.Num("2"), "notes": []}, "mixed": [J.Num("4"), {"knots": J.Num("6.0")}, ["a"]], "none": {}}
    assert TOONX.encode(value).split("\n") == ["log:", "  notes[0]:", "  page: 2", "mixed[3]:", "  - 4", '  - {"knots":6.0}', '  - ["a"]', "none: {}"]


@pytest.mark.parametrize("text", ["{}", "[]", "3", '"x"', "null"])
def test_what_has_no_indented_form(text):
    with pytest.raises(Ineligible):
        TOONX.encode(J.parse(text))


def broken(text):
    """A text with one line lost, doubled, deeper or with a cell too many."""
    lines = text.split("\n")
    for k, line in enumerate(lines[1:], 1):
        if not line.startswith("  all rows: "):  # without it the text is another table's
            yield "\n".join(lines[:k] + lines[k + 1 :])
        yield "\n".join([*lines[:k], line, *lines[k:]])
        yield "\n".join([*lines[:k], "  " + line, *lines[k + 1 :]])
        yield "\n".join([*lines[:k], line + ",9", *lines[k + 1 :]])


@pytest.mark.parametrize("rows", TABLES[:5])
def test_broken_tables_are_refused(rows):
    for text in broken(TOONX.encode(J.parse(json.dumps(rows)))):
        with pytest.raises(ValueError):
            TOONX.decode(text)


@pytest.mark.parametrize("text", ["knots: 4\nknots: 5", "[2]{crew,crew}:\n  1,2\n  3,4", "port: Hull: quay", "[02]: 4,5", '[1]{mate}:\n  "open', 'tide[1]: "in"out', "lonely"])
def test_other_broken_texts_are_refused(text):
    with pytest.raises(ValueError):
        TOONX.decode(text)


# JSON.


@pytest.mark.parametrize("text", ['{"z":[{"y":1,"x":[]}],"a":"t\\u0009é\\/"}', " [ 10.50 , -0.0e0, 12345678901234567890 ] ", '{"ä":1,"z":2,"\\ud83d\\ude80":3}'])
def test_canonical_is_sorted_compact_and_keeps_numbers(text):
    got = J.canonical(text)
    assert json.loads(got) == json.loads(text) and J.canonical(got) == got
    assert re.findall(r"-?[0-9][0-9.e]*", re.sub(r'"(?:[^"\\]|\\.)*"', "", got)) == re.findall(r"-?[0-9][0-9.e]*", re.sub(r'"(?:[^"\\]|\\.)*"', "", text)) or "{" in text
    keys = list(json.loads(got)) if got.startswith("{") else []
    assert keys == sorted(keys, key=str.encode) and got == J.write(J.parse(text))


def test_lone_halves_of_pairs_are_replaced():
    assert J.canonical('["\\udc00x",{"\\udbff":"\\ud834"}]') == '["�x",{"�":"�"}]'


@pytest.mark.parametrize("text", ["", "{} {}", '{"k":1,"k":1}', "Infinity", "-", "2.", "007", '["x",]', "{k:1}", '"\x02"', b"\xc3(", "[" * 600 + "]" * 600])
def test_strict_parsing_rejects(text):
    with pytest.raises(J.JsonError):
        J.parse(text)


def test_depth_limit_is_inclusive():
    deepest = "[" * J.MAX_DEPTH + "]" * J.MAX_DEPTH
    assert J.write(J.parse(deepest)) == deepest
    with pytest.raises(J.JsonError):
        J.parse(f"[{deepest}]")


@settings(max_examples=200, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=15))
def test_pretty_is_that_of_the_standard_library(v):
    text = json.dumps(v, ensure_ascii=False)
    if "\ud800" <= max(text, default="") <= "\udfff":
        return
    value = J.parse(text)
    ordered = lambda x: {k: ordered(x[k]) for k in sorted(x, key=str.encode)} if isinstance(x, dict) else [ordered(y) for y in x] if isinstance(x, list) else x
    assert J.pretty(value) == json.dumps(ordered(json.loads(J.write(value))), ensure_ascii=False, indent=2).replace("\x7f", "\x7f")
    assert rendering.compact(J.pretty(value)) == J.write(value)


# Round trips of everything.

VALUES = st.recursive(
    st.none() | st.booleans() | st.sampled_from(["4", "-0", "19.0", "2e300", "-31", "18014398509481985"]).map(J.Num) | st.text(alphabet=st.sampled_from(list("qr:,\"[]{}-#.=\n é07\x02\\")), max_size=6)
    | st.sampled_from(["https://quay.example/a/5", "https://quay.example/a/6", "https://quay.example/b", "false", "null", "03"]),
    lambda x: st.lists(x, max_size=5) | st.dictionaries(st.sampled_from(["m", "n", "o.p", "#", "", "ü", *(f"w{i}" for i in range(9)), "part1", "part2"]), x, max_size=12),
    max_leaves=40,
)


@settings(max_examples=400, deadline=None)
@given(VALUES)
def test_round_trips(v):
    for codec in CODECS.values():
        try:
            text = codec.encode(v)
        except Ineligible:
            continue
        assert J.write(codec.decode(text)) == J.write(v)


ROWS = st.lists(st.fixed_dictionaries({k: st.sampled_from(["u", "v w", "", "4"]) | st.integers(0, 99).map(lambda i: J.Num(i)) | st.none() for k in "klmnopqrst"}), min_size=2, max_size=6)


@settings(max_examples=100, deadline=None)
@given(ROWS)
def test_wide_tables_are_cut_and_joined(rows):
    text = TOONX.encode(rows)
    assert J.write(TOONX.decode(text)) == J.write(rows)
    vary = sum(len(rows) < 3 or len({J.write(r[k]) for r in rows}) > 1 for k in rows[0])
    assert ("part1" in text) == (vary > 8)


# Lists in the public notation.


def test_lists_stand_under_dashes():
    value = J.parse('{"log":[{"at":1,"crew":["ann","bo"]},{"at":2,"wind":{"from":"west"}},[3,4],"calm",{"ports":[{"n":"Hull"},{"n":"Cork"}],"z":1}]}')
    want = ["log[5]:", "  - at: 1", "    crew[2]: ann,bo", "  - at: 2", "    wind:", "      from: west", "  - [2]: 3,4", "  - calm", "  - z: 1", "    ports[2]{n}:", "      Hull", "      Cork"]
    assert TOON.encode(value).split("\n") == want
    assert J.write(TOON.decode("\n".join(want))) == J.write(value)


def test_numbers_that_are_doubles():
    """What a double writes in its shortest plain form is kept, anything else refused."""
    for text in ("2.5", "-17", "0", "1000000", "0.001"):
        assert TOON.decode(TOON.encode([J.Num(text)])) == [text]
    for text in ("2.50", "-0", "1e3", "36028797018963969", "1e999"):
        assert float(text) in (float("inf"), 0) or format(float(text), "f").rstrip("0").rstrip(".") != text
        with pytest.raises(Ineligible):
            TOON.encode([J.Num(text)])


@pytest.mark.parametrize("value", [[{}, {"a": J.Num("1")}], ["bell\x07"], J.Num("4"), "text", None])
def test_what_the_public_notation_refuses(value):
    with pytest.raises(Ineligible):
        TOON.encode(value)


# Tables of JSON lines.


def test_tabular_lines_are_json():
    rows = J.parse('[{"w":"a, b","v":7.10},{"w":null,"v":-0}]')
    lines = TABULAR.encode(rows).split("\n")
    assert [json.loads(x, parse_int=str, parse_float=str) for x in lines] == [["v", "w"], ["7.10", "a, b"], ["-0", None]]
    assert TABULAR.decode("\n".join(lines)) == rows


def test_tabular_union_fills_what_is_absent():
    rows = J.parse('[{"n":"Hull"},{"depth":9},{"n":"Oban","depth":4}]')
    with pytest.raises(Ineligible):
        TABULAR.encode(rows)
    assert [json.loads(x) for x in TABULAR.encode(rows, union=True).split("\n")] == [["depth", "n"], [None, "Hull"], [9, None], [4, "Oban"]]


@pytest.mark.parametrize("text", ["[]", "[4]", "[{}]", '[{"":1}]', '[{"k":1},{"k":true}]', '[{"k":1},{"k":2,"l":3}]', '[{"k":{"l":1}}]', '{"k":[{"l":1}]}'])
def test_what_is_no_flat_table(text):
    with pytest.raises(Ineligible):
        TABULAR.encode(J.parse(text))


def test_tabular_refuses_changed_lines():
    good = TABULAR.encode(J.parse('[{"k":1,"l":"x"},{"k":2,"l":"y"}]'))
    head, first, second = good.split("\n")
    for lines in ([head], ['["l","k"]', first, second], ['["k","k"]', first, second], [head, first, "[3]"], [head, first, '[3,["y"]]'], [head, first, second, ""], [head, first, second + "x"], [head, '{"k":1}', second]):
        with pytest.raises(Ineligible):
            TABULAR.decode("\n".join(lines))


# Primers, formats, the registry.


def test_primers_tell_what_is_used():
    from ledgerloom.functions.codecs.toonx import SENTENCES

    plain, holes = (TOONX.encode(J.parse(t)) for t in ('[{"k":1},{"k":2}]', '[{"k":1,"l":"x"},{"k":2}]'))
    assert TOONX.primer_for([plain]) == TOON.primer
    assert TOONX.primer_for([plain, holes]) == TOON.primer + SENTENCES["absent"]
    assert TOONX.primer_for(["no table {"]) == TOON.primer + "".join(SENTENCES.values())


def test_formats():
    text = '[ {"b": "x, y", "a": 1.0}, {"b": null, "a": 2} ]'
    got = {f: rendering.render(f, text, True) for f in rendering.FORMATS if f not in ("toon",)}
    assert got["json-compact"] == got["gateway"] == got["json-compact-2"] == ('[{"b":"x, y","a":1.0},{"b":null,"a":2}]', "")
    assert rendering.render("json-compact", text)[0] == J.canonical(text)
    assert list(csv.reader(io.StringIO(got["csv"][0]))) == [["a", "b"], ["1.0", "x, y"], ["2", ""]] and got["csv"][1] == rendering.CSV_PRIMER
    assert got["toonx-p2"][0] == got["toonx"][0] and got["toonx-p2"][1].startswith(rendering.SHORT_PRIMER)
    assert got["tabular"][1] == TABULAR.primer and json.loads(got["json-pretty"][0]) == json.loads(text)
    with pytest.raises(Ineligible):
        rendering.render("toon", text)  # 1.0 is no shortest form
    with pytest.raises(ValueError):
        rendering.render("xml", text)


def test_names_are_taken_once():
    assert names() == ["tabular", "toon", "toonx"]
    with pytest.raises(ValueError):
        register(TOON)
