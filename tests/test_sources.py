import json

import pytest

from ledgerloom.functions import jsonlex as J
from ledgerloom.functions import questions as Q
from ledgerloom.sources import records as S


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_strict_and_tolerant_lines(spark, tmp_path):
    good = json.dumps({"tenant_id": "a", "route_id": "r", "from": 0, "to": 1, "stats": {"N": 3, "Diff": 0.5}, "more": 1})
    path = write(tmp_path / "t.jsonl", good, "{broken", good.replace('"a"', '"b"'))
    rows = S.read_tolerant(spark, path, S.TRANSITION).orderBy("ordinal").collect()
    assert [(r.tenant_id, r.to, r.stats.N) for r in rows] == [("a", 1, 3), ("b", 1, 3)]
    assert S.read_tolerant(spark, str(tmp_path / "none"), S.TRANSITION).collect() == []
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        S.read_strict(spark, path, S.TRANSITION).collect()


def test_policies(spark, tmp_path):
    routes = [{"route_id": "r", "state": "shadow", "min_payload_tokens": 50}, {"tenant_id": "t", "route_id": "r", "codec": "toonx", "rules": ["max"], "output_price_ratio": 5}]
    rows = S.read_policies(spark, write(tmp_path / "p.json", json.dumps({"routes": routes}))).collect()
    assert [(r.tenant_id, r.state, r.min_payload_tokens, r.output_price_ratio, r.rules) for r in rows] == [("*", "SHADOW", 50, 4.0, []), ("t", "OFF", 200, 5.0, ["max"])]
    for bad in ({"route_id": "r", "colour": 1}, {"route_id": "r", "state": "ON"}, {"route_id": "r", "output_price_ratio": -1}, {}, {"route_id": "r", "validate": 1}):
        with pytest.raises(S.PolicyError):
            S.read_policies(spark, write(tmp_path / "q.json", json.dumps({"routes": [bad]})))


def test_streams_and_tables(spark, tmp_path):
    path = write(tmp_path / "s.txt", "event: a", 'data: {"x":1} ', "", "data:[DONE]")
    assert [r.data for r in S.read_sse(spark, path).orderBy("pos").collect()] == ['{"x":1}', "[DONE]"]
    path = write(tmp_path / "t.tsv", "a\tb", "1\\n2\tx\\py", "only\\\\n")
    cells = {(r.row, r.col): r.cell for r in S.read_tables(spark, path).collect()}
    assert cells == {(0, 0): "a", (0, 1): "b", (1, 0): "1\n2", (1, 1): "x|y", (2, 0): "only\\n", (2, 1): ""}


def test_manifests(spark, tmp_path):
    bodies = spark.createDataFrame([("a", "one"), ("b", "two")], "name string, body string")
    S.write_manifest(bodies, str(tmp_path / "m"))
    manifest = spark.read.json(str(tmp_path / "m"))
    assert [r.body for r in S.registered(bodies, manifest, ["name"]).orderBy("name").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="checksum differs"):
        S.registered(bodies.where("name = 'a'"), manifest, ["name"]).collect()
    path = write(tmp_path / "d.json", json.dumps({"items": [{"n": 1}, {"n": 2}]}))
    assert [r.n for r in S.read_manifest(spark, path, "items", "n int").collect()] == [1, 2]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x|y", 0.5), (2, None, None)], "a int, b string, c double")
    S.append_lines(rows, str(tmp_path / "l"))
    S.append_lines(rows, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    S.dump(rows, str(tmp_path / "d"), "a")
    assert (tmp_path / "d" / "a=1").is_dir()
    assert S.markdown(rows.orderBy("a")).split("\n") == ["| a | b | c |", "| --- | --- | --- |", "| 1 | x\\|y | 0.500 |", "| 2 |  |  |"]


TABLE = {"total": J.Num("3"), "items": [{"id": J.Num(i), "v": J.Num(f"{i}.50"), "s": "xy"[i % 2], "n": {"k": f"k{i}"}, **({"o": "z"} if i else {})} for i in range(6)]}


def test_questions_have_their_answers():
    text = J.write(TABLE)
    asked = Q.payload_questions(text, "seed")
    assert asked == Q.payload_questions(text, "seed") and len(asked) == 4
    kinds = {q["kind"]: q for q in asked}
    assert kinds["argmax"]["answer"] == "5" and kinds["count-where"]["answer"] in ("1", "3", "5")
    assert kinds["lookup-nested"]["answer"].startswith("k") and kinds["lookup-sparse"]["answer"] in ("z", "none")
    assert Q.payload_questions("[1,2]", "s") == [] and Q.payload_questions('[{"a":1},{"a":1}]', "s") == []


def test_largest_tables_and_rows():
    assert J.largest_table(TABLE) == ["items"]
    assert J.with_rows(TABLE, ["items"], 2)["items"] == TABLE["items"][:2]
    assert J.largest_table({"a": {"b": {"c": {"d": [{}]}}}}) is None
    assert J.largest_table({"a.b": [{}, {}], "c": [{}]}) == ["c"]


def test_judgements():
    shown = Q.judge_input({"toonx": "t", "json": "j"}, "s")
    assert sorted(f for _, f, _ in shown) == ["json", "toonx"] and [x[0] for x in shown] == ["A", "B"]
    reply = 'Sure: {"grades":{"A":{"errors":[],"complete":5},"B":{"errors":["e"],"complete":1}},"same":{"A=B":false}} done'
    assert Q.parse_judgement(reply, ["A", "B"]) == {"grades": {"A": {"errors": [], "complete": 5}, "B": {"errors": ["e"], "complete": 1}}, "same": {"A=B": False}}
    for bad in ("none", reply.replace("5", "6"), reply.replace("A=B", "A=C")):
        with pytest.raises(ValueError):
            Q.parse_judgement(bad, ["A", "B"])
    rows = TABLE["items"]
    assert [Q.free_form_task(k, rows, "x", "s") is None for k in Q.TASKS] == [False] * 4
    assert Q.free_form_task("compare", rows[:1], "x", "s") is None
