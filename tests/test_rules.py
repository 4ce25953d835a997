import base64
import hashlib
import hmac
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import columns as C
from ledgerloom.functions import messages as M
from ledgerloom.functions import scoring as S
from ledgerloom.operators import evidence as E
from ledgerloom.operators import payloads as P
from ledgerloom.operators import records as R
from ledgerloom.operators import wire as W
from ledgerloom.plans.evidence_queries import samples
from ledgerloom.plans.stream_queries import SAMPLES
from ledgerloom.streaming.promoter import Route

PARTS_FORM = json.dumps({"model": "m", "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "t1", "name": "list", "input": {"b": 1, "a": 2}}]}, {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": "[{\"a\":1}]"}, {"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "[]"}, {"type": "image"}]}]})
CALLS_FORM = json.dumps({"messages": [{"role": "assistant", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": "{}"}}]}, {"role": "tool", "tool_call_id": "c", "content": [{"type": "text", "text": "{\"x\":1}"}]}]})


def test_requests_become_blocks(spark):
    df = spark.createDataFrame([(1, PARTS_FORM), (2, CALLS_FORM), (3, "nope"), (4, None)], "request_id long, body string")
    rows = W.blocks(df, "request_id", "body")
    got = {(r.request_id, r.msg, r.part, r.kind, r.tool) for r in rows.collect()}
    assert got == {(1, 0, 0, "text", None), (1, 1, 0, "tool_use", "list"), (1, 2, 0, "tool_result", "list"), (1, 2, 1, "tool_result", "list"), (1, 2, 2, "other", None), (2, 0, -1, "tool_use", "f"), (2, 1, 0, "tool_result", "f")}
    assert sorted(r.data for r in W.data_blocks(rows).collect()) == ['[{"a":1}]', '{"x":1}']
    marked = W.marked(rows, F.lit("0, 7:1,x")).where("kind = 'marked_data'").collect()
    assert [(r.request_id, r.text) for r in marked] == [(1, "hi")]


def test_results_are_patched_in_place():
    out = json.loads(M.with_result(PARTS_FORM, 2, 0, "enc", "p"))
    assert out["messages"][2]["content"][0]["content"] == "enc" and out["system"] == "p"
    assert json.loads(M.with_result(CALLS_FORM, 1, 0, "enc", ""))["messages"][1]["content"] == "enc"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[1]", [(0, 3, "", "[1]")]),
        ("é\n```json\n{\"a\":1}\n```", [(11, 18, "json", '{"a":1}')]),
        ("```\n[1]\n```\n~~~JSON\n[2]\n~~~~", [(4, 7, "", "[1]"), (20, 23, "JSON", "[2]")]),
        ("```python\n[1]\n```", []),
        ("```json\n[1]", []),
        ("````json\n```\n````", []),
        (None, []),
    ],
)
def test_data_spans(text, want):
    assert M.data_spans(text) == want


def test_streams_fold():
    lines = [
        {"type": "message_start", "message": {"usage": {"input_tokens": 5}}},
        {"type": "content_block_start", "index": 1, "content_block": {"type": "tool_use", "id": "t", "name": "f"}},
        {"type": "content_block_delta", "index": 0, "delta": {"text": "he"}},
        {"type": "content_block_delta", "index": 1, "delta": {"partial_json": '{"a"'}},
        {"type": "content_block_delta", "index": 0, "delta": {"text": "llo"}},
        {"type": "content_block_delta", "index": 1, "delta": {"partial_json": ":1}"}},
        {"type": "message_delta", "usage": {"output_tokens": 7}},
    ]
    found = M.assemble("".join(f"event: x\ndata: {json.dumps(x)}\n\n" for x in lines) + "data: [DONE]\n")
    assert found == {"text": "hello", "calls": [{"id": "t", "name": "f", "args": '{"a":1}'}], "usage": {"input_tokens": 5, "output_tokens": 7}}
    assert M.usage_of({"usage": {"input_tokens": 1, "cache_read_input_tokens": 2, "cache_creation_input_tokens": 4, "output_tokens": 8}}) == (7, 8, 2)


def test_redaction():
    text = '{"API-Key":1,"x":"{\\"password\\":\\"p\\",\\"y\\":[1.50]}","z":["t",{"token":null}]}'
    assert M.redacted(text) == '{"API-Key":"[REDACTED]","x":"{\\"password\\":\\"[REDACTED]\\",\\"y\\":[1.50]}","z":["t",{"token":"[REDACTED]"}]}'
    assert M.redacted("not json") == '"[REDACTED]"' and M.redacted(None) is None


CONTRACT = {
    "schemas": {"pay": {"type": "object", "required": ["amount"], "properties": {"amount": {"type": ["number", "string"]}, "to": {"type": "string", "pattern": "^a"}, "n": {"type": "integer", "minimum": "1"}}, "additionalProperties": {"type": ["string", "object"]}}},
    "scopes": {"pay": "payments:write"},
    "max_amount": "100.10",
}
CONTEXT = {"scopes": ["payments:*"], "tenant_id": "7", "resource_constraints": {"account": ["x", "y"]}}


@pytest.mark.parametrize(
    ("args", "step"),
    [
        ('{"amount":100.10}', None),
        ('{"amount":"100.11"}', "rule"),
        ('{"amount":1e9}', "rule"),
        ("{}", "schema"),
        ('{"amount":1,"to":"b"}', "schema"),
        ('{"amount":1,"n":1.5}', "schema"),
        ('{"amount":1,"n":2.0}', None),
        ('{"amount":1,"amount":2}', "schema"),
        ('{"amount":1,"sub":{"Tenant_ID":"8"}}', "authz"),
        ('{"amount":1,"account":"z"}', "authz"),
        ('{"amount":1,"account":"y"}', None),
    ],
)
def test_tool_calls(args, step):
    found = M.violations({"name": "pay", "args": args}, CONTRACT, CONTEXT)
    assert (found[0][0] if found else None) == step


def test_unknown_tools_and_scopes(spark):
    assert M.violations({"name": "x", "args": "{}"}, CONTRACT, CONTEXT)[0][0] == "contract"
    assert M.violations({"name": "pay", "args": '{"amount":1}'}, CONTRACT, {"scopes": ["payments:read"]})[0][0] == "authz"
    calls = spark.createDataFrame([(1, "pay", '{"amount":1}'), (1, "x", "{}")], "request_id long, name string, args string")
    assert [len(r.violations) for r in W.checked(calls, CONTRACT, CONTEXT).orderBy("name").collect()] == [0, 1]


def test_claims():
    pack = lambda x: base64.urlsafe_b64encode(x).rstrip(b"=").decode()
    head, body = pack(b'{"alg":"HS256"}'), pack(b'{"sub":"u","exp":100}')
    token = f"{head}.{body}.{pack(hmac.new(b'k', f'{head}.{body}'.encode(), hashlib.sha256).digest())}"
    assert M.claims(token, b"k", 99)["sub"] == "u"
    assert M.claims(token, b"k", 100) is None and M.claims(token, b"j", 1) is None and M.claims("x", b"k", 1) is None


@pytest.mark.parametrize(
    ("reply", "answer", "numeric", "want"),
    [("1,234.50", "1234.5", True, True), ("The total is $12.", "12", True, True), ("x" * 90 + " 12", "12", True, False), ("1e2", "100", True, True), ("13", "12", True, False), ("It is Paris", "paris", False, True), ("Paris " + "x" * 40, "paris", False, False), ("", "", False, True)],
)
def test_scoring(reply, answer, numeric, want):
    assert S.correct(reply, answer, numeric) == want


@pytest.mark.parametrize(
    ("got", "want", "same"),
    [(["Ångström (unit)", "2"], ["2.0", "angstrom"], True), (["a"], ["a", "b"], False), (["2001-xx-05"], ["2001-XX-5"], True), (["a", "a"], ["a"], True), (["1,000"], ["1000"], True)],
)
def test_value_sets(got, want, same):
    assert S.same_values(got, want) == same


def test_table_cells():
    assert S.column_names(["", "a  b", "a b", " "]) == ["col0", "a b", "a b_2", "col3"]
    assert S.listed(r"a\pb|c\\n|\n") == ["a|b", "c\\n", "\n"]


def test_exact_tests(spark):
    rows = [(b, c, E.mcnemar_p(b, c)) for b in range(0, 30, 3) for c in range(0, 30, 4)]
    got = spark.createDataFrame(rows, "b long, c long, p double").select("p", E.mcnemar(F.col("b"), F.col("c")).alias("q")).collect()
    assert all(abs(r.p - r.q) < 1e-9 for r in got)
    rows = [(k, n, p, E.upper_tail(k, n, p)) for n in (1, 50, 400) for k in range(0, n + 1, 7) for p in (0.02, 0.5, 0.9)]
    got = spark.createDataFrame(rows, "k long, n long, p double, t double").select("t", E.binomial_upper_tail(F.col("k"), F.col("n"), F.col("p")).alias("q")).collect()
    assert all(abs(r.t - r.q) < 1e-8 for r in got)


def tally(n, d):
    t = E.Tally()
    for i in range(n):
        t.add({"ab": d(i) >= 0, "cb": d(i) >= 0, "ac": d(i) <= 0, "in_a": 100, "in_b": 70, "in_c": 100, "out_a": 10, "out_b": 10, "out_c": 10, "ok_a": None, "ok_b": None})
    return t


def test_states():
    even = lambda i: 0
    assert E.next_state("SHADOW", tally(199, even)) == ("SHADOW", "collecting")
    assert E.next_state("SHADOW", tally(400, even)) == ("ENABLED", "promoted")
    assert E.next_state("SHADOW", tally(400, even), min_savings=0.5) == ("SHADOW", "measured savings")
    assert E.next_state("SHADOW", tally(400, lambda i: -(i % 2))) == ("OFF", "rejected")
    assert E.next_state("SHADOW", tally(200, lambda i: -(i % 20 == 0) + (i % 20 == 1)))[1] == "straddle"
    assert E.next_state("ENABLED", tally(400, lambda i: -(i % 2))) == ("SHADOW", "demoted")
    assert E.next_state("OFF", tally(400, even))[0] == "OFF"


def rate_of_promotion(drop, routes=120, seed=3):
    """Share of routes whose treatment agrees `drop` less often that are promoted within 4000 samples, and rejected."""
    draw = np.random.default_rng(seed)
    n, end = 4000, {"ENABLED": 0, "OFF": 0, "SHADOW": 0}
    for _ in range(routes):
        ac, ab, cb = draw.random(n) < 0.95, draw.random(n) < 0.95 - drop, draw.random(n) < 0.95 - drop
        d = ab.astype(int) + cb - 2 * ac
        cum, cum2 = np.cumsum(d), np.cumsum(d * d)
        state = "SHADOW"
        for k in range(200, n + 1, 100):
            t = E.Tally()
            t.n, t.d2, t.dd4, t.in_json2, t.in_enc = k, int(cum[k - 1]), int(cum2[k - 1]), 200 * k, 70 * k
            state = E.next_state("SHADOW", t)[0]
            if state != "SHADOW":
                break
        end[state] += 1
    return end["ENABLED"] / routes, end["OFF"] / routes


def test_error_rates_of_the_rule():
    assert rate_of_promotion(0.0)[0] >= 0.9
    assert rate_of_promotion(0.02)[0] <= 0.1
    promoted, off = rate_of_promotion(0.05)
    assert promoted == 0 and off >= 0.95


def test_stream_equals_a_fold(spark, sf_dir):
    from ledgerloom.plans.catalog import QUERIES

    rows = E.valid(samples(spark, sf_dir)).toPandas().sort_values(["ts", "id"])
    want = set()
    for key, group in rows.groupby(["tenant_id", "route_id"]):
        route = Route(None)
        for r in group.to_dict("records"):
            if found := route.take(r, pd.Timestamp(r["ts"]).value // 1000, E.DEFAULTS, 0.15):
                want.add((*key, r["id"], *found))
                route = Route(route.saved())
    got = {(r.tenant_id, r.route_id, r.id, r.n, r.from_state, r.to_state, r.reason) for r in QUERIES["promoter_stream"](spark, sf_dir).collect()}
    assert got == want and got and "FROM events" in SAMPLES


def test_gate_order(spark):
    rows = spark.createDataFrame([(1, "[" + "1," * 50 + "1]", "x"), (2, "y" * 1000, None), (3, "y" * 1000, "z" * 1000), (4, "y" * 1000, "z" * 100)], "id long, json string, encoded string")
    assert [r.failed_gate for r in P.gated(rows).orderBy("id").collect()] == ["min-size", "structural", "net-savings", None]
    assert {r.failed_gate for r in P.gated(rows, P.Policy(state="OFF")).collect()} == {"structural", "opt-in"}


def test_payload_udfs_and_sql_names(spark):
    P.register_sql(spark)
    row = spark.sql("""SELECT canonical_json('{"b":1.50,"a":-0}') AS c, canonical_json('[1') AS n, encode_toonx('[{"a":1},{"a":2}]').encoded AS e, decode_toonx('[1]: 5') AS d, table_check('[]').reason AS t""").first()
    assert tuple(row) == ('{"a":-0,"b":1.50}', None, "[2]{a}:\n  1\n  2", "[5]", "empty array")


def test_clean_reply(spark):
    df = spark.createDataFrame([("<think>a\nb</think> x ",), ("Because.\nAnswer: 12.",), ("plain\ntext",), (None,)], "r string")
    assert [r[0] for r in df.select(C.clean_reply(F.col("r"))).collect()] == ["x", "12", "plain\ntext", None]


@pytest.mark.parametrize(("said", "base", "worse"), [("worse than JSON", "inconclusive", 3), ("inconclusive", "non-inferior", 3), ("inconclusive", "inconclusive", 0), ("non-inferior", "worse than JSON", 0)])
def test_primers_are_adopted_unless_a_verdict_is_worse(spark, said, base, worse):
    rows = spark.createDataFrame([(m, "p2", -0.1, said, base) for m in "abc"], "model string, variant string, cost_hi double, said string, base string")
    (got,) = R.primer_adopted(rows.withColumns({"rank": R.rank(F.col("said")), "base_rank": R.rank(F.col("base"))})).collect()
    assert (got.variant, got.cheaper, got.worse, got.adopted) == ("p2", 3, worse, worse == 0)
