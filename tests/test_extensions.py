"""Counters, registries, validation, identities, logs in many files, loaded questions, reports, calibration."""

import base64
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.functions import bpe, extensions
from ledgerloom.functions import jsonlex as J
from ledgerloom.functions import messages as M
from ledgerloom.operators import evidence as E
from ledgerloom.operators import joins
from ledgerloom.operators import payloads as P
from ledgerloom.operators import records as R
from ledgerloom.operators import wire as W
from ledgerloom.sources import records as S

#: A small vocabulary: all bytes, then merges in the order of their ranks.
MERGES = [b"th", b"in", b"er", b" t", b"the", b" the", b"ing", b"an", b"and", b" a", b" and", b"on", b"ion", b"12", b"123", b"  ", b"\n\n", b"\xc3\xa9", b"st", b"est"]


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    path = tmp_path_factory.mktemp("vocabulary") / "small.tiktoken"
    words = [bytes([i]) for i in range(256)] + MERGES
    path.write_text("\n".join(f"{base64.b64encode(w).decode()} {i}" for i, w in enumerate(words)))
    return str(path), {w: i for i, w in enumerate(words)}


def slow(piece, ranks):
    """Merges one pair a round, the first of the least rank."""
    parts = [bytes([b]) for b in piece]
    while True:
        known = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not known:
            return len(parts)
        k = min(known)[1]
        parts = parts[:k] + [parts[k] + parts[k + 1]] + parts[k + 2 :]


TEXT = st.text(alphabet=st.sampled_from(list("then igrad 123\n\té'sTIE,/!漢ß ́")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_counts_are_those_of_plain_merges(vocabulary, text):
    path, ranks = vocabulary
    parts = list(bpe.pieces(text))
    assert "".join(parts) == text
    assert all(bpe.merged(p.encode(), ranks) == slow(p.encode(), ranks) for p in parts)
    assert bpe.BytePairCounter(path)(text) == sum(slow(p.encode(), ranks) for p in parts)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("HelloWorld it's", ["Hello", "World", " it's"]),
        ("12345 a", ["123", "45", " a"]),
        ("a  b\n\n c", ["a", " ", " b", "\n\n", " c"]),
        ("x.//\ny", ["x", ".//\n", "y"]),
        ("ÉTÉ été", ["ÉTÉ", " été"]),
        ("end   ", ["end", "   "]),
    ],
)
def test_pieces(text, want):
    assert list(bpe.pieces(text)) == want


def test_counters_without_a_vocabulary(spark, vocabulary):
    assert bpe.BytePairCounter("/nowhere")("four bytes") == bpe.heuristic("four bytes") == 3
    assert bpe.BytePairCounter(vocabulary[0])("\ud800") == bpe.BytePairCounter(vocabulary[0])("�")
    if "small" not in extensions.COUNTERS:
        extensions.COUNTERS.register("small", bpe.BytePairCounter(vocabulary[0]))
    rows = spark.createDataFrame([(1, '[{"the":"and the"}]', None), (2, "[12345]", "[[1]]")], "id long, json string, encoded string")
    got = {r.id: (r.json_tokens, r.enc_tokens) for r in P.gated(rows, counter="small").collect()}
    count = extensions.COUNTERS["small"]
    assert got == {1: (count('[{"the":"and the"}]'), None), 2: (count("[12345]"), count("[[1]]"))}


def test_registries():
    own = extensions.Registry("thing")
    own.register("a", 1)
    with pytest.raises(ValueError):
        own.register("a", 2)
    with pytest.raises(KeyError, match="no thing 'b'"):
        own["b"]
    assert {"anthropic", "openai"} <= set(extensions.ADAPTERS) and {"orders", "logs", "search", "employees"} <= set(__import__("ledgerloom.sources.generated", fromlist=["x"]).GENERATORS)


SCHEMAS = {"move": {"type": "object", "required": ["to"], "properties": {"to": {"type": "string"}}}}


def test_rules_and_authorizers_of_the_user():
    if "no-islands" not in extensions.RULES:
        extensions.RULES.register("no-islands", lambda call, args, context: iter(["islands are closed"] if args["to"] == "isle" else []))
        extensions.AUTHORIZERS.register("only-ann", lambda call, args, contract, context: None if context.get("subject") == "ann" else "not ann")
    contract = {"schemas": SCHEMAS, "rules": ["no-islands"], "authorizer": "only-ann"}
    call = lambda to, name="move": {"id": "7", "name": name, "args": json.dumps({"to": to})}
    assert M.checked_call(call("quay"), contract, {"subject": "ann"}) == []
    both = M.checked_call(call("isle"), contract, {})
    assert [(v["step"], v["rule"], v["call_id"]) for v in both] == [("rule", "no-islands", "7"), ("authz", None, "7")]
    assert [v["step"] for v in M.checked_call(call("quay"), contract, {}, declared=set())] == ["contract"]
    # A response fails as a whole, and each call tells what is wrong with it.
    answer = {"calls": [call("quay"), call(4), call("quay", "sink")]}
    assert [v["step"] for v in M.validated(answer, contract, {"subject": "ann"})] == ["schema", "contract"]
    assert [v["step"] for v in M.validated({"calls": [], "structured": "{}"}, contract, {})] == ["contract"]
    assert M.validated({"calls": [], "structured": '{"ok":1}'}, {"output_schema": {"required": ["ok"]}}, {}) == []
    assert M.validated({"calls": []}, {}, {}, wants_output=True)[0]["step"] == "contract"


@pytest.mark.parametrize(("value", "want"), [("x", "x"), (J.Num("1.50"), "1.50"), (True, "true"), (None, "null"), ([1], M.CONTAINER), ({}, M.CONTAINER)])
def test_scalars_for_comparison(value, want):
    assert M.scalar_string(value) == want


def test_identities(spark):
    import hashlib
    import hmac

    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    body = f"{part({'alg': 'HS256'})}.{part({'sub': 'ann', 'tenant_id': 't', 'scope': ['a', 4, 'b'], 'exp': 100, 'resource_constraints': {'berth': ['4']}})}"
    token = f"{body}.{base64.urlsafe_b64encode(hmac.new(b'k', body.encode(), hashlib.sha256).digest()).rstrip(b'=').decode()}"
    want = {"tenant_id": "t", "subject": "ann", "scopes": ["a", "b"], "resource_constraints": {"berth": ["4"]}}
    assert M.identified({"X-TP-Identity": token}, "jwt-hs256", b"k", 99) == want
    for key, now, headers in ((b"k", 100, {"x-tp-identity": token}), (b"other", 9, {"x-tp-identity": token}), (b"", 9, {"x-tp-identity": token}), (b"k", 9, {"x-tp-tenant": "t"})):
        assert M.identified(headers, "jwt-hs256", key, now) is None
    with pytest.raises(ValueError):
        M.identified({}, "none")
    from pyspark.sql import functions as F

    row = spark.range(1).select(W.identified(F.create_map(F.lit("x-tp-identity"), F.lit(token)), "jwt-hs256", b"k", 99).alias("w")).first().w
    assert (row.tenant_id, row.scopes, row.resource_constraints) == ("t", ["a", "b"], {"berth": ["4"]})


def test_responses_in_both_formats():
    one = {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "id": "1", "name": "f", "input": {"x": 1}}], "usage": {"input_tokens": 3}}
    two = {"choices": [{"message": {"content": "a", "tool_calls": [{"id": "1", "function": {"name": "f", "arguments": '{"x":1}'}}]}}]}
    for body in (one, two):
        got = extensions.ADAPTERS["openai"].response(json.dumps(body))
        assert (got["text"], got["calls"], got["structured"]) == ("a", [{"id": "1", "name": "f", "args": '{"x":1}'}], None)
    assert M.response_of('{"content":[{"type":"text","text":" {\\"a\\":1}"}]}')["structured"] == ' {"a":1}'


# Logs.


def test_many_files_keep_their_order(spark, tmp_path):
    """Spark deals files by size; the place of a line doesn't depend on that."""
    for name, n in (("a", 1), ("b", 60), ("c", 3)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"tenant_id": name, "route_id": str(i)}) + "\n" for i in range(n)))
    rows = S.read_tolerant(spark, str(tmp_path), S.TRANSITION).orderBy("ordinal").collect()
    assert [(r.tenant_id, int(r.route_id)) for r in rows] == [(n, i) for n, k in (("a", 1), ("b", 60), ("c", 3)) for i in range(k)]


def test_lines_are_numbered_within_their_file(spark, tmp_path):
    for name in "xy":
        (tmp_path / f"{name}.txt").write_bytes(f"{name}0\r\n{name}1\n\n{name}3".encode())
    got = {(r.path[-5:-4], r.pos): r.line for r in S.read_lines(spark, str(tmp_path)).collect()}
    assert got == {(n, k): x for n in "xy" for k, x in enumerate((f"{n}0", f"{n}1", "", f"{n}3"))}


def test_stores_and_sinks(spark, tmp_path):
    store = S.TableStore(str(tmp_path / "s"), "id string, model string")
    rows = spark.createDataFrame([("1", "m"), ("2", None)], "id string, model string")
    assert store.read(spark).collect() == []
    store.add(rows)
    store.add(rows)
    assert sorted((r.id, r.model) for r in store.read(spark).collect()) == [("1", "m"), ("1", "m"), ("2", None), ("2", None)]
    put = S.log_sink(str(tmp_path / "l"))
    for number in (0, 1, 1):
        put(rows, number)
    assert spark.read.json(str(tmp_path / "l")).count() == 4


def test_reports(spark):
    rows = spark.createDataFrame([("m", 0.25)], "model string, change double")
    sections = {"calls_table": rows, "verify_report": rows}
    assert json.loads(S.report_json(sections)) == {"calls_table": [{"model": "m", "change": 0.25}], "verify_report": [{"model": "m", "change": 0.25}]}
    table = "| model | change |\n| --- | --- |\n| m | 0.250 |"
    assert S.report_text("verify", sections) == f"### Accuracy and tokens\n\n{table}\n\n### Calls\n\n{table}\n"
    assert len(S.REPORTS) == 8


# Questions.


@pytest.fixture
def released(tmp_path):
    (tmp_path / "tagged/data").mkdir(parents=True)
    (tmp_path / "csv/1-csv").mkdir(parents=True)
    head = "id\tutterance\tcontext\ttokens\ttargetValue\ttargetCanon"
    asked = [f"nt-{k}\twho is {k}?\tcsv/1-csv/{k % 2}.csv\t-\tAnn|B\\pC\tAnn|B\\pC" for k in (3, 1, 2, 4)]
    (tmp_path / "tagged/data/unseen.tagged").write_text("\n".join([head, *asked, "short\tline"]) + "\n")
    (tmp_path / "csv/1-csv/0.tsv").write_text("Name\tRank\tName\nAnn\t1\tx\\ny\nBo\t2\n")
    (tmp_path / "csv/1-csv/1.tsv").write_text("Only\nrow\n")
    return str(tmp_path)


def test_questions_meet_their_tables(spark, released):
    rows = S.load_questions(spark, released, "unseen").collect()
    assert [r.id for r in rows] == ["nt-1", "nt-2", "nt-3", "nt-4"] and rows[0].answers == ["Ann", "B|C"]
    assert rows[0].json == '[{"Only":"row"}]' and rows[1].json == '[{"Name":"Ann","Rank":"1","Name_2":"x\\ny"},{"Name":"Bo","Rank":"2","Name_2":""}]'
    assert [r.id for r in S.load_questions(spark, released, "unseen", min_rows=2).collect()] == ["nt-2", "nt-4"]
    drawn = [[r.id for r in S.load_questions(spark, released, "unseen", 2, seed=s).collect()] for s in (1, 1, 2, 3, 4)]
    assert drawn[0] == drawn[1] == sorted(drawn[0]) and all(len(d) == 2 for d in drawn) and len({tuple(d) for d in drawn}) > 1
    sets = S.question_sets(S.load_questions(spark, released, "unseen")).orderBy("dataset_id").collect()
    assert (sets[1].dataset_id, sets[1].rows, sets[1].answer, sets[1].kind) == ("wtq-nt-2", 2, "Ann | B|C", "wtq")
    (__import__("pathlib").Path(released) / "tagged/data/bad.tagged").write_text("id\tutterance\n")
    with pytest.raises(ValueError, match="no column"):
        S.load_questions(spark, released, "bad")


def test_payload_sets(spark):
    body = J.write([{"id": J.Num(i), "name": f"vessel {i}", "crew": J.Num(i % 3), "port": "Aberdeen"} for i in range(30)])
    rows = spark.createDataFrame([("tuning", "fleet", "list", "u", body), ("tuning", "fleet", "tiny", "u", "[1]")], "set string, api string, name string, url string, body string")
    asked = S.payload_sets(rows).collect()
    assert {r.dataset_id for r in asked} == {"payload-fleet-list"} and [r.question_id for r in asked] == [f"payload-fleet-list-q{k + 1}" for k in range(len(asked))] and asked
    from pyspark.sql import functions as F

    manifest = rows.select("set", "api", "name", F.sha2("body", 256).alias("sha256"))
    assert {r.name for r in S.payload_sets(rows, manifest.where("name = 'list'")).collect()} == {"list"}
    with pytest.raises(Exception, match="checksum"):
        S.payload_sets(rows, manifest.withColumn("sha256", F.lit("0"))).collect()


# Rules on rows.


def test_large_factorials(spark):
    import math

    from pyspark.sql import functions as F

    n = [0, 1, 2, 20, 255, 256, 257, 5000, 10**7, 10**12]
    got = {r.n: r.f for r in spark.createDataFrame([(x,) for x in n], "n long").select("n", E.log_factorial(F.col("n")).alias("f")).collect()}
    assert all(math.isclose(got[x], math.lgamma(x + 1), rel_tol=1e-13, abs_tol=1e-12) for x in n)


def test_payloads_have_a_bound(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 100).select((F.col("id") % 2).alias("k"), "id")
    made = P.grouped_payloads(rows, "k", "id", {"id": F.col("id").cast("string")})
    assert {r.n_rows for r in made.collect()} == {50}
    with pytest.raises(Exception, match="more than 300 bytes"):
        P.grouped_payloads(rows, "k", "id", {"id": F.col("id").cast("string")}, most_bytes=300).collect()


def test_largest_blocks_leave_out_what_is_too_long(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 11), (1, 2, "x" * 10), (1, 3, "y" * 10), (2, 4, "x" * 12)], "r long, o long, b string")
    assert [tuple(x) for x in P.largest_blocks(rows, "r", "b", "o", 10).collect()] == [(1, 2, "x" * 10)]


def test_calibration_is_taken_once_an_interval(spark):
    times = {"a": [0, 10, 899, 900, 901, 1800, 5000, 5001], "b": [7]}
    rows = spark.createDataFrame([(m, i, t) for m, ts in times.items() for i, t in enumerate(ts)], "model string, id long, t long").selectExpr("model", "id", "timestamp_seconds(t) AS ts")
    got = joins.due(rows.repartition(3), 900).collect()
    assert sorted((r.model, r.id) for r in got) == [("a", 0), ("a", 3), ("a", 5), ("a", 6), ("b", 0)]


def test_resumed_routes_start_where_they_were(spark):
    from ledgerloom.streaming import promoter

    t = "tenant_id long, route_id string"
    policies = spark.createDataFrame([(1, "a", "v1", "SHADOW"), (1, "b", "v2", "SHADOW"), (1, "c", "v1", "OFF"), (2, "a", "v1", "ENABLED")], f"{t}, version string, state string")
    made = spark.createDataFrame([(i, 1, r, "v1", s, i) for i, r, s in ((1, "a", 2), (2, "a", 0), (3, "b", 2), (4, "c", 2))], f"id long, {t}, policy_version string, to_state long, s long").selectExpr("*", "timestamp_seconds(s) AS ts")
    got = promoter.starts(E.resumed(policies, made, ["tenant_id", "route_id"]))
    assert got == {(1, "a"): ("OFF", 2_000_000), (1, "b"): ("SHADOW", None), (1, "c"): ("OFF", None), (2, "a"): ("ENABLED", None)}


def test_codecs_named_by_rows(spark):
    text = '[{"k":1,"l":"x"},{"k":2,"l":"y"}]'
    rows = spark.createDataFrame([(text, n) for n in ("tabular", "toonx", "toon", "none", None)], "t string, c string")
    got = {r.c: r.e for r in rows.select("c", W.encoded_by("t", "c").alias("e")).collect()}
    assert got["tabular"].startswith('["k","l"]') and got["toonx"] == got["toon"] and got["none"] is None and got[None] is None


def test_draws_have_mean_one(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 300).crossJoin(spark.range(0, 300).withColumnRenamed("id", "r"))
    m = rows.select(R.draw(F.col("id"), F.col("r")).alias("w")).agg(F.avg("w").alias("a"), F.var_pop("w").alias("v"), F.max("w").alias("m")).first()
    assert abs(m.a - 1) < 0.02 and abs(m.v - 1) < 0.05 and m.m <= 7


# Scoring.


@pytest.mark.parametrize(
    ("reply", "answers", "canon", "want"),
    [
        ("Answer: Hull", ["Hull"], None, True),
        ("<think>Cork?</think>The answer follows.\nAnswer: *Hull*.", ["Hull"], None, True),
        ("It was in Hull, surely", ["Hull"], None, True),
        ("It was in Hullavia", ["Hull"], None, False),
        ("x" * 40 + " Hull", ["Hull"], None, False),
        ("Cork, Hull", ["Hull", "Cork"], None, True),
        ("Cork|Hull|Oban", ["Hull", "Cork"], None, False),
        ("Hull", ["Hull", "Cork"], None, False),
        ("Hull\nCork", ["Hull", "Cork", "hull"], None, True),
        ("about 1,204.0 ships", ["1204"], None, True),
        ("1204 of 1300", ["1204"], None, False),
        ("3", ["three"], ["3"], True),
        ("1876-01-05", ["January 5, 1876"], ["1876-01-05"], True),
        ('5h 29\' 10"', ['5h 29\' 10"'], None, True),
        ('"Hull"', ["Hull"], None, True),
        ("", ["Hull"], None, False),
    ],
)
def test_answers(reply, answers, canon, want):
    from ledgerloom.functions.scoring import answers_met

    assert answers_met(reply, answers, canon) is want


def test_free_form_sets(spark):
    body = J.write([{"id": J.Num(i), "crew": J.Num(i % 3)} for i in range(6)])
    rows = spark.createDataFrame([("s", "fleet", f"p{i}", body if i else "[[1]]") for i in range(9)], "set string, api string, name string, body string")
    got = S.free_form_sets(rows).collect()
    assert {r.name for r in got} == {f"p{i}" for i in range(1, 9)} and all(r.question_id == f"freeform-fleet-{r.name}-{r.kind.removeprefix('freeform-')}" for r in got)
    kinds = [r.kind for r in got]
    assert max(map(kinds.count, set(kinds))) <= 3 and len(set(kinds)) == 4
    assert got == S.free_form_sets(rows).collect()


# Streams and SQL text.


def test_streams_start_where_routes_were(spark, tmp_path):
    """Given the states after a restart, samples up to a route's last transition are no evidence, and routes go on in
    their state; one that is OFF stays so."""
    from ledgerloom.streaming import promoter

    rows = []
    for k in range(700):
        agree = k % 10 > 0
        for route in ("fresh", "off", "on"):
            rows.append((k, k, 1, route, "PAIRED", agree, agree, agree, 400, 280, 400, 60, 60, 60, 5, 5, 5, True, True, None, None, None))
    names = "id long, s long, tenant_id long, route_id string, kind string, ab boolean, cb boolean, ac boolean, in_a long, in_b long, in_c long, out_a long, out_b long, out_c long, lat_a long, lat_b long, lat_c long, ok_a boolean, ok_b boolean, err_a string, err_b string, err_c string"
    samples = spark.createDataFrame(rows, names).selectExpr("*", "timestamp_seconds(s) AS ts").drop("s")
    samples.repartition(3).write.parquet(f"{tmp_path}/samples")
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 16).parquet(f"{tmp_path}/samples")
    start = {(1, "off"): ("OFF", 0), (1, "on"): ("SHADOW", 99_000_000)}
    out = promoter.promotions(stream, start=start).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    got = {(r.route_id, r.id, r.n, r.from_state, r.to_state) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {("fresh", 199, 200, "SHADOW", "ENABLED"), ("on", 299, 200, "SHADOW", "ENABLED")}


def test_functions_in_sql_text(spark):
    P.register_sql(spark)
    leaves = spark.sql("""SELECT path, value FROM VALUES ('{"a":[1,{"b":"x"}]}'), ('[') AS t(j), LATERAL json_leaf_rows(j)""").collect()
    assert sorted(map(tuple, leaves)) == [("out/a/0", "1"), ("out/a/1/b", '"x"')]
    body = J.write([{"id": J.Num(i), "port": "Hull" if i % 2 else "Cork"} for i in range(6)])
    asked = spark.sql("SELECT q.kind FROM VALUES (:body) AS t(j), LATERAL payload_questions(j, 's') q", {"body": body}).collect()
    assert {r.kind for r in asked} >= {"count-where", "lookup"}
    assert spark.sql("SELECT render_payload_json_pretty('[1]').text AS t").first().t == "[\n  1\n]"
    assert spark.sql("SELECT decode_toonx(encode_toonx('{\"a\":[1,2]}').encoded) AS t").first().t == '{"a":[1,2]}'


def test_running_sums_across_pieces(spark):
    """Sums up to each sample and over the last ones, for samples without a time, on one day and over several."""
    import random

    draw = random.Random(3)
    rows = [(i, draw.choice([None, 10, 86_400 * 2 + 5, 86_400 * 2 + 5, 86_400 * 9]), i % 2, *(draw.random() < 0.5 for _ in range(3)), *(draw.randrange(50) for _ in range(6)), None, True) for i in range(120)]
    names = "id long, s long, k long, ab boolean, cb boolean, ac boolean, in_a long, in_b long, in_c long, out_a long, out_b long, out_c long, ok_a boolean, ok_b boolean"
    df = spark.createDataFrame(rows, names).selectExpr("*", "timestamp_seconds(s) AS ts")
    ordered = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    for last in (None, 7):
        want = {}
        for k in (0, 1):
            own = [r for r in ordered if r[2] == k]
            for i, r in enumerate(own):
                part = own[: i + 1] if last is None else own[max(0, i + 1 - last) : i + 1]
                want[r[0]] = (len(part), sum(int(p[3]) + int(p[4]) - 2 * int(p[5]) for p in part), sum(p[7] for p in part))
        got = {r.id: (r.n, r.d2, r.in_enc) for r in E.running(df, ["k"], ["ts", "id"], last).collect()}
        assert got == want


def test_ewma_of_many(spark):
    values = [(i * 37 % 101 + 50) / 100 for i in range(3000)]
    want = values[0]
    for v in values[1:]:
        want = 0.9 * want + 0.1 * v
    rows = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)] + [("m", 9999, 0.0), ("one", 1, 2.5)], "model string, id long, ratio double")
    got = {r.model: (r.factor, r.n) for r in joins.ewma(rows, ["model"], ["id"]).collect()}
    assert abs(got["m"][0] - want) < 1e-12 and got["m"][1] == 3000 and got["one"] == (2.5, 1)
