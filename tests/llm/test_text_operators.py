import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import decontamination, near_duplicates, pii, quality, queries, secrets

from .oracle import assert_same

HEXES = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
ODD = [
    (1, None, 1),
    (2, "", 2),
    (3, f'token = "{HEXES}" and Api_Key:\'{HEXES}\' password=short PASSWD : "abcdefghijkl"', 3),
    (4, f"token: secret: abcdefghijkl123 AKIA{'Q' * 14} AKIA{'Q' * 13} AKIAAKIA{'9' * 12}", 4),
    (5, f"é😀 x {HEXES} {HEXES[:15]} {HEXES[:16]}\n{HEXES}{HEXES}", 5),
    (5, f"é😀 x {HEXES} {HEXES[:15]} {HEXES[:16]}\n{HEXES}{HEXES}", 5),
    (None, "mail a.b+c@x-y.example.com, @ @a.b x@@b.c a@b.c@d.e 1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", 6),
    (7, "4111 1111 1111 1111 4111-1111-1111-1111. 4111111111111111 4111111111111112 +1 (487) 555-7209 x", 7),
    (8, "+1 (487) 555-7209 4736962573099581 and +12 345 +123456789 +1234567890123456", 8),
    (9, "Zq9xT7bLw2Rk8YpVn4Jd6Hs3 getUserAccountListenerFactory account_transaction_manager_default", 9),
    (10, "wort " * 30000 + "a b c d e f g h " * 3, 10),
    (11, "\n".join(["same line here"] * 30), 11),
    (12, " \t\n\x0b\x0c\r ", 12),
    (13, " \n".join(f"w{i} ### $$$" for i in range(40)), 13),
    (14, "one two three four five six seven " * 2 + "x" * 5000, 14),
    (15, "9" * 5000 + " " + "1.2" * 500 + " " + "a" * 5000, 15),
]
SCHEMA = "doc_id long, text string, base int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).repartition(3)


# Personal data.

PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def brute_pii(text):
    return sorted(
        [(m.start(), k, m.end()) for k, (p, ok) in PII.items() for m in re.finditer(p, text) if ok(m[0])],
        key=lambda s: (s[0], list(PII).index(s[1])),
    )


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab@..  +-()0123456789\né%")), max_size=50))
def test_pii_patterns_on_random_texts(text):
    assert pii.base_spans(text) == brute_pii(text)


def check_pii(rows, got):
    want = Counter()
    for doc_id, text in rows:
        base = brute_pii(text or "")
        n = Counter(s[1] for s in base)
        want[(doc_id, *(n[k] for k in PII), hashlib.sha256(pii.joined(base).encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)


def test_pii_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_pii([(r.doc_id, r.text) for r in docs.collect()], queries.op4_pii(spark, sf_dir).collect())


def test_pii_odd_rows(odd):
    got = pii.personal_data(odd).collect()
    check_pii([r[:2] for r in ODD], got)
    for r in got:
        text = next(t or "" for d, t, _ in ODD if d == r.doc_id)
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert {f"{k}:{a}:{b}" for a, k, b in brute_pii(text)} <= {":".join(s) for s in spans}
        assert all(0 <= int(a) < int(b) <= len(text) for _, a, b in spans)
    assert pii.personal_data(odd.limit(0)).collect() == []


def test_field_adds_what_patterns_drop():
    ((base, every),) = pii.all_spans(["please call +1 (269) 555-3296 4524132264652876 before noon"], pii.trained())
    assert base == []
    assert [(k, b - a) for a, k, b in every] == [("phone", 17), ("card", 16)]


def test_field_reads_whole_words():
    assert pii.shape("x" * 100 + "7" * 13 + "--" + "é" * 200) == "a9*-a"
    assert pii.shape("+" + "1" * 70) == "+" + "9" * 9 and pii.shape("word" * 30 + "@" + "host" * 30 + ".org") == "a@a.a"


def test_many_spans_take_linear_time():
    import time

    text = " ".join(f"a{i}@b.org +1 (269) 555-3296 4524132264652876" for i in range(6000))
    began = time.perf_counter()
    ((base, every),) = pii.all_spans([text], pii.trained())
    assert time.perf_counter() - began < 20 and len(base) == 6000 and len(every) > len(base)
    brute = [s for s in every if s not in base]
    assert all(not (s[0] < b and a < s[2]) for s in brute[:200] for a, _, b in base)


def test_words_far_from_marks_change_nothing(spark, sf_dir):
    """The field over whole texts gives the spans that it gives around digits and at signs."""
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(400).collect()]
    near = [pii.field_spans([t], pii.trained())[0] for t in texts]
    real = pii.windows
    try:
        pii.windows = lambda text: [w] if (w := [m.span() for m in pii.WORD.finditer(text)]) and pii.MARK.search(text) else []
        whole = [pii.field_spans([t], pii.trained())[0] for t in texts]
    finally:
        pii.windows = real
    both = sum(len(set(a) & set(b)) for a, b in zip(near, whole))
    assert both >= 0.99 * sum(len(set(a) | set(b)) for a, b in zip(near, whole)) and both


def test_field_of_the_callers_table(spark):
    plain = "the boat lay at anchor off the quay until noon".split()
    rows = [([*plain[: k % 6], f"berth{k % 10}-{k % 7}", *plain[k % 5 :]], ["O"] * (k % 6) + ["B-card"] + ["O"] * (len(plain) - k % 5)) for k in range(60)]
    labelled = spark.createDataFrame([*rows, ([], [])], "words array<string>, labels array<string>")
    docs = spark.createDataFrame([(1, "we saw berth4-3 there, and 17 gulls")], "doc_id long, text string")
    assert pii.personal_data(docs, labelled).first().spans == "card:7:15" and pii.personal_data(docs).first().spans == ""
    for bad in ([(["a"], ["O", "O"])], [(["a"], ["B-name"])]):
        with pytest.raises(ValueError):
            pii.personal_data(docs, spark.createDataFrame(bad, "words array<string>, labels array<string>"))


def test_field_on_held_out_rows():
    rows = pii.labelled_rows(400)[240:]
    model = pii.trained()
    right = total = 0
    for (_, want), got in zip(rows, model.decode([model.scores(w) for w, _ in rows])):
        right += sum(model.labels[g] == w for g, w in zip(got, want))
        total += len(want)
    assert right / total > 0.97


def test_masking(spark):
    rows = [(1, "write to a@b.org now", "x", 20), (2, None, "y", None), (3, "clean", None, 5)]
    got = pii.without_personal_data(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")).collect()
    assert sorted(map(tuple, got)) == [(1, "write to <email> now", "x", 20), (2, None, "y", None), (3, "clean", None, 5)]


# Secrets.

SECRETS = {
    "assign": (r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 16),
}


def brute_secrets(text):
    return sorted(
        [(m.start(), k, m.end()) for k, (p, ok) in SECRETS.items() for m in re.finditer(p, text) if ok(m)],
        key=lambda s: (s[0], list(SECRETS).index(s[1])),
    )


def check_secrets(rows, got):
    want = Counter()
    for doc_id, text in rows:
        base = brute_secrets(text or "")
        n = Counter(s[1] for s in base)
        want[(doc_id, *(n[k] for k in SECRETS), hashlib.sha256(pii.joined(base).encode()).hexdigest())] += 1
    assert want == Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got)


def test_secrets_match_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    check_secrets([(r.doc_id, r.text) for r in docs.collect()], queries.op1_secret_scans(spark, sf_dir).collect())


def test_secrets_odd_rows(odd):
    got = secrets.secrets(odd).collect()
    check_secrets([r[:2] for r in ODD], got)
    (r,) = [r for r in got if r.doc_id == 9]
    assert r.spans == "random:0:24"
    assert secrets.secrets(odd.limit(0)).collect() == []


def test_texts_of_many_hits(spark):
    import time

    digests = [hashlib.sha256(str(i).encode()).hexdigest()[: 16 + i % 20] for i in range(16000)]
    texts = [" ".join(digests[:n]) + " " + " ".join(f"Zq9xT7bLw2Rk8YpVn4Jd{i:06d}" for i in range(n // 4)) for n in (1, 2, 3, 5, 100, 16000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r for r in secrets.secrets(docs).collect()}
    assert time.perf_counter() - began < 30
    check_secrets(list(enumerate(texts)), got.values())
    for k, n in enumerate((1, 2, 3, 5, 100, 16000)):
        spans = [x.split(":") for x in got[k].spans.split(",")]
        assert sum(x[0] == "random" for x in spans) == n // 4 and [int(x[1]) for x in spans] == sorted(int(x[1]) for x in spans)


def test_samples_of_the_caller(spark):
    samples = spark.createDataFrame([(1, "zzzzzzzzzzzzzzzzzzzzzzz"), (0, "xyxyxyxyxyxyxyxyxyxy"), (None, "x"), (1, None), (0, "é")], "secret int, s string")
    docs = spark.createDataFrame([(1, "zzzzzzzzzzzzzzzzzzzzzzzz xyxyxyxyxyxyxyxyxyxyxyxyxy")], "doc_id long, text string")
    assert secrets.secrets(docs, samples).first().spans == "random:0:24"


def test_markov_models_tell_random_from_names(spark):
    ratios = secrets.train(spark)
    names = ["getUserProfileRequest", "max_connection_pool_size", "DEFAULT_BUFFER_LENGTH", "session-token-lifetime", "unglichheitkeitberechnung"]
    randoms = ["Zq9xT7bLw2Rk8YpVn4Jd6Hs3", "f3ef4d6b2755a36d7d9c25bd", "q0sk-Qd93-x7Gw_11bZr0tYk"]
    df = spark.createDataFrame([(n, 0) for n in names] + [(n, 1) for n in randoms], "s string, y int")
    from pyspark.sql import functions as F

    got = df.select("y", (secrets.scored(F.col("s"), ratios) / (F.length("s") - 1)).alias("v")).collect()
    assert min(r.v for r in got if r.y) > secrets.THRESHOLD > max(r.v for r in got if not r.y)


# Quality.


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    seen = defaultdict(list)
    for i in range(n - 7):
        seen[tuple(w[i : i + 8])].append(i)
    places = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols, chars, dup = sum(text.count(c) for c in "#*$%&|<>"), sum(map(len, w)), len(lines) - len(set(lines))
    failed = n < 20 or 100 * len(places) > 30 * n
    rejected = (
        100 * symbols > 5 * chars
        or 100 * dup > 50 * len(lines)
        or chars > 12 * n
        or chars < 2 * n
        or 100 * sum("A" <= c <= "Z" for c in text) > 50 * chars
        or 100 * sum(any(c.isalpha() for c in x) for x in w) < 30 * n
    )
    return n, chars, symbols, dup, len(places), failed, not failed and not rejected


def test_quality_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = queries.op7_quality_rules(spark, sf_dir).collect()
    assert Counter(map(tuple, got)) == Counter((r.doc_id, *brute_quality(r.text)) for r in docs)


@pytest.mark.parametrize("name", ["op1_secret_scans", "op7_quality_rules", "op9_minhash_near_dedup"])
def test_queries_match_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), queries.SQL[name], sf_dir)


def test_quality_odd_rows(odd):
    got = quality.quality(odd).drop("failed_rule").collect()
    assert Counter(map(tuple, got)) == Counter((d, *brute_quality(t)) for d, t, _ in ODD)
    assert quality.quality(odd.limit(0)).collect() == []


def test_rule_order_never_changes_the_verdict(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = {r.doc_id: r.kept for r in quality.quality(docs, quality.RULES).collect()}
    b = {r.doc_id: r.kept for r in quality.quality(docs, quality.RULES[::-1]).collect()}
    assert a == b
    order = quality.estimate(docs)
    assert {e.rule for e in order} == set(quality.RULES)
    assert [e.gain for e in order] == sorted((e.gain for e in order), reverse=True)


def test_cost_decides_among_rules_that_reject_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    dear = quality.Rule("a_dear", r"length(regexp_replace(lower(_text), '([a-z]+)([0-9]*)([a-z]*)', '$3$2$1')) < 0")
    cheap = quality.Rule("z_cheap", "word_chars < 0")
    some = quality.Rule("b_rejects", "n_words < 100")
    found = {e.rule.name: e for e in quality.estimate(docs, [dear, cheap, some])}
    assert list(found)[-1] == "a_dear" and found["a_dear"].seconds > 20 * found["z_cheap"].seconds
    assert found["a_dear"].rejected == found["z_cheap"].rejected == 0 < found["b_rejects"].rejected


# Decontamination.


def test_decontamination_matches_sql(spark, sf_dir):
    df = queries.op5_benchmark_decontamination(spark, sf_dir)
    assert df.count() > 0
    assert_same(df, decontamination.SQL, sf_dir)


def test_decontamination_by_join(spark, sf_dir):
    """A benchmark too large to broadcast gives the same."""
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = decontamination.contained_items(docs, bench).collect()
    assert sorted(whole) == sorted(decontamination.contained_items(docs, bench, index_bytes=0).collect())
    kept = {r.doc_id for r in docs.collect()} - {r.doc_id for r in whole}
    for size in (0, decontamination.INDEX_BYTES):
        left = decontamination.without_contaminated(docs, bench, index_bytes=size)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == kept


def test_decontamination_odd_rows(odd, spark):
    items = [(1, None), (2, ""), (3, "wort wort wort wort wort wort"), (4, "c d"), (4, "c d"), (5, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got, joined = (Counter(map(tuple, decontamination.contained_items(odd, bench, index_bytes=n).select("doc_id", "item_id", "n_shingles", "n_found").collect())) for n in (1 << 20, 0))
    assert got == joined
    want = Counter()
    for doc_id, text, _ in ODD:
        w = [x for x in re.findall(r"[^\W_]+", (text or "").lower())]
        want[(doc_id, 3, 1, 1)] += any(w[i : i + 6] == ["wort"] * 6 for i in range(len(w)))
        want[(doc_id, 4, 1, 1)] += 2 * any(w[i : i + 2] == ["c", "d"] for i in range(len(w)))
    assert got == +want
    assert decontamination.contained_items(odd, bench.limit(0)).collect() == []
    assert decontamination.contained_items(odd.limit(0), bench).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e f g".split()), max_size=40), min_size=1, max_size=6), st.lists(st.sampled_from("a b c d e f g".split()), max_size=80))
def test_search_finds_all_contained(items, doc):
    got = decontamination.ItemIndex([(i, " ".join(x)) for i, x in enumerate(items)]).search(" ".join(doc))
    want = []
    for i, x in enumerate(items):
        if x:
            w = min(5, len(x))
            a, b = decontamination.shingles_of(x, w), decontamination.shingles_of(doc, w)
            if 100 * len(a & b) >= 80 * len(a):
                want.append((i, len(a), len(a & b)))
    assert got == want


# Near-duplicates.


def brute_near(rows, width):
    sets = []
    for d, t in rows:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    home = {d: d for d, _ in rows if d is not None}

    def root(x):
        while home[x] != x:
            x = home[x]
        return x

    by = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    pairs = Counter((i, j) for v in by.values() if len(v) < 400 for k, i in enumerate(v) for j in v[k + 1 :])
    for (i, j), both in pairs.items():
        a, b = rows[i][0], rows[j][0]
        if a is not None and b is not None and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            x, y = sorted((root(a), root(b)))
            home[y] = x
    return {(d, len(s), root(d), root(d) == d) for (d, _), s in zip(rows, sets) if d is not None}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_match_brute_force(spark, sf_dir, width):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = near_duplicates.near_duplicates(docs, width=width).drop("row_no").collect()
    assert {tuple(r) for r in got} == brute_near([(r.doc_id, r.text) for r in docs.collect()], width)


def test_near_duplicates_in_hot_groups(spark):
    import random

    draw = random.Random(5)
    words = [f"w{i}" for i in range(5000)]
    rows = []
    for g in range(4):
        base = [draw.choice(words) for _ in range(60)]
        for k in range(80):
            copy = list(base)
            for _ in range(draw.randrange(0, 9)):
                copy[draw.randrange(60)] = draw.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, rows[0][1]) for i in range(100)]
    draw.shuffle(rows)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).drop("row_no").collect()
    assert {tuple(r) for r in got} == brute_near(rows, 2)


def test_near_duplicates_odd_rows(odd, spark):
    rows = [(d, t) for d, t, _ in ODD]
    got = near_duplicates.near_duplicates(odd, width=2).drop("row_no").collect()
    assert {tuple(r) for r in got if r.doc_id is not None} == brute_near(rows, 2)
    assert len(got) == len(rows)
    assert near_duplicates.near_duplicates(odd.limit(0)).collect() == []


def test_texts_that_share_an_id(spark):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:58], "x"])), (3, " ".join([*b[:58], "y"])), (4, " ".join(c)), (None, " ".join(a)), (None, " ".join([*c[:58], "z"]))]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_no_key_goes_to_one_task(spark):
    """A third of the rows in one group of copies, a third without words: answered where they are."""
    from pyspark.sql import functions as F

    from ledgerloom.llm.common import hot_keys, spread_join

    rows = spark.range(0, 9000).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.col("id")).alias("k"), "id")
    right = spark.range(0, 20000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = hot_keys(rows, "k")
    assert [r.k for r in hot.collect()] == [1] and hot_keys(right, "k") is None
    got = spread_join(rows, right, "k", hot, "left")
    assert got.count() == 9000 and got.where("k = 1 and v = 2").count() == 3000 and got.where("k is null and v is null").count() == 3000
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_signature_pairs_meet():
    import numpy as np

    signer = near_duplicates.SIGNER
    draw = np.random.default_rng(3)
    for _ in range(200):
        a = draw.integers(0, 1 << 16, 78).astype(np.uint16)
        b = a.copy()
        far = draw.choice(78, near_duplicates.CHUNKS * (near_duplicates.ERRORS + 1) - 1, replace=False)
        b[far] ^= 1
        ka, kb = signer.keys(np.stack([a, b]))
        assert set(ka) & set(kb)


@pytest.mark.parametrize("blocks", [1, 3])
def test_links_in_blocks_join_all(blocks):
    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(2)
    base = draw.integers(0, 1 << 64, 60, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        s[draw.choice(60, draw.integers(0, 12), replace=False)] = draw.integers(0, 1 << 64, 1, dtype=np.uint64)
        sets.append(np.unique(s))
    sim = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    names = np.arange(60) // 2 * 2
    part = {"node": np.arange(60), "component": names, "apart": [1 - sim(base, s) for s in sets], "block": np.arange(60) % blocks, "shingles": [s.view(np.int64) for s in sets]}
    found = []
    for lo in range(blocks):
        for hi in range(lo, blocks):
            keep = [i for i in range(60) if i % blocks in (lo, hi)]
            found += near_duplicates.joining_links(pa.table({k: pa.array([v[i] for i in keep]) for k, v in part.items()}), lo, hi, 80)

    def groups(links):
        home = list(names)
        for a, b in links:
            x, y = home[a], home[b]
            home = [y if h == x else h for h in home]
        return {frozenset(i for i in range(60) if home[i] == h) for h in home}

    every = [(a, b) for a in range(60) for b in range(a) if sim(sets[a], sets[b]) >= 0.8]
    assert groups(found) == groups(every) and all(sim(sets[a], sets[b]) >= 0.8 for a, b in found)
