import zlib

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from ledgerloom.llm import decontamination, pii, queries, toxicity
from ledgerloom.llm.common import table

from .test_text_operators import brute_near
from .test_tokens_and_bins import check_packing


def test_nearest_is_exact():
    draw = np.random.default_rng(4)
    vectors = []
    for _ in range(500):
        terms = draw.choice(40, draw.integers(1, 6), replace=False)
        w = draw.random(len(terms)) + 0.1
        w /= np.sqrt((w**2).sum())
        vectors.append(dict(zip(map(int, terms), map(float, w))))
    index = toxicity.Index(vectors, 40)
    dense = np.zeros((500, 40))
    for i, v in enumerate(vectors):
        dense[i, list(v)] = list(v.values())
    for i in range(0, 500, 7):
        sims = dense @ dense[i]
        sims[i] = 0
        want = sorted((j for j in range(500) if sims[j] > 0), key=lambda j: (-round(sims[j], 12), j))[:15]
        near, similar = index.nearest(vectors[i], 15, but=i)
        assert near.tolist() == want
        assert np.allclose(similar, sims[want])


def test_monotone_map():
    ends, values = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.9]), np.array([0, 1, 0, 1.0]), np.ones(4))
    assert list(values) == sorted(values) and len(ends) == 3


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf_dir).toPandas()
    labels = pd.read_parquet(f"{sf_dir}/labels.parquet")
    assert len(got) == 10000 and got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    both = got.merge(labels, on="doc_id")
    both = both[both["held_out"]]
    wrong = both[both["predicted"] != both["toxic"]]
    assert len(wrong) / len(both) < 0.04
    assert abs(both["score"].mean() - both["toxic"].mean()) < 0.03


def test_labels_of_held_out_rows_are_never_read(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").toPandas()
    other = labels.copy()
    away = np.array([zlib.crc32(str(d).encode()) % 5 == 0 for d in other["doc_id"]])
    other.loc[away, "toxic"] = 1 - other.loc[away, "toxic"]
    a, b = (toxicity.toxicity(docs, spark.createDataFrame(x)).select("doc_id", "score").orderBy("doc_id").collect() for x in (labels, other))
    assert a == b


def test_blocks_that_are_passed_over_hold_no_neighbour():
    draw = np.random.default_rng(6)
    vectors = []
    for i in range(1500):
        terms = np.unique(np.concatenate([draw.choice(60, 6), 60 + 30 * (i % 20) + draw.choice(30, 5)]))
        w = (draw.random(len(terms)) + 0.1) * np.where(terms < 60, 1, 6)
        vectors.append((terms, w / np.sqrt((w**2).sum())))
    vectors = [vectors[i] for i in toxicity.in_blocks(vectors, 660)]
    index = toxicity.Index(vectors, 660)
    dense = np.zeros((1500, 660))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    asked = list(range(0, 1500, 11))
    rough = index._rough([vectors[i] for i in asked], 15, asked)
    assert np.isinf(rough.reshape(len(asked), -1, toxicity.BLOCK)).all(axis=2).mean() > 0.2
    for i, (near, similar) in zip(asked, index.nearest_of([vectors[i] for i in asked], 15, asked)):
        sims = dense @ dense[i]
        sims[i] = 0
        want = sorted((j for j in range(1500) if sims[j] > 0), key=lambda j: (-round(sims[j], 12), j))[:15]
        assert near.tolist() == want and np.allclose(similar, sims[want])


def test_copies_count_as_one_example(spark):
    rows = [(i, "copied words of one text" if i < 30 else f"{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]} " + ("you awful vermin" if i % 2 else "nice day")) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scorer = toxicity.train(docs, spark.createDataFrame([(i, int(i < 30 or i % 2)) for i in range(100)], "doc_id long, toxic int"))
    copied, awful = (scorer.idf[scorer.terms[w]] for w in ("copied", "awful"))
    assert copied < np.log(101 / 30) * np.log2(3) ** 2 + 1e-9 < awful
    assert sum(len(t) and (t == scorer.terms["copied"]).any() for t in np.split(scorer.index.terms, scorer.index.ends[1:-1])) == 1


def test_every_text_with_words_has_neighbours(spark, sf_dir):
    """Words that say nothing about the label are compared too, and common ones weigh less, over all documents."""
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.train(docs, table(spark, sf_dir, "labels"), relevance=0.0)
    rows = [r.text for r in docs.select("text").collect()]
    for text, (_, near) in zip(rows, scorer.scores(rows)):
        assert bool(near) == any(w in scorer.terms for w in toxicity.counts_of(text))
    wordy = [t for t in rows if len(toxicity.counts_of(t)) >= 5]
    assert all(near for _, near in scorer.scores(wordy))
    word, place = next((w, t) for w, t in scorer.terms.items() if w == "the")
    n = sum(word in toxicity.counts_of(t) for t in rows)
    assert np.isclose(scorer.idf[place], np.log((1 + len(rows)) / n))


def test_scores_match_brute_force(spark, sf_dir):
    """The whole query against dense vectors, all pairs and a sort."""
    docs, labels = (pd.read_parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    away = {d: zlib.crc32(str(d).encode()) % 5 == 0 for d in docs["doc_id"]}
    rows = docs.merge(labels, on="doc_id").sort_values("doc_id")
    rows = rows[[not away[d] for d in rows["doc_id"]]]
    share = rows["toxic"].value_counts().to_dict()
    rows = rows.drop_duplicates(["text", "toxic"]).reset_index(drop=True)
    words = [toxicity.counts_of(t) for t in rows["text"]]
    toxic = rows["toxic"].to_numpy()
    keys = [(y, (lambda s: s[0] if len(s) else d)(toxicity.shingle_set(t.encode(), 5)) >> 1) for t, y, d in zip(rows["text"], toxic, rows["doc_id"])]
    first = [keys.index(k) == i for i, k in enumerate(keys)]
    places = {w: i for i, w in enumerate(sorted(set().union(*words)))}
    have = np.zeros((2, len(places)))
    for c, y, f in zip(words, toxic, first):
        have[y, [places[w] for w in c]] += f
    kept = [sum(f for f, y in zip(first, toxic) if y == k) for k in (0, 1)]
    every = [toxicity.counts_of(t) for t in docs["text"]]
    df = np.zeros(len(places))
    for c in every:
        df[[places[w] for w in c if w in places]] += 1
    rf = np.log2(2 + have[1] / np.maximum(1, have[0] * kept[1] / kept[0]))
    weight = np.log((1 + len(docs)) / df) * rf**2

    def dense(counts):
        out = np.zeros((len(counts), len(places)))
        for r, c in enumerate(counts):
            for w, n in c.items():
                if w in places:
                    out[r, places[w]] = (1 + np.log(n)) * weight[places[w]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)

    own = dense(words)
    usable = own.any(axis=1)
    own, toxic = own[usable], toxic[usable]

    def votes(similar):
        out = np.full(len(similar), np.nan)
        for i, s in enumerate(similar):
            near = [j for j in np.argsort(-np.round(s, 12), kind="stable")[:15] if s[j] > 1e-12]
            if near:
                w = 1 / (1.05 - np.minimum(s[near], 1))
                out[i] = (w * toxic[near]).sum() / w.sum()
        return out

    within = own @ own.T
    np.fill_diagonal(within, 0)
    seen = votes(within)
    worth = np.array([share[y] / (rows["toxic"] == y).sum() for y in toxic])
    ok = ~np.isnan(seen)
    ends, values = toxicity.monotone(seen[ok], toxic[ok].astype(float), worth[ok])
    found = votes(dense(every) @ own.T)
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, sf_dir).collect()}
    differ = 0
    for d, v in zip(docs["doc_id"], found):
        if np.isnan(v):
            assert not got[d].evidence
        else:
            assert got[d].evidence
            # The order of equal similarities is each side's own.
            differ += abs(got[d].score - values[min(np.searchsorted(ends, v - 1e-9), len(values) - 1)]) > 1e-9
    assert differ <= 0.005 * len(docs)


def test_toxicity_odd_rows(spark):
    rows = [(i, f"{'abcdefghij'[i // 6]}{'klmnop'[i % 6]} {'nice day' if i % 3 else 'you awful vermin'}", "x") for i in range(60)]
    rows += [(61, None, "x"), (62, "", None), (None, "awful vermin", "x"), (0, "you awful vermin", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (7, None), (999, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.predicted) for r in got}
    assert (None, 1) in by and (61, 0) in by and (62, 0) in by and (0, 1) in by and (1, 0) in by
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []
    left = toxicity.without_toxic(docs, labels)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in got if not r.predicted}


def test_pipeline_stages_match_brute_force(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    kept = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [{r.doc_id: r.asDict() for r in df.collect()} for df in kept[:5]]
    assert all(df.columns == list(corpus_pipeline.COLUMNS) for df in kept[:5])
    scores = {r.doc_id for r in queries.op3_toxicity(spark, sf_dir).collect() if r.predicted}
    assert set(rows[1]) == set(rows[0]) - scores and scores
    near = {d for d, _, _, k in brute_near([(d, r["text"]) for d, r in rows[1].items()], 5) if k}
    assert set(rows[2]) == near
    index = decontamination.ItemIndex([(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])
    leaks = {d for d, r in rows[2].items() for i, w, s in index.items if len(s & decontamination.shingles_of(decontamination.words_of(r["text"]), w)) >= 0.8 * len(s)}
    assert set(rows[3]) == set(rows[2]) - leaks and leaks
    assert all(rows[3][d] == rows[2][d] for d in rows[3])
    assert set(rows[4]) == set(rows[3])
    for d, r in rows[4].items():
        before = rows[3][d]["text"]
        assert not pii.base_spans(r["text"]) and r["n_chars"] == (len(r["text"]) if r["text"] != before else rows[3][d]["n_chars"])
        assert r["text"] != before or not pii.base_spans(before)
    check_packing([(d, r["text"]) for d, r in rows[4].items()], kept[5].collect(), 4096)


@pytest.mark.parametrize("n", [0, 8])
def test_pipeline_odd_rows(spark, sf_dir, n):
    from .test_tokens_and_bins import ODD

    docs = spark.createDataFrame([(*r[:3], "s", r[3]) for r in ODD][:n], "doc_id long, text string, lang string, source string, n_chars int")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert len(docs.collect()) == (n and (6 if k else 8))


@pytest.mark.parametrize("n", [0, 8])
def test_whole_run(spark, sf_dir, tmp_path, n):
    """run() over odd rows: the rows of all stages one after another, and nothing left but the last output."""
    import os
    import shutil

    from .test_tokens_and_bins import ODD

    home = spark.conf.get("spark.checkpoint.dir")
    for t in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{t}.parquet", tmp_path)
    docs = spark.createDataFrame([(*r[:3], "s", r[3]) for r in ODD][:n], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    before = set(os.listdir(f"{home}/tables")) if os.path.exists(f"{home}/tables") else set()
    others = {x for x in os.listdir(home) if x.startswith("pipeline-")}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert set(os.listdir(f"{home}/tables")) == before
    (own,) = {x for x in os.listdir(home) if x.startswith("pipeline-")} - others
    assert len(os.listdir(f"{home}/{own}")) == 1
    want = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, want, sf_dir).write.parquet(f"{tmp_path}/{k}")
        want = spark.read.parquet(f"{tmp_path}/{k}")
    check_packing([(r.doc_id, r.text) for r in want.collect()], got, 4096)
    assert len({(r.doc_id, r.ids_crc32) for r in got}) >= (n and 6)
