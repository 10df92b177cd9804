import random
import re
import zlib

import numpy as np
import pytest

from tablelens.llm.language import LanguageModel, classify_language, ngram_counts, spherical_kmeans
from tablelens.llm.queries import op3_toxicity, op9_language_id
from tablelens.llm import toxicity
from tablelens.llm.toxicity import Sparse, choose_features, classify_toxicity, count_features, fit_nnpu, fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.01"


def out_of_fold(i, folds):
    return zlib.crc32(str(i).encode()) % folds == 0


def auc(scores, labels):
    order = np.argsort(np.argsort(np.asarray(scores), kind="stable"))
    labels = np.asarray(labels, bool)
    n = labels.sum()
    return (order[labels].sum() - n * (n - 1) / 2) / (n * (~labels).sum())


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op3_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [i for i in labels if out_of_fold(i, 5)]
    assert all(got[i].held_out == out_of_fold(i, 5) for i in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert auc([got[i].score for i in held], [labels[i] for i in held]) > 0.95
    assert np.mean([got[i].predicted for i in held if labels[i]]) > 0.9
    clean = [got[i].predicted for i in held if not labels[i]]
    assert np.mean(clean) < 0.02


def toy_docs(rng, n=400):
    words = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < .25
        own = [rng.choice(words) for _ in range(rng.randrange(3, 200))] + (["awful", "nasty"] if toxic else [])
        rng.shuffle(own)
        rows.append((i, " ".join(own)))
        if rng.random() < .6:
            labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_learns_and_takes_odd_rows(spark, frame):
    rows, labels = toy_docs(random.Random(1))
    odd = [(None, None), (1000, ""), (1001, "nasty " * 100_000), (3, rows[3][1]), (None, "awful nasty")]
    out = classify_toxicity(frame(rows + odd, "doc_id long, text string"), frame([*labels, (None, 1), (7, None), (5, labels[0][1])], "doc_id long, toxic int")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc.doc_id, []).append(r)
    assert len(out) == len(rows) + len(odd)
    assert all(r.predicted == ("awful" in r.doc.text) for r in out if r.doc.text and r.doc.doc_id is not None and r.doc.doc_id < 1000)
    assert by[1000][0].predicted == 0 and by[1001][0].predicted == 1
    assert by[3][0].score == by[3][1].score


def brute_features(text):
    """Features of a text by the definition: words, word beginnings, and how often at least they are met."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    met = {}
    for w in (w.encode() for w in words):
        for f in [b"=" + w, *(w[:n] for n in (3, 4, 5, 6, 8) if len(w) >= n)]:
            met[f] = met.get(f, 0) + 1
    return {f if t == 1 else f + b"#%d" % t for f, n in met.items() for t in (1, 2, 4) if n >= t}


@pytest.mark.parametrize("few", [True, False])
def test_toxicity_counts_features_of_all_rows(spark, frame, monkeypatch, few):
    monkeypatch.setattr(toxicity, "_COUNTED", 50)
    rows, _ = toy_docs(random.Random(2), 200)
    rows += [(3, rows[3][1]), (500, None), (501, ""), (502, "Ärger ÄRGER x1 X1 x1 x1")]
    toxic = {3, 7, 100, 502, 9999}
    got = {bytes(r.feature): (r.p, r.u) for r in count_features(frame(rows, "doc_id long, text string").repartition(5),
                                                               frame([(i,) for i in toxic], "doc_id long"), few).collect()}
    want = {}
    for i, text in rows:
        for f in brute_features(text):
            p, u = want.get(f, (0, 0))
            want[f] = p + (i in toxic), u + 1
    assert got == want


def test_toxicity_feature_outside_the_fit_sample(spark, frame):
    """A word of four positive texts among many is a feature however few texts the fit takes, and the score is by hand."""
    rows = [(i, "plain words " + ("awful" if i % 4 == 0 else "fine") + (" rareword" if i in (0, 400, 800, 1200) else "")) for i in range(2000)]
    labels = [(i, int(i % 4 == 0)) for i in range(2000)]
    docs = frame(rows, "doc_id long, text string")
    seen = count_features(docs, frame([(i,) for i, t in labels if t], "doc_id long"), True)
    share_p, share_u = 4 / 500, 5 / 2000
    assert (share_p - share_u) / (share_p / 500 + share_u / 2000) ** .5 > 1
    assert b"=rareword" in choose_features(seen, 500, 2000, 4, 1.0, 4096)
    model = fit_toxicity(docs, frame(labels, "doc_id long, toxic int"), max_positive=50, max_unlabelled=100, min_contrast=1.0)
    assert b"=rareword" in model.weights and b"=awful" in model.weights
    for r in score_toxicity(docs.where("doc_id < 40"), model).collect():
        z = model.bias + sum(model.weights.get(f, 0) for f in brute_features(r.doc.text))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert r.predicted == int(r.score >= .5) == int("awful" in r.doc.text)


def test_toxicity_without_labels_or_documents(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame([(1, "a b", "x"), (2, None, "y")], "doc_id long, text string, score string")
    out = classify_toxicity(docs, labels).collect()
    assert len({r.score for r in out}) == 1 and {r.predicted for r in out} == {0}
    assert classify_toxicity(spark.createDataFrame([], "doc_id long, text string"), labels).collect() == []


def test_nnpu_beats_treating_unlabelled_as_clean():
    rng = np.random.default_rng(0)
    prior, n = 0.4, 3000
    hidden = rng.random(n) < prior
    row = lambda toxic: np.flatnonzero(rng.random(30) < np.where(np.arange(30) < 10, 0.5 if toxic else 0.1, 0.3))
    u = [row(t) for t in hidden]
    p = [row(True) for _ in range(500)]
    weights, bias, risks = fit_nnpu(Sparse(p), Sparse(u), 30, prior)
    z = Sparse(u).scores(weights) + bias
    assert ((z > 0) == hidden).mean() > 0.88
    assert risks[-1] >= 0 and risks[-1] < risks[0]
    assert abs((z > 0).mean() - prior) < 0.1


def test_language_on_held_out_rows(spark):
    got = {r.doc_id: r for r in op9_language_id(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").collect()
    held = [r for r in docs if out_of_fold(r.doc_id, 5) and r.lang and any(map(str.isalpha, r.text or ""))]
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got.values())
    assert all(got[r.doc_id].held_out == out_of_fold(r.doc_id, 5) for r in docs)


def test_language_of_odd_rows(spark, frame):
    rows = [(i, t, lang) for i in range(40) for t, lang in ((f"the cat and the dog {i}", "en"), (f"der hund und die katze {i}", "de"))]
    odd = [(None, None, None), (901, "", "en"), (902, "123 ...", "en"), (903, "THE cat" * 3, None), (904, "der hund " * 100_000, None), (905, "xq", None), (906, "日本", None)]
    out = classify_language(frame(rows + odd, "doc_id long, text string, lang string")).collect()
    by = {r.doc.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd)
    assert [by[i].lang_pred for i in (None, 901, 902)] == ["und"] * 3
    assert by[903].lang_pred == "en" and by[904].lang_pred == "de"
    assert by[905].lang_pred in ("en", "de") and by[906].lang_pred in ("en", "de") and by[906].rejected
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert classify_language(empty).collect() == []
    unlabelled = frame([(1, "the cat", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in classify_language(unlabelled).collect()] == [("und", 0.0)]


@pytest.mark.parametrize("chunk", [5, 64])
def test_ngram_counts_do_not_depend_on_chunks(monkeypatch, chunk):
    text = "Der Hund, the dog! é 12 ß" * 9
    whole = ngram_counts(text)
    monkeypatch.setattr("tablelens.llm.language._CHUNK", chunk)
    assert (ngram_counts(text) == whole).all() and whole.sum() > 100


def test_kmeans_finds_separate_clusters():
    rng = np.random.default_rng(2)
    base = np.eye(3, 20)
    v = np.abs(np.repeat(base, 30, axis=0) + 0.05 * rng.random((90, 20)))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    centroids, own = spherical_kmeans(v, 3)
    assert sorted(np.bincount(own)) == [30, 30, 30] and np.allclose(np.linalg.norm(centroids, axis=1), 1)
    assert LanguageModel(np.ones(4096), {}, 3, 0.01).predict(["abc"]) == [("und", 0.0, True)]


def test_every_language_is_learnt_from_its_distinct_texts(spark):
    from pyspark.sql import functions as F

    from tablelens.llm.language import fit_language

    rows = spark.range(20_000).select(F.concat(F.lit("lang"), (F.col("id") % 20).cast("string")).alias("lang"),
                                      F.concat(F.lit("copy "), F.col("id") % 100, F.lit(" of a text")).alias("text"))
    many = spark.range(1000).select(F.lit("many").alias("lang"), F.concat(F.lit("text "), "id").alias("text"))
    learnt = {}

    class Model(LanguageModel):
        def __init__(self, idf, samples, clusters, reject):
            learnt.update(samples)
            super().__init__(idf, samples, clusters, reject)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr("tablelens.llm.language.LanguageModel", Model)
        model = fit_language(rows.unionByName(many), per_language=50)
    assert {lang: len(own) for lang, own in learnt.items()} == {**{f"lang{i}": 5 for i in range(20)}, "many": 50}
    assert set(model.langs) == set(learnt)
