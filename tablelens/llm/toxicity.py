"""Toxicity (operator 3): non-negative positive-unlabelled learning.

A linear classifier over the words of a text and their beginnings is trained
from confirmed toxic documents (P) and unlabelled ones (U, drawn from all
documents, whatever their label). The risk on clean text is not observed; it is estimated as R_u^- - prior * R_p^- and kept from
going below zero (Kiryo et al., 2017):

    risk = prior * R_p^+  +  max(0, R_u^- - prior * R_p^-)

When the second term is negative the step goes up its gradient instead, so a
flexible model cannot drive it down by fitting the unlabelled toxic texts.

Features are counted over all documents and chosen from those counts. Only the
fit takes bounded samples P and U (``max_positive``, ``max_unlabelled``
documents, picked by a hash of their id); the model is a short list of features.
Scoring reads every whole text once, in tasks, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, held_out
from .decontaminate import split_words

#: Lengths, in bytes, of the word beginnings that are features besides whole words.
BEGINNINGS = (3, 4, 5, 6, 8)
#: A feature that a text has so many times stands for a feature of its own.
TIMES = (1, 2, 4)
_CACHE_WORDS = 100_000
#: Features that a task counts before it hands the counts on, and entries of texts that it counts at once.
_COUNTED = 500_000
#: So many ids (8 MB) are broadcast to the texts; more are joined by a shuffle.
_FEW_IDS = 1_000_000
_HASH_RANGE = 1 << 40


def word_features(word: bytes) -> list[bytes]:
    return [b"=" + word, *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def _often(feature: bytes, times: int) -> bytes:
    return feature if times == 1 else b"%s#%d" % (feature, times)


def text_features(text: str | None, features=word_features) -> list[bytes]:
    """Features of a whole text: those of its words, and again where they are met often (``TIMES``)."""
    words, met = Counter(), Counter()
    for part in split_words(text):
        words.update(part)
    for word, own in zip(words, map(features, words)):
        for f in own:
            met[f] += words[word]
    return sorted([_often(f, t) for f, n in met.items() for t in TIMES if n >= t])


class _FeatureCounts:
    """How many texts hold each feature, in arrays by the features' numbers.

    Texts are taken apart one by one and counted many at once: equal (text,
    feature) entries are summed by a sort, which gives how often a text has each.
    """

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}  # feature -> number
        self.known: dict[bytes, list[int]] = {}  # word -> numbers of its features
        self.counts = np.zeros((2, len(TIMES), 0), np.int64)  # of positive texts, of all
        self._start()

    def _start(self) -> None:
        self.features, self.sizes, self.times, self.entries, self.positive = [], [], [], [], []

    def _number(self, word: bytes) -> list[int]:
        got = self.known[word] = [self.numbers.setdefault(f, len(self.numbers)) for f in word_features(word)]
        return got

    def add(self, text: str | None, positive: bool) -> None:
        words, before = Counter(), len(self.features)
        for part in split_words(text):
            words.update(part)
        own = [self.known.get(w) or self._number(w) for w in words]
        self.features.extend(chain.from_iterable(own))
        self.sizes.extend(map(len, own))
        self.times.extend(words.values())
        self.entries.append(len(self.features) - before)
        self.positive.append(positive)
        if len(self.features) > _COUNTED:
            self.fold()

    def fold(self) -> None:
        """Count the texts added since the last time."""
        n, texts = len(self.numbers), np.repeat(np.arange(len(self.entries)), self.entries)
        key = texts * n + np.array(self.features, np.int64)
        order = np.argsort(key)
        key, times = key[order], np.repeat(np.array(self.times, np.int64), self.sizes)[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        times = np.add.reduceat(times, first) if len(first) else times
        text, feature = np.divmod(key[first], max(1, n))
        toxic = np.array(self.positive, bool)[text]
        self.counts = np.pad(self.counts, ((0, 0), (0, 0), (0, n - self.counts.shape[2])))
        for at, t in enumerate(TIMES):
            self.counts[0, at] += np.bincount(feature[toxic & (times >= t)], minlength=n)
            self.counts[1, at] += np.bincount(feature[times >= t], minlength=n)
        self._start()

    def batch(self) -> pa.RecordBatch:
        self.fold()
        names, found, p, u = list(self.numbers), [], [], []
        for at, t in enumerate(TIMES):
            some = np.flatnonzero(self.counts[1, at])
            found += [_often(names[i], t) for i in some.tolist()]
            p.append(self.counts[0, at, some])
            u.append(self.counts[1, at, some])
        return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array(np.concatenate(p)), pa.array(np.concatenate(u))], names=["feature", "p", "u"])


def _count_features(batches):
    """How many texts of a task hold each feature: ``p`` of the positive ones, ``u`` of all."""
    seen = _FeatureCounts()
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("positive").to_pylist()):
            seen.add(text.as_py(), toxic)
            if len(seen.numbers) > _COUNTED:
                yield seen.batch()
                seen = _FeatureCounts()
    yield seen.batch()


def count_features(docs: DataFrame, toxic: DataFrame, few: bool) -> DataFrame:
    """(feature, p, u): how many texts hold it of those with an id in ``toxic``, and of all (doc_id, text) rows.

    ``few``: ``toxic`` is known to be small, so it is broadcast and no text is shuffled.
    """
    toxic = toxic.withColumn("positive", F.lit(True))
    rows = docs.select("doc_id", "text").join(F.broadcast(toxic) if few else toxic, "doc_id", "left")
    return (rows.select("text", F.coalesce("positive", F.lit(False)).alias("positive"))
            .mapInArrow(_count_features, "feature binary, p long, u long")
            .groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u")))


def _number_features(chosen: dict[bytes, int]):
    def run(batches):
        for batch in batches:
            lists = [[chosen[f] for f in text_features(t.as_py()) if f in chosen] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("positive"), pa.array(lists, pa.list_(pa.int32()))],
                                             names=["doc_id", "positive", "features"])
    return run


class Sparse:
    """Rows of feature numbers: products with a weight vector and with row coefficients."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def scores(self, weights: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(weights[self.at])])
        return total[self.ends] - total[self.ends - self.sizes]

    def gradient(self, coefficients: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.at, np.repeat(coefficients, self.sizes), n)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_nnpu(positive: Sparse, unlabelled: Sparse, n_features: int, prior: float, steps: int = 400,
             rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float, list[float]]:
    """Weights, bias and the risk per step of a logistic-loss nnPU classifier, by Adam over whole samples."""
    weights, risks = np.zeros(n_features + 1), []  # the last is the bias
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    weights[-1] = np.log(prior / (1 - prior))
    n_p, n_u = max(1, len(positive.sizes)), max(1, len(unlabelled.sizes))
    for step in range(1, steps + 1):
        z_p, z_u = positive.scores(weights) + weights[-1], unlabelled.scores(weights) + weights[-1]
        r_p_plus, r_p_minus, r_u_minus = (np.logaddexp(0, z).sum() / n for z, n in ((-z_p, n_p), (z_p, n_p), (z_u, n_u)))
        clean = r_u_minus - prior * r_p_minus
        risks.append(prior * r_p_plus + max(0.0, clean))
        s_p, s_u = _sigmoid(z_p), _sigmoid(z_u)
        if clean >= 0:
            c_p, c_u = prior * (s_p - 1) / n_p - prior * s_p / n_p, s_u / n_u
        else:
            c_p, c_u = prior * s_p / n_p, -s_u / n_u
        g = np.append(positive.gradient(c_p, n_features) + unlabelled.gradient(c_u, n_features), c_p.sum() + c_u.sum())
        g[:-1] += decay * weights[:-1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights[:-1], float(weights[-1]), risks


class _Known(dict):
    """word -> those of its features that a model uses."""

    def __init__(self, used: set[bytes]) -> None:
        self.used = used

    def __missing__(self, word: bytes) -> tuple[bytes, ...]:
        got = self[word] = tuple(f for f in word_features(word) if f in self.used)
        return got


class ToxicityModel:
    def __init__(self, features: list[bytes], weights: np.ndarray, bias: float, prior: float) -> None:
        self.weights, self.bias, self.prior = dict(zip(features, weights.tolist())), bias, prior

    def scorer(self):
        """text -> score, with a bounded memory of words."""
        weights, bias, known = self.weights, self.bias, _Known({f.split(b"#")[0] for f in self.weights})

        def score(text: str | None) -> float:
            if len(known) > _CACHE_WORDS:
                known.clear()
            z = bias + sum(weights.get(f, 0.0) for f in text_features(text, known.__getitem__))
            return float(_sigmoid(np.float64(z)))
        return score


def _within(share: float):
    """Ids whose hash falls in ``share`` of the range."""
    return F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(_HASH_RANGE)) < int(min(1.0, share) * _HASH_RANGE)


def _sample(docs: DataFrame, positive: DataFrame, unlabelled: DataFrame) -> DataFrame:
    """(doc_id, positive, text) of the picked ids, one row per doc_id."""
    picked = positive.withColumn("positive", F.lit(True)).unionByName(unlabelled.withColumn("positive", F.lit(False)))
    # About max_positive + max_unlabelled ids: small enough to broadcast, so no text is shuffled.
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return cut(rows.groupBy("doc_id", "positive").agg(F.max("text").alias("text")), "sample")


def choose_features(seen: DataFrame, n_p: int, n_u: int, min_positive: int, min_contrast: float, max_features: int) -> list[bytes]:
    """The features of (feature, p, u) that tell ``n_p`` positive texts from ``n_u`` unlabelled ones, best first."""
    share_p, share_u = F.col("p") / max(1, n_p), (F.col("u") + 1) / max(1, n_u)
    contrast = (share_p - share_u) / F.sqrt(share_p / max(1, n_p) + share_u / max(1, n_u))
    kept = (seen.where((F.col("p") >= min_positive) & (share_p >= 2 * share_u) & (contrast >= min_contrast))
            .orderBy(F.desc(contrast), "feature").limit(max_features).collect())
    return [bytes(r["feature"]) for r in kept]


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_positive: int = 8192, max_unlabelled: int = 16384,
                 min_positive: int = 4, min_contrast: float = 3.0, max_features: int = 4096, class_prior: float | None = None) -> ToxicityModel:
    """Train from (doc_id, text) and (doc_id, toxic). A text is positive if a label of its id is toxic = 1;
    other labels only enter the class prior, the share of toxic ids among labelled ones (unless given).

    Features are counted over all rows of ``docs`` with an id. They are kept if at
    least ``min_positive`` positive rows hold them and their share among those is
    at least twice that among all rows and ``min_contrast`` standard errors above
    it; of more than ``max_features`` those of the largest contrast. The fit takes
    about ``max_positive`` positive ids and ``max_unlabelled`` of all ids, repeated
    ids once. With no positive row the model has no feature and gives all texts
    one low score.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.where("doc_id is not null")
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).first()
    n_toxic = n["toxic"] or 0
    prior = class_prior or min(0.5, max(1e-4, n_toxic / max(1, n["n"])))
    toxic, few = known.where("toxic = 1").select("doc_id"), n_toxic <= _FEW_IDS
    ids = docs.select("doc_id")
    n_u, n_p = ids.count(), ids.join(F.broadcast(toxic) if few else toxic, "doc_id").count()
    names = choose_features(count_features(docs, toxic, few), n_p, n_u, min_positive, min_contrast, max_features)

    sample = _sample(docs, toxic.where(_within(max_positive / max(1, n_toxic))), ids.where(_within(max_unlabelled / max(1, n_u))).distinct())
    rows = sample.mapInArrow(_number_features({f: i for i, f in enumerate(names)}), "doc_id long, positive boolean, features array<int>")
    rows = rows.toPandas().sort_values("doc_id")  # at most the sample, a few numbers a row
    split = lambda wanted: Sparse([np.asarray(f) for f, p in zip(rows["features"], rows["positive"]) if p == wanted])
    weights, bias, _ = fit_nnpu(split(True), split(False), len(names), prior)
    return ToxicityModel(names, weights, bias, prior)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``doc`` (the input row as a struct), ``score`` (0 to 1) and ``predicted`` (1 if score >= 0.5).

    A null or empty text has no features and gets the model's lowest evidence,
    its bias. Every row is scored, repeated ones alike.
    """
    bounded_batches(docs.sparkSession)
    made = []  # one scorer for all batches of a task

    def run(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(model.scorer())
        return pa.array([made[0](t.as_py()) for t in texts], pa.float64())
    udf = F.arrow_udf(run, "double")
    return (docs.select(F.struct("*").alias("doc"))
            .select("doc", udf(F.col("doc").getField(text)).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))


def classify_toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 5,
                      **settings) -> DataFrame:
    """Fit on the rows outside the held-out fold and score all: ``doc``, ``held_out``, ``score``, ``predicted``.

    Only texts enter a score. A null doc_id is in no label's reach, so its row is
    scored but never learnt from. Empty tables: an empty ``docs`` gives an empty
    result, empty ``labels`` one low score for all rows.
    """
    learn = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(~held_out(F.col("doc_id"), folds))
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where(~held_out(F.col("doc_id"), folds))
    model = fit_toxicity(learn, taught, **settings)
    return score_toxicity(docs, model, text).withColumn("held_out", held_out(F.col("doc").getField(doc_id), folds))
