"""Language ID (operator 9): nearest centroids of TF-IDF n-gram vectors.

A text's vector holds its byte bigrams and trigrams, hashed to a fixed number
of places, weighted by (1 + log count) * idf and brought to length 1. Each
language has several centroids, found by spherical k-means, and a text gets the
language of the centroid with the largest cosine. A centroid remembers how far
its own texts lie; a text farther away than nearly all of them is marked as
rejected.

Document frequencies count every learning text. The centroids come from a
bounded sample of each language's distinct texts (``per_language``, ``max_sample``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bounded_batches, held_out

PLACES = 4096
_CHUNK = 1 << 22
_LETTER = {*b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
#: A-Z lower-cased, ASCII characters other than letters turned into spaces.
_TEXT_BYTES = bytes(c if c in _LETTER else 32 for c in LOWER_BYTES)
_HASH_RANGE = 1 << 40


def ngram_counts(text: str | None) -> np.ndarray:
    """Counts of the hashed bigrams and trigrams of a whole text; runs of spaces count as one."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TEXT_BYTES).split())
    counts = np.zeros(PLACES, np.int64)
    if not data:
        return counts
    data = b" " + data + b" "
    for at in range(0, len(data) - 1, _CHUNK):
        b = np.frombuffer(data[at:at + _CHUNK + 2], np.uint8).astype(np.uint32)
        two = b[:-1] * np.uint32(257) + b[1:]
        three = two[:-1] * np.uint32(263) + b[2:]
        # A chunk's last bigram belongs to the next one, which starts with it.
        two = two[:_CHUNK]
        for grams in (two, three):
            counts += np.bincount((grams * np.uint32(2654435761)) >> np.uint32(20), minlength=PLACES)
    return counts


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts) * idf
    norm = np.linalg.norm(vectors, axis=-1, keepdims=True)
    return vectors / np.where(norm > 0, norm, 1)


def _frequencies(batches):
    seen = np.zeros(PLACES, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            seen += ngram_counts(text.as_py()) > 0
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(PLACES)), pa.array(seen)], names=["place", "n"])


def _counted(batches):
    for batch in batches:
        counts = [ngram_counts(t.as_py()).astype("<i4").tobytes() for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(counts, pa.binary())], names=["lang", "counts"])


def spherical_kmeans(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length 1 and each row's centroid; starts from rows far apart."""
    first = [int(np.argmax(vectors @ vectors.sum(axis=0)))]
    while len(first) < min(k, len(vectors)):
        first.append(int(np.argmin((vectors @ vectors[first].T).max(axis=1))))
    centroids = vectors[first]
    for _ in range(rounds):
        own = np.argmax(vectors @ centroids.T, axis=1)
        sums = np.stack([vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = sums / np.where(norm > 0, norm, 1)
    return centroids, np.argmax(vectors @ centroids.T, axis=1)


class LanguageModel:
    def __init__(self, idf: np.ndarray, samples: dict[str, np.ndarray], clusters: int, reject: float) -> None:
        self.idf, self.langs, self.floors, parts = idf, [], [], []
        for lang in sorted(samples):
            vectors = _weigh(samples[lang], idf)
            centroids, own = spherical_kmeans(vectors, clusters)
            near = (vectors * centroids[own]).sum(axis=1)
            for c in range(len(centroids)):
                mine = near[own == c]
                self.langs.append(lang)
                self.floors.append(float(np.quantile(mine, reject)) if len(mine) else 0.0)
                parts.append(centroids[c])
        self.centroids = np.array(parts).reshape(-1, PLACES)

    def predict(self, texts: list[str | None], chunk: int = 256):
        """(language, cosine, rejected) of each text."""
        out = []
        for at in range(0, len(texts), chunk):
            part = texts[at:at + chunk]
            cosine = _weigh(np.stack([ngram_counts(t) for t in part]), self.idf) @ self.centroids.T
            for text, row in zip(part, cosine):
                if not has_letter(text) or not self.langs:
                    out.append(("und", 0.0, True))
                    continue
                c = int(np.argmax(row))
                score = float(min(1.0, max(0.0, row[c])))
                out.append((self.langs[c], score, score < self.floors[c]))
        return out


def fit_language(docs: DataFrame, per_language: int = 400, max_sample: int = 4000, clusters: int = 3,
                 reject: float = 0.005) -> LanguageModel:
    """Learn from (text, lang) rows with both; document frequencies use all of them."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.where("text is not null and lang is not null and text <> ''").select("text", "lang")
    copies = docs.groupBy("lang", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))
    # One row per language: rows, and distinct texts.
    sizes = {r["lang"]: (r["n"], r["texts"]) for r in copies.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")).collect()}
    n = sum(rows for rows, _ in sizes.values())
    # PLACES rows, whatever the table's size.
    seen = docs.mapInArrow(_frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(PLACES)
    df[seen["place"].to_numpy(int)] = seen["n"].to_numpy(float)
    idf = np.log((1 + n) / (1 + df)) + 1e-3
    each = max(1, min(per_language, max_sample // max(1, len(sizes))))
    # The ``each`` smallest hashes of a language's distinct texts: hashes below a bound that about 2 * each + 64 of them pass, then ranked.
    shares = spark.createDataFrame([(lang, int(min(1.0, (2 * each + 64) / texts) * _HASH_RANGE)) for lang, (_, texts) in sizes.items()],
                                   "lang string, below long")
    place = F.pmod(F.xxhash64("text"), F.lit(_HASH_RANGE))
    picked = (docs.join(F.broadcast(shares), "lang").where(place < F.col("below")).select("lang", "text").distinct()
              .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(place, "text"))).where(F.col("nth") <= each))
    rows = picked.mapInArrow(_counted, "lang string, counts binary").toPandas().sort_values(["lang", "counts"])
    samples = {lang: np.stack([np.frombuffer(c, "<i4") for c in own["counts"]]) for lang, own in rows.groupby("lang")}
    if missing := sizes.keys() - samples.keys():
        raise RuntimeError(f"no learning text drawn for {sorted(missing)}")
    return LanguageModel(idf, samples, clusters, reject)


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """``doc`` (the input row as a struct), ``lang_pred``, ``score`` (cosine, 0 to 1), ``rejected``.

    A text that is null, empty or without a letter is ``und`` with score 0. A
    text with letters always gets a learned language (``und`` only if none was
    learned); ``rejected`` marks those too far from their centroid.
    """
    def run(texts: pa.Array) -> pa.Array:
        found = model.predict(texts.to_pylist())
        langs, scores, rejected = zip(*found) if found else ([], [], [])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                                          names=["lang_pred", "score", "rejected"])
    bounded_batches(docs.sparkSession)
    udf = F.arrow_udf(run, "lang_pred string, score double, rejected boolean")
    return (docs.select(F.struct("*").alias("doc")).select("doc", udf(F.col("doc").getField(text)).alias("found"))
            .select("doc", "found.lang_pred", "found.score", "found.rejected"))


def classify_language(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", folds: int = 5,
                      **settings) -> DataFrame:
    """Fit on the rows outside the held-out fold and predict all: ``doc``, ``held_out``, ``lang_pred``, ``score``, ``rejected``.

    Only texts enter a prediction. Null languages are not learnt from; a null
    doc_id is in the held-out fold if crc32 of '' says so. An empty table gives
    an empty result.
    """
    learn = docs.where(~held_out(F.col(doc_id), folds)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit_language(learn, **settings)
    return identify_language(docs, model, text).withColumn("held_out", held_out(F.col("doc").getField(doc_id), folds))
