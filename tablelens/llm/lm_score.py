"""LM scoring (operator 10): context-tree weighting over bytes, and a unigram base.

1. One pass over all texts counts words and grams (a byte with the ``depth``
   bytes before it); only learning texts add to the counts, the others add
   their grams with count 0. One aggregate brings the counts together.
2. Grams are dealt by their two nearest context bytes: each pair's subtree is
   worked out in one task. What the tree above needs is at most 256 * 255 sums.
3. With that known, every gram of the corpus gets its log10 probability.
4. A second pass scores the texts. The most used words and grams are broadcast
   (``HOT_WORDS``, ``HOT_GRAMS`` bound them); occurrences of all others leave the
   pass as counts per text and are joined to their tables, so every token and
   every byte of every text is scored exactly, however large the tables are.

The text a probability is about is its tokens, joined by single spaces, and a
line break as the end.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bounded_batches, cut, held_out, shuffle_parts
from .ctw import Crown, Lookup, Subtrees, grams_of

HOT_WORDS = 1 << 18
HOT_GRAMS = 1 << 20
END = b"\n"
_FLUSH_WORDS = 200_000
_FLUSH_GRAMS = 1 << 21
_CHUNK = 1 << 22


def text_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()


def _gram_chunks(words: list[bytes], depth: int):
    """Grams of the words and the end, in pieces of bounded size."""
    body = b" ".join(words) + END
    yield grams_of(body[:_CHUNK], depth)
    for at in range(_CHUNK, len(body), _CHUNK):
        yield grams_of(body[at - depth:at + _CHUNK], depth)[depth:]


class _GramCounter:
    """Distinct grams and counts of a stream of arrays, merged whenever enough have come."""

    def __init__(self) -> None:
        self.waiting, self.size = [], 0
        self.grams, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, grams: np.ndarray) -> None:
        self.waiting.append(grams)
        self.size += len(grams)
        if self.size >= _FLUSH_GRAMS:
            self.merge()

    def merge(self) -> None:
        if self.waiting:
            grams, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            both, at = np.unique(np.concatenate([self.grams, grams]), return_inverse=True)
            self.n = np.bincount(at, np.concatenate([self.n, n]), len(both)).astype(np.int64)
            self.grams, self.waiting, self.size = both, [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.merge()
        out = self.grams, self.n
        self.grams, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


def _rows(words, word_n, grams, gram_n) -> pa.RecordBatch:
    n, m = len(words), len(grams)
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(words, pa.binary()), pa.nulls(m, pa.binary())]), pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(grams, pa.int64())]),
         pa.array(np.concatenate([np.asarray(word_n, np.int64), gram_n]))], names=["word", "gram", "n"])


def _counter(depth: int):
    none = np.zeros(0, np.int64)

    def run(batches):
        words, learnt, others = Counter(), _GramCounter(), _GramCounter()
        for batch in batches:
            for text, out in zip(batch.column("text"), batch.column("held_out").to_pylist()):
                own = text_words(text.as_py())
                if not out:
                    words.update(own)
                    words[END] += 1
                    if len(words) > _FLUSH_WORDS:
                        yield _rows(list(words), list(words.values()), none, none)
                        words = Counter()
                for grams in _gram_chunks(own, depth):
                    (others if out else learnt).add(grams)
            for counter, weight in ((learnt, 1), (others, 0)):
                if len(counter.grams) > _FLUSH_GRAMS:
                    grams, n = counter.take()
                    yield _rows([], none, grams, n * weight)
        yield _rows(list(words), list(words.values()), none, none)
        for counter, weight in ((learnt, 1), (others, 0)):
            grams, n = counter.take()
            yield _rows([], none, grams, n * weight)
    return run


def _sorted_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    grams, n = table["gram"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _parts(depth: int, top: int):
    def run(table):
        context, node, weighted, zeros, ones = Subtrees(*_sorted_grams(table), depth, top).parts()
        return pa.table({"context": pa.array(context), "node": pa.array(node), "weighted": pa.array(weighted),
                         "zeros": pa.array(zeros), "ones": pa.array(ones)})
    return run


def _predictions(depth: int, top: int, crown: Crown):
    def run(table):
        grams, n = _sorted_grams(table)
        return pa.table({"gram": pa.array(grams), "n": pa.array(n), "value": pa.array(Subtrees(grams, n, depth, top).log10(crown))})
    return run


def train_ctw(grams: DataFrame, depth: int) -> DataFrame:
    """(gram, n) with learning counts -> (gram, n, value): log10 of its probability for every gram given.

    Subtrees of the two nearest bytes are dealt to tasks whole, some to each.
    """
    top = min(2, depth)
    nearest = F.shiftright("gram", 8 * (depth + 1 - top))
    dealt = grams.withColumn("deal", F.pmod(F.xxhash64(nearest), F.lit(4 * shuffle_parts(grams.sparkSession)))).groupBy("deal")
    parts = (dealt.applyInArrow(_parts(depth, top), "context long, node long, weighted double, zeros long, ones long")
             .groupBy("context", "node").agg(F.sum("weighted").alias("weighted"), F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")))
    got = parts.orderBy("context", "node").toPandas()  # at most 256 * 255 rows
    crown = Crown(top, *(got[c].to_numpy() for c in ("context", "node", "weighted", "zeros", "ones")))
    return dealt.applyInArrow(_predictions(depth, top, crown), "gram long, n long, value double")


def _hottest(table: DataFrame, most: int) -> DataFrame:
    """Rows with the largest n, all that share a step of a sixteenth of a power of two together; at most ``most``."""
    step = F.floor(16 * F.log2("n")).cast("int")
    steps = table.where("n > 0").groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()  # under 1024 rows
    least, total = 1 << 20, 0
    for r in steps:
        total += r["count"]
        if total > most:
            break
        least = r["step"]
    return table.where(F.col("n") > 0).where(step >= least)


def _scorer(shared, depth: int):
    def run(batches):
        words, word_values, grams, gram_values = shared.value
        word_at = {w: i for i, w in enumerate(words)}.get
        gram_at = Lookup(grams)
        for batch in batches:
            tokens, known, base, score, size, rare_words, rare_grams = [], [], [], [], [], [], []
            for text in batch.column("text"):
                own = text_words(text.as_py())
                at = np.fromiter(map(word_at, own, repeat(-1)), np.int64, len(own))
                hit = at >= 0
                rare = Counter(own[i] for i in np.flatnonzero(~hit).tolist())
                end = word_at(END, -1)
                if end < 0:
                    rare[END] += 1
                total = word_values[at[hit]].sum() + (word_values[end] if end >= 0 else 0.0)
                tokens.append(len(own) + 1)
                known.append(int(hit.sum()) + (end >= 0))
                base.append(float(total))
                rare_words.append(sorted(rare.items()))
                total, n, missed = 0.0, 0, []
                for g in _gram_chunks(own, depth):
                    at = gram_at.find(g)
                    hit = at >= 0
                    total += gram_values[at[hit]].sum()
                    n += len(g)
                    missed.append(g[~hit])
                g, k = np.unique(np.concatenate(missed), return_counts=True)
                score.append(float(total))
                size.append(n)
                rare_grams.append(list(zip(g.tolist(), k.tolist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.array(size, pa.int64()),
                 pa.array(rare_words, pa.map_(pa.binary(), pa.int64())), pa.array(rare_grams, pa.map_(pa.int64(), pa.int64()))],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bytes", "rare_words", "rare_grams"])
    return run


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", folds: int = 10, depth: int = 5) -> DataFrame:
    """Score every whole text by a model of the texts outside the held-out fold.

    Returns per input row: ``doc_id``, ``held_out``, ``n_tokens`` (words and one
    end), ``n_known`` (tokens with a learning count), ``train_tokens``,
    ``base_score`` (log10 by smoothed unigrams), ``score`` (log10 by the context
    trees), ``bits_per_byte`` (the trees' code length).

    A null or empty text is its end alone. Rows that repeat an id or a text are
    all learnt from and scored. A null doc_id is in the held-out fold if crc32
    of '' says so. An empty table gives an empty result; with nothing to learn
    from, every bit has probability one half and the base one word type.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), held_out(F.col(doc_id), folds).alias("held_out"))
    counts = cut(rows.mapInArrow(_counter(depth), "word binary, gram long, n long")
                 .groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words = counts.where("word is not null").select("word", "n")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, under = sums["n"], sums["n"] + 0.1 * (sums["v"] + 1)
    grams = cut(train_ctw(counts.where("gram is not null").select("gram", "n"), depth), "grams")

    hot_words, hot_grams = (_hottest(t, k).toArrow() for t, k in ((words, HOT_WORDS), (grams.select("gram", "n", "value"), HOT_GRAMS)))
    shared = spark.sparkContext.broadcast((
        hot_words["word"].to_pylist(), np.log10((hot_words["n"].to_numpy() + 0.1) / under),
        hot_grams["gram"].to_numpy(), hot_grams["value"].to_numpy()))
    schema = (f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, known long, base double, score double, "
              "n_bytes long, rare_words map<binary,bigint>, rare_grams map<bigint,bigint>")
    scored = cut(rows.mapInArrow(_scorer(shared, depth), schema).withColumn("row", F.monotonically_increasing_id()), "scored")

    rare = scored.select("row", F.explode("rare_words").alias("word", "k")).join(words, "word", "left")
    found = F.col("n").isNotNull()
    rare = rare.groupBy("row").agg(F.sum(F.when(found, F.col("k")).otherwise(0)).alias("rare_known"),
                                   F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(under))).alias("rare_base"))
    late = (scored.select("row", F.explode("rare_grams").alias("gram", "k")).join(grams.select("gram", "value"), "gram")
            .groupBy("row").agg(F.sum(F.col("k") * F.col("value")).alias("rare_score")))
    score = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return (scored.drop("rare_words", "rare_grams").join(rare, "row", "left").join(late, "row", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
                    F.lit(n_train).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
                    score.alias("score"), (-score * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte")))
