"""Spelling variant grouping (operator 13): PartEnum signatures over letter multisets.

A word's letters are a set of features (letter, how many of it before), that is
a binary vector. One inserted or deleted letter changes one of its dimensions,
one replaced letter two. The dimensions are dealt to ``BLOCKS`` blocks by a hash.
Words of equal length that differ by a replaced letter agree in all but two
blocks at most, words whose lengths differ by one in all but one. So each word
has a signature for every choice of blocks that may differ (two out of all
within its own length, one out of all towards the next shorter and the next longer
length), two near words share at least one of them, and an equi-join on
signatures followed by a check of the edit distance finds every near pair.

Many words share a choice of blocks (anagrams, long words of few letters), so a
signature also holds one of two halves: of two near words either the first half
or the rest agrees letter by letter. That costs two rows instead of one and
leaves few pairs to check.

Joins of tables as large as the vocabulary ask for a sort-merge join: Spark sizes a
stage by its compressed files and does not know that a task makes 20 signatures of a
word, so it would send far more than its limit through the driver.

Signatures are 64-bit hashes of the agreeing features; two that collide only
cost a check. Words, not their occurrences, are joined; occurrences are summed up
in the tasks that read the texts, before any shuffle.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shuffle_parts

BLOCKS = 4
#: Words a counting task holds before it hands its counts on.
HELD_WORDS = 1 << 18
_WORD_BATCH = 1 << 15
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _letters_only() -> bytes:
    """Latin-1 byte table: A-Z lower-cased, other letters and U+00C0-U+00FF kept, all else a space."""
    letter = {c: c for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]}
    letter |= {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
    return bytes(letter.get(c, 32) for c in range(256))


_LETTERS = _letters_only()


def _count(least_length: int, delete_every: int | None):
    def run(batches):
        counts: Counter[bytes] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out
        for batch in batches:
            for own, text in zip(batch.column("doc_id"), batch.column("text")):
                # Characters beyond U+00FF become '?', which parts words like any other.
                words = (text.as_py() or "").encode("latin-1", "replace").translate(_LETTERS).split()
                found = Counter(w for w in words if len(w) >= least_length)
                if delete_every:
                    start = zlib.crc32(f"{'' if own.as_py() is None else own.as_py()}:".encode())
                    for w in list(found):
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
                        if h % delete_every == 0:
                            at = h % len(w)
                            n, shorter = found.pop(w), w[:at] + w[at + 1:]
                            if len(shorter) >= least_length:
                                counts[shorter] += n
                counts.update(found)
                if len(counts) > HELD_WORDS:
                    yield flush()
        yield flush()
    return run


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_count: int = 5,
                delete_every: int | None = None) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` letters that occur at least ``least_count`` times in all texts.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF with A-Z
    lower-cased. With ``delete_every``, a run's letter h % length is deleted
    where ``delete_every`` divides h = crc32 of "<doc_id>:<run>", before
    anything is counted (a null doc_id is the empty text). A null or empty text
    has no words; rows that repeat count again.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(docs[f"`{doc_id}`"].cast("string").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    return (own.mapInArrow(_count(least_length, delete_every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def block_sums(words: list[str], blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths; per word and block the sum of the hashes of its features there; per word four hashes of halves.

    The halves: the first base // 2 letters and the last base - base // 2, for
    base the word's length and one less.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    from_end, halves = lengths[word] - 1 - place, np.zeros((len(words), 4), np.uint64)
    for k, base in enumerate((lengths[word], lengths[word] - 1)):
        for side, at, inside in ((0, place, place < base // 2), (1, from_end, from_end < base - base // 2)):
            here = _mix(letters[inside] * _A + at[inside].astype(np.uint64) * _B + np.uint64(side + 2))
            np.add.at(halves, (word[inside], 2 * k + side), here)
    letters = letters[np.lexsort((letters, word))]  # each word's letters sorted; the words' order stays
    place, new = np.arange(len(letters)), np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (word[1:] != word[:-1])
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    feature = _mix(letters * _A + nth.astype(np.uint64) * _B + np.uint64(1))
    sums = np.zeros((len(words), blocks), np.uint64)
    np.add.at(sums, (word, (_mix(feature) % np.uint64(blocks)).astype(np.int64)), feature)
    return lengths, sums, halves


def _signatures(blocks: int, shorter: int):
    """(word, n) -> (sig, same, word, n), once for each choice of blocks and half.

    Towards words of another length, these are for a word ``shorter`` by 0 or 1
    letters: the longer word's with 1 meet the shorter word's with 0.
    """
    choices = [(True, gone) for gone in itertools.combinations(range(blocks), 2)] + [(False, (gone,)) for gone in range(blocks)]

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _WORD_BATCH):
                batch = whole.slice(at, _WORD_BATCH)
                lengths, sums, halves = block_sums(batch.column("word").to_pylist(), blocks)
                for k, (same, gone) in enumerate(choices):
                    kept = np.full(len(lengths), k + 1, np.uint64) * _B
                    for b in range(blocks):
                        if b not in gone:
                            kept = _mix(kept ^ sums[:, b])
                    less = 0 if same else shorter
                    within = _mix(kept + (lengths - less).astype(np.uint64) * _A)
                    for side in (0, 1):
                        sig = _mix(within ^ (halves[:, 2 * less + side] + np.uint64(side)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(sig.view(np.int64)), pa.array(np.full(len(sig), same)), batch.column("word"), batch.column("n")],
                            names=["sig", "same", "word", "n"])
    return run


def near_words(words: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """(word, other, other_n): all ordered pairs of words at edit distance one. ``words``: distinct (word, n)."""
    schema = "sig long, same boolean, word string, n long"
    one, two = (words.select("word", "n").mapInArrow(_signatures(blocks, shorter), schema).alias(name) for shorter, name in ((0, "one"), (1, "two")))
    once = F.expr("NOT one.same OR one.word < two.word")
    pairs = (one.join(two.hint("merge"), (F.col("one.sig") == F.col("two.sig")) & once & (F.levenshtein("one.word", "two.word", 1) == 1))
             .select(F.col("one.word").alias("a"), F.col("one.n").alias("na"), F.col("two.word").alias("b"), F.col("two.n").alias("nb"))
             .distinct())
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("other_n")),
                   F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("other_n")))
    return pairs.select(F.inline(both))


def roots(forms: DataFrame, most_n: int, factor: int) -> DataFrame:
    """(word, root) of (word, form) rows by pointer doubling.

    A form occurs at least ``factor`` times as often as its word, so a chain has
    at most log(most_n) / log(factor) links and there are no cycles.
    """
    found = cut(forms.select("word", F.col("form").alias("root")), "roots")
    links = math.log(max(most_n, factor), factor) + 1
    for _ in range(math.ceil(math.log2(links))):
        further = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = cut(found.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return found


def group_variants(words: DataFrame, factor: int = 5, blocks: int = BLOCKS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of ``words``: distinct (word, n) with n >= 1.

    ``n_near``: words at edit distance one. ``form``: the near word of largest n
    (ties: the smallest in code-point order) if that is at least ``factor``
    (over 1) times the word's own n, else null. ``root``: where following forms ends.
    An empty table gives an empty result. Letters of any kind may occur.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = (near_words(words, blocks).groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best")))
    much = -F.col("best.minus") >= factor * F.col("n")
    out = cut(words.join(best.hint("merge"), "word", "left")
              .select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                      F.when(much, F.col("best.other")).alias("form"), F.when(much, -F.col("best.minus")).alias("form_n")), "forms")
    most = words.agg(F.max("n")).first()[0] or 1
    ends = roots(out.where("form is not null"), most, factor)
    return out.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least_length: int = 6, least_count: int = 5,
                      factor: int = 5, delete_every: int | None = None) -> DataFrame:
    """:func:`group_variants` of :func:`count_words`: variants among the words of whole texts."""
    return group_variants(count_words(docs, text, doc_id, least_length, least_count, delete_every), factor)
