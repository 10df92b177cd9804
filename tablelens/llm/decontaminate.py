"""Benchmark decontamination (operator 5): suffix arrays over the training text.

Each task cuts its documents into shards of bounded size and builds a suffix
array over each shard's words. Every suffix of every benchmark item is
binary-searched in it; the run of the array that starts with the suffix's first
``window`` words gives all places of verbatim matches, and matches on one
diagonal join to the longest ones. Nothing is shuffled: the corpus is read once
and the benchmark, whose size is checked, is broadcast.

Only words that occur in the benchmark can be part of a match, so runs of such
words that are shorter than the shortest window are left out of the array.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER_BYTES, bounded_batches

#: Words in a shard: a document that reaches this many ends the shard.
SHARD_WORDS = 1 << 20
#: The benchmark is broadcast; a larger one is refused (call once for each part of it).
MAX_BENCHMARK_CHARS = 64 << 20
_CHUNK_BYTES = 8 << 20
_WORD = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
#: A-Z lower-cased, everything that is not part of a word turned into a space.
_WORD_BYTES = bytes(c if c in _WORD else 32 for c in LOWER_BYTES)


def split_words(text: str | None):
    """Lists of the words of a whole text, a bounded piece at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while at < len(data):
        end = at + _CHUNK_BYTES
        end = len(data) if end >= len(data) or (cut := data.find(b" ", end)) < 0 else cut
        yield data[at:end].split()
        at = end


class Benchmark:
    """Items as word numbers (1 up; 0 is any other word) and the places where a window starts."""

    def __init__(self, items: list[tuple[str, str | None]], window: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.names, words, starts, lengths, owners = [], [], [], [], []
        for name, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for part in split_words(text) for w in part]
            if not own:
                continue
            base, n = len(words), min(window, len(own))
            starts += range(base, base + len(own) - n + 1)
            lengths += [n] * (len(own) - n + 1)
            owners += [(len(self.names), k) for k in range(len(own) - n + 1)]
            words += [*own, 0]
            self.names.append(name)
        self.words = np.array(words, np.int32)
        self.starts, self.lengths = np.array(starts, np.int64), np.array(lengths, np.int64)
        self.owners = np.array(owners, np.int64).reshape(-1, 2)  # item, place in the item
        self.shortest = int(self.lengths.min()) if len(lengths) else 0


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words, by prefix doubling."""
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    order, span = np.argsort(rank, kind="stable"), 1
    while span < depth and len(words):
        after = np.zeros(len(rank), np.int64)
        after[:-span] = rank[span:] + 1
        key = rank * (len(rank) + 2) + after
        order = np.argsort(key, kind="stable")
        changed = np.concatenate([[0], np.diff(key[order]) != 0])
        rank = np.empty(len(key), np.int64)
        rank[order] = np.cumsum(changed)
        span *= 2
    return order


def _compare(text, at, words, starts, lengths):
    """Sign of text[at:] against words[starts:starts + lengths], word by word; 0 if it begins with them."""
    sign, open_ = np.zeros(len(at), np.int8), np.arange(len(at))
    for k in range(int(lengths.max(initial=0))):
        open_ = open_[lengths[open_] > k]
        if not len(open_):
            break
        place = at[open_] + k
        left = np.where(place < len(text), text[np.minimum(place, len(text) - 1)], -1)
        diff = np.sign(left.astype(np.int64) - words[starts[open_] + k]).astype(np.int8)
        sign[open_] = diff
        open_ = open_[diff == 0]
    return sign


def search(text: np.ndarray, order: np.ndarray, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
    """For each pattern the run [low, high) of the suffix array whose suffixes begin with it."""
    bounds = []
    for upper in (False, True):
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(order), np.int64)
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            sign = _compare(text, order[mid], words, starts[open_], lengths[open_])
            right = sign <= 0 if upper else sign < 0
            low[open_[right]] = mid[right] + 1
            high[open_[~right]] = mid[~right]
        bounds.append(low)
    return bounds


def _candidates(ids: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of benchmark words of at least ``shortest``, a 0 after each; and each word's place in the shard."""
    known = np.concatenate([[False], ids > 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    first, last = edge[::2], edge[1::2]
    long = last - first >= shortest
    first, size = first[long], (last - first)[long] + 1  # with the word (or end) after the run
    place = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
    return np.append(ids, 0)[place], place


def shard_matches(ids: np.ndarray, bench: Benchmark, deepest: int):
    """Longest verbatim matches in a shard: arrays of (place, length, item, place in the item).

    ``ids``: the words' numbers, 0 after each document.
    """
    text, place = _candidates(ids, bench.shortest)
    none = np.zeros((0, 4), np.int64)
    if not len(text):
        return none
    order = suffix_array(text, deepest)
    low, high = search(text, order, bench.words, bench.starts, bench.lengths)
    found = np.flatnonzero(high > low)
    count = high[found] - low[found]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    which = np.repeat(found, count)
    at = place[order[np.repeat(low[found], count) + nth]]
    item, offset, length = bench.owners[which, 0], bench.owners[which, 1], bench.lengths[which]
    # A window that an item repeats counts at its first place; then one row per place and item.
    sort = np.lexsort((offset, at, item))
    at, item, offset, length = at[sort], item[sort], offset[sort], length[sort]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (item[1:] != item[:-1])]) if len(at) else np.zeros(0, bool)
    at, item, offset, length = at[new], item[new], offset[new], length[new]
    if not len(at):
        return none
    sort = np.lexsort((at, at - offset, item))
    at, item, offset, length = at[sort], item[sort], offset[sort], length[sort]
    joined = (item[1:] == item[:-1]) & (at[1:] == at[:-1] + 1) & (offset[1:] == offset[:-1] + 1)
    head = np.flatnonzero(np.concatenate([[True], ~joined]))
    tail = np.append(head[1:], len(at)) - 1
    return np.stack([at[head], at[tail] + length[tail] - at[head], item[head], offset[head]], axis=1)


_SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())])


def _matcher(shared, window: int):
    def run(batches):
        bench = shared.value
        deepest = int(bench.lengths.max(initial=1))
        number = bench.vocabulary.get
        held, ids, sizes, total = [], [], [], 0

        def flush():
            nonlocal held, ids, sizes, total
            size = np.array(sizes, np.int64)  # with the 0 after each document
            begin = np.concatenate([[0], np.cumsum(size)])
            spans = shard_matches(np.concatenate(ids), bench, deepest)
            delta = np.zeros(begin[-1] + 1, np.int64)
            np.add.at(delta, spans[:, 0], 1)
            np.add.at(delta, spans[:, 0] + spans[:, 1], -1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(delta)[:-1] > 0)])
            n_hit = hit[begin[1:]] - hit[begin[:-1]]
            spans = spans[np.lexsort((spans[:, 2], spans[:, 1], spans[:, 0]))]
            doc = np.searchsorted(begin, spans[:, 0], "right") - 1
            edges = np.searchsorted(doc, np.arange(len(size) + 1)).astype(np.int32)
            names = [bench.names[i] for i in spans[:, 2]]
            struct = pa.StructArray.from_arrays([pa.array(spans[:, 0] - begin[doc]), pa.array(spans[:, 1]), pa.array(names, pa.string()),
                                                 pa.array(spans[:, 3])], fields=list(_SPAN))
            items = [sorted(set(names[a:b])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(held), pa.array(size - 1), pa.array(n_hit), pa.array(items, pa.list_(pa.string())),
                 pa.ListArray.from_arrays(pa.array(edges), struct)], names=["doc", "n_words", "n_hit", "items", "spans"])
            held, ids, sizes, total = [], [], [], 0
            return out

        for batch in batches:
            texts, docs, first = batch.column("text"), batch.column("doc"), 0
            for i, text in enumerate(texts):
                n = 0
                for words in split_words(text.as_py()):
                    ids.append(np.fromiter(map(number, words, repeat(0)), np.int32, len(words)))
                    n += len(words)
                ids.append(np.zeros(1, np.int32))
                sizes.append(n + 1)
                total += n + 1
                if total >= SHARD_WORDS:
                    held.append(docs.slice(first, i + 1 - first))
                    first = i + 1
                    yield flush()
            if first < len(docs):
                held.append(docs.slice(first))
        if sizes:
            yield flush()
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", window: int = 13,
                       keep: list[str] | None = None) -> DataFrame:
    """Verbatim matches of at least ``window`` words between documents and benchmark items.

    Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. An
    item of fewer words than ``window``, but not none, matches as a whole.

    Returns ``doc`` (the input row as a struct, of the columns ``keep`` if given), ``n_words``, ``n_hit`` (words
    inside any match), ``items`` (ids of matching items as strings, distinct,
    sorted) and ``spans`` (longest matches: word place and length in the
    document, item, word place in the item).

    A null or empty text has no words and no match. A null item text is no item,
    a null item id is named ''; items that repeat an id count once in ``items``.
    Repeated rows are all returned. An empty benchmark matches nothing, an empty
    ``docs`` gives an empty result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > MAX_BENCHMARK_CHARS:
        raise ValueError(f"the benchmark has {chars} characters; more than {MAX_BENCHMARK_CHARS} are not broadcast: pass it in parts")
    shared = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in items.orderBy("id", "text").collect()], window))
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), F.col(text).alias("text"))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                                     T.StructField("item_id", T.StringType()), T.StructField("item_start", T.LongType())]))
    schema = T.StructType([rows.schema["doc"], T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
                           T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span)])
    return rows.mapInArrow(_matcher(shared, window), schema)


def contaminated(n_words: str = "n_words", n_hit: str = "n_hit"):
    """At least a twentieth of the words are inside a match."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
