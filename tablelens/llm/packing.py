"""Packing (operator 2): order-preserving dynamic programming.

Documents stay in doc_id order and their ids form one stream per block of
documents. The program chooses where to cut it into sequences of at most
``window`` ids. It may cut at document ends (free), at sentence ends
(``sentence_penalty``) and, in a stretch without either, at fixed distances
(``word_penalty``); a sequence costs its padding to the window, or none if its
length is a power of two, plus ``sequence_cost`` so that many small sequences
don't pay. With f(i) the least cost up to cut i at place p(i),

    f(j) = penalty(j) + sequence_cost + min(window - p(j) + min_i (f(i) + p(i)),  min_k f(at p(j) - 2^k))

where i runs over the cuts at most ``window`` before j: a sliding minimum that a
monotone queue keeps, so the whole takes time linear in the number of cuts.

A range partition by doc_id gives each task a run of documents; it handles them
in blocks of bounded size, whatever the table's size.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, shuffle_parts
from .tokens import default_vocabulary, encoder

#: Ids in a block: a document that reaches this many ends the block.
BLOCK_IDS = 1 << 21
_PIECE = ["start", "length", "doc_tokens", "sequence_id", "offset", "ids"]


def cut_places(stream: np.ndarray, ends: np.ndarray, sentence_end: np.ndarray, window: int, gap: int,
               sentence_penalty: float, word_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, ascending, and what a cut there costs.

    ``ends``: where documents end. Of the sentence ends within ``gap`` ids the
    last is kept. No two places are more than ``window`` // 4 apart.
    """
    places = np.flatnonzero(sentence_end[stream]) + 1
    last = np.append(places[:-1] // gap != places[1:] // gap, True) if len(places) else np.zeros(0, bool)
    places = np.union1d(places[last], ends)
    before = np.concatenate([[0], places[:-1]])
    step = max(1, window // 4)
    more = (places - before - 1) // step
    if more.any():
        long = np.flatnonzero(more)
        nth = np.arange(more.sum()) - np.repeat(np.cumsum(more[long]) - more[long], more[long])
        forced = np.repeat(before[long], more[long]) + step * (nth + 1)
        places, kind = np.concatenate([places, forced]), np.concatenate([np.full(len(places), sentence_penalty), np.full(len(forced), word_penalty)])
        order = np.argsort(places, kind="stable")
        places, cost = places[order], kind[order]
    else:
        cost = np.full(len(places), float(sentence_penalty))
    cost[np.searchsorted(places, ends)] = 0.0
    return places, cost


def best_cuts(places: list[int], cost: list[float], window: int, sequence_cost: float) -> list[int]:
    """Ends of the cheapest sequences that cover 0..places[-1]; ties go to the longer sequence."""
    powers = [1 << k for k in range(window.bit_length()) if 1 << k <= window]
    value, back = {0: 0.0}, {}
    queue = deque([(0.0, 0)])  # (f(i) + p(i), p(i)): values ascend, places ascend
    for p, penalty in zip(places, cost):
        while queue[0][1] < p - window:
            queue.popleft()
        least, start = queue[0]
        least += window - p
        for k in powers:
            if (v := value.get(p - k)) is not None and v < least:
                least, start = v, p - k
        f = least + penalty + sequence_cost
        value[p], back[p] = f, start
        key = f + p
        while queue and queue[-1][0] > key:
            queue.pop()
        queue.append((key, p))
    out, p = [], places[-1] if places else 0
    while p:
        out.append(p)
        p = back[p]
    return out[::-1]


def pack_block(docs: list[bytes], sentence_end: np.ndarray, window: int, gap: int, sentence_penalty: float,
               word_penalty: float, sequence_cost: float) -> list[tuple[int, int, int, int, int, int, bytes]]:
    """(document's place in the block, *_PIECE) rows; sequence_id counts from 0 in the block."""
    data = b"".join(docs)
    ends = np.cumsum([len(d) // 4 for d in docs])
    places, cost = cut_places(np.frombuffer(data, "<u4"), ends, sentence_end, window, gap, sentence_penalty, word_penalty)
    cuts = np.asarray(best_cuts(places.tolist(), cost.tolist(), window, sequence_cost))
    bounds = np.union1d(ends, cuts)
    starts = np.concatenate([[0], bounds[:-1]])
    doc = np.searchsorted(ends, starts, "right")
    seq = np.searchsorted(cuts, starts, "right")
    doc_start = np.concatenate([[0], ends[:-1]])[doc]
    seq_start = np.concatenate([[0], cuts[:-1]])[seq]
    rows = zip(doc.tolist(), (starts - doc_start).tolist(), (bounds - starts).tolist(), (ends[doc] - doc_start).tolist(),
               seq.tolist(), (starts - seq_start).tolist(), starts.tolist(), bounds.tolist())
    return [(d, s, n, total, q, o, data[4 * a:4 * b]) for d, s, n, total, q, o, a, b in rows]


def _packer(vocabulary: str, added_tokens: bool, end_id: int, window: int, settings: dict):
    def run(batches):
        encode = encoder(vocabulary, added_tokens)
        size = encode.tokenizer.get_vocab_size(with_added_tokens=True)
        sentence_end = np.zeros(max(size, end_id + 1), bool)
        for token, i in encode.tokenizer.get_vocab(with_added_tokens=True).items():
            sentence_end[i] = token[-1:] in ".!?" or token.endswith("Ċ")  # the letter that stands for a line break
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 32
        held, ids, size = [], [], 0

        def flush():
            nonlocal held, ids, size, sequence
            rows = pack_block(ids, sentence_end, window, **settings)
            doc_rows = pa.concat_arrays(held).take(pa.array([r[0] for r in rows], pa.int64()))
            cols = [pa.array([r[k + 1] for r in rows], pa.binary() if name == "ids" else pa.int64()) for k, name in enumerate(_PIECE)]
            at = _PIECE.index("sequence_id")
            cols[at] = pa.array(cols[at].to_numpy() + sequence)
            sequence = cols[at][-1].as_py() + 1
            held, ids, size = [], [], 0
            return pa.RecordBatch.from_arrays([doc_rows, *cols], names=["doc", *_PIECE])

        for batch in batches:
            texts, docs, first = batch.column("text"), batch.column("doc"), 0
            for i, text in enumerate(texts):
                ids.append(encode.ids(text.as_py() or "") + end)
                size += len(ids[-1]) // 4
                if size >= BLOCK_IDS:
                    held.append(docs.slice(first, i + 1 - first))
                    first = i + 1
                    yield flush()
            if first < len(docs):
                held.append(docs.slice(first))
        if ids:
            yield flush()
    return run


def pack_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", window: int = 2048, end_id: int = 1,
                   vocabulary: str | None = None, gap: int = 48, sentence_penalty: float = 24.0,
                   word_penalty: float = 200.0, sequence_cost: float = 4.0, added_tokens: bool = False) -> DataFrame:
    """Cut all documents, in doc_id order, into sequences of at most ``window`` ids with little padding.

    Returns one row per piece: ``doc`` (the input row without its text, as a
    struct), ``start`` (ids of its document before it), ``length``,
    ``doc_tokens`` (ids of its document with the end id), ``sequence_id``,
    ``offset`` (its first place in the sequence; the pieces of a sequence follow
    each other without gaps), ``ids`` (little-endian unsigned 32-bit).

    A null or empty text is its end id alone. Rows that repeat a doc_id are
    documents of their own, ordered by text hash; null ids come first. A
    document longer than a window goes through several sequences. An empty table
    gives an empty result. ``added_tokens``: see :class:`.tokens.Encoder`.
    """
    bounded_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c != text]
    content = F.col(text)
    rows = (docs.select(F.struct(*kept).alias("doc"), content.alias("text"))
            .withColumn("tie", F.xxhash64("text"))
            .repartitionByRange(shuffle_parts(docs.sparkSession), F.col("doc").getField(doc_id), "tie")
            .sortWithinPartitions(F.col("doc").getField(doc_id), "tie")
            .select("doc", "text"))
    settings = {"gap": gap, "sentence_penalty": sentence_penalty, "word_penalty": word_penalty, "sequence_cost": sequence_cost}
    schema = T.StructType([rows.schema["doc"], *[T.StructField(c, T.BinaryType() if c == "ids" else T.LongType()) for c in _PIECE]])
    return rows.mapInArrow(_packer(vocabulary or default_vocabulary(), added_tokens, end_id, window, settings), schema)
