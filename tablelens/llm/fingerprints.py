"""Document fingerprints (operator 12): quartile bucket digests.

Six kinds of byte triplets within five neighbouring bytes are hashed into
``BUCKETS`` buckets over the whole text. A bucket's code says in which quarter of
all buckets its count lies (0 to 3: how many of the three quartiles it
exceeds). The digest, in hex: a checksum byte, a byte for the logarithm of the
length, and two bits a bucket. Counts add up, so texts of any length are taken
in slices.

The difference of two digests adds up the distances of their codes (opposite
quarters count double) and a share for different lengths; it is bounded by what
texts that have nothing in common come to. ``likeness`` is 1 at no difference and
0 at the bound.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fit import collect_bounded
from .common import bounded_batches, cut, shuffle_parts

BUCKETS = 128
#: Places of a triplet's second and third byte after its first.
TRIPLETS = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
#: Difference per bucket of codes that have nothing in common (the mean over all 16 pairs).
UNRELATED = 1.625
#: Steps of the length code that count at most, and what a step counts in buckets.
LENGTH_STEPS, STEP = 16, 4
_SLICE = 1 << 19
_CODE_DISTANCE = np.array([0, 1, 2, 6], np.int64)


def _add_counts(counts: np.ndarray, data: np.ndarray, owner: np.ndarray, left: np.ndarray, starts: int | None = None) -> None:
    """Count the triplets that begin at the first ``starts`` bytes; ``left``: bytes of the text after each."""
    n = len(data) if starts is None else starts
    wide = data.astype(np.uint32)
    for kind, (i, j) in enumerate(TRIPLETS):
        m = min(n, len(data) - j)
        if m <= 0:
            continue
        h = wide[:m] | wide[i:i + m] << np.uint32(8) | wide[j:j + m] << np.uint32(16) | np.uint32((kind + 1) << 24)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        at = owner[:m] * BUCKETS + (h >> np.uint32(16)) % np.uint32(BUCKETS)
        counts += np.bincount(at[left[:m] >= j], minlength=len(counts))


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Counts per text and bucket."""
    out, at = np.zeros((len(texts), BUCKETS), np.int64), 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (size + len(texts[end]) <= _SLICE or end == at):
            size, end = size + len(texts[end]), end + 1
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        flat = np.zeros((end - at) * BUCKETS, np.int64)
        if end == at + 1:  # perhaps a very long text: slices that overlap by four bytes
            for a in range(0, len(data), _SLICE):
                part = data[a:a + _SLICE + 4]
                left = len(data) - 1 - a - np.arange(len(part))
                _add_counts(flat, part, np.zeros(len(part), np.int64), left, min(_SLICE, len(part)))
        else:
            sizes = np.fromiter(map(len, texts[at:end]), np.int64, end - at)
            owner = np.repeat(np.arange(end - at), sizes)
            left = np.cumsum(sizes)[owner] - 1 - np.arange(len(data))
            _add_counts(flat, data, owner, left)
        out[at:end], at = flat.reshape(-1, BUCKETS), end
    return out


def digests(texts: list[str]) -> list[str]:
    """The fingerprints of whole texts; equal texts have equal ones."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    counts = bucket_counts(data)
    ranked = np.sort(counts, axis=1)
    codes = np.zeros(counts.shape, np.uint8)
    for k in (1, 2, 3):
        codes += counts > ranked[:, [k * BUCKETS // 4 - 1]]
    packed = (codes[:, 0::4] | codes[:, 1::4] << 2 | codes[:, 2::4] << 4 | codes[:, 3::4] << 6).astype(np.uint8)
    lengths = np.fromiter(map(len, data), np.float64, len(data))
    length_codes = np.minimum(255, np.ceil(8 * np.log2(lengths + 1))).astype(np.uint8)
    return [f"{zlib.crc32(d) & 255:02x}{n:02x}{row.tobytes().hex()}" for d, n, row in zip(data, length_codes.tolist(), packed)]


def differences(one: list[str], two: list[str]) -> np.ndarray:
    """The bounded difference scores of digests, pair by pair: 0 to the bound."""
    a, b = (np.frombuffer(bytes.fromhex("".join(x)), np.uint8).reshape(len(x), -1) for x in (one, two))
    body = np.zeros(len(one), np.int64)
    for shift in (0, 2, 4, 6):
        apart = np.abs((a[:, 2:] >> shift & 3).astype(np.int64) - (b[:, 2:] >> shift & 3))
        body += _CODE_DISTANCE[apart].sum(axis=1)
    steps = np.minimum(np.abs(a[:, 1].astype(np.int64) - b[:, 1]), LENGTH_STEPS)
    total = body + STEP * np.maximum(steps - 1, 0) + (a[:, 0] != b[:, 0])
    return np.minimum(total, bound())


def bound() -> int:
    return int(UNRELATED * BUCKETS)


def likeness(one: list[str], two: list[str]) -> np.ndarray:
    """1 - difference / bound. Digests without any triplet (texts under three bytes) are alike if equal, else not at all."""
    if not one:
        return np.zeros(0)
    out = 1 - differences(one, two) / bound()
    bare = np.array([int(a[4:], 16) == 0 or int(b[4:], 16) == 0 for a, b in zip(one, two)])
    return np.where(bare, [float(a == b) for a, b in zip(one, two)], out)


def fingerprint_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc`` (the input row as a struct) and ``fingerprint`` of its whole text (null: empty)."""
    bounded_batches(docs.sparkSession)

    def run(texts: pa.Array) -> pa.Array:
        return pa.array(digests([t or "" for t in texts.to_pylist()]), pa.string())
    return docs.select(F.struct("*").alias("doc")).select("doc", F.arrow_udf(run, "string")(F.col("doc").getField(text)).alias("fingerprint"))


def compare_fingerprints(one: F.Column, two: F.Column) -> F.Column:
    """Likeness of two columns of fingerprints, 0 to 1; null where either is null."""
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        whole = [(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())]
        known = [k for k, (x, y) in enumerate(whole) if x is not None and y is not None]
        out = [None] * len(whole)
        for k, v in zip(known, likeness([whole[k][0] for k in known], [whole[k][1] for k in known]).tolist()):
            out[k] = v
        return pa.array(out, pa.float64())
    return F.arrow_udf(run, "double")(one, two)


def splice(text: str, other: str) -> str:
    """``text`` with its last third of code points replaced by the first as many (or all) of ``other``."""
    n = len(text) // 3
    return text[:len(text) - n] + other[:n]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_STAGE = f"part int, edge int, doc_id long, text string, {_RESULT}"
_FIRST, _LAST = 1, 2


def _compared(texts: list[str], prints: list[str], nexts: list[str], next_prints: list[str]) -> list[tuple]:
    edited = [splice(t, o) for t, o in zip(texts, nexts)]
    edited_prints = digests(edited)
    return list(zip(map(len, texts), (hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited), prints, edited_prints,
                    likeness(prints, edited_prints).tolist(), likeness(prints, next_prints).tolist()))


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _along(batches):
    """Sorted (doc_id, text) rows, each compared with the one after it; a partition's last row is left open.

    A partition's first and last rows keep their texts, for the rows beyond its edges.
    """
    part, open_row, first = TaskContext.get().partitionId(), None, True
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
        if not ids:
            continue
        prints = digests(texts)
        if open_row:
            ids, texts, prints = [open_row[0], *ids], [open_row[1], *texts], [open_row[2], *prints]
        done = _compared(texts[:-1], prints[:-1], texts[1:], prints[1:])
        rows = [(part, 0, i, None, *d) for i, d in zip(ids, done)]
        if rows and first:
            rows[0], first = (part, _FIRST, ids[0], texts[0], *done[0]), False
        open_row = ids[-1], texts[-1], prints[-1]
        yield _rows(_STAGE, rows)
    if open_row:
        yield _rows(_STAGE, [(part, _LAST + first * _FIRST, open_row[0], open_row[1], len(open_row[1]), None, open_row[2], None, None, None)])


def _across(batches):
    """Open rows joined with the row after them."""
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        done = _compared(c["text"], c["fingerprint"], c["next_text"], c["next_print"])
        yield _rows(f"doc_id long, {_RESULT}", [(i, *d) for i, d in zip(c["doc_id"], done)])


def edited_likeness(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprint every whole text, its edited text and the next document, and compare.

    The next document is the one of the next smaller ``doc_id`` (null last, ties
    by a hash of the text), after the last one the first; the edited text is
    :func:`splice` of both. Columns: doc_id, n_chars, edited_sha256 (of UTF-8),
    fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty; a lone row is its own next; rows repeated in full all appear; an
    empty table gives an empty result. ``doc_id`` must be an integer column.

    Texts are shuffled once, by ranges. What remains open at the edges of
    partitions are two texts a partition, in one small join.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    rows = rows.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    stage = cut(rows.mapInArrow(_along, _STAGE), "neighbours")
    closed = stage.where(F.col("edge").bitwiseAND(_LAST) == 0).select("doc_id", *(f.split()[0] for f in _RESULT.split(", ")))
    edges = stage.where("edge > 0")
    parts = sorted(r["part"] for r in collect_bounded(edges.select("part").distinct(), 1 << 20))
    if not parts:
        return closed
    after = spark.createDataFrame(list(zip(parts, [*parts[1:], parts[0]])), "part int, next_part int")
    firsts = (edges.where(F.col("edge").bitwiseAND(_FIRST) > 0)
              .select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print")))
    opened = (edges.where(F.col("edge").bitwiseAND(_LAST) > 0).join(F.broadcast(after), "part").join(firsts, "next_part")
              .select("doc_id", "text", "fingerprint", "next_text", "next_print"))
    return closed.unionByName(opened.mapInArrow(_across, f"doc_id long, {_RESULT}"))
