"""SimHash near-dedup (operator 7): pivot distance tables.

A document's fingerprint has bit i set if over half of its shingle hashes have
it. Fingerprints at most ``max_bits`` apart are linked, links are transitive.

Candidates come from Hamming distances to reference fingerprints (pivots). The
distance to a pivot p and to p with one block of bits flipped differ by
2 * |mismatches in the block| - |block|, so each pair of pivots that differ in
a block gives one coordinate: the block's own distance to p. The 64 bits are cut
into blocks; two fingerprints at most ``max_bits`` apart agree in all but
``max_bits`` blocks, so on those blocks all their coordinates are equal (largest
coordinate difference 0). Rows meet if that holds for one choice of blocks. With
more fingerprints the bits are cut into more blocks, which keeps the number of
strangers that meet small. Pairs that meet are discarded if any of their
distances to the pivots differs by more than ``max_bits`` (triangle inequality),
and the rest are verified bit by bit. Every step is exact: no link is lost.

Documents are first collapsed to distinct fingerprints, and a task hands on one
star per component of the links it found, so groups of copies cost no pairs.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, bounded_batches, cut, shuffle_parts
from .components import connected_components, roots

#: Random reference fingerprints; each also stands with every block flipped.
PIVOTS = np.random.default_rng(20240611).integers(0, 2**64, 12, dtype=np.uint64)
#: Fingerprints that may share a key before it is refined.
HOT_KEY = 4096
_CHUNK = 1 << 20  # shingle hashes or pairs handled at once


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, lowest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int32)
    return total


_WEIGHTS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: str | None, shingle: int) -> int:
    """Fingerprint of a whole text; 0 if it has no words."""
    from xxhash import xxh64_intdigest
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh64_intdigest(b" ".join(words), 42)
    total, n = np.zeros(64, np.int64), len(words) - shingle + 1
    for at in range(0, n, _CHUNK):
        part = words[at:at + _CHUNK + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)))
        total += _bit_counts(np.fromiter((xxh64_intdigest(b" ".join(g), 42) for g in grams), np.uint64))
    return int(_WEIGHTS[2 * total > n].sum())


def _fingerprints(shingle: int):
    def run(texts: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))
    return run


def _blocks(n: int) -> list[np.uint64]:
    """Masks that cut 64 bits into ``n`` runs of near-equal length."""
    at = [64 * k // n for k in range(n + 1)]
    return [np.uint64(((1 << b) - 1) ^ ((1 << a) - 1)) for a, b in itertools.pairwise(at)]


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each pivot."""
    return np.bitwise_count(prints[:, None] ^ PIVOTS[None, :]).astype(np.int16)


def block_coordinates(prints: np.ndarray, table: np.ndarray, mask: np.uint64) -> np.ndarray:
    """Per pivot the mismatches within a block, from the distances to the pivot and to its flipped twin."""
    flipped = np.bitwise_count(prints[:, None] ^ (PIVOTS ^ mask)[None, :]).astype(np.int16)
    return (table - flipped + int(np.bitwise_count(mask))) // 2


def _keys(n_blocks: int, max_bits: int):
    """(print, key) rows: one per choice of blocks that must agree; key mixes their coordinates.

    Rows that already have a key keep to it: the new key refines the old one.
    """
    masks = _blocks(n_blocks)
    groups = list(itertools.combinations(range(n_blocks), n_blocks - max_bits))

    def run(batches):
        for batch in batches:
            prints = batch.column("print").to_numpy().view(np.uint64)
            within = batch.column("key").to_numpy().view(np.uint64) if "key" in batch.schema.names else np.uint64(0)
            table = pivot_table(prints)
            packed = []
            for mask in masks:
                base = np.uint64(int(np.bitwise_count(mask)) + 1)
                key = np.zeros(len(prints), np.uint64)
                for column in block_coordinates(prints, table, mask).T:
                    key = key * base + column.astype(np.uint64)
                packed.append(key)
            for g, chosen in enumerate(groups):
                key = np.full(len(prints), g, np.uint64) + within
                for b in chosen:
                    key = (key ^ packed[b]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(key.view(np.int64))], names=["print", "key"])
    return run


def near_pairs(prints: np.ndarray, keys: np.ndarray, max_bits: int):
    """Pairs of fingerprints with equal keys at most ``max_bits`` apart, as chunks of two arrays.

    Rows are sorted by key and first pivot distance; a row meets those after it
    while key and distance allow, so the table's first coordinate bounds the
    sweep and the others discard what it lets through.
    """
    table = pivot_table(prints)
    order = np.lexsort((prints, table[:, 0], keys))
    prints, keys, table = prints[order], keys[order], table[order]
    at, step = np.arange(max(0, len(prints) - 1)), 1
    while len(at):
        at = at[at + step < len(prints)]
        at = at[(keys[at] == keys[at + step]) & (table[at + step, 0] - table[at, 0] <= max_bits)]
        for k in range(0, len(at), _CHUNK):
            one = at[k:k + _CHUNK]
            two = one + step
            close = (np.abs(table[one] - table[two]) <= max_bits).all(axis=1)
            one, two = one[close], two[close]
            close = np.bitwise_count(prints[one] ^ prints[two]) <= max_bits
            if close.any():
                yield prints[one[close]], prints[two[close]]
        step += 1


def _links(max_bits: int):
    """Sorted (print, key) rows of whole keys -> one star per component of the links among them."""
    def flush(prints, keys):
        star = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for one, two in near_pairs(prints, keys, max_bits):
            nodes, root = roots(np.concatenate([star[0], one]), np.concatenate([star[1], two]))
            star = nodes[nodes != root], root[nodes != root]
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in star], names=["u", "v"])

    def run(batches):
        prints, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for batch in batches:
            prints.append(batch.column("print").to_numpy().view(np.uint64))
            keys.append(batch.column("key").to_numpy())
            if sum(map(len, keys)) >= _CHUNK:
                p, k = np.concatenate(prints), np.concatenate(keys)
                whole = int(np.searchsorted(k, k[-1]))  # the last key may go on in the next batch
                yield flush(p[:whole], k[:whole])
                prints, keys = [p[whole:]], [k[whole:]]
        yield flush(np.concatenate(prints), np.concatenate(keys))
    return run


def fingerprint_documents(docs: DataFrame, text: str = "text", shingle: int = 3) -> DataFrame:
    """``doc`` (the input row as a struct) and ``print`` (64 bits as a long)."""
    bounded_batches(docs.sparkSession)
    finger = F.arrow_udf(_fingerprints(shingle), "long")
    return docs.select(F.struct("*").alias("doc")).select("doc", finger(F.col("doc").getField(text)).alias("print"))


def near_duplicates(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(print, root) of the distinct fingerprints linked to another, save each component's root itself."""
    spark = prints.sparkSession
    distinct = cut(prints.select("print").distinct(), "prints")
    n = distinct.count()
    # Smallest cut at which random strangers seldom meet: agreeing bits >= log2(n) - 3.
    n_blocks = next((b for b in range(max_bits + 1, 3 * max_bits + 8)
                     if math.floor(64 / b) * (b - max_bits) >= math.log2(max(n, 2)) - 3), 3 * max_bits + 8)
    keyed = cut(distinct.mapInArrow(_keys(n_blocks, max_bits), "print long, key long"), "keyed")
    # A key that very many fingerprints share (a cluster of near copies) is cut finer, which is exact too.
    hot = keyed.groupBy("key").count().where(F.col("count") > HOT_KEY).select("key")
    finer = (keyed.join(hot, "key", "left_semi").select("print", "key")
             .mapInArrow(_keys(4 * max_bits, max_bits), "print long, key long"))
    met = keyed.join(hot, "key", "left_anti").select("print", "key").unionByName(finer)
    links = (met.repartition(2 * shuffle_parts(spark), "key").sortWithinPartitions("key")
             .mapInArrow(_links(max_bits), "u long, v long"))
    links = cut(links, "links")  # so that no task holds two Python workers, which stay with the executor
    return connected_components(links).select(F.col("node").alias("print"), F.col("component").alias("root"))


def simhash_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3,
                  max_bits: int = 3) -> DataFrame:
    """(doc_id, text_hash, print, component_id) per input row.

    Words are runs of anything but ASCII white space, A-Z lower-cased; a text
    of fewer words than ``shingle`` is one shingle; null, empty or blank texts
    have fingerprint 0 and are linked like any other. ``component_id`` is the
    smallest doc_id reachable over links (null only if no row reached has an
    id). Rows that repeat an id or a text all appear. An empty table gives an
    empty result. ``text_hash`` tells rows of equal doc_id apart.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = (fingerprint_documents(own, "text", shingle)
            .select("doc.doc_id", F.xxhash64(F.coalesce("doc.text", F.lit(""))).alias("text_hash"), "print"))
    rows = cut(rows, "fingerprints")
    groups = near_duplicates(rows, max_bits)
    least = rows.groupBy("print").agg(F.min("doc_id").alias("least"))
    least = least.join(groups, "print", "left").withColumn("root", F.coalesce("root", "print"))
    whole = least.groupBy("root").agg(F.min("least").alias("component_id"))
    named = least.join(whole, "root").select("print", "component_id")
    return rows.join(named, "print").select("doc_id", "text_hash", "print", "component_id")


def print_hex(col) -> F.Column:
    return F.lpad(F.lower(F.hex(col)), 16, "0")
