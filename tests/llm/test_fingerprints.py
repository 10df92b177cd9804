import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import fingerprints as fp
from tablelens.llm.fingerprints import compare_fingerprints, differences, digests, edited_likeness, fingerprint_texts, likeness

SCHEMA = "doc_id long, text string"
MASK = 0xFFFFFFFF


def slow_digest(text):
    data = text.encode("utf-8", "surrogatepass")
    counts = [0] * fp.BUCKETS
    for at in range(len(data)):
        for kind, (i, j) in enumerate([(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]):
            if at + j < len(data):
                h = data[at] | data[at + i] << 8 | data[at + j] << 16 | (kind + 1) << 24
                h = (h ^ h >> 15) * 0x85EBCA6B & MASK
                h = (h ^ h >> 13) * 0xC2B2AE35 & MASK
                counts[(h >> 16) % fp.BUCKETS] += 1
    ranked, n = sorted(counts), fp.BUCKETS
    codes = [sum(c > ranked[k * n // 4 - 1] for k in (1, 2, 3)) for c in counts]
    body = bytes(codes[k] | codes[k + 1] << 2 | codes[k + 2] << 4 | codes[k + 3] << 6 for k in range(0, n, 4))
    length = min(255, int(np.ceil(8 * np.log2(len(data) + 1))))
    return f"{zlib.crc32(data) & 255:02x}{length:02x}{body.hex()}"


def slow_likeness(one, two):
    if not int(one[4:], 16) or not int(two[4:], 16):
        return float(one == two)
    a, b = bytes.fromhex(one), bytes.fromhex(two)
    total = int(a[0] != b[0]) + 4 * max(0, min(abs(a[1] - b[1]), 16) - 1)
    for x, y in zip(a[2:], b[2:]):
        for shift in (0, 2, 4, 6):
            total += [0, 1, 2, 6][abs((x >> shift & 3) - (y >> shift & 3))]
    return 1 - min(total, 208) / 208


def slow_rows(rows):
    """The contract by the letter, from one sorted list."""
    ordered = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    out = []
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        n = len(text) // 3
        edited = text[:len(text) - n] + after[:n]
        own, other, changed = slow_digest(text), slow_digest(after), slow_digest(edited)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, changed, slow_likeness(own, changed), slow_likeness(own, other)))
    return sorted(out, key=repr)


def sample_rows(rng):
    words = [f"w{i}" for i in range(50)] + ["É", "ß", "日本", "😀", "\n", ""]
    rows = [(rng.randrange(-10, 10**6), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 60, 400])))) for _ in range(90)]
    rows = list(dict(rows).items())
    return rows + [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, "a"), (2 * 10**6 + 3, "ab"), (2 * 10**6 + 4, "abc"), (-99, "x" * 40_000), (None, "no id")]


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_against_brute_force(frame, spark, monkeypatch, parts):
    rows = sample_rows(random.Random(parts))
    monkeypatch.setattr(fp, "shuffle_parts", lambda s: parts)
    got = sorted(map(tuple, edited_likeness(frame(rows, SCHEMA)).collect()), key=repr)
    want = slow_rows(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_slices_and_groups_of_texts(monkeypatch):
    rng = random.Random(2)
    texts = ["", "ab", "word " * 3000, *("".join(rng.choice("abcdé ") for _ in range(rng.randrange(900))) for _ in range(40))]
    whole = digests(texts)
    for size in (7, 64, 1000):
        monkeypatch.setattr(fp, "_SLICE", size)
        assert digests(texts) == whole
    assert whole == [slow_digest(t) for t in texts]


def test_scores_are_bounded_and_symmetric():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(3, 2000))) for _ in range(30)]
    prints = digests(texts)
    for a in prints:
        scores = likeness([a] * 30, prints)
        assert ((scores >= 0) & (scores <= 1)).all() and np.allclose(scores, likeness(prints, [a] * 30))
        assert differences([a], [a])[0] == 0 and scores.max() == 1


def test_edited_texts_are_nearer_than_the_next(spark):
    out = edited_likeness(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    row = out.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("nearer"), F.avg((F.col("near_edited") >= 0.53).cast("int")).alias("kept"),
                  F.avg((F.col("near_next") < 0.53).cast("int")).alias("apart"), F.count("*").alias("n")).first()
    assert row["n"] == 1000 and row["nearer"] > 0.99 and row["kept"] > 0.9 and row["apart"] > 0.85


def test_repeated_rows_ties_and_empty_table(spark, frame):
    assert edited_likeness(spark.createDataFrame([], SCHEMA)).collect() == []
    one = edited_likeness(frame([(5, "only one here")], SCHEMA)).first()
    assert one.near_next == 1.0 and one.doc_id == 5
    rows = [(1, "same text here"), (1, "same text here"), (1, "another text"), (None, None), (None, None)]
    got = edited_likeness(frame([(i, t, "f", 3) for i, t in rows], "doc_id long, text string, fingerprint string, part int")).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == sorted((i is None, len(t or "")) for i, t in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 14}) == 1


def test_columns_of_fingerprints(frame):
    docs = frame([(1, "some words of text"), (2, None)], SCHEMA)
    prints = fingerprint_texts(docs).select("doc.doc_id", "fingerprint", compare_fingerprints(F.col("fingerprint"), F.col("fingerprint")).alias("own"),
                                            compare_fingerprints(F.col("fingerprint"), F.lit(None).cast("string")).alias("none"))
    got = {r.doc_id: r for r in prints.collect()}
    assert got[1].fingerprint == slow_digest("some words of text") and got[2].fingerprint == slow_digest("")
    assert got[1].own == got[2].own == 1.0 and got[1].none is None
