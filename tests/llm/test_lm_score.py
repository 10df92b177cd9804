import math
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tablelens.llm import lm_score
from tablelens.llm.ctw import Crown, Lookup, Subtrees, grams_of, kt
from tablelens.llm.lm_score import score_documents, text_words


def slow_kt(a, b):
    p = Fraction(1)
    for i in range(a):
        p *= Fraction(2 * i + 1, 2 * (i + 1))
    for j in range(b):
        p *= Fraction(2 * j + 1, 2 * (a + j + 1))
    return p


class SlowTree:
    """Context trees written out as recursions over dictionaries."""

    def __init__(self, bodies, depth):
        self.depth, self.counts = depth, Counter()
        for body in bodies:
            data = b"\n" * depth + body
            for i in range(depth, len(data)):
                for d in range(depth + 1):
                    context = data[i - d:i]
                    for bit in range(8):
                        node = (1 << bit) + (data[i] >> (8 - bit))
                        self.counts[context, node, (data[i] >> (7 - bit)) & 1] += 1
        self.children = {}
        for context, node, _ in self.counts:
            if context:
                self.children.setdefault((context[1:], node), set()).add(context)
        self.memory = {}

    def weighted(self, context, node):
        key = context, node
        if key not in self.memory:
            pe = slow_kt(self.counts[context, node, 0], self.counts[context, node, 1])
            if len(context) == self.depth:
                self.memory[key] = pe
            else:
                product = Fraction(1)
                for child in self.children.get(key, ()):
                    product *= self.weighted(child, node)
                self.memory[key] = pe / 2 + product / 2
        return self.memory[key]

    def log10(self, body):
        data, total = b"\n" * self.depth + body, 0.0
        for i in range(self.depth, len(data)):
            for bit in range(8):
                node, left, p = (1 << bit) + (data[i] >> (8 - bit)), Fraction(1), Fraction(0)
                for d in range(self.depth + 1):
                    context = data[i - d:i]
                    a, b = self.counts[context, node, 0], self.counts[context, node, 1]
                    stop = Fraction(1) if d == self.depth else slow_kt(a, b) / 2 / self.weighted(context, node)
                    p += left * stop * Fraction(2 * b + 1, 2 * (a + b + 1))
                    left *= 1 - stop
                total += math.log10(p if (data[i] >> (7 - bit)) & 1 else 1 - p)
        return total


def body(text):
    return b" ".join(text_words(text)) + b"\n"


def brute(rows, depth, folds=10):
    out = [zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0 for i, _ in rows]
    learn = [t for (_, t), o in zip(rows, out) if not o]
    counts = Counter(w for t in learn for w in [*text_words(t), None])
    n, v = sum(counts.values()), len(counts)
    tree = SlowTree([body(t) for t in learn], depth)
    result = []
    for (i, t), o in zip(rows, out):
        tokens = [*text_words(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        result.append((i, o, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, tree.log10(body(t))))
    return sorted(result, key=repr)


def run(df, **kw):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_documents(df, **kw).collect()), key=repr)


def agree(got, want):
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def corpus(rng, n=40):
    words = ["the", "cat", "Sat", "on", "mat", "é", "x1", "a"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(12)))) for i in range(n)]
    return rows + [(None, None), (900, ""), (901, " \t\n"), (3, rows[3][1]), (902, "never seen zzz"), (903, "\x1cq\x85 日")]


@pytest.mark.parametrize("hot", [1 << 18, 3, 0])
def test_against_recursions(frame, monkeypatch, hot):
    rows = corpus(random.Random(2))
    monkeypatch.setattr(lm_score, "HOT_WORDS", hot)
    monkeypatch.setattr(lm_score, "HOT_GRAMS", hot)
    agree(run(frame(rows, "doc_id long, text string"), depth=2), brute(rows, 2))


def test_other_depths(frame):
    rows = corpus(random.Random(5), 15)
    for depth in (1, 4):
        agree(run(frame(rows, "doc_id long, text string"), depth=depth), brute(rows, depth))


def test_small_buffers(frame, monkeypatch):
    rows = corpus(random.Random(3))
    for name, value in (("_FLUSH_WORDS", 3), ("_FLUSH_GRAMS", 20), ("_CHUNK", 7)):
        monkeypatch.setattr(lm_score, name, value)
    agree(run(frame(rows, "doc_id long, text string"), depth=3), brute(rows, 3))


@pytest.mark.parametrize("top", [1, 2])
def test_probabilities_add_to_one(top):
    rng = np.random.default_rng(1)
    depth, text = 3, bytes(rng.choice(list(b"abc \n"), 300).tolist())
    grams, n = np.unique(grams_of(text, depth), return_counts=True)
    context = int(grams[len(grams) // 2]) >> 8
    every = (context << 8) + np.arange(256)
    both = np.unique(np.concatenate([grams, every]))
    counts = np.zeros(len(both), np.int64)
    counts[np.searchsorted(both, grams)] = n
    nearest = both >> (8 * (depth + 1 - top))
    trees = [Subtrees(both[nearest == c], counts[nearest == c], depth, top) for c in np.unique(nearest)]
    rows = [np.concatenate(x) for x in zip(*(t.parts() for t in trees))]
    where, at = np.unique(rows[0] * 256 + rows[1], return_inverse=True)
    crown = Crown(top, where >> 8, where & 255, *(np.bincount(at, rows[k]) for k in (2, 3, 4)))
    mine = nearest == context >> (8 * (depth - top))
    p = 10 ** Subtrees(both[mine], counts[mine], depth, top).log10(crown)
    assert p[np.searchsorted(both[mine], every)].sum() == pytest.approx(1.0)


def test_kt_over_small_and_large_counts():
    for a, b in ((0, 0), (1, 0), (3, 5), (60, 2), (4095, 4096), (5000, 9000)):
        want = math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)
        assert kt(np.array([a]), np.array([b]))[0] == pytest.approx(want, abs=1e-6)


def test_lookup():
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys = rng.choice(10**12, n, replace=False)
        table = Lookup(keys)
        assert (table.find(keys) == np.arange(n)).all()
        assert (table.find(keys + 10**13) == -1).all()


def test_model_beats_the_base_on_held_out_texts(spark):
    out = [r for r in score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")).collect()]
    held = [r for r in out if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(0 < r.bits_per_byte < 8 for r in held)


def test_empty_tables_and_extra_columns(spark, frame):
    assert score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    agree(run(frame([(alone, "a b", 3, "x")], "doc_id long, text string, gram int, word string"), depth=2), brute([(alone, "a b")], 2))
