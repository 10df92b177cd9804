import random

import numpy as np

from tablelens.llm import decontaminate
from tablelens.llm.decontaminate import find_contamination, search, suffix_array

WORD = set("0123456789abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in WORD or ord(c) > 127:
            word += c
        elif word:
            out, word = [*out, word], ""
    return out


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        own = words_of(text)
        hit, found = set(), set()
        for item_id, item in items:
            w = words_of(item)
            n = min(window, len(w))
            grams = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()
            for i in range(len(own) - n + 1 if grams else 0):
                if tuple(own[i:i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(own), len(hit), sorted(found)))
    return sorted(out, key=repr)


def run(docs, bench, **kw):
    return sorted(((r.doc.doc_id, r.n_words, r.n_hit, r["items"]) for r in find_contamination(docs, bench, **kw).collect()), key=repr)


def tables(rng):
    vocabulary = [f"w{i}" for i in range(12)] + ["Été", "x9", "a", "B"]
    text = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ",\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 12, 13, 14, 30, 60]))) for i in range(25)]
    items += [(100, "Long " * 30), (None, text(20)), (101, None), (102, "..."), (5, items[7][1]), (6, items[6][1])]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            w = words_of(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a:a + rng.randrange(1, 40)]).upper(), text(rng.randrange(20))]
        rng.shuffle(parts)
        docs.append((i, " ".join(parts)))
    docs += [(None, None), (500, ""), (501, "-- !"), (502, "long " * 40_000), (3, docs[3][1]), (None, docs[4][1])]
    return docs, items


def test_against_brute_force(frame, monkeypatch):
    docs, items = tables(random.Random(6))
    d, b = frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")
    want = {w: brute(docs, items, w) for w in (13, 4)}
    for shard, chunk in ((1 << 20, 8 << 20), (100, 50)):  # shards and pieces of texts as small as they get
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
        monkeypatch.setattr(decontaminate, "_CHUNK_BYTES", chunk)
        for w in (13, 4):
            assert run(d, b, window=w) == want[w]


def test_spans_are_verbatim(frame):
    docs, items = tables(random.Random(7))
    texts = {}
    for i, t in items:
        texts.setdefault("" if i is None else str(i), []).append(words_of(t))
    spans = 0
    for r in find_contamination(frame(docs, "doc_id long, text string"), frame(items, "item_id long, text string")).collect():
        own = words_of(r.doc.text)
        cover = set()
        for s in r.spans:
            assert own[s.start:s.start + s.length] in [w[s.item_start:s.item_start + s.length] for w in texts[s.item_id]]
            cover.update(range(s.start, s.start + s.length))
            spans += 1
        assert len(cover) == r.n_hit
    assert spans > 50


def test_suffix_array_and_search():
    rng = np.random.default_rng(0)
    for n, depth in ((1, 3), (50, 4), (400, 16)):
        text = rng.integers(0, 4, n)
        order = suffix_array(text, depth)
        heads = [tuple(text[i:i + depth]) for i in order]
        assert sorted(order) == list(range(n)) and heads == sorted(heads)
        words = rng.integers(0, 4, 60)
        starts, lengths = np.arange(50), rng.integers(1, min(depth, 9) + 1, 50)
        low, high = search(text, order, words, starts, lengths)
        for s, k, a, b in zip(starts, lengths, low, high):
            want = {i for i in range(n) if i + k <= n and (text[i:i + k] == words[s:s + k]).all()}
            assert set(order[a:b]) == want


def test_empty_tables_names_and_limits(spark, frame, monkeypatch):
    docs = frame([(1, "a b c", 9, "i")], "doc_id long, text string, n_words int, items string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert run(docs, none) == [(1, 3, 0, [])]
    bench = frame([(1, "a b")], "item_id long, text string")
    assert find_contamination(spark.createDataFrame([], "doc_id long, text string"), bench).collect() == []
    assert [(r.doc.n_words, r.n_words, r.n_hit) for r in find_contamination(docs, bench).collect()] == [(9, 3, 2)]
    monkeypatch.setattr(decontaminate, "MAX_BENCHMARK_CHARS", 2)
    try:
        find_contamination(docs, bench)
        raise AssertionError("a too large benchmark must be refused")
    except ValueError:
        pass
