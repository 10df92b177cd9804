import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tablelens.llm import spelling
from tablelens.llm.common import cut
from tablelens.llm.spelling import group_variants, near_words, spelling_variants

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def slow_words(rows, every=199):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def slow_variants(words, factor=5):
    rows, forms = {}, {}
    for w, n in words.items():
        others = sorted((-words[o], o) for o in words if near(w, o))
        form = others[0][1] if others and -others[0][0] >= factor * n else None
        forms[w], rows[w] = form, (form, n, len(others))
    out = []
    for w, (form, n, n_near) in rows.items():
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, form, root, n, n_near, words[form] if form else None))
    return sorted(out)


def variants(rng, word, n):
    out = []
    for _ in range(n):
        at, kind = rng.randrange(len(word)), rng.random()
        letter = rng.choice("abcdeéñ÷")
        out.append(word[:at] + (letter if kind < .6 else "") + word[at + (kind > .3):])
    return out


def sample_words(rng):
    words = {}
    for k in range(60):
        base = "".join(rng.choice("abcdefgstuéü") for _ in range(rng.choice([6, 7, 9, 14, 40])))
        n = 5 ** rng.randrange(1, 7)
        words[base] = n
        for v in variants(rng, base, 5):
            words[v] = max(5, n // rng.choice([1, 5, 6, 25]))
            for u in variants(rng, v, 2):
                words.setdefault(u, 5)
    words |= {"".join(p): 5 for p in ("abcdef", "bacdef", "fedcba", "abcdfe", "abcdee", "abcde", "abcdeff")}
    words |= {"z" * k: 5 ** (k % 5 + 1) for k in (6, 7, 8, 9, 500)}
    return {w: n for w, n in words.items() if len(w) > 4}


@pytest.mark.parametrize("blocks", [3, 4, 7])
def test_against_brute_force(frame, blocks):
    words = sample_words(random.Random(blocks))
    got = sorted(map(tuple, group_variants(frame(list(words.items()), "word string, n long"), blocks=blocks).collect()))
    want = slow_variants(words)
    assert got == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[2] not in (r[0], r[1]) for r in want)


def test_whole_texts(frame):
    rng = random.Random(3)
    pool = ["letter", "Lettre", "étranger", "ÉTRANGER", "straße", "abcdefgh", "a", "xy1z", "naïveté", "x×y÷zabc", "日本語word", "worden", "wordens"]
    rows = [(i, rng.choice([" ", "\n", "-", "'"]).join(rng.choice(pool) for _ in range(rng.choice([0, 3, 40])))) for i in range(150)]
    rows += [(None, "letter letter Étranger"), (None, None), (3, ""), (3, rows[3][1]), (9, "letterletter" * 9000 + " worden" * 9000)]
    words = slow_words(rows)
    odd = frame([(t, i, "n", 1) for i, t in rows], "text string, doc_id long, word string, n int")
    got = sorted(map(tuple, spelling_variants(odd, delete_every=199).collect()))
    assert got == slow_variants(words) and len(got) > 8
    plain = sorted(map(tuple, spelling_variants(odd).collect()))
    assert plain == slow_variants(slow_words(rows, None))


def test_counts_handed_on_early(monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 3)
    rows = [(i, f"alphas betasss gammas{'x' * i} alphas") for i in range(20)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([str(i) for i, _ in rows]), "text": pa.array([t for _, t in rows])})
    total = Counter()
    for out in spelling._count(6, None)([batch]):
        total.update(dict(zip(out.column("word").to_pylist(), out.column("n").to_pylist())))
    assert total["alphas"] == 40 and total["gammas"] == 1 and sum(total.values()) == 80


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], SCHEMA), delete_every=199).collect() == []


def test_joins_are_not_broadcast_by_a_size_estimate(spark, frame):
    """A vocabulary under Spark's default limit still makes 20 signatures a word."""
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "10MB")
    try:
        words = sample_words(random.Random(1))
        staged = cut(frame(list(words.items()), "word string, n long"), "words")
        whole = group_variants(staged)
        for df in (near_words(staged), whole):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan
        assert sorted(map(tuple, whole.collect())) == slow_variants(words)
    finally:
        spark.conf.set(setting, before)
