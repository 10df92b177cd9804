import random

import numpy as np
import xxhash

from tablelens.llm import simhash
from tablelens.llm.components import connected_components
from tablelens.llm.simhash import fingerprint, near_pairs, simhash_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_print(text):
    words, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in "\x20\t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits):
    prints, group = np.array(prints, np.uint64), list(range(len(ids)))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    for i, j in zip(*np.nonzero(near)):
        group[find(i)] = find(j)
    low = {}
    for i, own in enumerate(ids):
        if own is not None:
            r = find(i)
            low[r] = min(low.get(r, own), own)
    return [low.get(find(i)) for i in range(len(ids))]


def sample_rows(rng, n=250):
    words = [f"w{i}" for i in range(80)] + ["É", "ß", "A B", "x\x1cy"]
    rows = []
    for i in range(n):
        if rows and rng.random() < .5:
            own = rng.choice(rows)[1].split(" ")
            if len(own) > 40 and rng.random() < .8:
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 4, 300, 800])))
        rows.append((i, text))
    return rows + [(None, None), (n, ""), (n + 1, " \t\r\n"), (5, rows[5][1]), (5, "other text of five"), (n + 2, "Word " * 50_000)]


def test_against_brute_force(frame):
    rows = sample_rows(random.Random(8))
    got = simhash_dedup(frame(rows, "doc_id long, text string")).collect()
    prints = [slow_print(t) for _, t in rows]
    want = sorted(zip([i for i, _ in rows], prints, brute_components([i for i, _ in rows], prints, 3)), key=repr)
    assert sorted(((r.doc_id, r["print"] & (2**64 - 1), r.component_id) for r in got), key=repr) == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_fingerprint_chunks(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(5000))
    whole = fingerprint(text, 3)
    monkeypatch.setattr(simhash, "_CHUNK", 64)
    assert fingerprint(text, 3) == whole == slow_print(text)


def planted_prints(rng, n):
    base = rng.integers(0, 2**64, n // 2, dtype=np.uint64)
    out = [int(x) for x in base]
    for x in base.tolist():
        for _ in range(rng.integers(0, 5)):
            for b in rng.choice(64, rng.integers(0, 6), replace=False).tolist():
                x ^= 1 << b
            out.append(x)
    return sorted(set(out) | {0, 1, 7, 15, 2**64 - 1})


def test_candidates_lose_no_link(spark):
    rng = np.random.default_rng(4)
    prints = planted_prints(rng, 400)
    want = brute_components(prints, prints, 3)
    for hot in (4096, 1):  # with and without refined keys
        simhash.HOT_KEY = hot
        df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "print long")
        got = {r["print"] % 2**64: r["root"] % 2**64 for r in simhash.near_duplicates(df).collect()}
        simhash.HOT_KEY = 4096
        groups, seen = {}, {}
        for p, w in zip(prints, want):
            groups.setdefault(got.get(p, p), set()).add(p)
            seen.setdefault(w, set()).add(p)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, seen.values()))


def test_every_block_count_is_exact():
    rng = np.random.default_rng(5)
    prints = np.array(planted_prints(rng, 300), np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    want = {(min(a, b), max(a, b)) for a, b in zip(*np.nonzero(near)) if a != b}
    at = {int(p): i for i, p in enumerate(prints)}
    import pyarrow as pa
    for n_blocks in (4, 5, 7, 12):
        batch = pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64))], names=["print"])
        parts = list(simhash._keys(n_blocks, 3)([batch]))
        p = np.concatenate([x.column("print").to_numpy() for x in parts]).view(np.uint64)
        k = np.concatenate([x.column("key").to_numpy() for x in parts])
        got = {tuple(sorted((at[int(a)], at[int(b)]))) for one, two in near_pairs(p, k, 3) for a, b in zip(one, two)}
        assert got == want


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 2000 + i) for i in range(300)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain + hub, "u long, v long").repartition(9)).collect()}
    assert {got.get(i, i) for i in range(301)} == {0}
    assert {got[2000 + i] for i in range(300)} == {1000}


def test_empty_table_and_extra_columns(spark, frame):
    assert simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c d", "x", 5), (2, "a b c d", "y", 6)]
    out = simhash_dedup(frame(rows, "doc_id long, text string, print string, root int")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1)]


def test_links_are_staged_before_components(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(simhash, "connected_components", lambda links: seen.append(links) or connected_components(links))
    df = spark.createDataFrame([(0,), (1,), (1 << 40,)], "print long")
    assert sorted(map(tuple, simhash.near_duplicates(df).collect())) == [(1, 0), (1 << 40, 0)]
    assert "MapInArrow" not in seen[0]._jdf.queryExecution().executedPlan().toString()  # else a task holds two Python workers
