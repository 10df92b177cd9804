import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tablelens.llm import conversation_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def slow_trie(convs):
    """Nodes of {conv_id: [(role, text)]} by walking every prefix."""
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                kids[path[:d - 1]].add(path[:d])
    rows = []
    for path, ids in members.items():
        below = [p for p in members if p[:len(path)] == path]
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(path))
        rows.append((ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), len(kids[path]),
                     sum(not kids[p] for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p),
                     hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def slow_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}


def slow_rebuild(convs):
    out = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + convs[c][h:]
    return out


def sample_rows(rng):
    rows = []
    for c in [*range(60), *range(100, 160), *range(301, 330), 10**12]:
        length = rng.choice([1, 1, 2, 3, 6, 7, 13, 25])
        rows += [(c, t if rng.random() < .95 else None, rng.choice(["user", "bot", None]), rng.choice(["hi", "é ö", "", None, "yes no"])) for t in range(length)]
    rows += [(7, 3, "user", "hi")] * 3 + [(None, 1, "user", "lost"), (8, 2**40, "u", "x" * 100_000), (12, -5, "1:u", "a"), (12, -5, "1", ":ua")]
    return rows


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("width", [1, 3, 6])
def test_against_brute_force(frame, width, monkeypatch):
    rows = sample_rows(random.Random(width))
    turns = frame(rows, SCHEMA)
    monkeypatch.setattr(trie, "CHUNK", 2)  # prefix sums go over several chunks
    assert result(trie.conversation_trie(turns, width=width)) == slow_trie(slow_order(rows))
    assert result(trie.rebuilt_trie(turns, width=width)) == slow_trie(slow_rebuild(slow_order(rows)))


def test_one_conversation_over_many_partitions(frame):
    rows = [(5, t, "u", f"t{t % 3}") for t in range(300)] + [(1, 0, "u", "t0"), (9, 0, "u", "t0"), (9, 1, "u", "t1")]
    numbered = trie.number_turns(frame(rows, SCHEMA))
    assert sorted(r.pos for r in numbered.where("conv_id = 5").collect()) == list(range(1, 301))
    got = result(trie.conversation_trie(frame(rows, SCHEMA)))
    assert got == slow_trie(slow_order(rows)) and len(got) == 301


def test_pieces_of_ends(frame, monkeypatch):
    rows = [(c, 0, "u", "same") for c in range(200)]
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    assert result(trie.conversation_trie(frame(rows, SCHEMA))) == slow_trie(slow_order(rows))


def test_empty_table_and_odd_columns(spark, frame):
    assert trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = "`my.conv` long, turn string, role string, text string, k1 string, block int, a1 long, depth string, conv_id string"
    rows = [(1, "b", "u", "x", "k", 1, 2, "d", "z"), (1, "a", "u", "y", "k", 1, 2, "d", "z"), (2, "a", "u", "y", "k", 1, 2, "d", "z")]
    got = trie.conversation_trie(frame(rows, odd), conv_id="my.conv")
    assert result(got) == slow_trie({1: [("u", "y"), ("u", "x")], 2: [("u", "y")]})
