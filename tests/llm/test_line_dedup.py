import random
from collections import defaultdict

import numpy as np

from tablelens.llm import mph
from tablelens.llm.line_dedup import dedup_lines

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_chars, min_docs):
    held = defaultdict(list)
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: line.strip(STRIP).translate(LOWER)
    low = lambda i: float("-inf") if i is None else i
    for i, lines in split:
        for k in {key(x) for x in lines}:
            held[k].append(low(i))
    gone = lambda i, x: len(k := key(x)) >= min_chars and len(held[k]) >= min_docs and low(i) != max(held[k])
    out = []
    for i, lines in split:
        kept = [x for x in lines if not gone(i, x)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def run(df, **kw):
    return sorted(((r.doc.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in dedup_lines(df, **kw).collect()), key=repr)


def test_mph_is_minimal_and_total():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 5000):
        h1, h2 = (rng.integers(0, 2**63, n).astype("u8") for _ in range(2))
        h1[: n // 3] = 7  # equal first halves are told apart by the second
        sizes, words, slot = mph.build(h1, h2)
        assert sorted(slot) == list(range(n))
        assert (mph.slots(sizes, words, h1, h2) == slot).all()


def test_against_brute_force(frame):
    rng = random.Random(5)
    shared = [f"Shared line number {i} with quite some text in it é" for i in range(40)]
    rows = []
    for i in range(300):
        lines = [rng.choice(shared) if rng.random() < .4 else f"own line {rng.random()} of document {i} which is long" for _ in range(rng.randrange(8))]
        lines += [" \t" + rng.choice(shared).upper() + "\r", "short", ""]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(None, None), (None, shared[0]), (400, ""), (401, "\n\n"), (7, rows[7][1]), (402, "x" * 300_000 + "\n" + shared[1])]
    df = frame(rows, "doc_id long, text string")
    assert run(df, shard_keys=8) == brute(rows, 40, 5)
    assert run(df, shard_keys=8, min_chars=1, min_docs=2) == brute(rows, 1, 2)


def test_line_in_every_document_and_ties(frame):
    line = "the same line stands in every single document here"
    rows = [(i, line) for i in range(50)] + [(49, line)]
    assert run(frame(rows, "doc_id long, text string")) == brute(rows, 40, 5)


def test_boundaries_of_length_and_count(frame):
    at, below = "a" * 40, "b" * 39
    rows = [(i, f"{at}\n{below}") for i in range(5)] + [(i, "é" * 40) for i in range(10, 14)]
    assert run(frame(rows, "doc_id long, text string")) == brute(rows, 40, 5)


def test_empty_table_and_clashing_names(frame, spark):
    schema = "doc_id long, text string, gone string, id int, kept_text string"
    assert dedup_lines(spark.createDataFrame([], schema)).collect() == []
    rows = [(i, "a line that is long enough to count, surely yes", "g", i, "k") for i in range(6)]
    out = dedup_lines(frame(rows, schema)).collect()
    assert sorted((r.doc.id, r.doc.gone, r.doc.kept_text, r.n_dropped) for r in out) == [(i, "g", "k", int(i < 5)) for i in range(6)]
