import csv
import io
import random

import pytest
from hypothesis import given, settings, strategies as st

from tablelens.sources import quoted
from tablelens.sources.delimited import RaggedRows, ingest, read_csv, read_txt

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set(SPLIT, "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in was.items():
        spark.conf.set(k, v)


def random_text(rng):
    return "".join(rng.choice(['"', ",", "\n", "\r\n", " ", "a", "é", "日", '""', "x\ny", "word "]) for _ in range(rng.choice([0, 1, 4, 30, 300])))


def written(path, header, rows, sep=",", quoting=csv.QUOTE_MINIMAL, end="\n"):
    out = io.StringIO()
    writer = csv.writer(out, delimiter=sep, quoting=quoting, lineterminator=end)
    writer.writerows([header, *rows])
    path.write_bytes(out.getvalue().encode())


@pytest.mark.parametrize("sep,end,name", [(",", "\n", "t.csv"), ("\t", "\r\n", "t.txt"), (",", "\n\n", "t.csv")])
def test_splits_of_one_file_equal_the_rows_written(spark, tmp_path, small_splits, sep, end, name):
    rng = random.Random(len(sep + end))
    rows = [(str(i), random_text(rng) or "z", rng.choice(["x", "", 'say "no"'])) for i in range(250)]
    rows = [(i, t if t.strip() not in ("", "\n") else "t", o) for i, t, o in rows]
    written(tmp_path / name, ("id", "text\nof two lines", "odd.name"), rows, sep, end=end)
    lines = quoted.physical_lines(spark, str(tmp_path / name), "UTF-8")
    assert lines.rdd.getNumPartitions() > 5 and quoted.has_quotes(spark, str(tmp_path / name))
    df = ingest(spark, str(tmp_path / name))
    assert df.columns == ["id", "text\nof two lines", "odd.name"] and dict(df.dtypes)["id"] == "bigint"
    got = sorted(tuple(r) for r in df.collect())
    assert got == sorted((int(i), t, o or None) for i, t, o in rows)


def test_a_record_longer_than_many_splits(spark, tmp_path, small_splits):
    long = '"quoted" line,\n' * 2000
    rows = [("1", "a"), ("2", long), ("3", "b\nc"), ("4", long + "end")]
    written(tmp_path / "t.csv", ("id", "text"), rows, quoting=csv.QUOTE_ALL)
    got = sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv")).collect())
    assert got == [(int(i), t) for i, t in rows]


def test_several_files_with_a_mark_and_an_open_end(spark, tmp_path, small_splits):
    for k in range(3):
        (tmp_path / f"{k}.csv").write_bytes(("﻿" if k else "").encode() + b'a,b\n' + f'{k},"x\ny"\n'.encode() * 60 + b'9,"open\nend')
    got = sorted(tuple(r) for r in read_csv(spark, str(tmp_path)).collect())
    assert got == sorted([(k, "x\ny") for k in range(3) for _ in range(60)] + [(9, "open\nend")] * 3)
    (tmp_path / "9.csv").write_text('b,a\n1,"2"\n')
    with pytest.raises(ValueError, match="headers of"):
        read_csv(spark, str(tmp_path))


def test_rows_longer_than_the_header_and_other_encodings(spark, tmp_path):
    (tmp_path / "r.csv").write_text('a,b\n1,"2\n3",4\n')
    with pytest.raises(RaggedRows):
        read_csv(spark, str(tmp_path / "r.csv"))
    (tmp_path / "l.csv").write_bytes('a,b\n1,"é\nü"\n'.encode("latin-1"))
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "l.csv"), encoding="ISO-8859-1").collect()] == [(1, "é\nü")]
    (tmp_path / "none.csv").write_text("a,b\n")
    assert read_csv(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "q.csv").write_text('"a","b"\n')
    assert read_csv(spark, str(tmp_path / "q.csv")).collect() == []
    (tmp_path / "t.txt").write_text('a\tb\n\t\n1\t"x\ty"\n')
    assert sorted((tuple(r) for r in read_txt(spark, str(tmp_path / "t.txt")).collect()), key=repr) == [(1.0, "x\ty"), (None, None)]


def test_the_whole_file_reader_is_still_there(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\ny"\n')
    assert [tuple(r) for r in ingest(spark, str(tmp_path / "t.csv"), multiline=True).collect()] == [(1, "x\ny")]


def slow_state(line, state, sep):
    """One character at a time."""
    at_start, closing = state == 0, False
    inside = state == 1
    for c in line:
        if inside:
            if closing:
                if c == '"':
                    closing = False
                    continue
                inside = closing = False
                at_start = c == sep
            elif c == '"':
                closing = True
        elif at_start and c == '"':
            inside, at_start = True, False
        else:
            at_start = c == sep
    return int(inside and not closing)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet='",a \t', max_size=14), st.sampled_from([0, 1]))
def test_states(line, state):
    assert quoted.end_state(line, state, ",") == slow_state(line, state, ",")


def test_functions_of_splits_compose(spark):
    rng = random.Random(6)
    rows = [(f, 100 * b, *rng.choice([(0, 1), (1, 0), (0, 0), (1, 1)])) for f in (1, 2) for b in range(60)]
    want = {}
    for f in (1, 2):
        state = 0
        for _, b, outside, inside in sorted(r for r in rows if r[0] == f):
            want[f, b] = state
            state = inside if state else outside
    rng.shuffle(rows)
    got = quoted.split_starts(spark.createDataFrame(rows, "file long, block long, outside int, inside int")).collect()
    assert {(r.file, r.block): r.start for r in got} == want


def test_many_splits_are_joined_not_broadcast(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(quoted, "BROADCAST_KEYS", 1)
    rows = [(str(i), "line\nof text" * (i % 9 + 1)) for i in range(100)]
    written(tmp_path / "t.csv", ("id", "text"), rows)
    got = sorted(tuple(r) for r in read_csv(spark, str(tmp_path / "t.csv")).collect())
    assert got == [(int(i), t) for i, t in rows]
