import zlib
from array import array

import numpy as np
import pytest

import corpus_pipeline
from tablelens.llm import pipeline
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_line_dedup import brute as shared_lines
from tests.llm.test_simhash import brute_components, slow_print
from tests.llm.test_tokens import plain

SF = "/root/testdata/sf0.01"


def test_run_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clean = pipeline.clean_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert 0.8 * docs.count() < len(rows) < docs.count()
    rows = [(i, t) for i, t, _, _ in shared_lines(rows, 40, 5)]
    ids, prints = [i for i, _ in rows], [slow_print(t) for _, t in rows]
    rows = [r for r, c in zip(rows, brute_components(ids, prints, 3)) if r[0] == c]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, n, hit, _ in contamination(rows, bench, 13) if hit and 20 * hit >= n}
    assert bad
    want = {i: array("I", [*plain(t), 1]).tobytes() for i, t in rows if i not in bad}
    got, places = {}, {}
    for r in corpus_pipeline.run(spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r)
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got.keys() == want.keys()
    for i, pieces in got.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.ids_crc32 == zlib.crc32(want[i][4 * at:4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(want[i]) == 4 * pieces[0].doc_tokens
    used = padded = 0
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        used, padded = used + at, padded + (0 if at & (at - 1) == 0 else 2048 - at)
    assert padded < 0.03 * used


@pytest.mark.parametrize("name", [s for s, _ in corpus_pipeline.STAGES])
def test_stage_takes_odd_and_empty_tables(spark, frame, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, print int"
    odd = [(None, None, None, None, None, None, None), (1, "", "en", "s", 0, "d", 1), (1, "", "en", "s", 0, "d", 1), (2, "a word " * 30_000, "en", None, 9, "d", 1)]
    out = stage(spark, frame(odd, schema), SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == [c.split()[0] for c in schema.split(", ")]
    assert len(out.collect()) >= 1
    assert stage(spark, spark.createDataFrame([], schema), SF).collect() == []


def test_line_stage_changes_text_and_length(spark, frame):
    line = "this line stands in all of the six documents here"
    rows = [(i, f"{line}\nown {i}", i) for i in range(6)] + [(6, None, 7)]
    out = {r.doc_id: r for r in pipeline.drop_shared_lines(spark, frame(rows, "doc_id long, text string, n_chars long"), SF).collect()}
    assert out[0].text == "own 0" and out[0].n_chars == 5 and out[5].text.startswith(line) and out[5].n_chars == 5
    assert out[6].text is None and out[6].n_chars == 7
