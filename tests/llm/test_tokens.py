import random
import zlib
from array import array

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tablelens.llm import packing, token_output, tokens
from tablelens.llm.packing import best_cuts, pack_documents
from tablelens.llm.pipeline import pack_digest

ENCODER = tokens.Encoder(tokens.default_vocabulary())
PLAIN = Tokenizer.from_file(tokens.default_vocabulary())
PLAIN.encode_special_tokens = True


def plain(text):
    return list(PLAIN.encode(text or "", add_special_tokens=False).ids)


def ids(text):
    return array("I", ENCODER.ids(text)).tolist()


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "\n\n", " \n", "\t", " ", "᠎", " ", "the", "The", "'s", "'ll", "don't", ".", ",", "...", "1", "12a",
                                 "é", "straße", "日本", "🙂", "á", "<|endoftext|>", "ᄀ", "$%", "x.", "y,", "l'eau", "\r\n", "\x1c", "​"]), max_size=25).map("".join))
def test_ids_equal_the_library(text):
    assert ids(text) == plain(text)
    assert ids(text) == plain(text)  # again, from memory


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert ids(text) == plain(text)


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 10)
    e = tokens.Encoder(tokens.default_vocabulary())
    for i in range(30):
        e.ids(f"word{i} other{i} third{i}")
        assert len(e) <= 14


def texts(rng, n):
    words = ["the", "of", "and.", "Ende.", "l'été", "x1", "foo,", "bar\nBaz", "?", "  "]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 80, 400, 3000]))) for _ in range(n)]
    return out + [None, "", "a" * 30_000, "word " * 20_000, "<|endoftext|>"]


def rows_of(rng, n=60):
    rows = [(i, t) for i, t in enumerate(texts(rng, n))]
    return [*rows, (None, "no id"), (3, rows[3][1]), (3, "another three")]


@pytest.mark.parametrize("block", [1 << 21, 5000])
def test_packing_is_whole_and_tight(frame, monkeypatch, block):
    rng = random.Random(1)
    rows = rows_of(rng)
    monkeypatch.setattr(packing, "BLOCK_IDS", block)
    out = [r.asDict(recursive=True) for r in pack_documents(frame(rows, "doc_id long, text string"), window=256).collect()]
    want = sorted((str(i), array("I", [*plain(t), 1]).tobytes()) for i, t in rows)
    docs, seqs, current = [], {}, None
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        seqs.setdefault(r["sequence_id"], []).append(r)
        if r["start"] == 0:
            assert current is None or len(current[1]) == current[2] * 4
            current = [str(r["doc"]["doc_id"]), b"", r["doc_tokens"]]
            docs.append(current)
        assert len(current[1]) == 4 * r["start"] and len(r["ids"]) == 4 * r["length"]
        current[1] += r["ids"]
    assert sorted((d[0], d[1]) for d in docs) == want
    order = [-1 if d[0] == "None" else int(d[0]) for d in docs]
    assert order == sorted(order)
    used = padded = 0
    for pieces in seqs.values():
        size = 0
        for r in pieces:
            assert r["offset"] == size
            size += r["length"]
        assert size <= 256
        used, padded = used + size, padded + (0 if size & (size - 1) == 0 else 256 - size)
    assert padded < 0.06 * used


def brute_cost(places, cost, window, fee):
    best = {0: 0.0}
    for p, c in zip(places, cost):
        pad = lambda n: 0 if n & (n - 1) == 0 else window - n
        best[p] = c + fee + min(best[i] + pad(p - i) for i in best if p - i <= window)
    return best[places[-1]] if places else 0.0


def test_cuts_are_the_cheapest():
    rng = random.Random(2)
    for _ in range(300):
        window = rng.choice([8, 16, 32])
        places, p = [], 0
        for _ in range(rng.randrange(0, 40)):
            p += rng.randrange(1, window // 4 + 1)
            places.append(p)
        cost = [rng.choice([0.0, 1.5, 3.0, 20.0]) for _ in places]
        cuts = best_cuts(places, cost, window, 0.5)
        total, at = 0.0, 0
        for c in cuts:
            n = c - at
            total, at = total + cost[places.index(c)] + 0.5 + (0 if n & (n - 1) == 0 else window - n), c
        assert at == (places[-1] if places else 0) and abs(total - brute_cost(places, cost, window, 0.5)) < 1e-9


def test_packing_of_empty_and_odd_tables(spark, frame):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    out = pack_digest(pack_documents(frame([(1, None, 2)], "doc_id long, text string, start int"))).collect()
    assert [tuple(r)[:5] for r in out] == [(1, 0, 1, zlib.crc32(array("I", [1]).tobytes()), 1)]


def test_token_files_round_trip(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(token_output, "PAGE_ROWS", 8)
    rng = random.Random(3)
    rows = rows_of(rng)
    path = str(tmp_path / "tokens")
    token_output.write_tokens(frame([(*r, "p") for r in rows], "doc_id long, text string, part string"), path)
    order, start, want = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0])), 0, []
    back = token_output.token_digests(spark, path).collect()
    sizes = {}
    for i, t in order:
        data = array("I", [*plain(t), 0]).tobytes()
        want.append((i, len(data) // 4, zlib.crc32(data)))
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in back), key=repr) == sorted(want, key=repr)
    for r in sorted(back, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    ids_in_order = [r.doc_id for r in sorted(back, key=lambda r: r.start)]
    assert ids_in_order == [i for i, _ in order]
    some = token_output.read_tokens(spark, path, 10, 12).collect()
    assert sorted((r.doc_id, r.tokens) for r in some) == [(i, [*plain(t), 0]) for i, t in rows if i is not None and 10 <= i <= 12]
    assert {c for c in token_output.read_metadata(spark, path).columns} == {"part", "place", "doc_id", "part_start", "n_tokens"}
    checked = 0
    for f in sorted((tmp_path / "tokens").glob("*.parquet")):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert all(c.has_offset_index for c in columns.values())
            assert any("DICTIONARY" in e for e in columns["tokens.list.element"].encodings)
            assert "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            checked += 1
    assert checked


def test_token_files_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "none")
    token_output.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_output.token_digests(spark, path).collect() == []


def test_queries_give_the_ids_of_an_unmodified_tokenizer(spark, frame, tmp_path):
    from tablelens.llm import pipeline, queries

    library = Tokenizer.from_file(tokens.default_vocabulary())
    texts = ["<|endoftext|>", "one<|endoftext|>two. three", "a <|endoftext|> b", "x <|endoftext|", "plain words here",
             "<|endoftext|><|endoftext|>", "the end\n<|endoftext|>\nof it"]
    frame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {i: list(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert want[0] == [50256]
    start = 0
    for r in sorted(queries.op8_token_output(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id):
        data = array("I", [*want[r.doc_id], 0]).tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(data) // 4, zlib.crc32(data))
        start += r.n_tokens
    packed = queries.op2_packing(spark, str(tmp_path)).collect()
    last = pipeline.pack(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()
    for rows in (packed, last):
        got = {i: sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for i in want}
        for i, pieces in got.items():
            ids = [*want[i], 1]
            assert sum(r.length for r in pieces) == len(ids) == pieces[0].doc_tokens
            assert all(r.ids_crc32 == zlib.crc32(array("I", ids[r.start:r.start + r.length]).tobytes()) for r in pieces)
