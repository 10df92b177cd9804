import math

import numpy as np
import pytest

from tablelens.llm.embedding_dedup import _Shard, dedup_embeddings, planted_recall
from tablelens.llm.hnsw import Hnsw
from tablelens.llm.queries import op4_embedding_dedup


def brute(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) in double precision."""
    ok = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e in rows]
    unit = [np.array(e, float) / np.abs(e).max() if good else None for (_, e), good in zip(rows, ok)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    n, group = len(rows), list(range(len(rows)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i
    links = [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and (float(unit[i] @ unit[j]) >= threshold or rows[i][1] == rows[j][1]):
                links[i] += 1
                links[j] += 1
                group[find(i)] = find(j)
    low = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            low[find(i)] = min(low.get(find(i), v), v)
    return sorted(((v, links[i], low.get(find(i)), v == low.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr)


def near(rng, base, cosine):
    side = rng.normal(size=base.shape)
    side -= (side @ base) * base / (base @ base)
    side *= np.linalg.norm(base) / np.linalg.norm(side)
    return cosine * base + math.sqrt(1 - cosine**2) * side


def sample(rng, n=300, dim=16):
    rows = []
    for i in range(n):
        if rows and rng.random() < .4:
            e = near(rng, np.array(rows[rng.integers(len(rows))][1]), rng.choice([0.96, 0.99, 0.94]))
        else:
            e = rng.normal(size=dim)
        rows.append((i, (e * 10.0 ** rng.integers(-3, 4)).tolist()))
    hub = rng.normal(size=dim)
    return rows + [(1000 + i, near(rng, hub, 0.999).tolist()) for i in range(80)]


@pytest.mark.parametrize("shards", [1, 4])
def test_against_brute_force(frame, shards):
    rng = np.random.default_rng(3)
    rows = sample(rng)
    rows += [(2000 + i, rows[0][1]) for i in range(30)] + [(0, rows[0][1]), (0, rows[9][1]), (None, rows[1][1]), (None, rng.normal(size=16).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [None] * 16), (3004, [math.nan] * 16), (3005, [math.inf] + [1.0] * 15),
             (3006, [1e-200] * 16), (3007, [1e200] * 16), (3008, [1.0] * 3), (3009, [2.0] * 3)]
    out = dedup_embeddings(frame(rows, "vec_id long, embedding array<double>"), min_shards=shards, small_shard=50)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in out.collect()), key=repr)
    want = brute(rows)
    want = sorted(((v, k, c, True if v is None and c is None else kept) for v, k, c, kept in want), key=repr)
    assert got == want


def test_search_recall_on_a_larger_set():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(6000, 32))
    v[3000:3600] = [near(rng, v[0], 0.995) for _ in range(600)]  # one large group of near copies
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Hnsw.build(v.astype(np.float32))
    assert planted_recall(graph, 0.95, 64, 1) > 0.9
    shard = _Shard.__new__(_Shard)
    shard.nodes, shard.weights, shard.vectors, shard.beam, shard.graph = np.arange(6000), np.ones(6000, int), v, 64, graph
    q = np.concatenate([v[3000:3100], [near(rng, x, 0.96) for x in v[:400]]])
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    a, b = shard.audited(q, 0.95, 0.98)
    want = {(i, j) for i, j in zip(*np.nonzero(q @ v.T >= 0.95))}
    got = set(zip(a.tolist(), b.tolist()))
    assert got <= want and len(got) >= 0.97 * len(want)
    assert {(i, j) for i, j in want if i < 100} <= got  # crowded queries end in an exact scan


def test_query_recall(spark):
    sf = "/root/testdata/sf0.01"
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in op4_embedding_dedup(spark, sf).collect()), key=repr)
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    assert sum(k for _, k, _, _ in got) >= 0.97 * sum(k for _, k, _, _ in want)
    assert np.mean([g == w for g, w in zip(got, want)]) > 0.98


def test_empty_table_and_extra_columns(spark, frame):
    assert dedup_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    rows = [(1, [1.0, 0.0], "a", 3), (2, [1.0, 0.01], "b", 4), (3, [0.0, 1.0], "c", 5)]
    out = dedup_embeddings(frame(rows, "vec_id long, embedding array<float>, h1 string, node int")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


@pytest.mark.parametrize("tight", [0.99, 0.973])  # all pairs linked; pairs on both sides of the threshold
def test_a_dense_cluster_takes_memory_by_rows(tight):
    import tracemalloc

    import pyarrow as pa

    from tablelens.llm.embedding_dedup import _builder, _searcher

    rng = np.random.default_rng(5)
    n, dim, base = 5000, 16, rng.normal(size=16)
    v = np.stack([near(rng, base, tight) for _ in range(n)] + [rng.normal(size=dim) for _ in range(500)])
    table = pa.table({"node": np.arange(len(v)), "weight": np.full(len(v), 2), "embedding": pa.array(v.tolist())})
    index = _builder(0.95, 0.98, 64)((pa.scalar(dim), pa.scalar(0)), table)
    tracemalloc.start()
    out = _searcher(0.95, 0.98)((pa.scalar(dim),), table, index).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = 2 * ((unit @ unit.T >= 0.95).sum(axis=1) - 1)
    counts = {u: k for u, w, k in zip(out["u"], out["v"], out["links"]) if u == w}
    assert [counts.get(i, 0) for i in range(n)] == want[:n].tolist() and want.sum() > 10_000_000
    assert len({w for u, w in zip(out["u"], out["v"]) if u != w and u < n and w < n}) == 1
    assert peak < 250 << 20


def test_links_found_through_the_graphs_of_several_shards(frame):
    """Shards of over 1,000 vectors, so every search walks a graph; planted links of the least cosines that count."""
    rng = np.random.default_rng(12)
    v = [rng.normal(size=32) for _ in range(2400)]
    v += [near(rng, v[i], c) for i, c in enumerate(np.linspace(0.951, 0.97, 300))]
    for i in range(500, 510):  # clusters
        v += [near(rng, v[i], 0.985) for _ in range(20)]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = {r.vec_id: r for r in dedup_embeddings(frame(rows, "vec_id long, embedding array<double>"), min_shards=2, small_shard=1000).collect()}
    unit = np.stack(v) / np.linalg.norm(v, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    counts = np.array([got[i].n_links for i in range(len(v))])
    assert (counts <= want).all() and counts.sum() >= 0.98 * want.sum() and want.sum() > 2000
    brutal = {i: (c, k) for i, _, c, k in brute(rows)}
    assert np.mean([(got[i].component_id, got[i].kept) == brutal[i] for i in got]) >= 0.99
