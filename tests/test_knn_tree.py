import numpy as np
import pandas as pd
import pytest

from tablelens.operators import knn
from tablelens.operators.knn import BLOCK, TopTree, distances, knn_impute, lower_bounds, nearest


def gappy(rng, n, f, share=0.25):
    x = np.column_stack([rng.normal(size=n) * 3 ** j if j % 2 else rng.integers(0, 9, n).astype(float) for j in range(f)])
    x[rng.random((n, f)) < share] = np.nan
    return x


def brute(queries, donors, k):
    out = []
    for q, row in enumerate(queries):
        d = distances(row[None], donors)[0]
        out += [(q, d[j], j) for j in sorted(np.flatnonzero(np.isfinite(d)), key=lambda j: (d[j], j))[:k]]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_nearest_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    donors, queries = gappy(rng, 1500, 5, [0, .25, .6][seed % 3]), gappy(rng, 90, 5, .3)
    donors[:300] = donors[0]  # ties
    queries[3] = np.nan  # shares nothing with anyone
    for k in (1, 7, 400):
        q, d, j = nearest(queries, donors, k, np.full(len(queries), np.inf))
        assert list(zip(q.tolist(), d.tolist(), j.tolist())) == brute(queries, donors, k)


def test_a_radius_only_cuts_what_lies_beyond():
    rng = np.random.default_rng(9)
    donors, queries = gappy(rng, 700, 4), gappy(rng, 40, 4)
    q, d, j = nearest(queries, donors, 5, np.full(40, 1.5))
    assert list(zip(q, d, j)) == [t for t in brute(queries, donors, 5) if t[1] <= 1.5]


@pytest.mark.parametrize("share", [0.0, 0.3])
def test_bounds_are_below_every_distance(share):
    rng = np.random.default_rng(5)
    for _ in range(60):
        box, queries = gappy(rng, 30, 4, share), gappy(rng, 20, 4, .3)
        here = ~np.isnan(box)
        with np.errstate(all="ignore"):
            low, high = np.where(here, box, np.inf).min(0), np.where(here, box, -np.inf).max(0)
        bound = lower_bounds(queries, low[None], high[None], here.any(0)[None], here.all(0)[None])[:, 0]
        assert (bound <= distances(queries, box).min(axis=1)).all()


def test_top_tree_routes_every_point():
    rng = np.random.default_rng(2)
    points = gappy(rng, 4000, 3, .2)
    tree = TopTree(points[::9], 37)
    leaf = tree.leaf(points)
    assert tree.leaves <= 37 and set(leaf) == set(range(tree.leaves)) and np.bincount(leaf).max() < 900
    assert TopTree(np.full((50, 2), 3.0), 8).leaves == 1 and TopTree(np.zeros((0, 2)), 8).leaf(points).max() == 0


@pytest.mark.parametrize("leaf,task", [(60, 1 << 13), (200, 7)])
def test_many_leaves_and_dealt_recipients(spark, monkeypatch, leaf, task):
    monkeypatch.setattr(knn, "LEAF_DONORS", leaf)
    monkeypatch.setattr(knn, "TASK_RECIPIENTS", task)
    rng = np.random.default_rng(leaf)
    x = gappy(rng, 900, 5, .15)
    x[:150] = x[150]  # one vector that many rows have
    x[7, 1:] = np.nan
    names = ["t", "a.b", "a b", "`q`", "plain"]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(**{"row.id": np.arange(900)}))
    got = knn_impute(df, ["t", "a.b"], k=4, features=names, order_by=["row.id"]).orderBy("`row.id`").toPandas()
    for c, name in ((0, "t"), (1, "a.b")):
        lacks = np.isnan(x[:, c])
        order = [c, *(j for j in range(5) if j != c)]
        donors = np.flatnonzero(~lacks)
        want = x[:, c].copy()
        for r in np.flatnonzero(lacks):
            near = brute(x[[r]][:, order], x[donors][:, order], 4)
            want[r] = np.mean([x[donors[j], c] for _, _, j in near]) if near else np.nanmean(x[:, c])
        np.testing.assert_allclose(got[name].to_numpy(), want, rtol=1e-12)
    assert got.columns.tolist() == [*names, "row.id"]


def test_no_donor_is_copied_into_classes():
    rng = np.random.default_rng(1)
    blocks = knn._blocks(gappy(rng, 5000, 6, .4))
    assert sorted(np.concatenate(blocks)) == list(range(5000)) and max(map(len, blocks)) <= BLOCK


def test_leaves_part_donors_by_their_gaps():
    rng = np.random.default_rng(4)
    points = gappy(rng, 20_000, 4, .3)
    leaf = TopTree(points[::5], 64).leaf(points)
    masks = np.isnan(points) @ (1 << np.arange(4))
    pure = [len(set(masks[leaf == n])) == 1 for n in range(leaf.max() + 1)]
    assert np.mean(pure) > 0.95
    boxes = [points[leaf == n] for n in range(leaf.max() + 1)]
    here = np.array([(~np.isnan(b)).any(0) for b in boxes])
    every = np.array([(~np.isnan(b)).all(0) for b in boxes])
    low, high = (np.array([g(np.where(np.isnan(b), s, b), axis=0) for b in boxes]) for g, s in ((np.min, np.inf), (np.max, -np.inf)))
    assert (lower_bounds(points[:300], low, high, here, every) <= 0).mean() < 0.5


def test_a_feature_that_queries_lack_is_split_less():
    rng = np.random.default_rng(6)
    points = rng.random((1000, 2)) * [100, 10]
    none, lack = np.zeros(2), np.array([0.9, 0.1])
    assert knn._split(points, none, lack, np.inf)[0] == 0 and knn._split(points, none, lack, 0.0)[0] == 1
    assert knn._split(points, np.array([0, 9]), lack, 0.0)[0] == 0 and knn._split(np.full((9, 2), 1.0), none, lack, 0.0) is None
    blocks = knn._blocks(points, lack, 0.0)
    assert sorted(np.concatenate(blocks)) == list(range(1000))


def test_equal_donors_are_the_first_at_distance_zero():
    rng = np.random.default_rng(3)
    odd = np.array([0.0, -0.0, 1.0, 2.5, np.inf, -np.inf, np.nan, 1e300, 1e308])
    donors, queries = odd[rng.integers(0, len(odd), (900, 3))], odd[rng.integers(0, len(odd), (300, 3))]
    for has in np.unique(~np.isnan(queries), axis=0):
        own = queries[(np.isnan(queries) == ~has).all(axis=1)]
        for k in (1, 7, 40):
            with np.errstate(all="ignore"):
                want = [sorted(np.flatnonzero((d := distances(q[None], donors)[0]) == 0), key=int)[:k] if not np.isinf(q).any() else None for q in own]
            for found, first in zip(knn.equal_donors(own, donors, k), want):
                if first is not None:
                    assert found.tolist() == first + [len(donors)] * (k - len(first))
    assert knn.equal_donors(queries[:0], donors, 3).shape == (0, 3) and (knn.equal_donors(queries[:5], donors[:0], 2) == 0).all()


def test_squares_that_are_lost_are_left_to_the_tree():
    donors = np.array([[1e-170, 1.0], [0.0, 1.0], [0.0, 1.0]])
    queries = np.array([[0.0, 1.0], [1e-170, 1.0], [3.0, 1.0]])
    assert (distances(queries[:2], donors) == 0).all()
    assert (knn.equal_donors(queries, donors, 2) == len(donors)).all()
    assert knn.equal_donors(queries[:1], donors[1:], 2).tolist() == [[0, 1]]


def few_values(rng, n):
    x = rng.integers(0, 4, (n, 4)).astype(float)
    x[:, 0] = rng.random(n)
    x[rng.random((n, 4)) < .2] = np.nan
    return x


def filled(x, k):
    lacks, out = np.isnan(x[:, 0]), x[:, 0].copy()
    donors = np.flatnonzero(~lacks)
    for r in np.flatnonzero(lacks):
        near = brute(x[[r]], x[donors], k)
        out[r] = np.mean([x[donors[j], 0] for _, _, j in near]) if near else np.nanmean(x[:, 0])
    return out


@pytest.mark.parametrize("early,found,repeat", [(0, 50, 1), (32, 20, 1), (200, 1 << 20, 1), (200, 1 << 20, 60), (1 << 19, 100, 1)])
def test_early_donors_change_nothing(spark, monkeypatch, early, found, repeat):
    monkeypatch.setattr(knn, "LEAF_DONORS", 90)
    monkeypatch.setattr(knn, "EARLY_DONORS", early)
    monkeypatch.setattr(knn, "EARLY_FOUND", found)
    x = few_values(np.random.default_rng(8), 900)
    x[:40, 1:] += np.random.default_rng(9).random((40, 3)) * .01  # no donor equals these
    x[41] = [np.nan, np.nan, np.nan, np.nan]
    frame = pd.DataFrame(x, columns=["t", "a", "b", "c"]).assign(key=np.arange(900) // repeat, sub=[f"k{i % repeat:02}" for i in range(900)])
    frame.loc[frame.key == 0, "key"] = None  # keys may be null: these come first
    df = spark.createDataFrame(frame.astype({"key": "Int64"}).astype(object).where(frame.notna(), None), "t double, a double, b double, c double, key long, sub string").repartition(5)
    got = knn_impute(df, ["t"], k=4, features=["t", "a", "b", "c"], order_by=["key", "sub"]).orderBy("key", "sub").toPandas()
    np.testing.assert_allclose(got["t"].to_numpy(float), filled(x, 4), rtol=1e-12)


def test_recipients_with_equal_donors_meet_no_leaf(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF_DONORS", 90)
    monkeypatch.setattr(knn, "_in_leaves", None)
    x = few_values(np.random.default_rng(5), 2000)
    x[np.isnan(x[:, 1:]).all(axis=1), 1] = 0.0
    frame = pd.DataFrame(x, columns=["t", "a", "b", "c"]).assign(key=np.arange(2000))
    got = knn_impute(spark.createDataFrame(frame), ["t"], k=3, features=["t", "a", "b", "c"], order_by=["key"]).orderBy("key").toPandas()
    np.testing.assert_allclose(got["t"].to_numpy(), filled(x, 3), rtol=1e-12)


def test_no_donor_has_what_the_recipients_have(spark, monkeypatch):
    monkeypatch.setattr(knn, "LEAF_DONORS", 20)
    rows = [(float(i), float(i % 7), None, i) for i in range(100)] + [(None, None, float(i), 100 + i) for i in range(9)]
    got = knn_impute(spark.createDataFrame(rows, "t double, a double, b double, key long"), ["t"], k=3, features=["t", "a", "b"], order_by=["key"])
    assert [r["t"] for r in got.orderBy("key").collect()] == [*map(float, range(100)), *[49.5] * 9]
