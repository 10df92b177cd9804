"""D4 — exact k-nearest-neighbour imputation by a partitioned k-d tree.

Semantics (KNNImputer, uniform weights, *nan-euclidean* metric): for a row r
missing column c, donors are rows with c present; the distance to donor d is
``sqrt(F/|P| · Σ_{j∈P} (r_j − d_j)²)`` over the coordinates P present in both
(F = number of features); donors sharing no coordinate are skipped; the fill
is the mean of c over the k nearest (fewer if fewer exist, the column mean if
none). Ties are broken by the donor's row key.

Plan (exact, any number of features, each with gaps or without):

* No donor comes before one at distance zero with a smaller key. So each recipient
  first looks for equal values (in all features shared) among the donors of the
  smallest keys, about ``EARLY_DONORS`` of them, by look-ups without any distance. One that
  finds k there is settled; only the rest goes on. Where few features are shared or
  values repeat, that is nearly every recipient of a large table. The look-up is
  left out where it would copy more rows than the table has, four times over.
* The upper part of a k-d tree is cut from a bounded sample of donors: at most
  ``MAX_LEAVES`` leaves of about ``LEAF_DONORS`` donors. It parts donors by the
  features they have before it parts them by values, so most leaves hold donors
  of equal features and have sharp bounds. Every donor goes down it to one leaf
  and is staged once. Each leaf's bounding box (least and largest
  value, and how many donors have one, per feature) comes from all its donors.
* A box gives a lower bound of the distance to anything in it, over all
  features the recipient has: a feature that every donor of the box has counts
  with its gap; of those that only some have, just the ones that lower the mean
  gap do.
* Round one sends a recipient to the leaf where the k-th donor is likely nearest
  (by its bound and how densely it holds donors), or as many as are sure to hold
  k donors, which gives it a radius: the k-th distance found. Round two
  sends it to every other leaf whose bound is within the radius. So two rounds
  are always enough.
* Within a leaf a task goes on with the tree down to blocks of ``BLOCK`` donors
  that have the same features, and measures only blocks within the radius.

Many recipients of one leaf are dealt to several tasks, with a copy of the leaf's
donors each. Donors of equal features (besides the target) are cut to the k
smallest row keys (only those can be chosen), equal recipients are solved once.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.fit import BROADCAST_KEYS, clean_value, col, collect_bounded, materialize, one_row, typed_lit

LEAF_DONORS = 1 << 16
MAX_LEAVES = 4096
SAMPLE_PER_LEAF = 32
BLOCK = 256
#: Recipients of one leaf that a task takes.
TASK_RECIPIENTS = 1 << 14
#: Donors of the smallest keys in which equal values are looked up first.
EARLY_DONORS = 1 << 19
#: Recipients of the same features that a task looks up, times k.
EARLY_FOUND = 1 << 20
_EARLY_SETS = 64  # of features that recipients have, at most
_TINY = 1e-140  # squares of gaps between larger numbers are not lost
_QUERIES = 128  # sent to leaves together
_PAIRS = 512  # of a query and a block, measured together
_FOUND = 1 << 18  # candidates of them that are kept before they are cut to the k nearest
#: Bounds are lowered by this share, more than rounding can add to them.
_SLACK = 1e-9


def _split(points: np.ndarray, splits: np.ndarray, lack: np.ndarray, reach: float) -> tuple[int, float] | None:
    """Feature and threshold that halve the points; None if no feature has two values.

    A query that lacks the feature (a share ``lack`` of them) meets both halves, so the more often a
    feature was used (``splits``) the less it helps; one that has it meets both if the threshold lies
    within its ``reach``. The split of least expected work is chosen, the widest where reach is unknown.
    """
    here = ~np.isnan(points)
    with np.errstate(invalid="ignore"):
        low = np.where(here, points, np.inf).min(axis=0)
        high = np.where(here, points, -np.inf).max(axis=0)
        width = np.where(high > low, high - low, 0.0)
    fit = (width > 0) & np.isfinite(width)
    if not fit.any():
        return None
    width = np.where(fit, width, 1.0)
    if np.isfinite(reach):
        work = (1 - lack + lack * 2.0 ** (splits + 1)) / (1 - lack + lack * 2.0**splits) * (width / 2 + 2 * reach) / (width + 2 * reach)
        work = 1 - (1 - work) * here.mean(axis=0)
    else:
        work = -width * here.mean(axis=0)
    f = int(np.where(fit, work, np.inf).argmin())
    values = points[here[:, f], f]
    cut = float(np.median(values))
    return f, cut if cut > low[f] else float(values[values > low[f]].min())


def _gaps(points: np.ndarray) -> tuple[int, float] | None:
    """Feature that most evenly is there or missing, and a threshold above all its values; None if none has gaps."""
    share = np.isnan(points).mean(axis=0)
    share = np.minimum(share, 1 - share)
    f = int(share.argmax())
    return (f, np.inf) if share[f] > 0 else None


def _likely_radius(sample: np.ndarray, donors: int, k: int) -> float:
    """The k-th donor's distance, were the donors of each set of features spread evenly: the least over those sets."""
    sets, of = np.unique(~np.isnan(sample), axis=0, return_inverse=True)
    least = math.inf
    for s, has in enumerate(sets):
        own = sample[of.ravel() == s][:, has]
        width = own.max(axis=0) - own.min(axis=0) if has.any() else np.zeros(0)
        if width.size and np.isfinite(width).all():
            share = k * len(sample) / (donors * len(own))
            least = min(least, math.sqrt(len(has) / len(width)) * math.exp((np.log(np.maximum(width, 1e-9)).sum() + math.log(share)) / len(width)))
    return least


class TopTree:
    """Split planes that send any point to one of ``leaves`` leaves; a missing value goes right.
    Points are parted by their gaps first, and leaves dealt to both sides by their share of the sample."""

    def __init__(self, sample: np.ndarray, most_leaves: int, lack: np.ndarray | None = None, reach: float = math.inf):
        self.lack, self.reach = np.zeros(sample.shape[1]) if lack is None else lack, reach
        self.feature, self.cut, self.child, self.leaves = [], [], [], 0
        self._grow(sample, most_leaves, np.zeros(sample.shape[1]))
        self.feature, self.cut, self.child = np.array(self.feature), np.array(self.cut), np.array(self.child).reshape(-1, 2)

    def _grow(self, points: np.ndarray, most: int, splits: np.ndarray) -> int:
        """The node's number, or -1 - leaf."""
        plane = (_gaps(points) or _split(points, splits, self.lack, self.reach)) if most > 1 and len(points) > 1 else None
        if plane is None:
            self.leaves += 1
            return -self.leaves
        node = len(self.feature)
        self.feature.append(plane[0])
        self.cut.append(plane[1])
        self.child.append([0, 0])
        left = points[:, plane[0]] < plane[1]
        own = min(max(1, round(most * left.mean())), most - 1)
        splits = splits + ((np.arange(len(splits)) == plane[0]) & np.isfinite(plane[1]))
        self.child[node] = [self._grow(points[left], own, splits), self._grow(points[~left], most - own, splits)]
        return node

    def leaf(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), 0 if len(self.feature) else -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            node = at[inner]
            left = points[inner, self.feature[node]] < self.cut[node]
            at[inner] = self.child[node, np.where(left, 0, 1)]
        return -1 - at


def lower_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray, some: np.ndarray, every: np.ndarray) -> np.ndarray:
    """Least distance of each query to any donor of each box; infinite where no donor can share a feature."""
    n_features = queries.shape[1]
    must, n_must = np.zeros((len(queries), len(low))), np.zeros((len(queries), len(low)))
    mixed = np.flatnonzero((some & ~every).any(axis=1))  # boxes that hold features only some of their donors have
    may = np.full((n_features, len(queries), len(mixed)), np.inf)
    for f in np.flatnonzero(~np.isnan(queries).all(axis=0)):
        q = queries[:, [f]]
        has = ~np.isnan(q)
        with np.errstate(invalid="ignore"):
            gap = np.maximum(np.maximum(low[None, :, f] - q, q - high[None, :, f]), 0.0) ** 2
        sure = has & every[None, :, f]
        must += np.where(sure, gap, 0.0)
        n_must += sure
        if len(mixed):
            may[f] = np.where(has & (some & ~every)[None, mixed, f], gap[:, mixed], np.inf)
    with np.errstate(invalid="ignore", divide="ignore"):
        best = np.where(n_must > 0, must / n_must, np.inf)
        if len(mixed):  # the optional gaps in ascending order, as long as they lower the mean
            may.sort(axis=0)
            total = must[:, mixed] + np.cumsum(may, axis=0)
            for f in range(n_features):
                best[:, mixed] = np.fmin(best[:, mixed], total[f] / (n_must[:, mixed] + f + 1))
    return np.sqrt(n_features * best) * (1 - _SLACK)


def _blocks(points: np.ndarray, lack: np.ndarray | None = None, reach: float = math.inf) -> list[np.ndarray]:
    """Row numbers in blocks of near rows that have the same features (``lack`` and ``reach``: see :func:`_split`)."""
    lack, none = np.zeros(points.shape[1]) if lack is None else lack, np.zeros(points.shape[1])
    masks, out = np.zeros(len(points), np.int64), []
    for gap in np.isnan(points).T:
        masks = np.unique(2 * masks + gap, return_inverse=True)[1]
    todo = [(np.flatnonzero(masks == m), none) for m in range(masks.max(initial=-1) + 1)]
    while todo:
        rows, splits = todo.pop()
        plane = _split(points[rows], splits, lack, reach) if len(rows) > BLOCK else None
        if plane is None:
            out += [rows[a:a + BLOCK] for a in range(0, len(rows), BLOCK)]
        else:
            left = points[rows, plane[0]] < plane[1]
            splits = splits + (np.arange(len(splits)) == plane[0])
            todo += [(rows[left], splits), (rows[~left], splits)]
    return out


def distances(queries: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """nan-euclidean distances; infinite where no coordinate is shared."""
    squares, shared = np.zeros((len(queries), len(donors))), np.zeros((len(queries), len(donors)))
    for f in np.flatnonzero(~np.isnan(queries).all(axis=0)):
        apart = queries[:, [f]] - donors[None, :, f]
        both = ~np.isnan(apart)
        squares += np.where(both, apart * apart, 0.0)
        shared += both
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(shared > 0, np.sqrt(queries.shape[1] / shared * squares), np.inf)


def _best(query: np.ndarray, distance: np.ndarray, donor: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k nearest, ties by donor."""
    order = np.lexsort((donor, distance, query))
    query = query[order]
    first = np.searchsorted(query, query)
    return order[np.arange(len(order)) - first < k]


class _Blocks:
    """Donors in blocks of near ones that have the same features, measured many (query, block) pairs at once."""

    def __init__(self, donors: np.ndarray, lack: np.ndarray, reach: float):
        blocks = _blocks(donors, lack, reach)
        self.sizes = np.array([len(b) for b in blocks])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.rows = np.concatenate(blocks)
        points = donors[self.rows]
        self.has = ~np.isnan(points[self.starts])
        self.low, self.high = np.minimum.reduceat(points, self.starts), np.maximum.reduceat(points, self.starts)
        self.columns = np.nan_to_num(points.T, nan=0.0, posinf=np.inf, neginf=-np.inf).copy()

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least distance of each block to a box around all queries, which have the same features."""
        both = self.has & ~np.isnan(queries[0])
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = np.maximum(np.maximum(self.low - queries.max(axis=0), queries.min(axis=0) - self.high), 0.0)
            return np.nan_to_num(np.sqrt(queries.shape[1] / both.sum(axis=1) * np.where(both, gap * gap, 0.0).sum(axis=1)), nan=np.inf, posinf=np.inf) * (1 - _SLACK)

    def measure(self, queries: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """nan-euclidean distances of each query to its block's donors, infinite beyond the block's end
        or where no coordinate is shared, and the donors' places in ``rows``."""
        place = np.arange(self.sizes[block].max(initial=1))
        at = np.minimum(self.starts[block][:, None] + place, len(self.rows) - 1)
        both = self.has[block] & ~np.isnan(queries)
        squares, shared = np.zeros(at.shape), both.sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            for f in np.flatnonzero(both.any(axis=0)):
                apart = np.where(both[:, f], queries[:, f], 0.0)[:, None] - self.columns[f][at]
                squares += np.where(both[:, [f]], apart * apart, 0.0)
            distance = np.sqrt((queries.shape[1] / shared)[:, None] * squares)
        distance[(place >= self.sizes[block][:, None]) | (shared == 0)[:, None] | np.isnan(distance)] = np.inf
        return distance, at


def nearest(queries: np.ndarray, donors: np.ndarray, k: int, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, donor) of each query's k nearest donors within its radius, ties to the lower donor row."""
    none = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    if not len(queries) or not len(donors):
        return none
    donors = np.where(np.isnan(queries).all(axis=0), np.nan, donors)  # what no query has tells nothing
    lack, reach = np.isnan(queries).mean(axis=0), float(np.median(radius))
    blocks, found = _Blocks(donors, lack, reach), []
    for own in _blocks(queries, lack, reach):  # near queries of equal features want the same blocks
        some, limit = queries[own], radius[own].copy()
        at_hand = np.flatnonzero(blocks.bounds(some) <= limit.max())
        if not len(at_hand):
            continue
        sizes = blocks.sizes[at_hand]
        bound = lower_bounds(some, blocks.low[at_hand], blocks.high[at_hand], blocks.has[at_hand], blocks.has[at_hand])
        # Where many donors may lie within the radius, the blocks of least bound that hold k donors together give a smaller one.
        wide = np.flatnonzero((((bound <= limit[:, None]) & np.isfinite(bound)) @ sizes > 4 * max(k, BLOCK)) & (limit > 0))
        first = bound[wide].argmin(axis=1)
        lone = (sizes[first] >= k) & np.isfinite(bound[wide, first])
        if lone.any():
            q = wide[lone]
            limit[q] = np.minimum(limit[q], np.partition(blocks.measure(some[q], at_hand[first[lone]])[0], k - 1, axis=1)[:, k - 1])
        for q in wide[~lone]:
            rank = np.argsort(bound[q])
            rank = rank[np.isfinite(bound[q, rank])]
            held = np.cumsum(sizes[rank])
            if len(rank) and held[-1] >= k:
                rank = rank[:(held < k).sum() + 1]
                near = blocks.measure(np.repeat(some[[q]], len(rank), axis=0), at_hand[rank])[0].ravel()
                limit[q] = min(limit[q], np.partition(near, k - 1)[k - 1])
        query, block = np.nonzero((bound <= limit[:, None]) & np.isfinite(bound))
        parts = []
        for a in range(0, len(query), _PAIRS):
            i, b = query[a:a + _PAIRS], at_hand[block[a:a + _PAIRS]]
            d, place = blocks.measure(some[i], b)
            x, y = np.nonzero((d <= limit[i][:, None]) & np.isfinite(d))
            parts.append((i[x], d[x, y], blocks.rows[place[x, y]]))
            if sum(len(p[0]) for p in parts) > _FOUND:
                i, d, j = (np.concatenate(c) for c in zip(*parts))
                keep = _best(i, d, j, k)
                parts = [(i[keep], d[keep], j[keep])]
        if parts:
            i, d, j = (np.concatenate(c) for c in zip(*parts))
            keep = _best(i, d, j, k)
            found.append((own[i[keep]], d[keep], j[keep]))
    if not found:
        return none
    query, distance, donor = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(query, kind="stable")
    return query[order], distance[order], donor[order]


def equal_donors(queries: np.ndarray, donors: np.ndarray, k: int) -> np.ndarray:
    """Rows of each query's first k donors at distance zero, ``len(donors)`` where there are fewer.

    All queries have the same features. A query near numbers so small that the square of a
    gap would be lost gets none.
    """
    found = np.full((len(queries), k), len(donors))
    if not len(queries) or not len(donors):
        return found
    features = np.flatnonzero(~np.isnan(queries[0]))
    tiny, none = (donors != 0) & (np.abs(donors) < _TINY), queries == 0
    lost = ((none & tiny.any(axis=0)) | (~none & (np.abs(queries) < _TINY))).any(axis=1)
    masks = np.zeros(len(donors), np.int64)
    for f in features:
        masks = np.unique(2 * masks + ~np.isnan(donors[:, f]), return_inverse=True)[1]
    for m in range(masks.max() + 1):  # donors that share the same features with the queries
        rows = np.flatnonzero(masks == m)
        shared = [f for f in features if not np.isnan(donors[rows[0], f])]
        if not shared:
            continue
        code, own, wanted = np.zeros(len(rows), np.int64), np.flatnonzero(~lost), np.zeros((~lost).sum(), np.int64)
        for f in shared:
            values, place = np.unique(donors[rows, f], return_inverse=True)
            q = queries[own, f]
            at = np.minimum(np.searchsorted(values, q), len(values) - 1)
            same = (values[at] == q) & np.isfinite(q)
            levels, code = np.unique(code * len(values) + place, return_inverse=True)
            own, wanted = own[same], wanted[same] * len(values) + at[same]
            at = np.minimum(np.searchsorted(levels, wanted), len(levels) - 1)
            same = levels[at] == wanted
            own, wanted = own[same], at[same]
            if not len(own):
                break
        else:
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code))
            place = np.concatenate([[0], ends])[wanted][:, None] + np.arange(k)
            more = np.where(place < ends[wanted][:, None], rows[order[np.minimum(place, len(rows) - 1)]], len(donors))
            found[own] = np.sort(np.concatenate([found[own], more], axis=1), axis=1)[:, :k]
    return found


def _matrix(table: pa.Table | pa.RecordBatch, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([pc.fill_null(table.column(n), math.nan).to_numpy() for n in names]) if table.num_rows else np.zeros((0, len(names)))


def _search(feats: list[str], keys: list[str], target: str, k: int):
    """Cogroup of a leaf's recipients and donors -> (rid, distance, value, keys…), at most k rows a recipient."""
    def run(recipients: pa.Table, donors: pa.Table) -> pa.Table:
        donors = donors.take(pc.sort_indices(donors, [(c, "ascending") for c in keys], null_placement="at_start"))
        queries = _matrix(recipients, feats)
        q, d, j = nearest(queries, _matrix(donors, feats), k, recipients.column("radius").to_numpy())
        chosen = donors.take(pa.array(j))
        return pa.table([recipients.column("rid").take(pa.array(q)), pa.array(d), chosen.column(target), *(chosen.column(c) for c in keys)],
                        names=["rid", "distance", "value", *keys])
    return run


def _look_up(feats: list[str], keys: list[str], target: str, k: int):
    """Cogroup of recipients of the same features and early donors -> the recipients and ``_fill``, null if not settled."""
    def run(recipients: pa.Table, donors: pa.Table) -> pa.Table:
        donors = donors.take(pc.sort_indices(donors, [(c, "ascending") for c in keys], null_placement="at_start"))
        queries, values = _matrix(recipients, feats)[:, 1:], donors.column(target).to_numpy()
        found = equal_donors(queries, _matrix(donors, feats)[:, 1:], k)
        settled, fill = found[:, -1] < len(values), np.zeros(len(queries))
        fill[settled] = values[found[settled]].mean(axis=1)
        return recipients.select([*feats, "rid", "radius"]).append_column("_fill", pa.array(fill, mask=~settled))
    return run


def _settle(recipients: DataFrame, donors: DataFrame, rows: int, feats: list[str], keys: list[str], k: int) -> tuple[DataFrame, int]:
    """Recipients with ``_fill``, which is not null if k of the donors with the smallest keys are at distance
    zero, and how many recipients there are. ``rows``: of the table."""
    others = feats[1:]
    recipients = recipients.withColumn("has", F.concat(*[F.when(F.col(f).isNull(), "0").otherwise("1") for f in others]))
    sets = recipients.groupBy("has").agg(F.count("*").alias("n")).limit(_EARLY_SETS + 1).collect()
    tasks = {r["has"]: math.ceil(r["n"] * k / EARLY_FOUND) for r in sets if "1" in r["has"]}
    unsettled = recipients.drop("has").withColumn("_fill", F.lit(None).cast("double"))
    if len(sets) > _EARLY_SETS:
        return unsettled, unsettled.count()
    n = sum(r["n"] for r in sets)
    most = min(EARLY_DONORS, 4 * rows // max(1, sum(tasks.values())))
    every = max(1, most >> 10)
    wanted = most // every
    least = donors.where(F.pmod(F.xxhash64(*feats, *keys), F.lit(every)) == 0).select(*keys).orderBy(*keys).limit(wanted)
    last = collect_bounded(least, wanted)
    early = donors
    if len(last) == wanted > 0:
        early = donors.where(F.struct(*keys) <= F.struct(*[typed_lit(last[-1][c], donors.schema[c].dataType).alias(c) for c in keys]))
    if not tasks or not wanted or early.count() > 4 * most:  # keys that repeat very often
        return unsettled, n
    at = F.create_map(*[F.lit(x) for pair in tasks.items() for x in pair])
    left = recipients.withColumn("salt", F.pmod(F.xxhash64("rid"), F.coalesce(at[F.col("has")], F.lit(1))).cast("int"))
    right = (early.select("*", F.explode(at).alias("has", "tasks"))
             .select(*feats, *keys, "has", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("salt")))
    schema = f"{', '.join(f'{f} double' for f in feats)}, rid long, radius double, _fill double"
    return materialize(left.groupBy("has", "salt").cogroup(right.groupBy("has", "salt")).applyInArrow(_look_up(feats, keys, feats[0], k), schema)), n


def _route(tree: TopTree, feats: list[str]):
    def run(batches):
        for batch in batches:
            yield batch.append_column("leaf", pa.array(tree.leaf(_matrix(batch, feats)).astype(np.int32)))
    return run


def _assign(boxes: dict[str, np.ndarray], feats: list[str], k: int, again: bool):
    """Recipients -> one row for each leaf they are sent to: at first the nearest that surely hold k donors, then all others in the radius."""
    with np.errstate(divide="ignore", invalid="ignore"):
        width = np.nan_to_num(np.log(boxes["high"] - boxes["low"]), nan=0.0, neginf=-50.0, posinf=50.0)
        share = np.log(k / boxes["size"])[None, :]
    held_by = (boxes["present"] > 0).astype(float)

    def guess(has):
        """The k-th donor's distance from a point inside each box, were its donors spread evenly."""
        shared = np.maximum(has @ held_by.T, 1.0)
        return np.sqrt(has.shape[1] / shared) * np.exp(np.minimum((has @ (held_by * width).T + share) / shared, 300.0))

    def first(bound, has):
        sure = np.zeros(bound.shape)  # donors that share one feature at least
        for f in range(has.shape[1]):
            sure = np.maximum(sure, np.where(has[:, [f]], boxes["present"][None, :, f], 0))
        likely = bound + guess(has.astype(float))
        chosen = np.zeros(bound.shape, bool)
        best = likely.argmin(axis=1)
        one = (sure[np.arange(len(best)), best] >= k) & np.isfinite(bound[np.arange(len(best)), best])
        chosen[one, best[one]] = True
        rest = np.flatnonzero(~one)
        rank = np.argsort(likely[rest], axis=1, kind="stable")
        held = np.cumsum(np.take_along_axis(sure[rest], rank, 1), axis=1)
        wanted = (np.concatenate([np.zeros((len(rest), 1)), held[:, :-1]], axis=1) < k) & np.isfinite(np.take_along_axis(bound[rest], rank, 1))
        some = np.zeros((len(rest), bound.shape[1]), bool)
        np.put_along_axis(some, rank, wanted, 1)
        chosen[rest] = some
        return chosen

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _QUERIES):
                batch = whole.slice(at, _QUERIES)
                queries = _matrix(batch, feats)
                bound = lower_bounds(queries, boxes["low"], boxes["high"], boxes["present"] > 0, boxes["present"] == boxes["size"][:, None])
                chosen = first(bound, ~np.isnan(queries))
                if again:
                    chosen = ~chosen & (bound <= batch.column("radius").to_numpy()[:, None]) & np.isfinite(bound)
                q, leaf = np.nonzero(chosen)
                out = batch.take(pa.array(q))
                yield out.append_column("leaf", pa.array(boxes["leaf"][leaf].astype(np.int32)))
    return run


def _in_leaves(recipients: DataFrame, donors: DataFrame, counts: dict[int, int], feats, keys, k, schema) -> DataFrame:
    """Candidates of recipients in their leaves; leaves of many recipients are dealt to several tasks."""
    tasks = [math.ceil(counts.get(leaf, 0) / TASK_RECIPIENTS) for leaf in range(max(counts, default=0) + 1)]
    salts = F.coalesce(F.get(F.lit(tasks), F.col("leaf")), F.lit(0))
    left = recipients.withColumn("salt", F.pmod(F.xxhash64("rid"), salts).cast("int"))
    right = donors.where(salts > 0).withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.groupBy("leaf", "salt").cogroup(right.groupBy("leaf", "salt")).applyInArrow(_search(feats, keys, feats[0], k), schema)


def _boxes(donors: DataFrame, feats: list[str]) -> dict[str, np.ndarray]:
    aggs = [f(c).alias(f"{name}_{c}") for c in feats for name, f in (("low", F.min), ("high", F.max), ("present", F.count))]
    rows = collect_bounded(donors.groupBy("leaf").agg(F.count("*").alias("size"), *aggs).orderBy("leaf"), MAX_LEAVES)
    out = {name: np.array([[math.nan if r[f"{name}_{c}"] is None else r[f"{name}_{c}"] for c in feats] for r in rows], float) for name in ("low", "high", "present")}
    return out | {"leaf": np.array([r["leaf"] for r in rows]), "size": np.array([r["size"] for r in rows])}


def knn_fill_column(df: DataFrame, target: str, features: Sequence[str], key: Sequence[str],
                    k: int = 5) -> DataFrame:
    """Distinct recipient vectors with their fill: r0, r1, … (by ``features``, the target's null) and ``_fill``."""
    if target not in features:
        raise ValueError("the target column must be one of the features")
    names = [target, *(f for f in features if f != target)]
    feats, keys = [f"f{i}" for i in range(len(names))], [f"k{i}" for i in range(len(key))]
    base = df.select(*[col(c).alias(kc) for c, kc in zip(key, keys)], *[clean_value(df, n).cast("double").alias(f) for n, f in zip(names, feats)])
    own, others = feats[0], feats[1:]
    counts = one_row(base.agg(F.count(own).alias("donors"), F.count_if(F.col(own).isNull()).alias("recipients"), F.avg(own).alias("mean"),
                             *[F.count_if(F.col(own).isNull() & F.col(f).isNull()).alias(f"lack_{f}") for f in feats]))
    if counts["donors"] == 0:
        from .impute import ImputePlanError
        raise ImputePlanError(f"column {target!r} has no value to learn from")
    vectors = base.where(F.col(own).isNull()).select(*feats).distinct()
    back = [F.col(feats[names.index(f)]).alias(f"r{i}") for i, f in enumerate(features)]
    mean = F.lit(counts["mean"]).cast("double")
    if not others or counts["recipients"] == 0:
        return vectors.select(*back, mean.alias("_fill"))

    def distinct_donors(rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy(*others).orderBy(*keys))
        return rows.where(F.coalesce(*others).isNotNull()).withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")
    donors = base.where(F.col(own).isNotNull() & F.coalesce(*others).isNotNull())
    schema = f"rid long, distance double, value double, {', '.join(f'{c} {base.schema[c].dataType.simpleString()}' for c in keys)}"
    recipients = materialize(vectors.withColumn("rid", F.monotonically_increasing_id()).withColumn("radius", F.lit(math.inf)))
    leaves = min(MAX_LEAVES, math.ceil(counts["donors"] / LEAF_DONORS))
    if leaves == 1:
        found = _in_leaves(recipients.withColumn("leaf", F.lit(0)), distinct_donors(donors).withColumn("leaf", F.lit(0)), {0: counts["recipients"]}, feats, keys, k, schema)
    else:
        every, n_vectors = _settle(recipients, donors, counts["donors"] + counts["recipients"], feats, keys, k)
        settled = every.where(F.col("_fill").isNotNull() | F.coalesce(*others).isNull()).select(*back, F.coalesce("_fill", mean).alias("_fill"))

        def with_settled(filled: DataFrame) -> DataFrame:
            both = settled.unionByName(filled)  # Spark would size it by its compressed files
            return both.hint("merge") if n_vectors > BROADCAST_KEYS else both
        recipients = every.where(F.col("_fill").isNull() & F.coalesce(*others).isNotNull()).drop("_fill")
        counts = counts.asDict() | one_row(recipients.agg(F.count("*").alias("recipients"), *[F.count_if(F.col(f).isNull()).alias(f"lack_{f}") for f in feats])).asDict()
        averaged = recipients.select(*back, mean.alias("_fill"))
        if counts["recipients"] == 0:
            return with_settled(averaged)
        # What no recipient left has tells nothing.
        donors = distinct_donors(donors.withColumns({f: F.lit(None).cast("double") for f in others if counts[f"lack_{f}"] == counts["recipients"]}))
        wanted = leaves * SAMPLE_PER_LEAF
        share = int(min(1.0, wanted / counts["donors"]) * 1_000_000)
        sample = collect_bounded(donors.where(F.pmod(F.xxhash64(*feats), F.lit(1_000_000)) < share).select(*feats), 4 * wanted)
        points = np.array([[math.nan if v is None else v for v in r] for r in sample], float).reshape(-1, len(feats))
        points[:, 0] = math.nan  # no recipient has the target
        lack = np.array([counts[f"lack_{f}"] for f in feats]) / counts["recipients"]
        tree = TopTree(points, leaves, lack, _likely_radius(points, counts["donors"], k))
        placed = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in donors.schema.fields)}, leaf int"
        donors = materialize(donors.mapInArrow(_route(tree, feats), placed))
        boxes = _boxes(donors, feats)
        if not len(boxes["size"]):
            return with_settled(averaged)
        sent = f"{', '.join(f'{f} double' for f in feats)}, rid long, radius double, leaf int"

        def round_of(rows: DataFrame, again: bool) -> DataFrame:
            pairs = materialize(rows.mapInArrow(_assign(boxes, feats, k, again), sent))
            per_leaf = {r["leaf"]: r["n"] for r in collect_bounded(pairs.groupBy("leaf").agg(F.count("*").alias("n")), MAX_LEAVES)}
            return _in_leaves(pairs, donors, per_leaf, feats, keys, k, schema)
        near = materialize(round_of(recipients, False))
        ranked = near.withColumn("nth", F.row_number().over(Window.partitionBy("rid").orderBy("distance")))
        radius = ranked.where(F.col("nth") == k).select("rid", F.col("distance").alias("radius"))
        wider = recipients.drop("radius").join(radius, "rid", "left").select(*feats, "rid", F.coalesce("radius", F.lit(math.inf)).alias("radius"))
        found = near.unionByName(round_of(wider, True))
        nth = F.row_number().over(Window.partitionBy("rid").orderBy("distance", *keys))
        found = found.withColumn("nth", nth).where(F.col("nth") <= k)
    fills = found.groupBy("rid").agg(F.avg("value").alias("_fill"))
    filled = recipients.join(fills, "rid", "left").select(*back, F.coalesce("_fill", mean).alias("_fill"))
    return filled if leaves == 1 else with_settled(filled)


def knn_impute(df: DataFrame, targets: Sequence[str], k: int = 5, features: Sequence[str] | None = None,
               order_by: Sequence[str] | None = None) -> DataFrame:
    """Fill every column of ``targets`` with the mean of its k nearest donors.

    ``features`` defaults to ``targets`` (the imputer is fitted on the selected
    columns only); ``order_by`` is a unique row key used for tie-breaking. NaN
    counts as missing, in targets and in features; a target without any value is
    an error.
    """
    if not order_by:
        raise ValueError("knn_impute needs order_by= (a unique row key) for deterministic ties")
    if k < 1:
        raise ValueError("k must be at least 1")
    feats = list(features) if features else list(targets)
    feats += [t for t in targets if t not in feats]
    own = {f: F.col(f"_f_{i}") for i, f in enumerate(feats)}
    rows = df.select(*[col(c) for c in df.columns], *[clean_value(df, f).cast("double").alias(f"_f_{i}") for i, f in enumerate(feats)])
    lacking = F.lit(False)
    for t in targets:
        lacking = lacking | own[t].isNull()
    filled = rows.where(lacking)  # other rows need no fill and no join
    for n, t in enumerate(targets):
        fills = knn_fill_column(df, t, feats, list(order_by), k).withColumnRenamed("_fill", f"_fill_{n}")
        filled = filled.join(fills, [own[f].eqNullSafe(F.col(f"r{i}")) for i, f in enumerate(feats)], "left").drop(*[f"r{i}" for i in range(len(feats))])

    def result(frame: DataFrame, fill: bool) -> DataFrame:
        values = {t: F.coalesce(own[t], F.col(f"_fill_{n}")) if fill else own[t] for n, t in enumerate(targets)}
        return frame.select(*[values[c].alias(c) if c in values else col(c) for c in df.columns])
    return result(rows.where(~lacking), False).unionByName(result(filled, True))
