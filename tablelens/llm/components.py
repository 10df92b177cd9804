"""Connected components of an edge table, without collecting it.

Alternating large-star and small-star steps (Kiveris et al., 2014): every step
re-hangs neighbours on the smallest node they know, until each component is one
star around its smallest node. A node's neighbours are never gathered: minima
are aggregated map-side and joined back, so a hub is a skewed join key that
adaptive execution splits, not a group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_stage

_MAX_ROUNDS = 60


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b) and the smallest node of each one's component."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = ends[: len(a)], ends[len(a):]
    low = np.arange(len(nodes))
    while True:
        least = np.minimum(low[u], low[v])
        new = low.copy()
        np.minimum.at(new, low[u], least)
        np.minimum.at(new, low[v], least)
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _forest(batches):
    """Each batch of edges -> one star per component in it: never more rows than nodes."""
    for batch in batches:
        nodes, root = roots(batch.column("u").to_numpy(), batch.column("v").to_numpy())
        off = nodes != root
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(root[off])], names=["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (u long, v long) -> (node, component), component = smallest node reachable.

    A component's smallest node does not appear itself, nor do nodes without an
    edge to another. Loops and repeated edges are allowed; an empty table gives
    an empty result. Null ends are not allowed.
    """
    e = (edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
         .mapInArrow(_forest, "u long, v long").distinct())
    e = cut(e, "edges")
    before = None
    for _ in range(_MAX_ROUNDS):
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before, old = now, e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        e = cut(small, "small-star")
        drop_stage(old)
        drop_stage(large)
    raise RuntimeError(f"components did not settle in {_MAX_ROUNDS} rounds")
