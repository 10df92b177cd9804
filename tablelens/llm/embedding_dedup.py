"""Embedding near-dedup (operator 4): a navigable small-world graph per shard.

1. Equal vectors become one class with a count.
2. Classes are dealt to shards by hash; each shard's graph is built in one task
   (a shard holds at most about ``shard_size`` vectors) and audited: vectors at
   exactly the threshold from random members must be found, or the beam widens.
3. Blocks of classes query every shard. In each such task some queries are also
   answered by an exact scan; if the beam's recall on them is below ``recall``
   the beam widens before the block is searched. A query whose beam is full of
   links is answered by an exact scan of the shard, so no number of partners is
   a limit.
4. Every link is verified by cosine in double precision, unless float32 puts it
   clear of the threshold by more than its own error.
5. Links are folded chunk by chunk into link counts and one star per component,
   so a task holds rows and never all pairs of a dense cluster; the components
   are united over all tasks.

Querying every shard costs (vectors) x (shards); shards only multiply when one
would no longer fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import connected_components, roots
from .hnsw import Hnsw

_INDEX = ("dim int, shard int, nodes binary, weights binary, vectors binary, beam int, "
          "members array<binary>, neighbours array<binary>")
_AUDIT = 192
_SLACK = 1e-4  # between float32 search and double verification
_SURE_DIM = 1024  # up to here float32 errs by less than the slack, so only cosines within it of the threshold need verification
_LINKS_AT_ONCE = 1 << 20


def _unit(table: pa.Table, dim: int) -> np.ndarray:
    """Vectors of length 1 in double precision; scaled first so squares neither vanish nor overflow."""
    flat = table["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _rows_at_once(n: int) -> int:
    return max(32, min(1024, (32 << 20) // max(1, n)))


def planted_recall(graph: Hnsw, threshold: float, beam: int, seed: int) -> float:
    """Share of random members found from a vector at the threshold from them."""
    rng = np.random.default_rng(seed)
    n, dim = graph.vectors.shape
    goal = rng.integers(0, n, min(_AUDIT, n))
    y = graph.vectors[goal].astype(np.float64)
    side = rng.normal(size=y.shape)
    side -= (side * y).sum(axis=1, keepdims=True) * y
    norm = np.linalg.norm(side, axis=1, keepdims=True)
    side = np.where(norm > 1e-9, side / np.where(norm > 0, norm, 1), 0)
    at = threshold + 0.002
    q = (at * y + np.sqrt(1 - at * at) * side).astype(np.float32)
    nodes, sims = graph.search(q, beam)
    found = (nodes == goal[:, None]).any(axis=1)
    crowded = sims[:, -1] >= threshold  # the beam is full of links: wider beams follow anyway
    return float((found | crowded).mean())


def _builder(threshold: float, recall: float, first_beam: int):
    def run(key, table):
        dim, shard = key[0].as_py(), key[1].as_py()
        table = table.sort_by("node")
        vectors = _unit(table, dim)
        graph = Hnsw.build(vectors.astype(np.float32), seed=shard)
        beam = first_beam
        while beam < len(vectors) and planted_recall(graph, threshold, beam, shard) < recall:
            beam *= 2
        lists = lambda arrays: pa.array([[a.astype("<i4").tobytes() for a in arrays]], pa.list_(pa.binary()))
        one = lambda a, kind: pa.array([np.ascontiguousarray(a, kind).tobytes()], pa.binary())
        return pa.Table.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), one(table["node"].to_numpy(), "<i8"), one(table["weight"].to_numpy(), "<i8"),
             one(vectors, "<f8"), pa.array([beam], pa.int32()), lists(graph.members), lists([x.neighbours for x in graph.layers])],
            names=["dim", "shard", "nodes", "weights", "vectors", "beam", "members", "neighbours"])
    return run


class _Shard:
    def __init__(self, index: pa.Table, dim: int) -> None:
        get = lambda c: index[c][0].as_py()
        self.nodes, self.weights = (np.frombuffer(get(c), "<i8") for c in ("nodes", "weights"))
        self.vectors = np.frombuffer(get("vectors"), "<f8").reshape(-1, dim)
        self.beam = get("beam")
        members = [np.frombuffer(m, "<i4").astype(np.int64) for m in get("members")]
        near = [np.frombuffer(a, "<i4").astype(np.int64).reshape(len(m), -1) for a, m in zip(get("neighbours"), members)]
        self.graph = Hnsw(self.vectors.astype(np.float32), members, near)

    def scan(self, q: np.ndarray, threshold: float):
        """Chunks of (query, row) of all links, by comparing with every vector of the shard."""
        step = max(1, (4 << 20) // max(1, len(self.vectors)))
        for at in range(0, len(q), step):
            sims = q[at:at + step].astype(np.float32) @ self.graph.vectors.T
            a, b = np.nonzero(sims >= threshold - _SLACK)
            for start in range(0, len(a), _LINKS_AT_ONCE):
                one, two = (x[start:start + _LINKS_AT_ONCE] for x in (a, b))
                yield self._verified(q, one + at, two, sims[one, two], threshold)

    def _verified(self, q, one, two, sims, threshold):
        keep = sims >= (threshold + _SLACK if q.shape[1] <= _SURE_DIM else np.inf)
        unsure, step = np.flatnonzero(~keep), max(1, (8 << 20) // q.shape[1])
        for at in range(0, len(unsure), step):
            s = unsure[at:at + step]
            keep[s] = np.einsum("nd,nd->n", q[one[s]], self.vectors[two[s]]) >= threshold
        return one[keep], two[keep]

    def links(self, q: np.ndarray, threshold: float, beam: int):
        """Chunks of (query, row) of the links that searches find; queries whose beams fill up with links are scanned."""
        n, crowd = len(self.vectors), np.arange(len(q))
        if beam < n:
            full, step = [crowd[:0]], _rows_at_once(n)
            for at in range(0, len(q), step):
                nodes, sims = self.graph.search(q[at:at + step].astype(np.float32), beam)
                crowded = sims[:, -1] >= threshold - _SLACK
                a, b = np.nonzero((sims >= threshold - _SLACK) & (nodes >= 0) & ~crowded[:, None])
                yield self._verified(q, a + at, nodes[a, b], sims[a, b], threshold)
                full.append(at + np.flatnonzero(crowded))
            crowd = np.concatenate(full)
        for a, b in self.scan(q[crowd], threshold):
            yield crowd[a], b

    def widened(self, q: np.ndarray, threshold: float, recall: float) -> int:
        """The first beam that finds ``recall`` of an exact scan of some of the block's queries."""
        some = q[:: max(1, len(q) // _AUDIT)]
        truth = sum(len(a) for a, _ in self.scan(some, threshold))
        beam = self.beam
        # Links found are among the true ones, each once, so their number tells the share.
        while beam < len(self.vectors) and sum(len(a) for a, _ in self.links(some, threshold, beam)) < recall * truth:
            beam *= 2
        return beam

    def audited(self, q: np.ndarray, threshold: float, recall: float):
        """All links of a block as (query, row); memory grows with the links, see :meth:`folded`."""
        found = list(self.links(q, threshold, self.widened(q, threshold, recall)))
        return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2

    def folded(self, q: np.ndarray, nodes: np.ndarray, threshold: float, recall: float):
        """Weight of each query's links to others, and one star (u, v) per component of the links.

        Every chunk of links is folded in at once, so memory grows with rows and not with links.
        """
        n, count = len(self.vectors), np.zeros(len(q), np.int64)
        at = np.minimum(np.searchsorted(self.nodes, nodes), n - 1)
        own = np.where(self.nodes[at] == nodes, at, -1)  # a query's row, if it is of this shard
        place = np.where(own >= 0, own, n + np.arange(len(q)))
        root = np.arange(n + len(q))
        for a, b in self.links(q, threshold, self.widened(q, threshold, recall)):
            other = b != own[a]
            a, b = a[other], b[other]
            count += np.bincount(a, self.weights[b], len(q)).astype(np.int64)
            one, two = root[place[a]], root[b]
            new = one != two
            if new.any():
                ends, least = roots(one[new], two[new])
                to = np.arange(len(root))
                to[ends] = least
                root = to[root]
        ids, off = np.concatenate([self.nodes, nodes]), np.flatnonzero(root != np.arange(len(root)))
        return count, ids[off], ids[root[off]]


def _searcher(threshold: float, recall: float):
    def run(key, queries, index):
        none = np.zeros(0, np.int64)
        u, v, weight = none, none, none
        if len(queries) and len(index):
            dim = key[0].as_py()
            shard, nodes = _Shard(index, dim), queries["node"].to_numpy()
            count, u, v = shard.folded(_unit(queries, dim), nodes, threshold, recall)
            linked = np.flatnonzero(count)
            weight = np.concatenate([count[linked], np.zeros(len(u), np.int64)])
            u, v = np.concatenate([nodes[linked], u]), np.concatenate([nodes[linked], v])
        return pa.Table.from_arrays([pa.array(u), pa.array(v), pa.array(weight)], names=["u", "v", "links"])
    return run


def dedup_embeddings(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", threshold: float = 0.95,
                     recall: float = 0.98, first_beam: int = 64, shard_size: int = 1 << 17, min_shards: int = 4,
                     small_shard: int = 1024) -> DataFrame:
    """Link vectors with cosine >= ``threshold`` and unite linked ones.

    Returns per input row: ``vec_id``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest vec_id reachable, its own included), ``kept``
    (vec_id = component_id).

    Vectors that are null, empty, zero or hold a null or non-finite component
    link with nothing; vectors of different lengths don't link. Equal vectors
    always link. Rows that repeat a vec_id are vectors of their own; a null
    vec_id is named only where its component has no other, and then counts as
    kept. An empty table gives an empty result. The graphs can miss links (the
    audits bound how many); they never add one.
    """
    e = F.col("embedding")
    odd = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.withColumn("valid", F.coalesce(e.isNotNull() & ~odd & F.exists(e, lambda x: x != 0), F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")})
    classes = cut(rows.where("valid").groupBy("h1", "h2")
                  .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("embedding").alias("embedding"))
                  .withColumns({"node": F.monotonically_increasing_id(), "dim": F.size("embedding")}), "classes")
    plan = []
    for dim, n in sorted((r["dim"], r["count"]) for r in classes.groupBy("dim").count().collect()):  # one row per vector length
        shards = max(min(min_shards, -(-n // small_shard)), -(-n // shard_size))
        block = max(4096, n // shards // 2)
        plan.append((dim, shards, -(-n // block)))
    sizes = F.broadcast(vectors.sparkSession.createDataFrame(plan, "dim int, shards int, blocks int"))
    placed = classes.join(sizes, "dim")
    index = cut(placed.select("dim", F.pmod(F.xxhash64("node"), "shards").cast("int").alias("shard"), "node", "weight", "embedding")
                .groupBy("dim", "shard").applyInArrow(_builder(threshold, recall, first_beam), _INDEX), "graphs")
    queries = placed.select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
                            F.pmod(F.xxhash64(F.lit(1), "node"), "blocks").cast("int").alias("block"), "node", "embedding")
    copies = index.join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = cut(queries.groupBy("dim", "shard", "block").cogroup(copies.drop("shards", "blocks").groupBy("dim", "shard", "block"))
                .applyInArrow(_searcher(threshold, recall), "u long, v long, links long"), "links")

    counts = found.where("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("u <> v").select("u", "v"))
    named = (classes.select("h1", "h2", "node", "least", "weight").join(counts, "node", "left").join(groups, "node", "left")
             .withColumn("root", F.coalesce("component", "node")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("h1", "h2", F.lit(True).alias("valid"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    return (rows.drop("embedding").join(named, ["h1", "h2", "valid"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("valid"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
