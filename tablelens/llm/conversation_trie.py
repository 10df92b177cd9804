"""Conversation prefix trie (operator 11): SQL ROLLUP over positional turn-id columns.

Every sequence of first turns that some conversation starts with is a node; the
conversations that start with it are its members. A conversation's turns are
laid out in blocks of ``width`` positional columns, one row per block:

``k1..k4, block`` (the node at which the prior block ended), ``a1, b1, n1, ...``
(each turn's 120-bit id in two longs, and its code points).

``GROUP BY k1..k4, block, ROLLUP((a1, b1, n1), (a2, b2, n2), ...)`` then counts
all prefixes of all blocks at once, and ``grouping_id`` tells how many columns a
row stands for. A node's key is the sum of hashes of (position, turn id) over
its turns, in four lanes of 32 bits. A sum needs no order, so the keys of all
blocks are prefix sums, worked out for conversations of any length together and
not block after block.

Sums over a subtree come from the same ROLLUP. A node is called after its
smallest member; a conversation so owns a run of nodes down to its own end, and
a subtree's nodes are what its members own, less what its smallest member owns
above it. So per conversation the code points and leaves it owns are enough.

No group is taken whole into a task: turns are numbered in range partitions,
prefix sums go over chunks of 1,024 blocks, ROLLUP combines in the map tasks,
parents are joined (a much-forked node is a skewed join, which Spark splits),
and the ids of conversations that end at one node are sorted and joined in
range partitions. Only the last step of ``ends_sha256``, which is one chain by its
definition, streams a node's pieces through one task, a piece at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, shuffle_parts

#: Turn-id columns in a block, blocks in a chunk of prefix sums.
WIDTH = 6
CHUNK = 1024
#: Ids of conversations joined into one piece of text.
PIECE_IDS = 1 << 15
KEYS = ["k1", "k2", "k3", "k4"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _number(batches):
    """(conv_id, part, seq, a, b, chars): seq counts a conversation's turns within the partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        first = np.r_[True, conv[1:] != conv[:-1]]
        at = np.flatnonzero(first)
        seq = np.arange(len(conv)) - np.repeat(at, np.diff(np.r_[at, len(conv)]))
        if conv[0] == last:
            seq[:at[1] if len(at) > 1 else len(conv)] += seen
        last, seen = conv[-1], int(seq[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(np.full(len(conv), part, np.int32)), pa.array(seq),
             *(batch.column(c) for c in ("a", "b", "chars"))], names=["conv_id", "part", "seq", "a", "b", "chars"])


def number_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, pos, a, b, chars): every turn's place in its conversation from 1, its id and its code points.

    Turns go by ``turn``, null first, and where that ties by the md5 of role and
    text. A null role or text is empty. A turn without a conv_id belongs to no
    conversation and is left out. A turn id is 120 bits of md5.
    """
    c = {n: turns[f"`{n.replace('`', '``')}`"] for n in (conv_id, turn, role, text)}
    who, said = F.coalesce(c[role].cast("string"), F.lit("")), F.coalesce(c[text].cast("string"), F.lit(""))
    digest = F.md5(F.encode(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), "UTF-8"))
    rows = (turns.where(c[conv_id].isNotNull())
            .select(c[conv_id].cast("long").alias("conv_id"), c[turn].alias("turn"), digest.alias("digest"),
                    F.char_length(said).cast("long").alias("chars"))
            .select("conv_id", "turn", F.conv(F.substring("digest", 1, 15), 16, 10).cast("long").alias("a"),
                    F.conv(F.substring("digest", 16, 15), 16, 10).cast("long").alias("b"), "chars")
            .repartitionByRange(shuffle_parts(turns.sparkSession), "conv_id", "turn", "a", "b")
            .sortWithinPartitions("conv_id", "turn", "a", "b"))
    rows = cut(rows.mapInArrow(_number, "conv_id long, part int, seq long, a long, b long, chars long"), "turns")
    # Only the first and the last conversation of a partition can go over its edge: two rows a partition.
    edges = rows.groupBy("part").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("ids"))
    edges = edges.select(F.explode("ids").alias("conv_id")).distinct()
    counts = rows.join(F.broadcast(edges), "conv_id", "left_semi").groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "part", F.sum("count").over(before).alias("offset")).where("offset is not null")
    return (rows.join(F.broadcast(offsets), ["conv_id", "part"], "left")
            .select("conv_id", (F.col("seq") + F.coalesce("offset", F.lit(0)) + 1).alias("pos"), "a", "b", "chars"))


def _lanes(pos: Column, a: Column, b: Column) -> list[Column]:
    """Four 32-bit lanes of the hash of a turn at a position."""
    x, y = F.xxhash64(pos, a, b), F.xxhash64(b, pos, a, F.lit(1))
    low = 0xFFFFFFFF
    return [x.bitwiseAND(low), F.shiftrightunsigned(x, 32), y.bitwiseAND(low), F.shiftrightunsigned(y, 32)]


def share_openings(numbered: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Numbered turns of conversations rebuilt so that many start alike.

    Conversation c: the first h turns of conversation c - c % group (all if
    fewer, none if absent), then its own turns after its first h, with
    h = crc32(decimal c) % most.
    """
    own_h = F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most
    base = F.col("conv_id") - F.col("conv_id") % group
    rows = numbered.withColumns({"h": own_h, "base": base})
    heads = (rows.where((F.col("conv_id") == F.col("base")) & (F.col("pos") < most))
             .select("base", F.col("pos").alias("hpos"), F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("chars").alias("hchars")))
    # At most ``group`` conversations share a base, and less than ``most`` of its turns are lent.
    lent = (rows.where("pos = 1").select("conv_id", "h", "base").join(heads, "base").where("hpos <= h")
            .select("conv_id", F.col("hpos").alias("pos"), F.col("ha").alias("a"), F.col("hb").alias("b"), F.col("hchars").alias("chars")))
    sizes = heads.groupBy("base").agg(F.count("*").alias("size"))
    own = (rows.where("pos > h").join(sizes, "base", "left")
           .select("conv_id", (F.col("pos") - F.col("h") + F.least("h", F.coalesce("size", F.lit(0)))).alias("pos"), "a", "b", "chars"))
    return lent.unionByName(own)


def _blocks(numbered: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row per block of a conversation; one with nulls alone for a conversation without turns."""
    lanes = dict(zip(KEYS, _lanes(F.col("pos"), F.col("a"), F.col("b"))))
    at = F.pmod(F.col("pos") - 1, F.lit(width))
    rows = (numbered.withColumns(lanes).withColumn("block", F.floor((F.col("pos") - 1) / width).cast("long"))
            .withColumn("chunk", F.floor(F.col("block") / CHUNK).cast("long"))
            .repartition("conv_id", "chunk"))  # at most CHUNK * width turns meet; all that follows keeps this layout
    cells = [F.max(F.when(at == j, F.col(c))).alias(f"{o}{j + 1}") for j in range(width) for c, o in (("a", "a"), ("b", "b"), ("chars", "n"))]
    sums = [F.sum(c).alias(f"s_{c}") for c in [*KEYS, "chars"]]
    rows = rows.groupBy("conv_id", "chunk", "block").agg(*cells, *sums, F.count("*").alias("turns"))
    rows = cut(rows, "blocks")
    names = [*KEYS, "chars", "turns"]
    own = [F.col("turns") if c == "turns" else F.col(f"s_{c}") for c in names]
    before = Window.partitionBy("conv_id", "chunk").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = rows.groupBy("conv_id", "chunk").agg(*(F.sum(v).alias(f"c_{c}") for c, v in zip(names, own)))
    chunks = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("conv_id")
    per_chunk = per_chunk.select("conv_id", "chunk", *(F.coalesce(F.sum(f"c_{c}").over(chunks), F.lit(0)).alias(f"o_{c}") for c in names),
                                 *(F.sum(f"c_{c}").over(every).alias(f"all_{c}") for c in names))
    rows = rows.withColumns({f"w_{c}": F.coalesce(F.sum(v).over(before), F.lit(0)) for c, v in zip(names, own)})
    rows = rows.join(per_chunk, ["conv_id", "chunk"])
    rows = rows.select("conv_id", "block", *(f"{o}{j + 1}" for j in range(width) for o in "abn"),
                       *((F.col(f"w_{c}") + F.col(f"o_{c}")).alias(c) for c in [*KEYS, "chars"]),
                       *(F.col(f"all_{c}").alias(f"all_{c}") for c in names))
    none = convs.join(numbered.select("conv_id").distinct(), "conv_id", "left_anti")
    fill = {c: (F.lit(None).cast("long") if c[0] in "abn" and c[1:].isdigit() else F.lit(0).cast("long")) for c in rows.columns if c != "conv_id"}
    return rows.unionByName(none.select("conv_id", *(v.alias(c) for c, v in fill.items())))


def _rollup(blocks: DataFrame, width: int, aggregates: str) -> DataFrame:
    """Prefix rows: key and block, the columns of the prefix, its depth in the block, and the aggregates."""
    columns = [f"a{j}, b{j}, n{j}" for j in range(1, width + 1)]
    keys = f"{', '.join(KEYS)}, chars, block"
    grouped = blocks.sparkSession.sql(f"""
        SELECT {keys}, {', '.join(columns)}, grouping_id() AS gid, {aggregates} FROM {{blocks}}
        GROUP BY {keys}, ROLLUP({', '.join(f'({c})' for c in columns)})""", blocks=blocks)
    # Three bits of grouping_id a column group; those of the deepest are lowest.
    level = sum((F.when(F.col("gid").bitwiseAND(1 << (3 * j)) == 0, 1).otherwise(0) for j in range(width)), F.lit(0))
    grouped = grouped.withColumn("level", level)
    own_turn = F.expr("CASE level " + " ".join(f"WHEN {j} THEN a{j} IS NOT NULL" for j in range(1, width + 1)) + " ELSE block = 0 END")
    return grouped.where(own_turn)  # else a conversation that ended above; level 0 of a later block is the prior block's node


def _with_keys(nodes: DataFrame, width: int) -> DataFrame:
    """Adds depth, the node's key p1..p4 and its parent's q1..q4, ``last`` (code points of its last turn), ``above`` (those before it)."""
    exprs = {"depth": F.col("block") * width + F.col("level")}
    lanes = [_lanes(F.col("block") * width + j, F.col(f"a{j}"), F.col(f"b{j}")) for j in range(1, width + 1)]
    for k, key in enumerate(KEYS):
        for name, upto in (("p", F.col("level")), ("q", F.col("level") - 1)):
            exprs[f"{name}{k + 1}"] = sum((F.when(upto >= j, lanes[j - 1][k]).otherwise(0) for j in range(1, width + 1)), F.col(key))
    exprs["last"] = F.coalesce(*(F.when(F.col("level") == j, F.col(f"n{j}")) for j in range(1, width + 1)), F.lit(0))
    exprs["above"] = sum((F.when(F.col("level") > j, F.col(f"n{j}")).otherwise(0) for j in range(1, width + 1)), F.col("chars"))
    return nodes.withColumns(exprs)


def _pieces(batches):
    """Sorted (depth, p1..p4, conv_id) -> their ids, joined by commas, in pieces of bounded size in order."""
    part, piece, key, ids = TaskContext.get().partitionId(), 0, None, []

    def flush():
        return pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int64()) for n, v in zip(_END_KEY, key)}, "part": pa.array([part], pa.int32()),
                                           "piece": pa.array([piece], pa.int64()), "ids": pa.array([",".join(map(str, ids))])})
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in _END_KEY]
        conv = batch.column("conv_id").to_numpy()
        if not len(conv):
            continue
        new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        bounds = [0, *new.tolist(), len(conv)]
        for a, b in zip(bounds[:-1], bounds[1:]):
            now = tuple(int(c[a]) for c in columns)
            for at in range(a, b, PIECE_IDS):
                if ids and (now != key or len(ids) >= PIECE_IDS):
                    yield flush()
                    piece, ids = piece + 1, []
                key = now
                ids = ids + conv[at:min(b, at + PIECE_IDS)].tolist()
    if ids:
        yield flush()


def _digests(batches):
    """Sorted pieces -> sha256 of each key's pieces joined by commas."""
    key, state = None, None

    def flush():
        return pa.RecordBatch.from_pydict({**{n: pa.array([v], pa.int64()) for n, v in zip(_END_KEY, key)}, "ends_sha256": pa.array([state.hexdigest()])})
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in [*_END_KEY, "ids"])):
            if row[:-1] != key:
                if key is not None:
                    yield flush()
                key, state = row[:-1], hashlib.sha256()
            else:
                state.update(b",")
            state.update(row[-1].encode())
    if key is not None:
        yield flush()


_END_KEY = ["depth", "p1", "p2", "p3", "p4"]


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, p1..p4, ends_sha256) of (conv_id, depth, p1..p4) rows, one row per key."""
    parts, schema = shuffle_parts(ends.sparkSession), ", ".join(f"{c} long" for c in _END_KEY)
    order = [*_END_KEY, "conv_id"]
    pieces = ends.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_pieces, f"{schema}, part int, piece long, ids string")
    return (pieces.repartition(parts, *_END_KEY).sortWithinPartitions(*_END_KEY, "part", "piece")
            .mapInArrow(_digests, f"{schema}, ends_sha256 string"))


def prefix_trie(numbered: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of numbered turns.

    ``numbered``: (conv_id, pos, a, b, chars), pos from 1 without gaps;
    ``convs``: the distinct conv_ids, those without turns too. Columns: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. (conv_id, depth) tells nodes apart, and turn
    number ``depth`` of conversation ``conv_id`` is the node's last turn. No
    conversation at all: no row, not even the root.
    """
    bounded_batches(numbered.sparkSession)
    blocks = cut(_blocks(numbered, convs, width), "trie-blocks")
    first = _with_keys(_rollup(blocks, width, "count(*) AS n_convs, min(conv_id) AS top, sum(all_chars) AS sum_chars"), width)
    node_key = ["depth", "p1", "p2", "p3", "p4"]
    nodes = cut(first.select("top", *node_key, *(f"q{k}" for k in range(1, 5)), "last", "above", "n_convs", "sum_chars"), "nodes")
    children = (nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), *(F.col(f"q{k}").alias(f"p{k}") for k in range(1, 5)))
                .agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, node_key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = cut(nodes, "nodes-children")
    owned = nodes.groupBy("top").agg(F.sum("last").alias("own_chars"), F.count_if(F.col("n_children") == 0).alias("own_leaves"))
    # What each conversation owns, summed over the members of every prefix.
    scalars = owned.withColumnRenamed("top", "conv_id")
    members = (blocks.join(scalars, "conv_id", "left")
               .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("own_chars", "own_leaves")}))
    second = _with_keys(_rollup(members, width, "sum(own_chars) AS sum_own, sum(own_leaves) AS n_leaves"), width)
    second = second.select(*node_key, "sum_own", "n_leaves")
    total = blocks.where("block = 0").select(F.col("conv_id").alias("top"), "all_chars")
    out = nodes.join(second, node_key).join(owned.select("top", "own_chars"), "top").join(total, "top")
    below = F.col("all_chars") - F.col("above")  # code points of the smallest member from this node on
    saved = (F.col("sum_chars") - F.col("n_convs") * F.col("above")) - (F.col("sum_own") - F.col("own_chars") + below)
    parents = nodes.select((F.col("depth") + 1).alias("depth"), *(F.col(f"p{k}").alias(f"q{k}") for k in range(1, 5)), F.col("top").alias("parent_conv_id"))
    out = out.withColumn("saved_tokens", saved).join(parents, ["depth", "q1", "q2", "q3", "q4"], "left")
    ends = blocks.where("block = 0").select("conv_id", F.col("all_turns").alias("depth"), *(F.col(f"all_k{k}").alias(f"p{k}") for k in range(1, 5)))
    out = out.join(end_digests(ends), node_key, "left")
    longs = ["depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return out.select(F.col("top").alias("conv_id"), *(F.col(c).cast("long").alias(c) for c in longs),
                      F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      width: int = WIDTH) -> DataFrame:
    """The prefix trie (see :func:`prefix_trie`) of conversations as they are, one row per turn.

    See :func:`number_turns` for nulls and ties. Rows repeated in full are
    further turns. Other columns, whatever their names, play no part.
    """
    numbered = cut(number_turns(turns, conv_id, turn, role, text), "numbered")
    return prefix_trie(numbered, numbered.where("pos = 1").select("conv_id"), width)


def rebuilt_trie(turns: DataFrame, group: int = 100, most: int = 6, width: int = WIDTH) -> DataFrame:
    """The prefix trie of conversations rebuilt by :func:`share_openings`; a rebuilt one may have no turn."""
    numbered = cut(number_turns(turns), "numbered")
    rebuilt = cut(share_openings(numbered, group, most), "rebuilt")
    return prefix_trie(rebuilt, numbered.where("pos = 1").select("conv_id"), width)
