"""URL filters (operator 6): sort-merge range join on reversed-host keys.

A host's canonical key is its labels in reverse order, each followed by a dot
(``m.example.org`` -> ``org.example.m.``). A rule's host prefix is then the
interval [key, key with its last dot raised), which holds the host and all its
subdomains and nothing else, and intervals of different rules nest or are
apart. Pages and rules are sorted by key; one sweep per partition keeps a stack
of the rules whose interval is open and judges each page by the stack.

Pages are cut into ranges of near-equal size at split points taken from a
bounded hash sample of the keys (it decides the balance only, never a result).
A rule goes to every range that its interval meets. Pages of one host spread
over several ranges, since the page's id breaks ties between equal keys.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.fit import collect_bounded
from .common import lower_ascii, shuffle_parts

#: Rows sampled per range to place the split points.
SAMPLE_PER_RANGE = 24


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    return F.when(url.isNull() | (at == 0), "").otherwise(lower_ascii(rest))


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*([^?#]*)", 1)
    return F.when(url.isNull() | (at == 0), "").otherwise(rest)


def host_key(host: Column) -> Column:
    """Labels in reverse, each ended by a dot; the empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def _key_end(key: Column) -> Column:
    """The first string after all that start with ``key``: its last dot becomes the next character."""
    return F.concat(F.substr(key, F.lit(1), F.length(key) - 1), F.lit("/"))


class _Stack:
    """Open rules, outermost first: [end of interval, {path prefix: (rule, verdict)}, prefix lengths]."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, dict, set]] = []

    def close_before(self, key: str) -> None:
        while self.open and self.open[-1][1] <= key:
            self.open.pop()

    def add(self, key: str, end: str, path: str, rule: str, verdict: str) -> None:
        if not self.open or self.open[-1][0] != key:
            self.open.append((key, end, {}, set()))
        self.open[-1][2].setdefault(path, (rule, verdict))
        self.open[-1][3].add(len(path))

    def judge(self, path: str) -> tuple[str, str] | None:
        best = None
        for key, _, paths, lengths in self.open:
            for n in lengths:
                if n <= len(path) and (found := paths.get(path[:n])) and (best is None or len(key) + n >= best[0]):
                    best = (len(key) + n, found)
        return best and best[1]


_OUT = ("doc", "host", "path", "rule", "verdict")


def _sweep(default: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, now = _Stack(), None
        for batch in batches:
            doc = batch.column("doc")
            cols = [batch.column(c).to_pylist() for c in ("range", "key", "is_page", "end", "host", "path", "rule", "verdict")]
            rows, rules, verdicts = [], [], []
            for i, (part, key, is_page, end, _, path, rule, verdict) in enumerate(zip(*cols)):
                if part != now:
                    stack, now = _Stack(), part
                stack.close_before(key)
                if not is_page:
                    stack.add(key, end, path, rule, verdict)
                    continue
                found = stack.judge(path)
                rows.append(i)
                rules.append(found and found[0])
                verdicts.append(found[1] if found else default)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [doc.take(at), batch.column("host").take(at), batch.column("path").take(at),
                 pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=list(_OUT))
    return run


def _split_points(keys: DataFrame, ranges: int) -> list[tuple[str, int]]:
    """``ranges`` - 1 (key, tie) pairs that cut the rows evenly, from a share of the distinct pairs by their hash.

    The share is set after a count, so about SAMPLE_PER_RANGE pairs a range
    reach the driver however many tasks there are; rows that repeat count with their number.
    """
    wanted, steps = SAMPLE_PER_RANGE * ranges, 1 << 40
    share = min(steps, math.ceil(wanted / max(1, keys.count()) * steps))
    drawn = keys.where(F.pmod(F.xxhash64("key", "tie", F.lit("draw")), F.lit(steps)) < share)
    found = sorted(tuple(r) for r in collect_bounded(drawn.groupBy("key", "tie").count(), 4 * wanted + 1000))
    if not found:
        return []
    upto = list(accumulate(n for *_, n in found))
    at = (bisect_left(upto, upto[-1] * k / ranges) for k in range(1, ranges))
    return sorted({found[min(i + 1, len(found) - 1)][:2] for i in at})


def _range_finder(points: list[tuple[str, int]]):
    def find(keys: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array([bisect_right(points, at) for at in zip(keys.to_pylist(), ties.to_pylist())], pa.int32())
    return find


def _row_hash(df: DataFrame) -> Column:
    hashable = [F.col("doc").getField(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*hashable)


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
                ranges: int | None = None) -> DataFrame:
    """Judge every row's URL by the longest rule that fits it.

    ``rules`` has ``host``, ``path``, ``verdict``. A rule fits its host and all
    subdomains where the URL's path starts with the rule's path; of several, the
    one with the longest host plus path wins (at equal length the one with the
    more specific host). Rules that repeat host and path: the smallest
    verdict counts. Rules with a null field or an empty host are left out.

    Returns ``doc`` (the input row as a struct), ``host``, ``path``, ``rule``
    (host + path, null if none fits) and ``verdict`` (``default`` if none fits).

    A null URL or one without ``://`` has empty host and path, and no rule. An
    empty host has the empty key and no rule fits it. Repeated rows are all
    returned; an empty ``pages`` gives an empty result, empty ``rules`` give
    every page the default.
    """
    spark = pages.sparkSession
    ranges = ranges or 3 * shuffle_parts(spark)
    link = F.col("doc").getField(url)
    rows = (pages.select(F.struct("*").alias("doc"))
            .withColumns({"host": url_host(link), "path": url_path(link)})
            .withColumns({"key": host_key(F.col("host")), "tie": _row_hash(pages)}))
    points = _split_points(rows.select("key", "tie"), ranges)
    range_of = F.arrow_udf(_range_finder(points), "int")
    paged = rows.select(range_of(F.col("key"), F.col("tie")).alias("range"), "key", F.lit(True).alias("is_page"),
                        F.lit(None).cast("string").alias("end"), "host", "path", F.lit(None).cast("string").alias("rule"),
                        F.lit(None).cast("string").alias("verdict"), "doc")
    kept = (rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").where("host <> '' and path is not null and verdict is not null")
            .groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
            .withColumn("key", host_key(F.col("host"))).withColumn("end", _key_end(F.col("key"))))
    low, high = F.lit(-(1 << 63)).cast("long"), F.lit((1 << 63) - 1).cast("long")
    ruled = kept.select(
        F.explode(F.sequence(range_of(F.col("key"), low), range_of(F.col("end"), high))).alias("range"),
        "key", F.lit(False).alias("is_page"), "end", "host", "path", F.concat("host", "path").alias("rule"), "verdict",
        F.lit(None).cast(rows.schema["doc"].dataType).alias("doc"))
    merged = (paged.unionByName(ruled).repartition(ranges, "range")
              .sortWithinPartitions("range", "key", "is_page", "rule"))
    schema = rows.select("doc", "host", "path", F.col("host").alias("rule"), F.col("host").alias("verdict")).schema
    return merged.mapInArrow(_sweep(default), schema)
