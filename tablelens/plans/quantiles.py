"""Exact quantiles by refining an approximate sketch (no full shuffle).

Full ranking (R1) shuffles every distinct value. Quantiles only need a few
positions, so:

1. one aggregate per key: ``count`` and ``percentile_approx`` at p ± 3ε for
   every target p (ε = 1/accuracy is the sketch's rank error) — the exact
   value at rank (n−1)·p lies inside [lo, hi];
2. only the bracketed rows (≈ 6ε·n per quantile) are ranked with R1, keyed by
   (key, quantile); rows below a bracket enter that ranking as one sentinel
   value (−inf) whose count the map-side aggregate collapses to a row per
   task, so the offsets already include them.

Whole-table quantiles of one or many columns (:func:`exact_quantiles_wide`) get
their brackets, and the rows below them, from one histogram pass over all
columns instead, and emit only the values inside a bracket.

Every answer is verified (both interpolation positions must fall inside the
bracket); if any key fails, that call falls back to full R1, so results are
always exact.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fit import BROADCAST_KEYS, attach, collect_bounded, materialize, one_row
from .ranks import quantiles_from_offsets, value_offsets

DEFAULT_ACCURACY = 10_000
_ROWS_PER_BUCKET = 2_000_000


def _verified_pick(off: DataFrame, keys: list[str], probs: Sequence[float]) -> DataFrame:
    """From bracket offsets (keys, _i, value, cnt, below[global], n) pick the
    interpolated quantile of prob _i; NULL when a position is outside the bracket."""
    p = F.element_at(F.array(*[F.lit(float(x)) for x in probs]), F.col("_i") + 1)
    h = (F.col("n") - 1) * p
    lo = F.floor(h)
    hi = F.least(lo + 1, F.col("n") - 1)
    has = lambda pos: (pos >= F.col("below")) & (pos < F.col("below") + F.col("cnt"))
    picked = (off.groupBy(*keys, "_i")
              .agg(F.max(F.when(has(lo), F.col("value"))).alias("_vlo"),
                   F.max(F.when(has(hi), F.col("value"))).alias("_vhi"),
                   F.max(h - F.floor(h)).alias("_frac")))
    ok = (F.col("_vlo") > F.lit(float("-inf"))) & F.col("_vhi").isNotNull()
    return picked.withColumn("_q", F.when(ok, F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")))


def sketch_probs(probs: Sequence[float], accuracy: int = DEFAULT_ACCURACY) -> list[float]:
    """The 2·len(probs) sketch points (p − 3ε for every p, then p + 3ε)."""
    margin = 3.0 / accuracy
    return [max(0.0, float(p) - margin) for p in probs] + [min(1.0, float(p) + margin) for p in probs]


#: Columns handled in one pass.
_COLUMNS_AT_ONCE = 64
#: Bins of a histogram for each power of e, and of a bracket that is cut again.
_BINS_PER_E = 64
_LINEAR_BINS = 1024
#: A bracket with more rows than this, and than a fiftieth of all, is cut again before its values are ranked.
_BRACKET_ROWS = 2_000_000


@dataclass
class Histogram:
    """A column's values in ascending bins (least value, largest value, rows)."""
    n: int
    bins: list[tuple[float, float, int]]

    def bracket(self, first: int, last: int) -> tuple[float, float, int, int]:
        """Least and largest value of the bins that hold positions ``first`` to ``last``, the rows below and the rows inside."""
        upto = list(accumulate(c for *_, c in self.bins))
        a, b = bisect_right(upto, first), bisect_right(upto, last)
        below = upto[a] - self.bins[a][2]
        return self.bins[a][0], self.bins[b][1], below, upto[b] - below


def _bin_key(x: Column) -> Column:
    """A whole number that never falls as x grows: sign and logarithm, ``_BINS_PER_E`` steps for each power of e."""
    top = 800 * _BINS_PER_E
    size = F.floor(F.ln(F.least(F.abs(x), F.lit(1.7e308))) * _BINS_PER_E) + top
    return F.when(x == 0, 0).when(x > 0, size).when(x < 0, -size).cast("long")


def column_histograms(df: DataFrame, columns: dict[str, Column]) -> dict[str, Histogram]:
    """Histograms of several DOUBLE expressions without NaN, all from one pass: each value adds to one bin of its column."""
    names, out = list(columns), {}
    for at in range(0, len(names), _COLUMNS_AT_ONCE):
        some = names[at:at + _COLUMNS_AT_ONCE]
        each = F.array(*[F.struct(F.lit(j).alias("j"), columns[c].alias("x")) for j, c in enumerate(some)])
        cells = (df.select(F.explode(each).alias("s")).select("s.j", "s.x").where(F.col("x").isNotNull()).groupBy("j", _bin_key(F.col("x")).alias("key"))
                 .agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")))
        rows = collect_bounded(cells, len(some) * (3200 * _BINS_PER_E + 1))  # as many keys as doubles can have
        for j, c in enumerate(some):
            own = sorted((r for r in rows if r["j"] == j), key=lambda r: r["key"])
            out[c] = Histogram(sum(r["n"] for r in own), [(r["lo"], r["hi"], r["n"]) for r in own])
    return out


def _narrower(src: DataFrame, brackets: dict, wanted: dict, large: list) -> dict:
    """The brackets in ``large`` cut once more, into ``_LINEAR_BINS`` equal widths each: one pass for all."""
    def cell(k: int, key: tuple[int, int]) -> Column:
        lo, hi, _, _ = brackets[key]
        x = F.col(f"_x{key[0]}")
        at = F.least(F.floor((x - F.lit(lo)) / F.lit((hi - lo) / _LINEAR_BINS)), F.lit(_LINEAR_BINS - 1)).cast("int")
        return F.when((x >= F.lit(lo)) & (x <= F.lit(hi)), F.struct(F.lit(k).alias("k"), at.alias("at"), x.alias("x")))
    cells = (src.select(F.explode(F.array_compact(F.array(*[cell(k, key) for k, key in enumerate(large)]))).alias("s")).select("s.*")
             .groupBy("k", "at").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")))
    rows = collect_bounded(cells, len(large) * _LINEAR_BINS)
    out = dict(brackets)
    for k, key in enumerate(large):
        below, (first, last) = brackets[key][2], wanted[key]
        own = Histogram(0, [(r["lo"], r["hi"], r["n"]) for r in sorted((r for r in rows if r["k"] == k), key=lambda r: r["at"])])
        lo, hi, under, inside = own.bracket(first - below, last - below)
        out[key] = lo, hi, below + under, inside
    return out


def exact_quantiles_wide(df: DataFrame, columns: dict[str, Column], probs: Sequence[float],
                         histograms: dict[str, Histogram] | None = None) -> DataFrame:
    """(variable, n, q): exact quantiles of several columns of one table.

    ``columns`` maps a name to a DOUBLE expression without NaN; columns without
    a value are left out. One pass counts the bins of all columns (unless the
    caller has them). The bin that holds a quantile's rank brackets it, and the
    rows below are known, so the second pass ranks only the values inside the
    brackets; no row is emitted for the others. A bracket that holds very many
    rows is first cut again.
    """
    names, probs = list(columns), [float(p) for p in probs]
    if len(names) > _COLUMNS_AT_ONCE:
        parts = [exact_quantiles_wide(df, {c: columns[c] for c in names[a:a + _COLUMNS_AT_ONCE]}, probs, histograms)
                 for a in range(0, len(names), _COLUMNS_AT_ONCE)]
        return reduce(DataFrame.unionByName, parts)
    hist = histograms or column_histograms(df, columns)
    src = df.select(*[columns[c].alias(f"_x{j}") for j, c in enumerate(names)])
    live = [j for j, c in enumerate(names) if hist[c].n]
    schema = "variable string, n long, q array<double>"
    if not live:
        return df.sparkSession.createDataFrame([], schema)
    wanted, brackets = {}, {}
    for j in live:
        n = hist[names[j]].n
        for i, p in enumerate(probs):
            first = math.floor((n - 1) * p)
            wanted[j, i] = first, min(first + 1, n - 1)
            brackets[j, i] = hist[names[j]].bracket(*wanted[j, i])
    while large := [key for key, (lo, hi, _, inside) in brackets.items()
                    if lo < hi and inside > max(_BRACKET_ROWS, hist[names[key[0]]].n / 50) and math.isfinite(hi - lo) and (hi - lo) / _LINEAR_BINS > 0]:
        cut = _narrower(src, brackets, wanted, large)
        if all(cut[key][3] == brackets[key][3] for key in large):
            break  # nothing between the bracket's ends is left to cut
        brackets = cut
    open_keys = [key for key, (lo, hi, *_) in brackets.items() if lo < hi]
    got = {key: lo for key, (lo, hi, *_) in brackets.items() if lo == hi}
    if open_keys:
        hits = {(j, i): (F.col(f"_x{j}") >= F.lit(brackets[j, i][0])) & (F.col(f"_x{j}") <= F.lit(brackets[j, i][1])) for j, i in open_keys}
        tags = [F.when(hit, F.struct(F.lit(j).alias("_j"), F.lit(i).alias("_i"), F.col(f"_x{j}").alias("_t"))) for (j, i), hit in hits.items()]
        # Few rows have a value inside any bracket; only those are exploded.
        inside = src.where(reduce(Column.__or__, hits.values())).select(F.explode(F.array_compact(F.array(*tags))).alias("_h")).select("_h.*")
        n_buckets = max(1, math.ceil(max(brackets[key][3] for key in open_keys) * 1.5 / _ROWS_PER_BUCKET))
        base = df.sparkSession.createDataFrame([(j, i, brackets[j, i][2], hist[names[j]].n) for j, i in open_keys],
                                               "_j int, _i int, _base long, n long")  # one row per column and quantile
        off = (value_offsets(inside, "_t", ["_j", "_i"], n_buckets=n_buckets).drop("n")
               .join(F.broadcast(base), ["_j", "_i"]).withColumn("below", F.col("below") + F.col("_base")))
        got |= {(r["_j"], r["_i"]): r["_q"] for r in collect_bounded(_verified_pick(off, ["_j"], probs), len(open_keys))}
    rows = []
    for j in live:
        q = [got.get((j, i)) for i in range(len(probs))]
        if None in q:  # the table gave other rows on the second pass: rank the whole column
            q = one_row(quantiles_from_offsets(value_offsets(src, f"_x{j}"), probs))["q"]
        rows.append((names[j], hist[names[j]].n, [float(v) for v in q]))
    return df.sparkSession.createDataFrame(rows, schema)


def exact_quantiles_refined(df: DataFrame, value: str, probs: Sequence[float],
                            keys: Sequence[str] = (), accuracy: int = DEFAULT_ACCURACY) -> DataFrame:
    """keys…, n, q (array in ``probs`` order): exact linear-interpolation quantiles per key.

    The brackets are one row per key, computed once: they are broadcast up to
    ``BROADCAST_KEYS`` keys and joined by key beyond it. Passes over the data:
    the sketch, then the bracket ranking. Without keys see
    :func:`exact_quantiles_wide`.
    """
    keys = list(keys)
    probs = [float(p) for p in probs]
    k = len(probs)
    if not keys:
        v = F.col(value).cast("double")
        return exact_quantiles_wide(df, {"value": F.when(~F.isnan(v), v)}, probs).select("n", "q")
    src = (df.select(*keys, F.col(value).cast("double").alias("_v"))
           .where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    margin = 3.0 / accuracy
    sketch = (src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     F.percentile_approx("_v", sketch_probs(probs, accuracy), accuracy).alias("_s"))
              .select(*keys, "n", *[F.col("_s")[i].alias(f"_lo{i}") for i in range(k)],
                      *[F.col("_s")[k + i].alias(f"_hi{i}") for i in range(k)]))
    brackets = materialize(sketch)
    size = one_row(brackets.agg(F.max("n").alias("m"), F.count(F.lit(1)).alias("c")))
    largest, expected_keys = size["m"] or 0, size["c"]

    def with_params(frame: DataFrame, params: DataFrame, how: str = "inner") -> DataFrame:
        return attach(frame, params, keys, True, how, broadcast=expected_keys <= BROADCAST_KEYS)

    rows = with_params(src, brackets)
    # Rows below a bracket collapse into one sentinel value (−inf) per (key, quantile):
    # the partial aggregate turns them into a single counted row per task, and the
    # ranking then offsets every bracketed value by exactly that count.
    tags = [F.when(F.col("_v") < F.col(f"_lo{i}"), F.lit(float("-inf")))
            .when(F.col("_v") <= F.col(f"_hi{i}"), F.col("_v")) for i in range(k)]
    in_rows = (rows.select(*keys, F.posexplode(F.array(*tags)).alias("_i", "_t"))
               .where(F.col("_t").isNotNull()))
    n_buckets = max(1, math.ceil(2 * margin * largest * 1.5 / _ROWS_PER_BUCKET))
    off = value_offsets(in_rows, "_t", [*keys, "_i"], n_buckets=n_buckets).drop("n")
    off = with_params(off, brackets.select(*keys, "n"))
    picked = _verified_pick(off, keys, probs)
    per_key = (picked.groupBy(*keys)
               .agg(F.array_sort(F.collect_list(F.struct("_i", "_q"))).alias("_qs"),
                    F.count_if(F.col("_q").isNull()).alias("_bad"), F.count(F.lit(1)).alias("_got")))
    result = materialize(with_params(per_key, brackets.select(*keys, "n"), "right"))
    check = one_row(result.agg(
        F.count(F.lit(1)).alias("c"),
        F.coalesce(F.sum(F.coalesce(F.col("_bad"), F.lit(0)) + (F.lit(k) - F.coalesce(F.col("_got"), F.lit(0)))),
                   F.lit(0)).alias("f")))
    if check["f"] or check["c"] != expected_keys:
        return quantiles_from_offsets(value_offsets(src, "_v", keys), probs, keys)
    return result.select(*keys, "n", F.transform("_qs", lambda s: s["_q"]).alias("q"))
