"""H — chart-ready aggregates: the data behind each figure, aggregated on the cluster.

Nothing here ships raw points to the driver. Binning/quantile parameters are
fitted with one bounded aggregate and applied as literals; per-point work
(histogram bins, KDE contributions) is native column arithmetic followed by a
partial (map-side) hash aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal import norm_pdf_col, ppnd_col
from ..plans.fit import attach, clean_value, col, collect_bounded, missing_cond, one_row, parse_double, plain_names
from ..plans.quantiles import exact_quantiles_refined
from ..plans.ranks import sorted_positions, value_offsets
from .columns import drop_missing, group_label, sample_rows

KDE_POINTS = 100
KDE_TERMS = 15
DENSITY_BINS = 30
NOTCH_FACTOR = 1.57
#: Columns on either side of a block of a correlation matrix.
BLOCK_COLUMNS = 6


def _x(df: DataFrame, var: str):
    return clean_value(df, var).cast("double")


def value_counts(df: DataFrame, var: str, by: str | None = None) -> DataFrame:
    """H1: value (and optional second key), count — nulls dropped, count desc then value."""
    keys = [by, var] if by else [var]
    base = df.where(~missing_cond(df, var))
    if by:
        base = base.where(~missing_cond(df, by))
    return (base.groupBy(*map(col, keys)).agg(F.count(F.lit(1)).alias("count"))
            .orderBy(F.desc("count"), *map(col, keys)))


def value_shares(df: DataFrame, var: str) -> DataFrame:
    """H2: value, count, pct of the non-null total (pie data)."""
    present = df.where(~missing_cond(df, var))
    counts = present.groupBy(col(var)).agg(F.count(F.lit(1)).alias("count"))
    total = one_row(present.agg(F.count(F.lit(1)).alias("n")))["n"]
    return counts.select(col(var), "count",
                         (F.col("count") / F.lit(max(total, 1)) * F.lit(100)).alias("pct"))


def _bin_params(df: DataFrame, var: str) -> tuple[float | None, float | None, int]:
    r = one_row(df.agg(F.min(_x(df, var)).alias("lo"), F.max(_x(df, var)).alias("hi"),
                       F.count(_x(df, var)).alias("n")))
    return r["lo"], r["hi"], r["n"]


def histogram(df: DataFrame, var: str, bins: int = 5, density: bool = False) -> DataFrame:
    """H3/H9: bin, lower, upper, count (and density) over [min, max] in equal widths.

    The last bin is closed. Empty bins are present (the bin frame is generated
    from the one-row statistics, ``bins`` rows, and joined to the counts).
    """
    if bins < 1:
        raise ValueError("bins must be >= 1")
    lo, hi, n = _bin_params(df, var)
    spark = df.sparkSession
    if lo is None:
        schema = "bin int, lower double, upper double, count long" + (", density double" if density else "")
        return spark.createDataFrame([], schema)
    width = (hi - lo) / bins
    x = _x(df, var)
    if width > 0:
        idx = F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    else:
        idx = F.lit(0)
    counts = (df.select(idx.alias("bin")).where(F.col("bin").isNotNull())
              .groupBy("bin").agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    lower = F.lit(lo) + F.col("bin") * F.lit(width)
    upper = F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(
        F.lit(lo) + (F.col("bin") + 1) * F.lit(width))
    out = (grid.join(F.broadcast(counts), "bin", "left")
           .select("bin", lower.alias("lower"), upper.alias("upper"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count")))
    if density:
        w = width if width > 0 else 1.0
        out = out.withColumn("density", F.col("count") / F.lit(float(n) * w))
    return out


def histograms(df: DataFrame, series: dict, bins: int) -> DataFrame:
    """H3 of several DOUBLE expressions at once: bin, lower, upper, count, series.

    One pass for all ranges and one for all counts, whatever their number.
    """
    names = list(series)
    edges = one_row(df.agg(*[f(x).alias(f"{k}{i}") for i, x in enumerate(series.values()) for k, f in (("lo", F.min), ("hi", F.max))]))
    live = [i for i in range(len(names)) if edges[f"lo{i}"] is not None]
    width = {i: (edges[f"hi{i}"] - edges[f"lo{i}"]) / bins for i in live}

    def bin_of(i: int):
        x = series[names[i]]
        at = F.least(F.floor((x - F.lit(edges[f"lo{i}"])) / F.lit(width[i])), F.lit(bins - 1)).cast("int") if width[i] > 0 else F.lit(0)
        return F.when(x.isNotNull(), F.struct(F.lit(i).alias("series"), at.alias("bin")))
    schema = "bin int, lower double, upper double, count long, series string"
    if not live:
        return df.sparkSession.createDataFrame([], schema)
    cells = df.select(F.explode(F.array_compact(F.array(*map(bin_of, live)))).alias("cell")).groupBy("cell.series", "cell.bin").count()
    counts = {(r["series"], r["bin"]): r["count"] for r in collect_bounded(cells, bins * len(live))}
    rows = [(b, edges[f"lo{i}"] + b * width[i], edges[f"hi{i}"] if b == bins - 1 else edges[f"lo{i}"] + (b + 1) * width[i], counts.get((i, b), 0), names[i])
            for i in live for b in range(bins)]
    return df.sparkSession.createDataFrame(rows, schema)


def density_histogram(df: DataFrame, var: str, bins: int = DENSITY_BINS) -> DataFrame:
    """H9: 30-bin histogram normalised to area one."""
    return histogram(df, var, bins, density=True)


def _keyed(df: DataFrame, var: str, by: str | None) -> tuple[DataFrame, list[str]]:
    """(source, keys): the grouping key as text, or a constant key when ungrouped,
    so grouped and whole-table statistics share one join-by-key plan."""
    if by:
        return df.select(group_label(by).alias(by), _x(df, var).alias("_x")), [by]
    return df.select(F.lit(0).alias("_g"), _x(df, var).alias("_x")), ["_g"]


@plain_names("var", "by", out=["by"])
def box_stats(df: DataFrame, var: str, by: str | None = None) -> DataFrame:
    """H4/H5: n, mean, std, q1, median, q3, fences, whiskers, outlier count, notch.

    Quartiles come from the sketch-then-refine exact plan; whiskers (extreme
    values inside Q1−1.5·IQR … Q3+1.5·IQR), the outlier count and the moments
    are then one aggregate over the rows with the per-group fences attached.
    """
    keys = [by] if by else []
    src = (df.select(*[group_label(k).alias(k) for k in keys], _x(df, var).alias("_x"))
           .where(F.col("_x").isNotNull()))
    quart = exact_quantiles_refined(src, "_x", [0.25, 0.5, 0.75], keys)
    q1, median, q3 = (F.get("q", F.lit(i)) for i in range(3))  # NULL where there is no value at all
    iqr = q3 - q1
    fences = quart.select(*keys, "n", q1.alias("q1"), median.alias("median"), q3.alias("q3"),
                          (q1 - F.lit(1.5) * iqr).alias("lower_fence"), (q3 + F.lit(1.5) * iqr).alias("upper_fence"))
    rows = attach(src, fences.select(*keys, "lower_fence", "upper_fence"), keys, bool(by))
    inside = (F.col("_x") >= F.col("lower_fence")) & (F.col("_x") <= F.col("upper_fence"))
    whisk = rows.groupBy(*keys).agg(
        F.min(F.when(inside, F.col("_x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("_x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
        F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("std"))
    out = attach(whisk, fences, keys, bool(by), "inner", broadcast=False).where(F.col("n") > 0)
    notch = F.lit(NOTCH_FACTOR) * (F.col("q3") - F.col("q1")) / F.sqrt(F.col("n"))
    return out.select(*keys, "n", "mean", "std", "q1", "median", "q3",
                      "lower_fence", "upper_fence", "whisker_low", "whisker_high", "outliers",
                      (F.col("median") - notch).alias("notch_low"),
                      (F.col("median") + notch).alias("notch_high"))


def box_outliers(df: DataFrame, var: str) -> DataFrame:
    """H4: the raw outlier points (value) outside the fences; none in a table without values."""
    points = df.select(_x(df, var).alias("value"))
    quart = exact_quantiles_refined(points, "value", [0.25, 0.75]).collect()  # one row
    if not quart or not quart[0]["n"]:
        return points.where(F.lit(False))
    q1, q3 = quart[0]["q"]
    return points.where((F.col("value") < q1 - 1.5 * (q3 - q1)) | (F.col("value") > q3 + 1.5 * (q3 - q1)))


def prepare_groups(df: DataFrame, quali: str, quanti: str, null_label: str = "None",
                   keep: Sequence[str] = ()) -> DataFrame:
    """B9 + B10 + B5: (group, value) with the group as text (missing = own group) and
    the value coerced to number; rows whose value does not parse are dropped.
    ``keep`` names columns to carry along."""
    return (df.select(group_label(quali, null_label).alias("group"),
                      parse_double(col(quanti), df.schema[quanti].dataType).alias("value"), *[col(k) for k in keep])
            .where(F.col("value").isNotNull() & ~F.isnan("value")))


def grouped_box(df: DataFrame, quali: str, quanti: str) -> DataFrame:
    """H5: per-group box statistics with mean and notch."""
    g = prepare_groups(df, quali, quanti)
    return box_stats(g, "value", by="group")


def grouped_mean(df: DataFrame, quali: str, quanti: str) -> DataFrame:
    """H6: group, mean, std (ddof=1, NULL when n=1), count — ordered by group."""
    g = prepare_groups(df, quali, quanti)
    return (g.groupBy("group").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                   F.count(F.lit(1)).alias("count"))
            .orderBy("group"))


def strip_points(df: DataFrame, quali: str, quanti: str, max_points: int | None = None,
                 seed: int = 42, row_key: Sequence[str] | None = None) -> DataFrame:
    """H7: group, value, group_mean for every point.

    ``max_points`` shows a sample of that many points (a sampling feature, off
    by default; see :func:`sample_rows`). Group means are those of all points;
    they are looked up by group without shuffling the points.
    """
    g = prepare_groups(df, quali, quanti, keep=row_key or ())
    means = g.groupBy("group").agg(F.avg("value").alias("group_mean"))
    if max_points is not None:
        g = sample_rows(g, max_points, seed, row_key)
    return attach(g, means, ["group"], True, "left").select("group", "value", "group_mean")


def scatter_points(df: DataFrame, cols: Sequence[str], max_points: int | None = None,
                   seed: int = 42, row_key: Sequence[str] | None = None) -> DataFrame:
    """Scatter-matrix data: the selected columns with listwise-missing rows dropped,
    optionally a sample of ``max_points`` rows (see :func:`sample_rows`)."""
    keys = [k for k in row_key or () if k not in cols]
    out = drop_missing(df.select(*[col(k) for k in keys], *[_x(df, c).alias(c) for c in cols]), cols)
    if max_points is not None:
        out = sample_rows(out, max_points, seed, row_key)
    return out.select(*[col(c) for c in cols])


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None,
                       listwise: bool = True) -> DataFrame:
    """H8: long form (var_x, var_y, r) of Pearson correlations.

    Rows with a missing value in any selected column are dropped first
    (listwise). A constant column gives NULL (no division by zero). The
    diagonal is exactly 1 for non-constant columns. Co-moments about running
    means (which merge over tasks) are taken in blocks of ``BLOCK_COLUMNS`` x
    ``BLOCK_COLUMNS`` columns: each block is one generated-code aggregate over the
    columns it reads, so up to that many columns are one pass, and no expression
    list grows with the square of the columns. Only the matrix reaches the driver.
    """
    from ..plans.fit import numeric_columns
    cols = list(cols) if cols else numeric_columns(df)[:4]
    names = [f"c{i}" for i in range(len(cols))]
    base = df.select(*[_x(df, c).alias(n) for c, n in zip(cols, names)])
    if not listwise:
        return _pairwise_correlation(base, names, cols)
    for n in names:
        base = base.where(F.col(n).isNotNull())
    blocks = [range(a, min(a + BLOCK_COLUMNS, len(cols))) for a in range(0, len(cols), BLOCK_COLUMNS)]
    products, about = {}, set()
    for a, left in enumerate(blocks):
        for right in blocks[a:]:
            pairs = [(i, j) for i in left for j in right if i <= j]
            edges = [f(names[i]).alias(f"{k}{i}") for i in left for k, f in (("low", F.min), ("high", F.max))] if left is right else []
            row = one_row(base.agg(*[F.covar_pop(names[i], names[j]).alias(f"s{k}") for k, (i, j) in enumerate(pairs)], *edges))
            products |= dict(zip(pairs, row))
            if left is right:
                about |= {i for i in left if row[f"low{i}"] is not None and row[f"low{i}"] < row[f"high{i}"]}

    def r(i: int, j: int) -> float | None:
        if i not in about or j not in about:
            return None
        if i == j:
            return 1.0
        return products[min(i, j), max(i, j)] / (math.sqrt(products[i, i]) * math.sqrt(products[j, j]))
    rows = [(x, y, r(i, j)) for i, x in enumerate(cols) for j, y in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "var_x string, var_y string, r double")


def _pairwise_correlation(base: DataFrame, names: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Correlations over the rows that have both values of a pair; one expression set per pair."""
    structs = []
    for a, x in zip(names, cols):
        for b, y in zip(names, cols):
            both = F.col(a).isNotNull() & F.col(b).isNotNull()
            u, v = F.when(both, F.col(a)), F.when(both, F.col(b))
            den = F.stddev_samp(u) * F.stddev_samp(v)
            r = F.when(den > 0, F.lit(1.0) if a == b else F.covar_samp(u, v) / den)
            structs.append(F.struct(F.lit(x).alias("var_x"), F.lit(y).alias("var_y"), r.alias("r")))
    return base.agg(F.array(*structs).alias("_a")).select(F.explode("_a").alias("_s")).select("_s.*")


def _grid(lo: float, hi: float, points: int):
    """numpy.linspace(lo, hi, points) as a Column expression of the index ``i``."""
    i = F.col("i")
    if points == 1:
        return F.lit(lo)
    step = (hi - lo) / (points - 1)
    return F.when(i == points - 1, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))


def kde(df: DataFrame, var: str, points: int = KDE_POINTS) -> DataFrame:
    """Gaussian KDE (Scott bandwidth h = n^(−1/5)·std) on ``points`` grid points.

    A fast Gauss transform: with u a value's distance to the middle of its box
    and t a grid point's, both in bandwidths, the kernel is
    exp(−t²/2) · Σ He_k(t) · u^k / k!. So every row only adds its powers to the
    ``KDE_TERMS`` moments of its box (a map-side aggregate), and the boxes alone
    meet the grid points. Boxes are half a bandwidth wide, so |u| <= 1/4 and what
    is cut off is below 1.1 · u^k / sqrt(k!), under 10^-15 of a kernel's height.
    """
    x = _x(df, var)
    r = one_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"),
                       F.count(x).alias("n"), F.stddev_samp(x).alias("sd")))
    spark = df.sparkSession
    if not r["n"] or r["sd"] is None or r["sd"] == 0:
        return spark.createDataFrame([], "i int, x double, density double")
    lo, hi, n, sd = r["lo"], r["hi"], r["n"], r["sd"]
    h = sd * n ** (-1.0 / 5.0)
    step = (hi - lo) / (points - 1) if points > 1 else 0.0
    grid = [lo + step * i for i in range(points)]
    if points > 1:
        grid[-1] = hi
    width = h / 2
    rows = df.select(x.alias("x")).where(F.col("x").isNotNull())
    rows = rows.select("x", F.floor((F.col("x") - F.lit(lo)) / F.lit(width)).alias("box"))
    u = (F.col("x") - F.lit(lo) - (F.col("box") + F.lit(0.5)) * F.lit(width)) / F.lit(h)
    powers = [F.lit(1.0)]
    for _ in range(KDE_TERMS - 1):
        powers.append(powers[-1] * u)
    boxes = rows.groupBy("box").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(powers)])
    sums = (boxes.mapInArrow(_gauss_sums(grid, lo, width, h), "i int, s double").groupBy("i").agg(F.sum("s").alias("s")))
    total = {row["i"]: row["s"] for row in collect_bounded(sums, points)}
    norm = float(n) * h * math.sqrt(2.0 * math.pi)
    return spark.createDataFrame([(i, float(g), total[i] / norm) for i, g in enumerate(grid)], "i int, x double, density double")


def _gauss_sums(grid: Sequence[float], lo: float, width: float, h: float):
    """Box moments -> what a batch of boxes adds at each grid point."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total, points = np.zeros(len(grid)), np.array(grid)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                middle = lo + (batch.column("box").to_numpy() + 0.5) * width
                t = (points[None, :] - middle[:, None]) / h
                near = np.abs(t) < 39  # beyond it the kernel is below the least double
                t = np.where(near, t, 0.0)
                series, before, now = np.zeros(t.shape), np.zeros(t.shape), np.ones(t.shape)
                for k in range(KDE_TERMS):
                    series += now * (batch.column(f"m{k}").to_numpy() / math.factorial(k))[:, None]
                    before, now = now, t * now - k * before
                total += np.where(near, np.exp(-0.5 * t * t) * series, 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid), dtype=np.int32)), pa.array(total)], names=["i", "s"])
    return run


def normal_curve(df: DataFrame, var: str, points: int = KDE_POINTS) -> DataFrame:
    """Fitted normal pdf (mean, ddof=0 std) on the KDE grid — closed form."""
    x = _x(df, var)
    stats = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mu"),
                   F.stddev_pop(x).alias("sd"))
    step = (F.col("hi") - F.col("lo")) / F.lit(max(points - 1, 1))
    gx = F.when(F.col("i") == points - 1, F.col("hi")).otherwise(
        F.col("i").cast("double") * step + F.col("lo"))
    g = stats.where(F.col("sd") > 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    g = g.withColumn("x", gx)
    return g.select(F.col("i").cast("int").alias("i"), "x",
                    norm_pdf_col(F.col("x"), F.col("mu"), F.col("sd")).alias("density"))


def qq_points(df: DataFrame, var: str, max_points: int | None = None) -> DataFrame:
    """Pos, theoretical = Φ⁻¹(linspace(0.01, 0.99, n)[pos]), observed = sorted value.

    The sorted sample comes from the R1 plan (no global sort in one task).
    ``max_points`` keeps every k-th position (thinning, off by default).
    """
    src = df.select(_x(df, var).alias("_x"))
    pos = sorted_positions(value_offsets(src, "_x"))
    n = F.col("n")
    p = F.when(n == 1, F.lit(0.01)).when(F.col("pos") == n, F.lit(0.99)).otherwise(
        (F.col("pos") - 1).cast("double") * (F.lit(0.98) / (n - 1)) + F.lit(0.01))
    out = pos.select(F.col("pos"), ppnd_col(p).alias("theoretical"), F.col("value").alias("observed"))
    if max_points:
        total = one_row(src.agg(F.count("_x").alias("n")))["n"]
        step = max(1, math.ceil(total / max_points))
        out = out.where(((F.col("pos") - 1) % step == 0) | (F.col("pos") == total))
    return out


def qq_reference_line(df: DataFrame, var: str) -> DataFrame:
    """y = x line between the first and last theoretical quantile."""
    x = _x(df, var)
    stats = df.agg(F.count(x).alias("n"))
    lo = ppnd_col(F.lit(0.01))
    hi = ppnd_col(F.when(F.col("n") == 1, F.lit(0.01)).otherwise(F.lit(0.99)))
    return stats.where(F.col("n") > 0).select(lo.alias("x0"), hi.alias("x1"), lo.alias("y0"), hi.alias("y1"))


def adjusted_moments(x) -> tuple:
    """(skew G1, excess kurtosis G2) bias-adjusted, as aggregate Column expressions."""
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    g2 = F.kurtosis(x)
    skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return skew, kurt


@plain_names("var", "by", out=["by"])
def distribution_summary(df: DataFrame, var: str, by: str | None = None) -> DataFrame:
    """N, mean, median, std (ddof=1), skewness G1, kurtosis G2 (bias-adjusted)."""
    src, keys = _keyed(df, var, by)
    skew, kurt = adjusted_moments(F.col("_x"))
    moments = src.groupBy(*keys).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"),
                                     F.stddev_samp("_x").alias("std"), skew.alias("skewness"),
                                     kurt.alias("kurtosis"))
    med = exact_quantiles_refined(src.where(F.col("_x").isNotNull()), "_x", [0.5], keys).select(
        *keys, F.get("q", F.lit(0)).alias("median"))
    out = attach(moments, med, keys, bool(by), "left", broadcast=False)
    return out.select(*([by] if by else []), "n", "mean", "median", "std", "skewness", "kurtosis")
