"""Fitted transforms on streaming DataFrames.

Imputation and scaling are fitted once on a batch table (one aggregate) and
applied as pure projections, so the same model serves a ``readStream`` frame
with no state. Per-micro-batch profiles reuse the batch operators through
``foreachBatch``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.impute import ImputeModel
from ..operators.scale import ScaleModel


def stream_transform(stream: DataFrame, *models: ImputeModel | ScaleModel) -> DataFrame:
    """Apply fitted imputation / scaling models to a streaming frame (stateless)."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream …)")
    out = stream
    for m in models:
        if isinstance(m, ImputeModel) and any(v == "knn" for v in m.methods.values()):
            raise ValueError("KNN fill needs the whole donor table; apply it per batch instead")
        out = m.transform(out)
    return out


def profile_each_batch(stream: DataFrame, profile: Callable[[DataFrame], DataFrame],
                       sink: Callable[[DataFrame, int], None]):
    """``foreachBatch`` writer: run a batch profile (e.g. ``describe_numeric``) on every
    micro-batch and hand the result with its batch id to ``sink``."""
    def run(batch: DataFrame, batch_id: int) -> None:
        sink(profile(batch), batch_id)
    return stream.writeStream.foreachBatch(run)


def running_missing_counts(stream: DataFrame) -> DataFrame:
    """C3 on a stream: per column, rows seen and missing values so far.

    A streaming aggregation over the unpivoted null flags (state: one row per
    column), written with ``outputMode("complete")`` or ``"update"``.
    """
    from pyspark.sql import functions as F

    from ..plans.fit import missing_cond
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame (spark.readStream …)")
    flags = stream.select(*[missing_cond(stream, c).cast("long").alias(c) for c in stream.columns])
    long = flags.unpivot([], stream.columns, "variable", "is_missing")
    return long.groupBy("variable").agg(F.count(F.lit(1)).alias("rows"),
                                        F.sum("is_missing").alias("missing"))
