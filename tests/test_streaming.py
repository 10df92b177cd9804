import os
import tempfile

from pyspark.sql import functions as F

from tablelens.operators.impute import fit_imputer
from tablelens.operators.scale import fit_scaler
from tablelens.operators.profile import describe_numeric
from tablelens.streaming.apply import profile_each_batch, stream_transform


def test_fitted_models_on_a_stream(spark):
    tmp = tempfile.mkdtemp(prefix="tl-stream-")
    batch = spark.createDataFrame([(1, 1.0), (2, None), (3, 5.0)], "id long, x double")
    batch.write.parquet(os.path.join(tmp, "in"))
    imp = fit_imputer(batch, mean=["x"])
    sc = fit_scaler(imp.transform(batch), "x", "minmax")
    stream = spark.readStream.schema(batch.schema).parquet(os.path.join(tmp, "in"))
    q = (stream_transform(stream, imp, sc).writeStream.format("memory").queryName("tl_stream_out")
         .option("checkpointLocation", os.path.join(tmp, "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM tl_stream_out ORDER BY id").collect()
    assert [r["x"] for r in got] == [1.0, 3.0, 5.0]
    assert [r["x_norm"] for r in got] == [0.0, 0.5, 1.0]

    seen = []
    w = profile_each_batch(stream, lambda b: describe_numeric(b, ["x"]),
                           lambda out, bid: seen.append(out.collect()[0]["count"]))
    q2 = w.option("checkpointLocation", os.path.join(tmp, "ck2")).start()
    q2.processAllAvailable()
    q2.stop()
    assert seen == [2]


def test_running_missing_counts(spark):
    from tablelens.streaming.apply import running_missing_counts
    tmp = tempfile.mkdtemp(prefix="tl-stream-mc-")
    schema = "a double, b string"
    spark.createDataFrame([(1.0, None), (float("nan"), "x")], schema).write.parquet(os.path.join(tmp, "in", "p1"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(tmp, "in", "*"))
    q = (running_missing_counts(stream).writeStream.outputMode("complete").format("memory")
         .queryName("tl_missing").option("checkpointLocation", os.path.join(tmp, "ck")).start())
    q.processAllAvailable()
    spark.createDataFrame([(None, None)], schema).write.parquet(os.path.join(tmp, "in", "p2"))
    q.processAllAvailable()
    q.stop()
    got = {r["variable"]: (r["rows"], r["missing"]) for r in spark.sql("SELECT * FROM tl_missing").collect()}
    assert got == {"a": (3, 2), "b": (3, 2)}
