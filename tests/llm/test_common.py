import pyarrow as pa
from pyspark.sql import functions as F

from tablelens.llm.common import bounded_batches


def test_many_long_texts_go_to_workers_in_batches_of_bounded_bytes(spark):
    bounded_batches(spark)
    docs = spark.range(0, 60, 1, 1).select("id", F.repeat(F.lit("x"), 5_000_000).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})
    got = docs.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 60 and len(got) >= 4 and max(r["bytes"] for r in got) < 80 << 20
