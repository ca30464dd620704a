"""Streamed metrics against the batch result, on shuffled input in several batches."""

import random

from pyspark.sql import functions as F

from sablespan.operators import matching
from sablespan.streaming.metrics import streamed_metrics

SCHEMA = "doc_id long, kind string, id string, entity_type string, text string, start_char int, end_char int, at timestamp"


def test_streamed_equals_batch(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for doc in range(12):
        for i in range(rng.randrange(1, 9)):
            a = rng.randrange(60)
            rows.append((doc, "truth", f"g{i}", rng.choice("AB"), "Ab c", a, a + 5))
            if rng.random() < 0.7:
                b = a + rng.choice([0, 0, 1, 3])
                rows.append((doc, "found", f"d{i}", rng.choice("AB"), rng.choice(["abc", "x"]), b, b + 5))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA.removesuffix(", at timestamp"))
    truth = df.filter("kind = 'truth'").withColumnRenamed("id", "gt_id").drop("kind")
    found = df.filter("kind = 'found'").withColumnRenamed("id", "det_id").drop("kind").withColumns({"points": F.lit(70), "source": F.lit("ner")})
    want = {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in matching.outcomes(truth, found).groupBy("doc_id").agg(*matching.counted()).collect()}

    stamp = lambda part, s: part.withColumn("at", F.timestamp_seconds(F.lit(s)))
    third = len(rows) // 3
    source = str(tmp_path / "in")
    for i in range(3):
        part = spark.createDataFrame(rows[i * third : (i + 1) * third if i < 2 else None], df.schema)
        stamp(part.coalesce(1), 1000 + i).write.mode("append").parquet(source)
    # Rows of another document move the watermark on; after that a row of document 0 is late, and then one more.
    stamp(spark.createDataFrame([(99, "truth", "g", "A", "x", 0, 5)], df.schema).coalesce(1), 10_000).write.mode("append").parquet(source)
    stamp(spark.createDataFrame([(0, "found", "late", "A", "x", 500, 505)], df.schema).coalesce(1), 1001).write.mode("append").parquet(source)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        out = streamed_metrics(stream, wait="5 minutes")
        query = out.writeStream.format("memory").queryName("stream_metrics").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        dropped = sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r["doc_id"]: (r["tp"], r["fp"], r["fn"]) for r in spark.sql("SELECT * FROM stream_metrics").collect()}
    assert got == want
    assert dropped == 1
