"""Work on keys is spread over tasks by their number, not by the bytes of the file they come from."""

from sablespan.plans import base as B


def test_candidates_of_many_keys_are_many_tasks(spark, tmp_path):
    n = 3 * B.KEYS + 1
    spark.range(1, n + 1, numPartitions=1).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    made = B.candidates(spark, str(tmp_path), ["GPA", "PHI"])
    per_task = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(per_task) == 2 * n
    assert max(per_task) < 2 * 2 * B.KEYS
    assert made.select("cand_id").distinct().count() == 2 * n
