"""Files of token ids: what is read for a few documents."""

import pyarrow.parquet as pq
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sablespan.llm.token_output import BLOCKS, near, ranges_of, read_documents, write_tokens

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


def test_few_documents_read_few_files(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("some words of number"), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id"), (77, None), (77, "again")], "doc_id long, text string"))
    path = str(tmp_path / "tokens")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        write_tokens(docs, path, TOKENIZER, 2, block_ids=500)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    blocks = spark.read.schema(BLOCKS).parquet(path)
    wanted = spark.createDataFrame([(77,), (3999,), (123456,), (None,)], "doc_id long")
    some = near(blocks, wanted)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(last_id" in plan and "LessThanOrEqual(first_id" in plan
    assert blocks.count() > 30 and some.count() <= 4
    # By the files' own statistics: those of at most two files let any wanted id through.
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "tokens").glob("*.parquet")]
    at = {c: i for i, c in enumerate(files[0].schema.names)}
    edges = [(m.row_group(0).column(at["first_id"]).statistics.min, m.row_group(0).column(at["last_id"]).statistics.max) for m in files if m.num_rows]
    assert len(edges) == 8 and sum(any(a <= i <= b for i in (77, 3999)) for a, b in edges) == 2
    got = read_documents(blocks, wanted).collect()
    assert sorted(r["doc_id"] for r in got) == [77, 77, 77, 3999] and {len(r["ids"]) for r in got if r["doc_id"] == 77} > {1}
    every = read_documents(blocks, docs.select("doc_id")).collect()
    assert len(every) == 4002  # more than a few: all blocks
    one = next(r["ids"] for r in got if r["doc_id"] == 3999)
    assert one == next(r["ids"] for r in every if r["doc_id"] == 3999)
    assert read_documents(blocks, wanted.filter("doc_id = 123456")).count() == 0 and read_documents(blocks, wanted.limit(0)).count() == 0


@given(st.lists(st.integers(-(2**63), 2**63 - 1), max_size=40), st.integers(1, 8))
def test_ranges_hold_all_ids(ids, most):
    got = ranges_of(ids, most)
    assert len(got) <= most and all(any(a <= i <= b for a, b in got) for i in ids)
    assert all(b < c for (_, b), (c, _) in zip(got, got[1:])) and (len(set(ids)) > most or all(a == b for a, b in got))
