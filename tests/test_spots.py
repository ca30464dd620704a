"""Phrases found in one pass over the texts, without an index and without exchanging words."""

from pyspark.sql import functions as F

from sablespan.operators import index as I
from sablespan.operators import redact as D

TEXTS = ["The cat  saw the cat\n\nTHE\nCAT é İX", "", None, "É é cat saw\n", "a the cat the cat saw"]


def test_spots_equal_the_index(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    phrases = spark.createDataFrame([(1, "the Cat"), (2, "cat saw"), (3, "é"), (4, "the cat saw the"), (5, "nowhere"), (6, "İX")], "phrase_id bigint, phrase string")
    columns = ["phrase_id", "doc_id", "first", "x0", "y0", "x1", "y1"]
    got = sorted(map(tuple, I.spots(docs, phrases).select(*columns).collect()))
    want = sorted(map(tuple, I.phrase_boxes(I.build_index(D.words(docs)), phrases).select(*columns).collect()))
    assert got == want and len({r[0] for r in got}) == 5


def test_spots_within_their_own_document(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    phrases = spark.createDataFrame([(0, "the cat"), (3, "the cat"), (4, "cat saw")], "doc_id bigint, phrase string")
    got = sorted((r["doc_id"], r["first"]) for r in I.spots(docs, phrases).collect())
    assert got == [(0, 1), (0, 4), (0, 6), (4, 5)]


def test_words_are_laid_out_without_an_exchange(spark, monkeypatch):
    monkeypatch.setattr(D, "SLICE", 8)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    laid = D.words(docs)
    assert "Exchange" not in laid._jdf.queryExecution().executedPlan().toString()
    got = [tuple(r) for r in laid.filter("doc_id = 0").orderBy("word_no").select("word_no", "line", "x0", "x1", "text").collect()]
    assert got[:6] == [(1, 0, 0, 3, "The"), (2, 0, 4, 7, "cat"), (3, 0, 9, 12, "saw"), (4, 0, 13, 16, "the"), (5, 0, 17, 20, "cat"), (6, 2, 0, 3, "THE")]
    assert laid.filter(F.col("text") == "").count() == 0
