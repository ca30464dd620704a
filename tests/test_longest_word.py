"""Of a text only its longest word leaves the worker that lays it out; documents that share an id still have one."""

import random

from pyspark.sql import functions as F

from sablespan.operators import redact as D
from sablespan.plans import queries as Z
from sablespan.plans import wider

TEXTS = [(1, "bb a\ncc  Bb"), (1, "cc aa dd"), (2, None), (3, ""), (4, " \n "), (5, "é😀 ab zz"), (None, "one three"), (None, "seven"), (6, "x y z x")]


def by_sort(laid):
    """As the query has it: the longest word, the least of several."""
    return laid.groupBy("doc_id").agg(F.min_by(F.lower("text"), F.struct(-F.length("text"), "text")).alias("word"))


def test_one_word_a_text(spark, monkeypatch):
    rng = random.Random(3)
    more = [(rng.choice([7, 8, 9, i]), " ".join("".join(rng.choice("abÉ😀") for _ in range(rng.choice([1, 2, 3, 3]))) for _ in range(rng.randrange(9)))) for i in range(10, 90)]
    docs = spark.createDataFrame(TEXTS + more, "doc_id bigint, text string").coalesce(2)
    every = sorted(map(tuple, by_sort(D.words(docs)).collect()), key=str)
    for size in (D.SLICE, 16):
        monkeypatch.setattr(D, "SLICE", size)
        picked = D.words(docs, D.longest)
        assert sorted(map(tuple, by_sort(picked).collect()), key=str) == every
        assert picked.count() == D.words(docs).select("doc_id").count() - D.words(docs).filter("word_no > 1").count()


def test_places_stay(spark):
    docs = spark.createDataFrame([(1, "a bbb\n cc dddd e")], "doc_id bigint, text string")
    assert [tuple(r) for r in D.words(docs, D.longest).collect()] == [(1, 4, 1, 4, 8, "dddd")]


def test_query_sorts_a_word_a_document(spark, sf_dir, monkeypatch):
    laid = []
    monkeypatch.setattr(Z, "laid_words", lambda *a, f=Z.laid_words: laid.append(f(*a)) or laid[-1])
    wider.longest_word_occurrences(spark, sf_dir)
    assert len(laid) == 1 and 0 < laid[0].count() <= spark.read.parquet(f"{sf_dir}/documents.parquet").count()
