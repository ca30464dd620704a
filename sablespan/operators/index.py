"""A stored positional index of words: where each token stands, in which documents.

postings: token, doc_id, gaps, lines, x0 and x1, a row a token and document, sorted by token and document over all
files.  A lookup by token reads the row groups whose range holds it; a common token's postings are
spread over as many files as they fill.  Positions and lines rise, so they are kept as gaps.
tokens: token, docs and places, to tell which token of a phrase is the rarest.

An index is for lookups that come again and again. spots() answers a set of phrases at once, of any size, in one pass over the texts and
without an index.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablespan.operators.extract import running
from sablespan.operators.redact import laid_out, slices
from sablespan.shared import shared_path


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    tokens: DataFrame


def _gaps(values: Column) -> Column:
    return F.transform(values, lambda v, i: v - F.when(i > 0, F.get(values, i - 1)).otherwise(0))


def build_index(laid: DataFrame, path: str | None = None) -> Index:
    """Write the index of words (doc_id, word_no, line, x0, x1, text) below path, or in the shared folder."""
    spark = laid.sparkSession
    path = path or shared_path(spark, "words")
    places = F.array_sort(F.collect_list(F.struct("word_no", "line", "x0", "x1")))
    grouped = laid.groupBy(F.lower("text").alias("token"), "doc_id").agg(places.alias("p"))
    rows = grouped.select("token", "doc_id", _gaps(F.col("p.word_no")).alias("gaps"), _gaps(F.col("p.line")).alias("lines"), F.col("p.x0").alias("x0"), F.col("p.x1").alias("x1"))
    order = ["token", "doc_id"]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("token").agg(F.count("*").alias("docs"), F.sum(F.size("gaps")).alias("places")).write.parquet(f"{path}/tokens")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/tokens"))


def _asked(phrases: DataFrame, *keys: str) -> DataFrame:
    """keys, n and, for each token of a phrase, k and token."""
    tokens = F.split(F.lower("phrase"), " ")
    return phrases.select(*keys, F.size(tokens).alias("n"), F.posexplode(tokens).alias("k", "token"))


def _boxes(hits: DataFrame, *keys: str) -> DataFrame:
    """Phrases' places and boxes from the postings of their tokens (keys, doc_id, n, k and a posting), by intersecting
    where each token would have the phrase begin."""
    each = F.struct("k", F.transform(running(F.col("gaps")), lambda p: p - F.col("k")).alias("starts"), running(F.col("lines")).alias("lines"), "x0", "x1")
    met = hits.select(*keys, "doc_id", "n", each.alias("t")).groupBy(*keys, "doc_id", "n").agg(F.collect_list("t").alias("t")).filter(F.size("t") == F.col("n"))
    common = F.aggregate(F.slice("t", 2, F.col("n")), F.col("t")[0]["starts"], lambda a, t: F.array_intersect(a, t["starts"]))
    found = met.select(*keys, "doc_id", "t", F.explode(common).alias("first"))
    at = F.transform("t", lambda t: F.struct((F.array_position(t["starts"], F.col("first")).cast("int") - 1).alias("i"), t.alias("t")))
    spots = F.transform(at, lambda x: F.struct(F.get(x["t"]["lines"], x["i"]).alias("y"), F.get(x["t"]["x0"], x["i"]).alias("x0"), F.get(x["t"]["x1"], x["i"]).alias("x1")))
    rows = found.select(*keys, "doc_id", "first", spots.alias("s"))
    return rows.select(
        *keys, "doc_id", "first", F.array_min("s.x0").alias("x0"), F.array_min("s.y").alias("y0"), F.array_max("s.x1").alias("x1"), F.array_max("s.y").alias("y1")
    )


def phrase_boxes(index: Index, phrases: DataFrame) -> DataFrame:
    """Every contiguous occurrence of phrases (phrase_id, phrase), with the box around it.

    A phrase's rarest token tells in which documents it can be; there its other tokens are looked up. A phrase with a token
    that no document has is nowhere.
    """
    asked = _asked(phrases, "phrase_id")
    counted = asked.join(index.tokens, "token")
    rare = counted.groupBy("phrase_id", "n").agg(F.min_by("token", F.struct("places", "k")).alias("token"), F.collect_list(F.struct("k", "token")).alias("all"))
    there = index.postings.select("token", "doc_id").join(rare.filter(F.size("all") == F.col("n")), "token")
    each = there.select("phrase_id", "doc_id", "n", F.inline("all"))
    return _boxes(each.join(index.postings, ["token", "doc_id"]), "phrase_id")


def phrase_boxes_within(index: Index, phrases: DataFrame) -> DataFrame:
    """phrase_boxes() of phrases that have a doc_id, each in its own document only: doc_id, phrase and its boxes."""
    asked = _asked(phrases, "doc_id", "phrase")
    return _boxes(asked.join(index.postings, ["token", "doc_id"]), "phrase")


def occurrences(index: Index, words: DataFrame) -> DataFrame:
    """word, doc_id, occurrence (from 1, in reading order) and place (line, x0, x1, word_no) of whole words (word)."""
    hits = index.postings.join(words.select("word", F.lower("word").alias("token")).distinct(), "token")
    spots = F.arrays_zip(running(F.col("gaps")).alias("word_no"), running(F.col("lines")).alias("line"), "x0", "x1")
    rows = hits.select("word", "doc_id", F.posexplode(spots).alias("i", "s"))
    return rows.select("word", "doc_id", (F.col("i") + 1).alias("occurrence"), "s.word_no", "s.line", "s.x0", "s.x1")


#: Bits of the filter that texts are read with; whatever the number of phrases, it has this size. A power of two.
BITS = 1 << 26
#: Bits of a row of bitmap_construct_agg().
_ROW = 1 << 15


def _hashed(tokens: Column) -> Column:
    step = lambda a, t: (a * 31 + F.crc32(t.cast("binary"))) % BITS
    return F.aggregate(tokens, F.size(tokens).cast("bigint"), step)


def _codes(tokens: list[str]) -> np.ndarray:
    """Hashes of tokens in small letters; -1 where Python's and Java's small letters might differ."""
    plain = lambda t: t.isascii() or (max(t) < "\u0250" and "\u0130" not in t)
    return np.array([zlib.crc32(t.lower().encode()) if plain(t) else -1 for t in tokens], np.int64)


def spots(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """Every contiguous occurrence of phrases (phrase: words between single spaces) in docs (doc_id, text), whatever the case: the columns
    of phrases, low (the phrase in small letters), doc_id, first (the first word's number) and the box around it: x0, y0, x1 and y1.

    A bitmap of the phrases' hashes goes to all tasks, so that only what it can't rule out leaves them; the join with the phrases
    decides. Where phrases have a doc_id, each is looked for in its own document only.
    """
    spark, keys = docs.sparkSession, ["doc_id", "low"] if "doc_id" in phrases.columns else ["low"]
    asked = phrases.withColumn("low", F.lower("phrase"))
    tokens = F.split("low", " ")
    numbered = asked.select(F.size(tokens).alias("n"), (_hashed(tokens) + 1).alias("h"))
    rows = numbered.groupBy(F.call_function("bitmap_bucket_number", "h").alias("k")).agg(
        F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", "h")).alias("bits"), F.collect_set("n").alias("n")
    )
    filled, sizes = np.zeros(BITS // 8, np.uint8), set()
    for r in rows.collect():  # at most BITS / _ROW rows
        filled[(r["k"] - 1) * _ROW // 8 : r["k"] * _ROW // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
        sizes |= set(r["n"])
    shared = spark.sparkContext.broadcast(filled)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in slices(batch):
                rows, at, texts = laid_out(part)
                coded = texts.dictionary_encode()
                code = _codes(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(rows) else np.zeros(0, np.int64)
                for n in sorted(sizes):
                    count = len(rows) - n + 1
                    if count <= 0:
                        continue
                    h, unsure = np.full(count, n, np.int64), np.zeros(count, bool)
                    for k in range(n):
                        h = (h * 31 + code[k : k + count]) % BITS
                        unsure |= code[k : k + count] < 0
                    may = (unsure | (bits[h >> 3] >> (h & 7) & 1).astype(bool)) & (rows[:count] == rows[n - 1 :])
                    first = np.flatnonzero(may)
                    if not len(first):
                        continue
                    every = first[:, None] + np.arange(n)
                    said = pc.binary_join(pa.ListArray.from_arrays(np.arange(0, every.size + 1, n, np.int32), texts.take(pa.array(every.ravel()))), " ")
                    places = (at["word_no"][first], at["x0"][every].min(1), at["line"][first], at["x1"][every].max(1), at["line"][first + n - 1])
                    numbers = [pa.array(p, pa.int32()) for p in places]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows[first])), said, *numbers], names=["doc_id", "said", "first", "x0", "y0", "x1", "y1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, said string, first int, x0 int, y0 int, x1 int, y1 int")
    seen = seen.select(F.lower("said").alias("low"), "doc_id", "first", "x0", "y0", "x1", "y1")
    return seen.join(asked, keys)


def word_spots(docs: DataFrame, words: DataFrame) -> DataFrame:
    """occurrences() of whole words (word) in docs (doc_id, text), by spots()."""
    order = Window.partitionBy("word", "doc_id").orderBy("first")
    placed = spots(docs, words.select("word", F.col("word").alias("phrase")).distinct()).withColumn("occurrence", F.row_number().over(order))
    return placed.select("word", "doc_id", "occurrence", F.col("first").alias("word_no"), F.col("y0").alias("line"), "x0", "x1")
