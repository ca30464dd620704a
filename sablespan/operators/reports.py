"""Reports and adapters over detections, annotations and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_json(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and the other columns as one JSON object."""
    return rows.select(key, F.to_json(F.struct(*[c for c in rows.columns if c != key])).alias("json"))


def last_by_text(rows: DataFrame, order: list) -> DataFrame:
    """Of the rows of a document with one text the last in order."""
    by = Window.partitionBy("doc_id", "text").orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


def first_by_text(rows: DataFrame, order: list) -> DataFrame:
    """Of the rows of a document with one text the first in order."""
    by = Window.partitionBy("doc_id", "text").orderBy(*order)
    return rows.withColumn("n", F.row_number().over(by)).filter("n = 1").drop("n")


def percent(share: Column) -> Column:
    """A share as text with two digits, from whole hundredths of a percent, so that ties don't depend on binary fractions."""
    hundredths = F.floor(share * 10_000 + F.lit(0.5)).cast("bigint")
    return F.concat((hundredths / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"), F.lit("%"))


def metrics_report(rates: DataFrame, by: str) -> DataFrame:
    """by and one line of text with precision, recall and F1."""
    parts = [F.concat(F.lit(f"{name}: "), percent(F.col(column))) for name, column in (("P", "precision"), ("R", "recall"), ("F1", "f1"))]
    return rates.select(by, F.concat_ws(", ", *parts).alias("report"))


def correction_counts(relocated: DataFrame) -> DataFrame:
    """How annotations were found again: a row a way, with how many need review."""
    return relocated.groupBy("how").agg(F.count("*").alias("n"), F.count_if(F.col("place") < 0).alias("needs_review"))


def literal_pattern(literal: str):
    """A pattern that matches just this text."""
    from sablespan.operators.extract import Pattern

    return Pattern("LITERAL", "literal", "".join(c if c.isalnum() or c == " " else f"\\{c}" for c in literal), 100)


def occurrences(docs: DataFrame, literal: str) -> DataFrame:
    """Every place of a literal in the documents, with its number in the document."""
    from sablespan.operators.extract import find_spans

    return find_spans(docs, [literal_pattern(literal)]).select("doc_id", "ordinal", "start_char", "end_char")


def from_json(rows: DataFrame, schema: str, key: str = "doc_id") -> DataFrame:
    """key and the columns of as_json()'s objects."""
    return rows.select(key, F.from_json("json", schema).alias("j")).select(key, "j.*")


def single_reports(analysed: DataFrame) -> DataFrame:
    """analysed with report, a line of text on each entity."""
    reasons = F.when(F.col("reasons") != "", F.concat(F.lit(" because="), F.col("reasons"))).otherwise("")
    points = F.concat(F.col("original_points").cast("string"), F.lit(">"), F.col("points").cast("string"))
    return analysed.withColumn("report", F.concat(F.lit("type="), F.col("entity_type"), F.lit(" points="), points, reasons))


def batch_summary(analysed: DataFrame) -> DataFrame:
    """kind, name and n: how many entities there are of each type, each detector and each fifth of the confidence."""
    fifth = F.when((F.col("points") >= 0) & (F.col("points") < 100), F.floor(F.col("points") / 20).cast("string"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("type", F.col("entity_type")), ("source", F.col("source")), ("bucket", fifth))])
    return analysed.select(F.inline(kinds)).filter("name IS NOT NULL").groupBy("kind", "name").agg(F.count("*").alias("n"))


def listing(found: DataFrame, least: dict[str, int]) -> DataFrame:
    """found with words, the number of a text's words, and enough, whether its type asks for no more."""
    from sablespan.functions.text import word_count

    asked = F.lit(0)
    for name, n in least.items():
        asked = F.when(F.col("entity_type") == name, n).otherwise(asked)
    words = word_count(F.col("text")).cast("bigint")
    return found.withColumn("words", words).withColumn("enough", words >= asked)


def source_analysis(found: DataFrame) -> DataFrame:
    """What each detector's analysis looks at: shape for patterns, length for names, weight for ensembles."""
    text = F.col("text")
    return found.withColumn(
        "analysis",
        F.when(F.col("source") == "pattern", F.concat(F.lit("digits:"), F.length(F.regexp_replace(text, "[^0-9]", "")).cast("string")))
        .when(F.col("source") == "ner", F.concat(F.lit("chars:"), F.length(text).cast("string")))
        .otherwise(F.concat(F.lit("points:"), F.col("points").cast("string"))),
    )


def by_stem(left: DataFrame, right: DataFrame, left_path: str, right_path: str) -> DataFrame:
    """Files that share a name without folder and ending; files of left without a partner keep a null."""
    stem = lambda c: F.regexp_extract(c, r"([^/]+?)(?:\.[^./]*)?$", 1)
    a = left.withColumn("stem", stem(F.col(left_path)))
    b = right.withColumn("stem", stem(F.col(right_path)))
    return a.join(b, "stem", "left")
