"""Annotation files, case files and manifests as tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablespan.schema import ANNOTATION_FILE, SENSITIVITY
from sablespan.sources import yaml


def read_annotations(spark: SparkSession, path: str, strict: bool = True, fail: bool = False) -> DataFrame:
    """A row an annotation of JSON or YAML files like {document, entities}.

    strict: only complete rows of a known sensitivity are returned; quarantined() has the others, or, with fail,
    the first of them ends the job. Else what is missing is filled in: start 0, end the text's length, sensitivity low.
    """
    rows = _flat(spark, path)
    if strict and fail:
        wrong = F.raise_error(F.concat(F.lit("incomplete annotation in "), F.coalesce("file_name", F.lit("?")), F.lit(", number "), F.col("ann_id").cast("string")))
        return rows.withColumn("text", F.when(F.coalesce(_complete(), F.lit(False)), F.col("text")).otherwise(wrong))
    if strict:
        return rows.filter(_complete())
    return rows.withColumns(
        {
            "start_char": F.coalesce("start_char", F.lit(0)),
            "end_char": F.coalesce("end_char", F.coalesce("start_char", F.lit(0)) + F.length("text")),
            "sensitivity": F.coalesce("sensitivity", F.lit("low")),
            "source": F.lit("ground_truth"),
        }
    )


def quarantined(spark: SparkSession, path: str) -> DataFrame:
    """The rows that a strict read leaves out."""
    return _flat(spark, path).filter(~F.coalesce(_complete(), F.lit(False)))


def _complete():
    return (
        F.col("text").isNotNull()
        & (F.col("text") != "")
        & F.col("entity_type").isNotNull()
        & (F.col("start_char") >= 0)
        & (F.col("end_char") > F.col("start_char"))
        & F.col("sensitivity").isin(*SENSITIVITY)
    )


def _flat(spark: SparkSession, path: str) -> DataFrame:
    files = as_json(spark, path).select(F.inline(F.array(F.from_json("value", ANNOTATION_FILE))))
    rows = files.select(F.col("document.file_name").alias("file_name"), F.posexplode("entities").alias("ann_id", "e"))
    return rows.select(
        "file_name", "ann_id", "e.text", F.col("e.type").alias("entity_type"), "e.should_redact", "e.location.*", "e.sensitivity", "e.instance", "e.needs_review", "e.review_reason"
    )


def as_json(spark: SparkSession, path: str) -> DataFrame:
    """value: the files at path, each as one JSON text. YAML files are read as such, by their ending."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,yaml,yml}").load(path)

    def work(frames):
        for frame in frames:
            texts = [bytes(c).decode() for c in frame["content"]]
            frame["value"] = [t if p.endswith(".json") else json.dumps(yaml.load(t), default=str) for p, t in zip(frame["path"], texts, strict=True)]
            yield frame[["value"]]

    return files.select("path", "content").mapInPandas(work, "value string")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Validator cases: files with one array each, under any name."""
    case = "array<struct<text: string, context: string, expected_valid: boolean, min_confidence_adjustment: double, description: string>>"
    text = spark.read.text(path, wholetext=True)
    values = F.map_values(F.from_json("value", f"map<string, {case}>"))
    return text.select(F.explode(F.flatten(values)).alias("c")).select("c.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Test cases: id, original_file, annotation_file, description."""
    one = "struct<id: string, original_file: string, annotation_file: string, description: string>"
    files = as_json(spark, path).select(F.from_json("value", f"test_cases array<{one}>").alias("v"))
    return files.select(F.explode("v.test_cases").alias("c")).select("c.*")


def write_annotations(rows: DataFrame, path: str) -> None:
    """Corrected annotations, grouped by file again."""
    entity = F.struct(
        "text", F.col("entity_type").alias("type"), "should_redact", F.struct("page", "start_char", "end_char").alias("location"), "sensitivity", "instance", "needs_review", "review_reason"
    )
    files = rows.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct("ann_id", entity.alias("e")))).alias("rows"))
    files.select(F.struct("file_name").alias("document"), F.col("rows.e").alias("entities")).write.json(path)
