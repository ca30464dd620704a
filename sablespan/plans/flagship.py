"""The flagship query: spans, validators, keep words and masking in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablespan.functions.validators import judged
from sablespan.operators.ensemble import without_kept
from sablespan.operators.extract import CUSTOM, DATES, PATTERNS, RECOGNIZERS, find_spans
from sablespan.operators.redact import redact
from sablespan.plans.base import table


def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, redacted, masked_chars and n_entities of the documents that hold valid personal data."""
    docs = table(spark, sf_dir, "documents")
    patterns = [p for p in PATTERNS if p.entity_type not in RECOGNIZERS] + [p for t in RECOGNIZERS for p in RECOGNIZERS[t]] + CUSTOM + DATES
    body = docs.select("doc_id", "text")
    found = find_spans(body, patterns)
    rows = found.join(body.withColumnRenamed("text", "d"), "doc_id").withColumns({"t": F.col("text"), "source": F.lit("pattern")})
    kept = without_kept(judged(rows, F.col("entity_type")).filter("is_valid").select("doc_id", "text", "start_char", "end_char"))
    counts = kept.groupBy("doc_id").agg(F.count("*").alias("n_entities"))
    return redact(docs, kept).join(counts, "doc_id")
