"""Commands over annotated documents: detect, analyze, batch and compare.

    python -m sablespan.cli detect --docs DOCS --type PHI
    python -m sablespan.cli analyze --docs DOCS --pattern validation-rules --format json
    python -m sablespan.cli batch --docs DOCS --truth TRUTH --runs RUNS --run-id A
    python -m sablespan.cli compare --runs RUNS --run-id A --compare-with B

DOCS is a Parquet table of doc_id and text, TRUTH one of doc_id, gt_id, entity_type, text, start_char and end_char.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sablespan.operators import analysis as A
from sablespan.operators import ensemble as E
from sablespan.operators import matching as M
from sablespan.operators import runs as R
from sablespan.operators.extract import CUSTOM, DATES, PATTERNS, Registry, find_spans
from sablespan.session import session
from sablespan.shared import stored
from sablespan.sources.files import read_runs, write_run

REPORTS = ("validation-rules", "confidence-impact", "context-patterns", "false-positives")


def detections(docs: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Raw detections of all recognizers with t and d, their text and their document."""
    patterns = [*PATTERNS, *Registry().patterns(), *DATES]
    if entity_type:
        patterns = [p for p in patterns if p.entity_type == entity_type]
    custom = [p for p in CUSTOM if entity_type in (None, p.entity_type)]
    body = docs.select("doc_id", "text")
    sides = [(patterns, "pattern"), (custom, "ner")]
    rows = [find_spans(body, p).withColumn("source", F.lit(name)) for p, name in sides if p]
    found = rows[0] if len(rows) == 1 else rows[0].unionByName(rows[1])
    found = found.drop("pattern", "ordinal").distinct()
    return found.withColumn("t", F.col("text")).join(body.withColumnRenamed("text", "d"), "doc_id")


def detect(docs: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Full detection, or that of one type, by document and place."""
    found = detections(docs, entity_type)
    return (E.detect_target(found, entity_type) if entity_type else E.detect_full(found)).orderBy("doc_id", "start_char", "end_char")


def analyze(docs: DataFrame, report: str, entity_type: str | None = None) -> DataFrame:
    """One of REPORTS over the validated detections."""
    rows = E.validated(detections(docs, entity_type))
    if report == "validation-rules":
        return A.rule_counts(rows).orderBy(F.desc("n"), "reason")
    if report == "confidence-impact":
        return A.impact(rows)
    if report == "context-patterns":
        counts = A.indicators(F.col("d"))
        return rows.groupBy("entity_type").agg(*[F.count_if(c > 0).alias(k) for k, c in counts.items()])
    return A.flags(rows).filter("flags <> ''").select("doc_id", "entity_type", "text", "points", "flags")


def batch(docs: DataFrame, truth: DataFrame, run_id: str) -> DataFrame:
    """Run metrics by type and over all: run_id, test_id, scope, key, metric and value."""
    found = stored(detect(docs).withColumn("det_id", F.sha1(F.concat_ws(":", "entity_type", "start_char", "end_char", "source", "text"))).dropDuplicates(["doc_id", "det_id"]), "detected")
    rows = M.outcomes(stored(truth, "truth"), found).groupingSets([["entity_type"], []], "entity_type").agg(*M.counted())
    names = ("precision", "recall", "f1")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    scope = F.when(F.col("entity_type").isNull(), "overall").otherwise("type")
    tall = M.rates(rows).select(scope.alias("scope"), F.coalesce("entity_type", F.lit("all")).alias("key"), F.inline(pairs))
    return tall.select(F.lit(run_id).alias("run_id"), F.lit("batch").alias("test_id"), "scope", "key", "metric", "value")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="sablespan")
    out.add_argument("command", choices=["detect", "analyze", "batch", "compare"])
    out.add_argument("--docs")
    out.add_argument("--truth")
    out.add_argument("--type", dest="entity_type")
    out.add_argument("--pattern", choices=REPORTS, default=REPORTS[0])
    out.add_argument("--runs", help="folder of run metrics")
    out.add_argument("--run-id", default="run")
    out.add_argument("--compare-with")
    out.add_argument("--format", choices=["text", "json"], default="text")
    out.add_argument("--output", help="folder to write to instead of printing")
    out.add_argument("--rows", type=int, default=50, help="rows to print")
    out.add_argument("--quiet", action="store_true")
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> DataFrame:
    args = parser().parse_args(arguments)
    spark = spark or session()
    docs = spark.read.parquet(args.docs) if args.docs else None
    if args.command == "detect":
        out = detect(docs, args.entity_type)
    elif args.command == "analyze":
        out = analyze(docs, args.pattern, args.entity_type)
    elif args.command == "batch":
        out = stored(batch(docs, spark.read.parquet(args.truth), args.run_id), "metrics")
        if args.runs:
            write_run(out, args.runs)
    else:
        out = R.compared(read_runs(spark, args.runs, args.run_id, args.compare_with), args.run_id, args.compare_with)
    if args.output:
        out.write.mode("overwrite").format("json" if args.format == "json" else "csv").save(args.output)
    elif not args.quiet:
        if args.format == "json":
            print("\n".join(out.limit(args.rows).toJSON().collect()))
        else:
            out.show(args.rows, truncate=False)
    return out


if __name__ == "__main__":
    main()
