"""Files as rows: catalogues, the check for PDFs, text extraction, anonymous names, result sinks."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablespan.sources import pdf


def catalogue(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """folder, file_name, path and size of the files below a path; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path", F.col("length").alias("size")
    )


def is_pdf(content: Column) -> Column:
    return F.substring(content, 1, 5) == F.lit(b"%PDF-")


def valid_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path and content of the files that begin as PDFs do."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(is_pdf(F.col("content"))).select("path", "content")


def extracted_text(files: DataFrame, pages_of: Callable[[bytes], list[str]] = pdf.pages) -> DataFrame:
    """path, page (from 1) and text of each page, by a function from a file's bytes to its pages' texts.

    The default reads plain PDF files; any PDF library on the executors can be passed in.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                texts = pages_of(content)
                yield pa.RecordBatch.from_pydict({"path": [path] * len(texts), "page": pa.array(range(1, len(texts) + 1), pa.int32()), "text": pa.array(texts, pa.string())})

    return files.select("path", "content").mapInArrow(work, "path string, page int, text string")


def assembled(pages: DataFrame, newline: bool = True) -> DataFrame:
    """Documents from pages in order; each page ends in a newline, unless told otherwise."""
    end = "\n" if newline else ""
    rows = pages.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("p"))
    return rows.select("path", F.array_join(F.transform("p", lambda x: F.concat(x["text"], F.lit(end))), "").alias("text"))


def anonymous_names(files: DataFrame, name: str = "file_name") -> DataFrame:
    """anon_name and orig_name: `confidential_001.pdf` and so on, by name.

    Numbers come from the rows before each range of names, so no task sees all names.
    """
    ranged = files.select(F.col(name).alias("orig_name")).repartitionByRange("orig_name").withColumn("part", F.spark_partition_id())
    within = Window.partitionBy("part").orderBy("orig_name")
    numbered = ranged.withColumn("k", F.row_number().over(within))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = numbered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    number = F.col("base") + F.col("k")
    return numbered.join(bases, "part").select(F.format_string("confidential_%03d.pdf", number).alias("anon_name"), "orig_name")


def as_pdf(redacted: DataFrame, deflate: bool = False) -> DataFrame:
    """doc_id and content, a PDF file, of redacted texts (doc_id, redacted); masked characters become black boxes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pdf.document(t or "", deflate=deflate) for t in batch.column("redacted").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "content"])

    return redacted.select("doc_id", "redacted").mapInArrow(work, "doc_id bigint, content binary")


def write_run(metrics: DataFrame, path: str) -> None:
    """Run metrics (run_id and more), which replace what the same runs had.

    Rows go to a folder of this attempt's own; then one line a run in the manifest names the attempt. A
    write that breaks off has no line, so no one sees what it left, and one that is repeated gives way to the last.
    """
    attempt = uuid.uuid4().hex
    metrics.withColumn("attempt", F.lit(attempt)).write.partitionBy("attempt", "run_id").mode("append").parquet(f"{path}/rows")
    _complete(metrics.sparkSession, path, attempt)


def _complete(spark: SparkSession, path: str, attempt: str) -> None:
    """Tell readers that an attempt's runs are whole."""
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("attempt") == attempt)
    lines = rows.groupBy(F.col("run_id").cast("string").alias("run_id")).agg(F.count("*").alias("n")).select("run_id", "n", F.lit(attempt).alias("attempt"), F.lit(time.time_ns()).alias("at"))
    lines.coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def read_runs(spark: SparkSession, path: str, *runs: str) -> DataFrame:
    """The rows of each of runs as it was last written whole. Folders of other runs and attempts aren't read."""
    lines = spark.read.parquet(f"{path}/manifest").filter(F.col("run_id").isin(*runs))
    last = lines.groupBy("run_id").agg(F.max_by("attempt", F.struct("at", "attempt")).alias("attempt")).collect()  # a row a run asked for
    whole = F.lit(False)
    for r in last:
        whole = whole | ((F.col("run_id") == r["run_id"]) & (F.col("attempt") == r["attempt"]))
    return spark.read.parquet(f"{path}/rows").filter(whole).drop("attempt")


def write_results(results: DataFrame, path: str, kind: str = "json") -> None:
    """Results as JSON lines or CSV."""
    results.write.option("header", "true").format(kind).save(path)
