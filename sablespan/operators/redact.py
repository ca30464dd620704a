"""Masking spans in texts, and words with boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablespan.operators.extract import bound

MASK = "█"


def merged(spans: DataFrame) -> DataFrame:
    """Maximal runs of overlapping or touching spans of each document: doc_id, start_char, end_char."""
    order = Window.partitionBy("doc_id").orderBy("start_char", "end_char")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("start_char") > F.max("end_char").over(before)).cast("int"), F.lit(1))
    grouped = spans.withColumn("new", new).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "run").agg(F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("run")


#: Characters looked at together when a text is masked, so that no offset is counted from a long text's start.
BLOCK = 4096


def _by_blocks(text: Column, runs: Column, body) -> Column:
    """text with body(characters, run) in place of each run (ordered structs of start_char and end_char), block by
    block. Runs are clipped to the blocks; opens and closes tell where one really begins and ends."""

    def block(part: Column, k: Column) -> Column:
        at, upto = k * BLOCK, (k + 1) * BLOCK
        own = F.filter(runs, lambda r: (r["end_char"] > at) & (r["start_char"] < upto))
        own = F.transform(
            own,
            lambda r: F.struct(
                F.greatest(r["start_char"] - at, F.lit(0)).alias("a"),
                F.least(r["end_char"] - at, F.length(part)).alias("b"),
                (r["start_char"] >= at).alias("opens"),
                (r["end_char"] <= upto).alias("closes"),
            ),
        )

        def pieces(clipped: Column) -> Column:
            before = lambda i: F.coalesce(F.get(clipped, i - 1)["b"], F.lit(0))
            each = F.transform(clipped, lambda r, i: F.concat(F.substring(part, before(i) + 1, r["a"] - before(i)), body(F.substring(part, r["a"] + 1, r["b"] - r["a"]), r)))
            return F.concat(F.array_join(each, ""), F.substring(part, before(F.size(clipped)) + 1, F.lit(BLOCK)))

        return bound(own, pieces)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.array_join(F.transform(blocks, block), "")


def mask_expression(text: Column, runs: Column, mask: str = MASK) -> Column:
    """text with every character of the runs masked."""
    return _by_blocks(text, runs, lambda _, r: F.repeat(F.lit(mask), r["b"] - r["a"]))


def highlight_expression(text: Column, runs: Column) -> Column:
    """text with each run between double brackets: the reversible form."""

    def marked(body: Column, r: Column) -> Column:
        return F.concat(F.when(r["opens"], "[[").otherwise(""), body, F.when(r["closes"], "]]").otherwise(""))

    return _by_blocks(text, runs, marked)


def redact(docs: DataFrame, spans: DataFrame, highlight: bool = False) -> DataFrame:
    """doc_id, redacted (the text with all spans masked or marked) and masked_chars of every document."""
    runs = merged(spans.select("doc_id", F.col("start_char").cast("int"), F.col("end_char").cast("int")))
    per = runs.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("start_char", "end_char"))).alias("runs"),
        F.sum(F.col("end_char") - F.col("start_char")).cast("bigint").alias("masked_chars"),
    )
    joined = docs.select("doc_id", "text").join(per, "doc_id", "left")
    change = highlight_expression if highlight else mask_expression
    new = F.when(F.col("runs").isNull(), F.col("text")).otherwise(change(F.col("text"), F.col("runs")))
    return joined.select("doc_id", new.alias("redacted"), F.coalesce("masked_chars", F.lit(0)).alias("masked_chars"))


#: Characters of documents that are laid out together.
SLICE = 1 << 23


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE bytes; a longer document is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")), at + 1)
        yield batch.slice(at, end - at)
        at = end


def laid_out(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray], pa.Array]:
    """The words of a batch's texts: each one's row in the batch, its word_no, line, x0 and x1, and the words."""
    lines = pc.split_pattern(batch.column("text"), "\n")
    cells = pc.split_pattern(pc.list_flatten(lines), " ")
    doc_of = pc.list_parent_indices(lines).to_numpy(zero_copy_only=False)
    line_of = pc.list_parent_indices(cells).to_numpy(zero_copy_only=False)
    texts = pc.list_flatten(cells)
    sizes = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    ahead = np.concatenate(([0], ends))[np.searchsorted(line_of, np.arange(len(doc_of)))]  # before each line
    some = sizes > 0
    line_of, ends, sizes = line_of[some], ends[some] - 1, sizes[some]
    rows, x1 = doc_of[line_of], ends - ahead[line_of]
    line = line_of - np.searchsorted(doc_of, rows)
    word_no = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
    return rows, {"word_no": word_no, "line": line, "x0": x1 - sizes, "x1": x1}, texts.filter(pa.array(some))


def longest(rows: np.ndarray, places: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    """The number of each row's longest word, the least of several in the order of their bytes."""
    begin = np.flatnonzero(np.diff(rows, prepend=-1))
    sizes = places["x1"] - places["x0"]
    most = np.repeat(np.maximum.reduceat(sizes, begin), np.diff(begin, append=len(rows)))
    tied = np.flatnonzero(sizes == most)
    table = pa.table({"row": rows[tied], "text": texts.take(pa.array(tied))})
    tied = tied[pc.sort_indices(table, [("row", "ascending"), ("text", "ascending")]).to_numpy()]
    return tied[np.flatnonzero(np.diff(rows[tied], prepend=-1))]


def words(docs: DataFrame, pick: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """The words of texts laid out in lines: doc_id, word_no, line (y), x0 and x1 in characters, and text.

    A row is a document, so its words are numbered where it is read and nothing is exchanged. Of what laid_out() gives, pick
    tells the numbers of the words that leave the worker; without it all do."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows, places, texts = laid_out(part)
                if len(rows) and pick:
                    some = pick(rows, places, texts)
                    rows, places, texts = rows[some], {k: v[some] for k, v in places.items()}, texts.take(pa.array(some))
                if len(rows):
                    numbers = [pa.array(v, pa.int32()) for v in places.values()]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(rows)), *numbers, texts], names=["doc_id", *places, "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, word_no int, line int, x0 int, x1 int, text string")


def first_pages(annotations: DataFrame, pages: DataFrame) -> DataFrame:
    """Annotations (doc_id, gt_id, text) with the first page of their document that has the text, its place there and in
    the whole, and needs_review where no page has it."""
    whole = page_offsets(pages).withColumnRenamed("text", "body")
    at = F.instr(F.col("body"), F.col("text"))
    hits = annotations.join(whole, "doc_id").withColumn("at", at).filter("at > 0")
    first = hits.groupBy("doc_id", "gt_id").agg(F.min(F.struct("page", "at", "before")).alias("hit"))
    found = annotations.join(first, ["doc_id", "gt_id"], "left")
    start = (F.col("hit.at") - 1).cast("bigint")
    return found.select("doc_id", "gt_id", "hit.page", start.alias("start"), (F.col("hit.before") + start).alias("absolute"), F.col("hit").isNull().alias("needs_review"))


def context_words(laid: DataFrame, reach: int = 2) -> DataFrame:
    """Each word with the words at most reach places away, in order."""
    frame = Window.partitionBy("doc_id").orderBy("word_no").rowsBetween(-reach, reach)
    return laid.withColumn("context", F.array_join(F.collect_list("text").over(frame), " "))


def lines_of(laid: DataFrame, gap: int = 0) -> DataFrame:
    """Words joined into lines: a line breaks where the step down from the word before is over gap."""
    order = Window.partitionBy("doc_id").orderBy("word_no")
    down = F.col("line") - F.lag("line").over(order)
    numbered = laid.withColumn("new", F.coalesce((down > gap).cast("int"), F.lit(1)))
    numbered = numbered.withColumn("line_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = numbered.groupBy("doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "text"))).alias("w"))
    return rows.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.array_join("w.text", " ").alias("line"))


def page_offsets(pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, text) with the number of characters before each."""
    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("before", F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)).cast("bigint"))


def instances(rows: DataFrame) -> DataFrame:
    """rows with instance: the number, from 1, within document, text and type by place."""
    order = Window.partitionBy("doc_id", "text", "entity_type").orderBy(F.coalesce("start_char", F.lit(0)), "gt_id")
    return rows.withColumn("instance", F.row_number().over(order))


def relocated(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """Annotations (doc_id, gt_id, text) with their place in the document: exact, else with white space made
    single spaces, else the longest run of leading words that has four fifths of them; else -1."""
    joined = annotations.join(docs.select("doc_id", F.col("text").alias("body")), "doc_id")
    exact = F.instr("body", F.col("text"))
    flat, flat_text = F.regexp_replace("body", r"\s+", " "), F.regexp_replace("text", r"\s+", " ")
    loose = F.instr(flat, flat_text)
    parts = F.split(flat_text, " ")
    least = F.ceil(F.size(parts) * 0.8).cast("int")
    runs = F.transform(F.sequence(F.size(parts), least, F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), " "))
    run = F.try_element_at(F.filter(runs, lambda r: F.contains(flat, r)), F.lit(1))
    how = F.when(exact > 0, "exact").when(loose > 0, "spaces").when(run.isNotNull(), "prefix").otherwise("missing")
    place = F.when(exact > 0, exact - 1).when(loose > 0, loose - 1).when(run.isNotNull(), F.instr(flat, run) - 1).otherwise(-1)
    return joined.select("doc_id", "gt_id", how.alias("how"), place.cast("bigint").alias("place"))


def word_rates(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """words, redacted (words that a span touches) and rate (per cent), by document and over all."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "row"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    at = lines.select("doc_id", "line", F.coalesce(F.sum(F.length("row") + 1).over(before), F.lit(0)).alias("at"))
    placed = words(docs).join(at, ["doc_id", "line"]).select("doc_id", "word_no", (F.col("at") + F.col("x0")).alias("a"), (F.col("at") + F.col("x1")).alias("b"))
    # Words and spans meet by document and block, as spans do elsewhere, so that a long document isn't one key.
    blocks = lambda first, last: F.explode(F.sequence((first / BLOCK).cast("int"), ((last - 1) / BLOCK).cast("int")))
    left = placed.select("*", blocks(F.col("a"), F.col("b")).alias("block"))
    right = spans.select("doc_id", "start_char", "end_char", blocks(F.col("start_char"), F.col("end_char")).alias("block"))
    hit = left.join(right, ["doc_id", "block"]).filter("a < end_char AND start_char < b").select("doc_id", "word_no").distinct()
    n = placed.groupBy("doc_id").agg(F.count("*").alias("n"))
    m = hit.groupBy("doc_id").agg(F.count("*").alias("m"))
    redacted = F.coalesce(F.sum("m"), F.lit(0)).cast("bigint")
    return n.join(m, "doc_id", "left").rollup("doc_id").agg(F.sum("n").cast("bigint").alias("words"), redacted.alias("redacted"), (redacted * 100 / F.sum("n")).alias("rate"))
