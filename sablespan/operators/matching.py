"""Comparing detected spans with annotated ones.

truth has doc_id, gt_id, entity_type, text, start_char, end_char; detected has doc_id, det_id and the
same, with points and source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablespan.functions.text import matcher_form
from sablespan.shared import stored

#: Characters in a block of the overlap join, so that one very long document isn't one key.
BLOCK = 4096


def ratio(a1: Column, b1: Column, a2: Column, b2: Column) -> Column:
    """Intersection over hull of two half-open spans, in ten-thousandths; 0 if they are apart."""
    inner = F.least(b1, b2) - F.greatest(a1, a2)
    hull = F.greatest(b1, b2) - F.least(a1, a2)
    return F.when(inner > 0, F.floor(inner * 10_000 / hull)).otherwise(0).cast("bigint")


def overlaps(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Overlapping pairs with their ratio. Spans meet by the blocks they touch; a pair is taken at the
    first block both touch."""

    def blocked(df: DataFrame, side: str) -> DataFrame:
        last = F.greatest(F.col("end_char") - 1, F.col("start_char"))
        return df.select(
            *[F.col(c).alias(f"{side}_{c}" if c != "doc_id" else c) for c in df.columns],
            F.explode(F.sequence((F.col("start_char") / BLOCK).cast("int"), (last / BLOCK).cast("int"))).alias("block"),
        )

    t, d = blocked(truth, "gt"), blocked(detected, "det")
    pairs = t.join(d, ["doc_id", "block"]).filter("gt_start_char < det_end_char AND det_start_char < gt_end_char")
    first = (F.greatest("gt_start_char", "det_start_char") / BLOCK).cast("int")
    value = ratio(F.col("gt_start_char"), F.col("gt_end_char"), F.col("det_start_char"), F.col("det_end_char"))
    return pairs.filter(F.col("block") == first).drop("block").withColumn("ratio", value)


def kind(pairs: DataFrame) -> Column:
    """exact: same type and normal text, ratio of 0.9 or more; partial: same type, ratio over 0.3 and up to
    0.5; type: the types differ; near: what lies between."""
    same = F.col("gt_entity_type") == F.col("det_entity_type")
    exact = same & (matcher_form(F.col("gt_text")) == matcher_form(F.col("det_text"))) & (F.col("ratio") >= 9_000)
    partial = same & (F.col("ratio") > 3_000) & (F.col("ratio") <= 5_000)
    return F.when(exact, "exact").when(partial, "partial").when(~same, "type").otherwise("near")


def _graded(pairs: DataFrame) -> DataFrame:
    """pairs with match_type and grade: exact before partial before other."""
    pairs = pairs.withColumn("match_type", kind(pairs))
    return pairs.withColumn("grade", F.when(F.col("match_type") == "exact", 0).when(F.col("match_type") == "partial", 1).otherwise(2))


def _classes(rows: DataFrame, ident: str) -> DataFrame:
    """Rows of equal place, type and text as one, with their ids in order: copies on both sides make one pair."""
    same = ["doc_id", "entity_type", "text", "start_char", "end_char"]
    return rows.groupBy(*same).agg(F.array_sort(F.collect_list(ident)).alias("ids"))


def _islands(pairs: DataFrame) -> DataFrame:
    """pairs with island: its number within the document. Where a pair begins at or behind all ends so far, a new one begins;
    pairs of different islands share no span."""
    low, high = F.least("gt_start_char", "det_start_char"), F.greatest("gt_end_char", "det_end_char")
    order = Window.partitionBy("doc_id").orderBy(low, high)
    before = F.max(high).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((low >= before).cast("int"), F.lit(1))
    return pairs.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


#: Better pairs first: exact before partial before other, then the higher ratio, then earlier starts. Within equals, smaller ids.
BETTER = ["grade", "ratio", "gt_start_char", "det_start_char"]


def _settle(equals: list[dict], used: dict) -> Iterator[tuple[dict, object, object]]:
    """Of equally good pairs of classes, row, annotation and detection of those taken: always the least ids that are free."""
    queue = []

    def offer(n: int) -> None:
        gt, det = equals[n]["gt_ids"], equals[n]["det_ids"]
        i, j = used.get(("gt", gt[0]), 0), used.get(("det", det[0]), 0)
        if i < len(gt) and j < len(det):
            heapq.heappush(queue, (gt[i], det[j], n))

    for n in range(len(equals)):
        offer(n)
    while queue:
        gt_id, det_id, n = heapq.heappop(queue)
        row = equals[n]
        g, d = ("gt", row["gt_ids"][0]), ("det", row["det_ids"][0])
        i, j = used.get(g, 0), used.get(d, 0)
        # Another pair may have taken one of the two since this was offered.
        if i < len(row["gt_ids"]) and j < len(row["det_ids"]) and (row["gt_ids"][i], row["det_ids"][j]) == (gt_id, det_id):
            used[g], used[d] = i + 1, j + 1
            yield row, gt_id, det_id
        offer(n)


def match_pairs(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """One-to-one pairs, taken greedily: the best pair of all, the best of those left, and so on. Better is exact
    before partial before other, then the higher ratio, the earlier start, the smaller id.

    Overlapping spans form islands, which have no span in common, so each is settled by itself in one pass over its
    pairs in order. Ids are distinct within a document. A chain of any length is one pass, and copies are one pair.
    """
    pairs = _islands(_graded(overlaps(_classes(truth, "gt_id"), _classes(detected, "det_id"))))
    kept = ["doc_id", "gt_entity_type", "det_entity_type", "gt_start_char", "det_start_char", "ratio", "match_type"]
    places = ["doc_id", "island"]
    ordered = pairs.select(*kept, "island", "grade", "gt_ids", "det_ids").sortWithinPartitions(*places, *[F.desc(c) if c == "ratio" else F.col(c) for c in BETTER])
    types = {f.name: f.dataType.simpleString() for f in ordered.schema}
    ids = [f"{new} {types[old].removeprefix('array<').removesuffix('>')}" for new, old in (("gt_gt_id", "gt_ids"), ("det_det_id", "det_ids"))]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = quality = None
        used: dict = {}
        equals: list[dict] = []
        for batch in batches:
            kinds = {f.name: f.type for f in batch.schema}
            schema = pa.schema([*[(c, kinds[c]) for c in kept], ("gt_gt_id", kinds["gt_ids"].value_type), ("det_det_id", kinds["det_ids"].value_type)])
            out: list[dict] = []
            for row in batch.to_pylist():
                at, worth = [row[c] for c in places], [row[c] for c in BETTER]
                if equals and (at != place or worth != quality):
                    out += [{c: r[c] for c in kept} | {"gt_gt_id": g, "det_det_id": d} for r, g, d in _settle(equals, used)]
                    equals = []
                if at != place:
                    used = {}
                place, quality = at, worth
                equals.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if equals:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in kept} | {"gt_gt_id": g, "det_det_id": d} for r, g, d in _settle(equals, used)], schema=schema)

    return ordered.mapInArrow(work, ", ".join([*[f"{c} {types[c]}" for c in kept], *ids]))


def first_matches(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Of each detection the first annotation that it matches exactly or in part, whatever others match it."""
    pairs = _graded(overlaps(truth, detected)).filter("match_type IN ('exact', 'partial')")
    order = Window.partitionBy("doc_id", "det_det_id").orderBy(F.desc("ratio"), "gt_start_char", "gt_gt_id")
    return pairs.withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n", "grade")


def _hits(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """doc_id, gt_id and det_id of the pairs that match exactly or in part."""
    pairs = _graded(overlaps(truth, detected)).filter("match_type IN ('exact', 'partial')")
    return pairs.select("doc_id", F.col("gt_gt_id").alias("gt_id"), F.col("det_det_id").alias("det_id"))


def fuzzy_missed(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Annotations that no detection matches, exactly or in part."""
    return truth.join(_hits(truth, detected), ["doc_id", "gt_id"], "left_anti")


def fuzzy_extra(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Detections that match no annotation, exactly or in part."""
    return detected.join(_hits(truth, detected), ["doc_id", "det_id"], "left_anti")


def fuzzy_found(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Annotations that some detection matches, exactly or in part."""
    return truth.join(_hits(truth, detected), ["doc_id", "gt_id"], "left_semi")


def outcomes(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """A row a span of either side: outcome tp (exact), fp or fn, with type, source, points and doc_id.

    truth and detected are read twice each: pass stored tables where they are costly.
    """
    hits = match_pairs(truth, detected).filter("match_type = 'exact'").select("doc_id", F.col("gt_gt_id").alias("gt_id"), F.col("det_det_id").alias("det_id"))
    hits = stored(hits, "hits")
    fn = truth.join(hits, ["doc_id", "gt_id"], "left_anti")
    hit = F.when(F.col("of").isNull(), "fp").otherwise("tp")
    found = detected.join(hits.withColumnRenamed("gt_id", "of"), ["doc_id", "det_id"], "left")
    none = F.lit(None)
    return found.select("doc_id", "entity_type", "source", "points", hit.alias("outcome")).unionByName(
        fn.select("doc_id", "entity_type", none.cast("string").alias("source"), none.cast("int").alias("points"), F.lit("fn").alias("outcome"))
    )


def counted() -> list[Column]:
    """tp, fp and fn of a group of outcomes."""
    return [F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "fp", "fn")]


def rates(df: DataFrame) -> DataFrame:
    """df with precision, recall and f1 from tp, fp and fn; 0 where undefined."""

    def part(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "f1": part(2 * tp, 2 * tp + fp + fn)})


def same_text(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """Truth rows with a detection of equal text in their document, whatever its case or type."""
    d = detected.select("doc_id", F.lower("text").alias("low"))
    return truth.withColumn("low", F.lower("text")).join(d, ["doc_id", "low"], "left_semi").drop("low")


def text_pairs(truth: DataFrame, detected: DataFrame) -> DataFrame:
    """All pairs of a document whose trimmed texts are equal, and whether their places are, too."""
    t = truth.select("doc_id", F.trim("text").alias("key"), F.col("start_char").alias("gt_start"), "gt_id")
    d = detected.select("doc_id", F.trim("text").alias("key"), F.col("start_char").alias("det_start"), "det_id")
    return t.join(d, ["doc_id", "key"]).withColumn("placed", F.col("gt_start") == F.col("det_start"))


def unmatched(rows: DataFrame, others: DataFrame) -> DataFrame:
    """Rows whose document has no row of equal trimmed text among the others."""
    keys = others.select("doc_id", F.trim("text").alias("key"))
    return rows.withColumn("key", F.trim("text")).join(keys, ["doc_id", "key"], "left_anti").drop("key")


def bucket(points: Column, clamp: bool) -> Column:
    """The fifth of 0 to 100 that a confidence is in, 1 to 5. Clamped, lower and higher ones go to the first
    and last; else they are in none."""
    inside = F.floor(points / 20).cast("int") + 1
    if clamp:
        return F.greatest(F.lit(1), F.least(F.lit(5), inside))
    return F.when((points >= 0) & (points < 100), inside)
