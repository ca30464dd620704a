"""Hard negatives by distance keys in one dimension (operator 11).

With M the greatest length of all vectors, a vector v gets one more component, sqrt(M^2 - |v|^2), and a query q
gets zero there: |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the highest inner products are the nearest neighbours.  Each
vector belongs to its nearest pivot, and the table is stored sorted by (pivot, distance to it), in
blocks that know their range of distances and their labels.  By the triangle inequality all vectors within r of a query
lie, for a pivot at distance d, in the key interval [d - r, d + r]; and as each is nearest to its own pivot,
a pivot farther than the query's nearest by 2 r or more has none.

A search widens its intervals step by step.  Each step scans only the annulus of blocks that the one before left out,
and a query stops once the distance of its k-th result is no more than the radius scanned.  Positives start from
the k-th score among the pivots' sample, a bound that is proven, as those are rows too.  The negatives of a
positive of score p lie between the distances of p and of low/high * p, which bound them from both sides.

Blocks and the queries that visit them meet by the block's number: a task reads a block, then streams its queries.
A block with very many visitors is dealt to several tasks.  Nothing but visits times a query's vector, and each block
once (or once for 65,536 visitors), is shuffled.

Of rows equal in vector and label, a task's part of the index keeps the positives + 1 of smallest
vec_id: one may be the anchor, and the others rank before any left out, for every anchor.

Cases: a null label or vector, a null or non-finite component, or a null vec_id takes no part; vectors of different
length don't meet, and one without components takes no part; rows that share an anchor's vec_id count as its own, and each of
them is an anchor with results of its own; equal scores rank by smaller vec_id; with a negative positive_score no score
satisfies the condition; an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablespan.llm.common import blocks_for, drop, mapped, stored
from sablespan.llm.topk import EXACT, quantized

#: Rows of a block; rows that pivots are fitted on (fewer for long vectors, PLACES numbers in all); the most pivots; visitors of a block that a task takes.
BLOCK, SAMPLE, PLACES, PIVOTS, VISITS = 2048, 4096, 1 << 20, 256, 65_536
#: How far the steps of a search go, as parts of what is left.
STEPS = (0.5, 0.8, 1.0)


def pivots_of(rows: np.ndarray, n: int) -> np.ndarray:
    """n centres of rows, by a few rounds of k-means from evenly spaced rows."""
    centres = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
    for _ in range(4):
        own = _distances(rows, centres).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        counts = np.bincount(own, minlength=n)[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def _distances(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), len(centres)))
    for i, c in enumerate(centres):  # differences, as squares and products would cancel
        out[:, i] = np.sqrt(((rows - c) ** 2).sum(1))
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows, np.int64)], pa.binary())


def _extra(v: np.ndarray, most: float) -> np.ndarray:
    """v with the component that makes all lengths equal."""
    v = v.astype(np.float64)
    return np.hstack([v, np.sqrt(np.maximum(most - (v * v).sum(1), 0))[:, None]])


def indexed(ints: DataFrame, dims: int, most: float, pivots: np.ndarray, tasks: int, keep: int) -> DataFrame:
    """Blocks sorted by (pivot, distance): block, pivot, lo, hi, labels (distinct), and ids, kinds and m of their rows."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), dims)
                far = _distances(_extra(v, most), pivots)
                own = far.argmin(1)
                columns = [batch.column("vec_id"), batch.column("label"), pa.array(own, pa.int32()), pa.array(far[np.arange(len(own)), own]), _binary(v)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "pivot", "distance", "m"])

    names = ["block", "pivot", "lo", "hi", "labels", "ids", "kinds", "m"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        at, copies = None, {}

        def block() -> pa.RecordBatch:
            ids, labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
            values = [number, rows[0][2], rows[0][3], rows[-1][3], np.unique(labels).tolist(), ids.tobytes(), labels.tobytes(), b"".join(r[4] for r in rows)]
            kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and (row[2] != rows[0][2] or len(rows) >= BLOCK):
                    yield block()
                    rows, number = [], number + 1
                if (row[2], row[3]) != at:
                    at, copies = (row[2], row[3]), {}
                seen = copies[row[1], row[4]] = copies.get((row[1], row[4]), 0) + 1
                if seen <= keep:
                    rows.append(row)
        if rows:
            yield block()

    keyed = mapped(ints.select("vec_id", "label", "v"), placed, "vec_id bigint, label bigint, pivot int, distance double, m binary")
    order = ["pivot", "distance", "vec_id"]
    dealt = keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    schema = "block bigint, pivot int, lo double, hi double, labels array<bigint>, ids binary, kinds binary, m binary"
    return stored(mapped(dealt, packed, schema), "index")


def anchors_of(ints: DataFrame, dims: int, most: float, pivots: np.ndarray, sample: tuple, k: int) -> DataFrame:
    """row, vec_id, label, q, square (of its length), far (distances to the pivots) and bound (a radius that holds k positives)."""
    own_ids, own_labels, own_rows = sample

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dims)
            q = v.astype(np.float64)
            square = (q * q).sum(1)
            far = _distances(np.hstack([q, np.zeros((len(q), 1))]), pivots)
            bound = np.full(len(q), np.inf)
            for i, (vec_id, label) in enumerate(zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), strict=True)):
                scores = own_rows[(own_labels == label) & (own_ids != vec_id)] @ q[i]
                if len(scores) >= k:
                    bound[i] = np.sqrt(max(0.0, square[i] + most - 2 * np.partition(scores, len(scores) - k)[len(scores) - k]))
            far_rows = pa.array(far.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "vec_id", "label")], _binary(v), pa.array(square), far_rows, pa.array(bound)], names=names)

    names = ["row", "vec_id", "label", "q", "square", "far", "bound"]
    return stored(mapped(ints.select("row", "vec_id", "label", "v"), work, "row bigint, vec_id bigint, label bigint, q binary, square double, far array<double>, bound double"), "anchors")


def wide(radius: Column) -> Column:
    """A radius with room for rounding."""
    return radius * (1 + 1e-9) + 1e-6


def visits(asked: DataFrame, blocks: DataFrame, same_label: bool) -> DataFrame:
    """row and block: whom each of asked (row, label, far, prev, outer, inner) visits: blocks whose least possible
    distance is over prev and up to outer, and whose greatest reaches inner."""
    each = asked.select("row", "label", "prev", "outer", "inner", F.array_min("far").alias("home"), F.posexplode("far").alias("pivot", "d"))
    each = each.withColumn("cell", (F.col("d") - F.col("home")) / 2).filter(F.col("cell") <= F.col("outer"))
    pairs = each.join(blocks.select("block", "pivot", "lo", "hi", "labels"), "pivot")
    lower = F.greatest(F.col("d") - F.col("hi"), F.col("lo") - F.col("d"), F.col("cell"), F.lit(0.0))
    pairs = pairs.withColumn("lower", lower).filter("lower <= outer AND lower > prev AND d + hi >= inner")
    if same_label:
        pairs = pairs.filter(F.array_contains("labels", F.col("label")))
    return pairs.select("row", "block")


def _met(pairs: DataFrame, asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """Blocks and, after each, the queries that visit it, by block and share of its visitors."""
    often = pairs.groupBy("block").agg(F.ceil(F.count("*") / VISITS).cast("int").alias("shares"))
    held = blocks.select("block", "ids", "kinds", "m").join(often, "block").withColumn("share", F.explode(F.expr("sequence(0, shares - 1)")))
    held = held.withColumn("side", F.lit(0)).drop("shares")
    many = often.filter("shares > 1")
    come = pairs.join(many, "block", "left").withColumn("share", F.pmod(F.xxhash64("row"), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    come = come.join(asked, "row").withColumn("side", F.lit(1))
    both = held.unionByName(come, allowMissingColumns=True)
    return both.repartition("block", "share").sortWithinPartitions("block", "share", "side")


def _scores(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    if np.abs(q).max(initial=0) * np.abs(m).max(initial=0) * max(1, q.shape[1]) < EXACT:
        return (q.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return q @ m.T


def _first(order: np.ndarray, n: int, scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Of rows, the n of highest score and then smallest id, in that order."""
    if len(order) > n:
        least = np.partition(scores[order], len(order) - n)[len(order) - n]
        order = order[scores[order] >= least]
    return order[np.lexsort((ids[order], -scores[order]))][:n]


def _scanned(met: DataFrame, dims: int, pick, schema: str) -> DataFrame:
    """met's queries against their blocks: pick(query's row as a dict, scores, ids, labels) gives rows of schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = labels = m = None
        for batch in batches:
            out: list[tuple] = []
            table = batch.to_pylist()
            at = 0
            while at < len(table):
                if table[at]["side"] == 0:
                    x = table[at]
                    ids, labels = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["kinds"], np.int64)
                    m = np.frombuffer(x["m"], np.int64).reshape(-1, dims)
                    at += 1
                    continue
                end = at
                while end < len(table) and table[end]["side"] == 1 and end - at < 256:
                    end += 1
                q = np.frombuffer(b"".join(x["q"] for x in table[at:end]), np.int64).reshape(-1, dims)
                for x, scores in zip(table[at:end], _scores(q, m), strict=True):
                    out += pick(x, scores, ids, labels)
                at = end
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return mapped(met, work, schema)


def _best(found: DataFrame, keys: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _radius(square: Column, most: float, score: Column) -> Column:
    return F.when(score.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), square + most - 2 * score)))


def positives_of(anchors: DataFrame, blocks: DataFrame, dims: int, most: float, k: int) -> DataFrame:
    """row, vec_id, score and rank: the k rows of each anchor's label with the highest scores."""

    def pick(x: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple]:
        rows = _first(np.flatnonzero((labels == x["label"]) & (ids != x["vec_id"])), k, scores, ids)
        return [(x["row"], int(ids[i]), int(scores[i])) for i in rows]

    best, asked = None, anchors.withColumn("prev", F.lit(-1.0)).withColumn("inner", F.lit(0.0))
    for step in STEPS:
        now = stored(asked.withColumn("outer", F.greatest("prev", wide(F.col("bound") * step))), "asked")
        pairs = visits(now, blocks, same_label=True)
        found = _scanned(_met(pairs, now.select("row", "vec_id", "label", "q"), blocks), dims, pick, "row bigint, vec_id bigint, score bigint")
        last, best = best, stored(_best(found if best is None else best.drop("rank").unionByName(found), ["row"], k), "positives")
        if last is not None:
            drop(last)
        kth = best.filter(F.col("rank") == k).select("row", F.col("score").alias("kth"))
        asked = now.join(kth, "row", "left").withColumn("bound", F.least("bound", _radius(F.col("square"), most, F.col("kth")))).drop("kth")
        # Certified: the k-th is within what has been scanned.
        asked = asked.withColumn("prev", F.col("outer")).filter(F.col("bound") > F.col("prev")).drop("outer")
        if asked.isEmpty():
            break
    return best


def negatives_of(anchors: DataFrame, positives: DataFrame, blocks: DataFrame, dims: int, most: float, k: int, low: int, high: int) -> DataFrame:
    """row, which (the positive's rank), vec_id, score and rank of the negatives."""

    def pick(x: dict, scores: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> list[tuple]:
        top = x["scores"]
        rows = np.flatnonzero((labels != x["label"]) & (scores <= top[0]) & (high * scores >= low * max(0, top[-1])))
        rows = rows[np.lexsort((ids[rows], -scores[rows]))]
        falling, out = -scores[rows], []
        for which, p in enumerate(top, 1):
            at = int(np.searchsorted(falling, -p))
            out += [(x["row"], which, int(ids[i]), int(scores[i])) for i in rows[at : at + k] if high * int(scores[i]) >= low * p]
        return out

    # Positives below zero have no negatives; the others' scores fall, so the first is nearest.
    tops = positives.filter("score >= 0").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))
    asked = anchors.drop("bound").join(tops, "row")
    square = F.col("square")
    asked = asked.withColumn("inner", _radius(square, most, F.col("scores")[0]) * (1 - 1e-9) - 1e-6).withColumn("prev", F.lit(-1.0))
    # What each positive still needs: as far as its k-th negative so far, or as its least score allowed.
    needs = F.transform("scores", lambda p: _radius(square, most, p * low / high))
    asked = asked.withColumn("bound", F.array_max(needs))
    best = None
    for step in STEPS:
        between = F.greatest("inner", F.lit(0.0))
        now = stored(asked.withColumn("outer", F.greatest("prev", wide(between + (F.col("bound") - between) * step))), "asked")
        pairs = visits(now, blocks, same_label=False)
        found = _scanned(_met(pairs, now.select("row", "vec_id", "label", "q", "scores"), blocks), dims, pick, "row bigint, which bigint, vec_id bigint, score bigint")
        last, best = best, stored(_best(found if best is None else best.drop("rank").unionByName(found), ["row", "which"], k), "negatives")
        if last is not None:
            drop(last)
        kth = best.filter(F.col("rank") == k).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("which", "score"))).alias("kth"))
        need = F.transform("scores", lambda p, i: _radius(square, most, F.coalesce(F.try_element_at("kth", (i + 1).cast("bigint")).cast("double"), p * low / high)))
        asked = now.join(kth, "row", "left").withColumn("bound", F.array_max(need)).drop("kth")
        asked = asked.withColumn("prev", F.col("outer")).filter(F.col("bound") > F.col("prev")).drop("outer")
        if asked.isEmpty():
            break
    return best


def hard_negatives(
    vectors: DataFrame, every: int = 100, k: int = 5, factor: int = 256, low: int = 80, high: int = 100, moved: int = 7, labels: int = 10
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Anchors are rows whose vec_id is divisible by every; of those divisible by moved, the label first becomes
    (label + 1) % labels. Each anchor has k positives, and each positive k negatives between low and high per cent of its score.
    """
    label = F.when(F.col("vec_id") % moved == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")).cast("bigint")
    known = vectors.select("vec_id", "embedding", label.alias("label")).filter("label IS NOT NULL")
    ints = stored(quantized(known, factor, "label"), "ints")
    out = None
    for (dims,) in ints.filter("dims > 0").select("dims").distinct().toLocalIterator():  # the lengths in use
        part = _hard_negatives(ints.filter(F.col("dims") == dims), dims, every, k, low, high)
        out = part if out is None else out.unionByName(part)
    if out is None:
        none = F.col("vec_id")
        out = ints.limit(0).select(none.alias("anchor_id"), none.alias("positive_id"), F.lit(1).alias("rank"), none.alias("negative_id"), none.alias("positive_score"), none.alias("negative_score"))
    return out


def _hard_negatives(ints: DataFrame, dims: int, every: int, k: int, low: int, high: int) -> DataFrame:
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, most = ints.agg(F.count("*"), F.max(square)).first()
    asked = min(SAMPLE, max(16, PLACES // dims))
    sample = ints.orderBy(F.xxhash64("row"), "row").limit(asked).select("vec_id", "label", "v").collect()  # bounded by SAMPLE and PLACES
    rows = np.array([r["v"] for r in sample], np.int64).reshape(-1, dims)
    pivots = pivots_of(_extra(rows, most), int(min(PIVOTS, len(rows), max(1, np.sqrt(n) / 2))))
    known = np.array([r["vec_id"] for r in sample], np.int64), np.array([r["label"] for r in sample], np.int64), rows.astype(np.float64)
    tasks = max(int(ints.sparkSession.conf.get("spark.sql.shuffle.partitions")), blocks_for(n, 16 * BLOCK))
    blocks = indexed(ints, dims, most, pivots, tasks, k + 1)
    anchors = anchors_of(ints.filter(F.col("vec_id") % every == 0), dims, most, pivots, known, k)
    positives = positives_of(anchors, blocks, dims, most, k)
    negatives = negatives_of(anchors, positives, blocks, dims, most, k, low, high)
    named = anchors.select("row", F.col("vec_id").alias("anchor_id"))
    pairs = positives.select("row", F.col("rank").cast("bigint").alias("which"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = negatives.select("row", "which", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["row", "which"]).join(named, "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


HARD_NEGATIVES_SQL = """
with ok as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select q.vec_id as anchor_id, c.vec_id, q.label = c.label as same, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from ok q join ok c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 100 = 0
), positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from (
    select *, row_number() over (partition by anchor_id order by score desc, vec_id) as k from scores where same) where k <= 5
), ranked as (
  select p.*, s.vec_id as negative_id, s.score as negative_score, (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id))::int as rank
  from positives p join scores s on s.anchor_id = p.anchor_id and not s.same and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from ranked where rank <= 5
"""
