"""Exact top-k inner products over vectors in order of falling length (operator 4).

Vectors fall into bands of falling length, each twice the one before, and bands into blocks.  Bands
are processed one after another.  A query's k-th best score so far is its bound; a query goes on
to a band only if the product of its length and the band's greatest can reach that bound
(Cauchy-Schwarz), and once none can, the rest is left out.  Within a block, candidates come by falling length
in slices, and the bound rises from slice to slice; scores grow over the leading coordinates of an
SVD rotation of all vectors, and a pair is dropped as soon as its partial sum and the product of the
residual lengths fall short.  What remains is scored in exact integers.

Cases: a vector that is null or has a null or non-finite component is neither query nor
candidate; equal scores rank by smaller vec_id; vectors of different length don't meet; rows that
share a query's vec_id are its own, and each of them is a query with results of its own; fewer than k candidates are all
returned; an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablespan.llm.common import blocks_for, drop, stored

#: Rows of the band of longest vectors, of a block of candidates, of a slice of it, and of a block of queries.
FIRST, BLOCK, SLICE, QUERIES = 256, 4096, 512, 1024
#: Bytes of candidates that a task holds while queries visit them.
HELD = 64 << 20
#: Parts of the coordinates after which pairs are pruned.
STEPS = (0.125, 0.25, 0.5)
#: Sums of products of integers below this are exact in double precision.
EXACT = 1 << 53

SCORES = "query bigint, query_id bigint, vec_id bigint, score bigint"


def quantized(vectors: DataFrame, factor: int, *keep: str) -> DataFrame:
    """row (a number of its own), vec_id, v (floor(factor * x) for each component), length, dims and keep of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("bigint"))
    good = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~bad).select("vec_id", v.alias("v"), *keep)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return good.withColumn("length", length).withColumn("dims", F.size("v")).withColumn("row", F.monotonically_increasing_id())


def rotation(ints: DataFrame, dims: int) -> np.ndarray:
    """The right singular vectors of all vectors of dims components, by falling singular value."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for frame in frames:
            m = np.array(frame["v"].tolist(), dtype=np.float64).reshape(-1, dims)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(dims * dims), "x": total.ravel()})

    rows = ints.select("v").mapInPandas(moments, "i int, x double")
    total = np.zeros(dims * dims)
    for i, x in rows.groupBy("i").agg(F.sum("x")).toLocalIterator():  # dims x dims numbers
        total[i] = x
    _, vectors = np.linalg.eigh(total.reshape(dims, dims))
    return vectors[:, ::-1]


def _blobs(rows: DataFrame, keys: list[str], order: str, extra: dict[str, str]) -> DataFrame:
    """A row a block: its vec_ids in order, their vectors as one matrix, and the columns of extra."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([order, "vec_id"], ascending=[False, True], kind="stable")
        m = np.array(frame["v"].tolist(), dtype=np.int64)
        m = m.astype(np.int32) if m.size and np.abs(m).max() < 1 << 31 else m
        out = {k: [frame[k].iloc[0]] for k in keys}
        out |= {"ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()], "wide": [m.dtype == np.int64]}
        return pd.DataFrame(out | {c: [frame[c].to_numpy(kind).tobytes()] for c, kind in extra.items()})

    kinds = ", ".join(f"{k} int" for k in keys)
    more = "".join(f", {c} binary" for c in extra)
    return rows.groupBy(*keys).applyInPandas(pack, f"{kinds}, ids binary, m binary, wide boolean{more}")


class Best:
    """The k best candidates so far of each query of a block, and the bounds they give."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bound: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.vectors, self.bound, self.turn, self.k = ids, vectors, bound.copy(), turn, k
        self.turned, self.lengths = vectors @ turn, np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)  # query, vec_id, score
        self.seen = {"pairs": 0, "skipped": 0, "pruned": 0}

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Candidates by falling length."""
        lengths = np.linalg.norm(vectors.astype(np.float64), axis=1)
        for at in range(0, len(ids), SLICE):
            part = slice(at, at + SLICE)
            n = len(ids[part])
            reach = self.lengths * lengths[part].max(initial=0) * (1 + 1e-9) + 1e-6 >= self.bound
            self.seen["pairs"] += len(self.ids) * n
            self.seen["skipped"] += int((~reach).sum()) * n
            if reach.any():
                self._slice(np.flatnonzero(reach), ids[part], vectors[part])

    def _slice(self, asked: np.ndarray, ids: np.ndarray, c: np.ndarray) -> None:
        q, bound = self.vectors[asked], self.bound[asked]
        alive = np.ones((len(q), len(c)), bool)
        dims = q.shape[1]
        if np.isfinite(bound).any():
            qt, ct = self.turned[asked], c @ self.turn
            slack, part, done = 1e-6 * (1 + np.abs(np.where(np.isfinite(bound), bound, 0))), np.zeros(alive.shape), 0
            for upto in sorted({max(1, int(dims * s)) for s in STEPS}):
                part += qt[:, done:upto] @ ct[:, done:upto].T
                done = upto
                rest = np.linalg.norm(qt[:, done:], axis=1)[:, None] * np.linalg.norm(ct[:, done:], axis=1)
                alive = part + rest >= (bound - slack)[:, None]
                if not 0.02 < alive.mean() < 0.7:  # few are left, or pruning doesn't pay
                    break
        self.seen["pruned"] += int(alive.size - alive.sum())
        if alive.mean() < 0.05:
            qi, ci = np.nonzero(alive)
            score = np.einsum("ij,ij->i", q[qi], c[ci])
        else:
            small = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * dims < EXACT
            every = (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if small else q @ c.T
            qi, ci = np.nonzero(alive & (every >= bound[:, None]))
            score = every[qi, ci]
        keep = (self.ids[asked[qi]] != ids[ci]) & (score >= bound[qi])
        self._add(asked[qi[keep]], ids[ci[keep]], score[keep])

    def _add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(query):
            return
        query, ids, score = (np.concatenate(x) for x in zip(self.rows, (query, ids, score), strict=True))
        order = np.lexsort((ids, -score, query))
        query, ids, score = query[order], ids[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kth = rank == self.k - 1
        self.bound[query[kth]] = np.maximum(self.bound[query[kth]], score[kth])
        keep = rank < self.k
        self.rows = query[keep], ids[keep], score[keep]


def _matrix(row, dims: int) -> np.ndarray:
    return np.frombuffer(row["m"], np.int64 if row["wide"] else np.int32).reshape(-1, dims).astype(np.int64)


def _scored(met: DataFrame, dims: int, turn: np.ndarray, k: int) -> DataFrame:
    """met: by group, first its blocks of candidates (side 0), then the blocks of queries that visit it."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held = None, []
        for frame in frames:
            for row in frame.to_dict("records"):
                if row["group"] != group:
                    group, held = row["group"], []
                if row["side"] == 0:
                    held.append((np.frombuffer(row["ids"], np.int64), _matrix(row, dims)))
                    continue
                ids = np.frombuffer(row["ids"], np.int64)
                best = Best(ids, _matrix(row, dims), np.frombuffer(row["bound"], np.float64), turn, k)
                for block in held:  # the bounds rise from block to block
                    best.meet(*block)
                query, vec_id, score = best.rows
                rows = np.frombuffer(row["row"], np.int64)
                yield pd.DataFrame({"query": rows[query], "query_id": ids[query], "vec_id": vec_id, "score": score.astype(np.int64)})

    return met.mapInPandas(work, SCORES)


def _top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 20, k: int = 20, factor: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose vec_id is divisible by every."""
    ints = stored(quantized(vectors.select("vec_id", "embedding"), factor), "ints")
    out = None
    for (dims,) in ints.filter("dims > 0").select("dims").distinct().toLocalIterator():  # the lengths in use
        part = _top_k(ints.filter(F.col("dims") == dims), dims, every, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return _none(ints)
    return out


def bands_of(ints: DataFrame, first: int) -> tuple[DataFrame, dict[int, tuple[int, float]]]:
    """ints with band, by falling length: about first rows, then twice as many, and so on; and each band's rows and
    greatest length."""
    n, ends = ints.count(), []
    upto = first
    while upto < n:
        ends.append(1 - upto / n)
        upto = 2 * upto + first
    marks = ints.select(F.percentile_approx("length", ends, 100_000)).first()[0] if ends else []
    band = sum((F.when(F.col("length") < m, 1).otherwise(0) for m in sorted(set(marks), reverse=True)), F.lit(0))
    banded = ints.withColumn("band", band.cast("int"))
    rows = banded.groupBy("band").agg(F.count("*"), F.max("length")).collect()  # a row a band, about log2(n)
    return banded, {band: (n, most) for band, n, most in sorted(rows)}


def groups_for(parts: int, dims: int, tasks: int) -> int:
    """Into how many groups blocks of candidates fall: one for each task, more where a group would be over HELD bytes."""
    most = max(1, HELD // (8 * BLOCK * dims))
    return min(parts, max(tasks, blocks_for(parts, most)))


def _top_k(ints: DataFrame, dims: int, every: int, k: int) -> DataFrame:
    turn = rotation(ints, dims)
    banded, bands = bands_of(ints, FIRST)
    parts = F.element_at(F.create_map(*[x for b, (n, _) in bands.items() for x in (F.lit(b), F.lit(blocks_for(n, BLOCK)))]), F.col("band"))
    dealt = banded.withColumn("part", F.pmod(F.xxhash64("row"), parts).cast("int"))
    blocks = stored(_blobs(dealt, ["band", "part"], "length", {}), "blocks")
    asked = ints.filter(F.col("vec_id") % every == 0).select("row", "vec_id", "v", "length")
    best = None
    for band, (_, most) in bands.items():
        queries = asked.withColumn("bound", F.lit(float("-inf")))
        if best is not None:
            # The bound of a query: its k-th score so far, or none if it has fewer.
            kth = best.groupBy("query").agg(F.min("score").cast("double").alias("low"), F.count("*").alias("n")).filter(F.col("n") >= k)
            bound = F.coalesce("low", F.lit(float("-inf")))
            queries = asked.join(kth, asked["row"] == kth["query"], "left").select("row", "vec_id", "v", "length", bound.alias("bound"))
            queries = queries.filter(F.col("length") * most * (1 + 1e-9) + 1e-6 >= F.col("bound"))
        queries = stored(queries, "queries")
        n = queries.count()
        if not n:
            break
        # Queries of like need share a block: by bound / length, where one has a bound.
        need = F.when((F.col("length") > 0) & (F.col("bound") > float("-inf")), F.col("bound") / F.col("length")).otherwise(0.0)
        marks = queries.select(F.percentile_approx(need, [i / blocks_for(n, QUERIES) for i in range(1, min(blocks_for(n, QUERIES), 256))] or [0.5], 10_000)).first()[0]
        near = sum((F.when(need < m, 1).otherwise(0) for m in sorted(set(marks))), F.lit(0))
        queries = queries.withColumn("near", near.cast("int")).withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks_for(n, QUERIES) // 256))).cast("int"))
        sides = _blobs(queries, ["near", "block"], "bound", {"row": "int64", "bound": "float64"})
        # A group of candidates goes to one task, and every block of queries visits it there: candidates are sent once,
        # queries once a group.
        groups = groups_for(blocks_for(bands[band][0], BLOCK), dims, int(ints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        held = blocks.filter(F.col("band") == band).select(F.pmod("part", F.lit(groups)).alias("group"), F.lit(0).alias("side"), "ids", "m", "wide")
        come = sides.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("side"), "ids", "m", "wide", "row", "bound")
        met = held.unionByName(come, allowMissingColumns=True).repartition("group").sortWithinPartitions("group", "side")
        scores = _scored(met, dims, turn, k)
        last, best = best, stored(_top(scores if best is None else best.unionByName(scores), k).drop("rank"), "scores")
        if last is not None:
            drop(last)
    return _top(best, k).select("query_id", "rank", "vec_id", "score") if best is not None else _none(ints)


def _none(ints: DataFrame) -> DataFrame:
    return ints.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("vec_id").alias("score"))


TOPK_SQL = """
with ok as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scores as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from ok q join ok c on q.vec_id <> c.vec_id and len(q.v) = len(c.v) where q.vec_id % 20 = 0
), ranked as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scores
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
