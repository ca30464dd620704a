"""Near-duplicate vectors by spherical-cap filters (operator 2).

A filter is a direction: one of a few random unit vectors in each of three blocks of the
rotated space, so that w + w + w vectors give w**3 structured directions and a vector's
score with each is a sum of three table entries.  A vector's cap holds the filters whose score
comes within a margin of its best one; they are list-decoded from the three tables.  Scores
shrink as one over the square root of the vector's length, and so does the margin.  Two
vectors of cosine 0.98 differ by at most 0.2 in length, which changes the scores by a fifth of their
spread, so the best filter of one lies in the cap of the other (the tests measure how
surely).  Each vector speaks at its best filter and listens at all of its cap.  With the number of vectors w
grows, so that a speaker meets some hundreds of listeners however many vectors there are.

Vectors meet as ids with 128 sign bits of random projections, which tell most strangers apart; only
for those that stay are the vectors themselves joined, and pairs verified in double precision.

Equal vectors are compared once and weighed by their number.  A filter that very many vectors
share is split into chunks and each pair of chunks is a task of its own; tasks return counts
and a spanning forest, not pairs.

Cases: a vector that is null, zero, or has a null or non-finite component links with nothing, nor
does one with a null label; vectors of another length than most links only with those of its
length; rows that repeat a vec_id count as vectors of their own; labels are of any type; an empty table gives no rows;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import chunk_pairs, forest, group_numbers, stored, whole_groups, worker_state
from sablespan.llm.components import components

#: Blocks of the rotated space, and the margin in units of a score's standard deviation over directions.
BLOCKS, MARGIN = 3, 1.05
#: Sign bits of vectors of cosine 0.98 differ in 8 of 128; in more than this with a probability below one in a billion.
BITS, APART = 128, 32
CHUNK = 4096
#: Tasks that the rows of a vector of very many copies are dealt over.
SALTS = 32
SEED = 20


def ways_for(n: int) -> int:
    """Unit vectors in each block for n vectors that may meet."""
    return max(2, round((n / 100) ** 0.4))


def directions(dims: int, ways: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """A random rotation, the unit vectors of each block, and the hyperplanes of the sign bits."""
    rng = np.random.default_rng(SEED)
    rotation, _ = np.linalg.qr(rng.standard_normal((dims, dims)))
    parts = [rng.standard_normal((ways, len(p))) for p in np.array_split(np.arange(dims), BLOCKS)]
    planes = np.random.default_rng(SEED + 1).standard_normal((dims, BITS))
    return rotation, [p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300) for p in parts], planes


def _directions(dims: int, ways: int):
    return worker_state(f"directions {dims} {ways}", lambda: directions(dims, ways))


def caps(vectors: np.ndarray, ways: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, filter for all filters in each unit vector's cap, and each vector's best filter."""
    dims = vectors.shape[1]
    rotation, parts, _ = _directions(dims, ways)
    turned = vectors @ rotation
    at, gaps, best = 0, [], np.zeros(len(vectors), np.int64)
    for p in parts:
        scores = turned[:, at : at + p.shape[1]] @ p.T
        at += p.shape[1]
        best = best * ways + scores.argmax(axis=1)
        gaps.append(scores.max(axis=1, keepdims=True) - scores)
    rows, filters = np.arange(len(vectors)), np.zeros(len(vectors), np.int64)
    lost = np.zeros(len(vectors))
    for g in gaps:  # extend each partial code by the ways that keep it within the margin
        more = lost[:, None] + g[rows]
        keep, way = np.nonzero(more <= MARGIN / np.sqrt(dims))
        rows, filters, lost = rows[keep], filters[keep] * ways + way, more[keep, way]
    return rows, filters, best


def sign_bits(vectors: np.ndarray, ways: int) -> np.ndarray:
    """Two 64-bit words for each vector."""
    signs = vectors @ _directions(vectors.shape[1], ways)[2] > 0
    return np.packbits(signs, axis=1).view("<i8")


def usable(vectors: DataFrame) -> DataFrame:
    """Those that can link."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    return vectors.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad & some)


def _unit(column: pd.Series) -> np.ndarray:
    matrix = np.array(column.tolist(), dtype=np.float64)
    matrix /= np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _decoded(ways: int):
    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, same in frame.groupby(frame["embedding"].map(len)):
                for at in range(0, len(same), 2048):
                    part = same.iloc[at : at + 2048].reset_index(drop=True)
                    units = _unit(part["embedding"])
                    rows, filters, best = caps(units, ways)
                    bounds = np.searchsorted(rows, np.arange(len(part) + 1))
                    bits = sign_bits(units, ways)
                    lists = [filters[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
                    yield part.assign(best=best, cap=lists, s0=bits[:, 0], s1=bits[:, 1])

    return work


def _meetings(frame: pd.DataFrame, where: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a speaker and a listener of one filter, some at a time. Of chunk pairs, rows meet where their sides
    differ, or at their own chunk."""
    group, side = group_numbers(frame, where), frame["side"].to_numpy()
    begin, end = np.searchsorted(group, group), np.searchsorted(group, group, side="right")
    speakers = np.flatnonzero(frame["best"].to_numpy() == frame["filter"].to_numpy())
    width = end[speakers] - begin[speakers]
    ends = np.cumsum(width)
    at = 0
    while at < len(speakers):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + (1 << 18), side="right")))
        own, n = speakers[at:upto], width[at:upto]
        a = np.repeat(own, n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + begin[a]
        keep = (a != b) & ((side[a] == 2) | (side[a] != side[b]))
        yield a[keep], b[keep]
        at = upto


def _hopeful(where: list[str]):
    """Rows that meet one with few differing sign bits."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, where):
            s0, s1 = (frame[c].to_numpy().view(np.uint64) for c in ("s0", "s1"))
            keep = np.zeros(len(frame), bool)
            for a, b in _meetings(frame, where):
                near = np.bitwise_count(s0[a] ^ s0[b]).astype(np.int64) + np.bitwise_count(s1[a] ^ s1[b]) <= APART
                keep[a[near]] = keep[b[near]] = True
            yield frame.loc[keep, [*where, "rid", "side"]]

    return work


def _verified(threshold: float, where: list[str]):
    def links(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Each link once: at its one speaker's filter, or at the lesser row's where both hear each other."""
        ids, best, caps_of = frame["rid"].to_numpy(), frame["best"].to_numpy(), frame["cap"].to_numpy()
        dims, lengths = frame["dims"].to_numpy(), {}
        place = np.zeros(len(frame), np.int64)
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            place[at] = np.arange(len(at))
            lengths[d] = _unit(frame["embedding"].iloc[at])
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _meetings(frame, where):
            near = np.zeros(len(a), bool)
            for d, matrix in lengths.items():
                at = np.flatnonzero(dims[a] == d)
                for some in np.array_split(at, max(1, len(at) * int(d) >> 22)):
                    near[some] = np.einsum("ij,ij->i", matrix[place[a[some]]], matrix[place[b[some]]]) >= threshold
            found_a.append(a[near])
            found_b.append(b[near])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        sets = {i: set(caps_of[i]) for i in np.unique(a).tolist()}
        heard = np.fromiter((j in sets[i] for i, j in zip(a.tolist(), best[b].tolist(), strict=True)), bool, len(a))
        once = ~heard | (ids[a] < ids[b])
        return a[once], b[once]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, where):
            a, b = links(frame)
            ids, copies = frame["rid"].to_numpy(), frame["copies"].to_numpy()
            names, number = np.unique(ids, return_inverse=True)
            count = np.bincount(number[a], weights=copies[b], minlength=len(names))
            count += np.bincount(number[b], weights=copies[a], minlength=len(names))
            root = names[forest(number[a], number[b], len(names))]
            has = (count > 0) | (root != names)
            yield pd.DataFrame({"rid": names[has], "links": count[has].astype(np.int64), "root": root[has]})

    return work


def embedding_components(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    vectors = vectors.select("vec_id", "label", "embedding")
    label, kind = (vectors.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    # Vectors have a number of their own, rid, as several may share their least vec_id.
    distinct = usable(vectors).groupBy("label", "embedding").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    distinct = stored(distinct.withColumn("rid", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")), "vectors")
    size = distinct.groupBy("label", "dims").agg(F.count("*").alias("n")).agg(F.max("n").alias("most")).first()
    ready = distinct.select("rid", "label", "dims", "copies", "embedding")
    schema = f"rid bigint, label {label}, dims int, copies bigint, embedding {kind}, best bigint, cap array<bigint>, s0 bigint, s1 bigint"
    info = stored(ready.mapInPandas(_decoded(ways_for(size["most"] or 0)), schema), "caps")

    where = ["label", "dims", "filter", "low", "high"]
    heard = info.select("rid", "label", "dims", "best", "s0", "s1", F.explode("cap").alias("filter"))
    met = chunk_pairs(heard.withColumn("key", F.struct("label", "dims", "filter")), "key", "rid", CHUNK).drop("key")
    met = met.repartition(*where).sortWithinPartitions(*where, "rid")
    hopeful = met.mapInPandas(_hopeful(where), f"label {label}, dims int, filter bigint, low int, high int, rid bigint, side int")
    full = hopeful.join(info.select("rid", "copies", "embedding", "best", "cap"), "rid").repartition(*where).sortWithinPartitions(*where, "rid")
    found = stored(full.mapInPandas(_verified(threshold, where), "rid bigint, links bigint, root bigint"), "links")

    classes = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))
    linked = found.groupBy("rid").agg(F.sum("links").alias("links"))
    per = (
        distinct.join(linked, "rid", "left")
        .join(classes, F.col("rid") == F.col("node"), "left")
        .select(
            "label",
            "embedding",
            "first",
            "copies",
            (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rid").alias("component"),
        )
    )
    least = per.groupBy("component").agg(F.min("first").alias("component_id"))
    # Rows go back to their vector. A vector of very many copies is dealt over several tasks; there are a thousand such at most.
    many = max(10_000, (distinct.agg(F.sum("copies")).first()[0] or 0) // 1000)
    content = F.xxhash64("label", "embedding")
    hot = [r[0] for r in distinct.filter(F.col("copies") > many).select(content).collect()]
    salt = F.when(content.isin(hot), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).otherwise(0).cast("int") if hot else F.lit(0)
    salts = F.when(content.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))) if hot else F.array(F.lit(0))
    named = per.join(least, "component").select("label", "embedding", "n_links", "component_id", F.explode(salts).alias("salt"))
    rows = vectors.withColumn("salt", salt).join(named, ["label", "embedding", "salt"], "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )


EMBEDDINGS_SQL = """
with recursive ok as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit as (
  select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from ok
), links as (
  select a.vec_id as a, b.vec_id as b from unit a join unit b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98
), reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a
), least as (
  select a, min(b) as m from reach group by a
), counts as (
  select a, count(*) as n from links group by a
)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, least(e.vec_id, coalesce(m, e.vec_id))::bigint as component_id,
  e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) as kept
from embeddings e left join counts c on e.vec_id = c.a left join least t on e.vec_id = t.a
"""
