"""Helpers that the operators share: tables, the shared folder, Arrow batches, worker state."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sablespan.shared import drop, drop_paths, drop_shared, scratch, shared_path, stored  # noqa: F401  for the operators

#: What contracts call white space: U+0020 and U+0009 to U+000D. bytes.split() splits on the same set.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks_for(rows: int, per_block: int) -> int:
    """How many blocks of about per_block rows hold all rows."""
    return max(1, -(-rows // per_block))


def worker_state(name: str, make: Callable[[], object]) -> object:
    """An object kept in a Python worker from task to task, made at its first use."""
    kept = vars(sys.modules["__main__"]).setdefault("_sablespan_kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4_000_000
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text (one row at least), to bound memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = byte_lengths(batch.column(column))
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def byte_lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, one after another, and where each row starts (one more than rows)."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def mapped(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow, in its usual order of arguments."""
    return df.mapInArrow(work, schema)


def chunk_pairs(keyed: DataFrame, key: str, ident: str, chunk: int) -> DataFrame:
    """keyed, with the rows of each key dealt so that every two of them meet in some task of bounded size.

    Keys of one row are left out. A key's rows fall by hash of ident into chunks of about chunk rows; a
    row goes to each pair of chunks, (low, high), that holds its own. side: 2 where both are its own
    chunk, so that its rows are compared with each other, else 0 in the lower and 1 in the higher chunk.
    """
    sizes = keyed.groupBy(key).count().filter("count > 1")
    return (
        keyed.join(sizes, key)
        .withColumn("_parts", F.ceil(F.col("count") / chunk).cast("int"))
        .withColumn("_own", F.pmod(F.xxhash64(ident), F.col("_parts")).cast("int"))
        .withColumn("_other", F.explode(F.expr("sequence(0, _parts - 1)")))
        .withColumn("low", F.least("_own", "_other"))
        .withColumn("high", F.greatest("_own", "_other"))
        .withColumn("side", F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") < F.col("_other"), 0).otherwise(1))
        .drop("count", "_parts", "_own", "_other")
    )


def whole_groups(frames, columns: list[str]):
    """Frames of rows sorted by columns, as frames in which no group is cut."""
    import pandas as pd

    rest = None
    for frame in frames:
        if rest is not None:
            frame = pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        last = (frame[columns] == frame[columns].iloc[-1]).all(axis=1).to_numpy()
        rest, done = frame[last], frame[~last].reset_index(drop=True)
        if len(done):
            yield done
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def group_numbers(frame, columns: list[str]) -> np.ndarray:
    """0, 1, ... for each run of equal values of columns."""
    change = np.zeros(len(frame), bool)
    for c in columns:
        values = frame[c].to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.cumsum(change)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that the links a - b lead to."""
    root = np.arange(n)
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            return root
        np.minimum.at(root, high[apart], low[apart])
        while (root != (up := root[root])).any():
            root = up
        a, b = a[apart], b[apart]
