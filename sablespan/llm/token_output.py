"""Token ids as fixed-width bit-packed blocks (operator 5).

A file of blocks is a Parquet file with one row a block: the ids of whole documents, each id
in the fewest bits that hold the vocabulary, the documents' ids and their numbers of ids.
The sums of those numbers are the offsets: a reader takes any document's ids out of a block
without reading what stands before them, and numpy unpacks a block as one array.  As files and blocks follow
doc_id, each block says its least and greatest one: Parquet's statistics of these tell a reader of few
documents which files and row groups, of about GROUP bytes each, it needn't read.

Cases: null text is empty and gives the end id alone; rows that repeat a doc_id stand next to
each other, in order of a hash of their texts; a null doc_id comes first; an empty table gives no rows; other
columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sablespan.llm.common import mapped, shared_path, text_batches, worker_state
from sablespan.llm.tokens import Encoder

BLOCKS = "shard int, block int, bits int, first_id bigint, last_id bigint, doc_ids array<bigint>, lengths array<bigint>, payload binary"
#: Bytes of a row group, the least that is read for a document, and the most ranges of ids that a scan is asked for.
GROUP, RANGES = 8 << 20, 64


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in bits bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """count ids from the one numbered start on; only their bytes are looked at."""
    if bits == 16:
        return np.frombuffer(payload, "<u2", count, start * 2).astype(np.uint32)
    first = start * bits // 8
    last = ((start + count) * bits + 7) // 8
    flat = np.unpackbits(np.frombuffer(payload, np.uint8, last - first, first), bitorder="little")
    flat = flat[start * bits - first * 8 :][: count * bits].reshape(count, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = 1 << 19) -> None:
    """Write the ids of all documents, in ascending doc_id order, as blocks of about block_ids ids."""
    order = ["doc_id", F.xxhash64("text"), "text"]  # so that rows of one id, or of none, needn't be one task's
    ordered = docs.select("doc_id", "text").repartitionByRange(*order[:2]).sortWithinPartitions(*order)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        bits = bits_for(max(encoder.vocabulary, end_id + 1))
        end = int(end_id).to_bytes(4, "little")
        shard, block, held, names, sizes, total = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            payload = pack(np.frombuffer(b"".join(held), "<u4"), bits)
            known = [n for n in names if n is not None]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int32()),
                    pa.array([bits], pa.int32()),
                    pa.array([min(known, default=None)], pa.int64()),
                    pa.array([max(known, default=None)], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([sizes], pa.list_(pa.int64())),
                    pa.array([payload], pa.binary()),
                ],
                names=["shard", "block", "bits", "first_id", "last_id", "doc_ids", "lengths", "payload"],
            )

        for batch in text_batches(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                held.append(ids)
                names.append(doc_id)
                sizes.append(len(ids) // 4)
                total += sizes[-1]
                if total >= block_ids:
                    yield row()
                    block, held, names, sizes, total = block + 1, [], [], [], 0
        if held:
            yield row()

    mapped(ordered, encode, BLOCKS).write.option("parquet.block.size", GROUP).parquet(path)


def block_bases(blocks: DataFrame) -> DataFrame:
    """shard, block and base, the number of ids before each block.

    Blocks are summed by shard first: one window sees a row a shard, of which there are as many as
    writing tasks, the other the blocks of a shard.
    """
    sums = blocks.select("shard", "block", F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sums.groupBy("shard").agg(F.sum("n").alias("n"))
    shards = shards.select("shard", before(Window.orderBy("shard")).alias("ahead"))
    within = sums.select("shard", "block", before(Window.partitionBy("shard").orderBy("block")).alias("within"))
    return within.join(shards, "shard").select("shard", "block", (F.col("ahead") + F.col("within")).alias("base"))


def read_tokens(blocks: DataFrame) -> DataFrame:
    """From blocks, one row a document: doc_id, its place among all ids, its ids' number and checksum."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                sizes = np.asarray(b["lengths"], np.int64)
                starts = np.cumsum(sizes) - sizes
                ids = unpack(b["payload"], b["bits"], 0, int(sizes.sum())).astype("<u4")
                checks = [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(starts, sizes, strict=True)]
                n = len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(b["doc_ids"], pa.int64()),
                        pa.array(np.full(n, b["shard"], np.int32)),
                        pa.array(np.full(n, b["block"], np.int32)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(checks, pa.int64()),
                    ],
                    names=["doc_id", "shard", "block", "within", "n_tokens", "ids_crc32"],
                )

    rows = mapped(blocks, decode, "doc_id bigint, shard int, block int, within bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(block_bases(blocks), ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def index(blocks: DataFrame) -> DataFrame:
    """doc_id, shard, block, at and n of every document: where in which block its ids are. No ids are read."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                sizes = np.asarray(b["lengths"], np.int64)
                where = [pa.array(np.full(len(sizes), b[k], np.int32)) for k in ("shard", "block")]
                arrays = [pa.array(b["doc_ids"], pa.int64()), *where, pa.array(np.cumsum(sizes) - sizes), pa.array(sizes)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "shard", "block", "at", "n"])

    return mapped(blocks.select("shard", "block", "doc_ids", "lengths"), places, "doc_id bigint, shard int, block int, at bigint, n bigint")


def ranges_of(ids: list[int], most: int = RANGES) -> list[tuple[int, int]]:
    """At most so many ranges that hold all ids, parted at the widest gaps."""
    ids = sorted(set(ids))
    gaps = sorted(range(1, len(ids)), key=lambda i: ids[i - 1] - ids[i])[: most - 1]
    cuts = [0, *sorted(gaps), len(ids)]
    return [(ids[i], ids[k - 1]) for i, k in zip(cuts, cuts[1:]) if i < k]


def near(blocks: DataFrame, wanted: DataFrame, few: int = 1000) -> DataFrame:
    """The blocks whose ids come near those of a few wanted documents; all blocks if more are wanted.

    The ranges are comparisons with first_id and last_id, which reach the scan.
    """
    ids = [r["doc_id"] for r in wanted.select("doc_id").filter("doc_id IS NOT NULL").distinct().limit(few + 1).collect()]
    if len(ids) > few:
        return blocks
    some = F.lit(False)
    for low, high in ranges_of(ids):
        some = some | ((F.col("last_id") >= low) & (F.col("first_id") <= high))
    return blocks.filter(some)


def read_documents(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """doc_id and ids of the documents whose doc_id is in wanted: random access. For up to a thousand documents only files and row
    groups near them are read; of a block only the wanted documents' own bytes are unpacked."""
    blocks = near(blocks, wanted)
    asked = index(blocks).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    asked = asked.groupBy("shard", "block").agg(F.collect_list(F.struct("doc_id", "at", "n")).alias("asked"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = [unpack(b["payload"], b["bits"], a["at"], a["n"]).tolist() for a in b["asked"]]
                arrays = [pa.array([a["doc_id"] for a in b["asked"]], pa.int64()), pa.array(ids, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "ids"])

    found = blocks.select("shard", "block", "bits", "payload").join(asked, ["shard", "block"])
    return mapped(found.drop("shard", "block"), cut, "doc_id bigint, ids array<bigint>")


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write all documents' ids to the shared folder and return what reading them back gives."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(spark.read.schema(BLOCKS).parquet(path))
