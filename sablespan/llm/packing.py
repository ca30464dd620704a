"""Best-two-fit packing of tokenized documents into sequences (operator 8).

A document of more than a sequence's tokens is cut into full pieces behind a first, shorter
one.  Full pieces are sequences of their own.  All other pieces go to groups of bounded size by
hash, and each group is packed in one task from its pieces' lengths alone: a sequence takes
the longest piece that fits until none does; then, if two unpacked pieces fill the gap that
its shortest piece would leave better than that piece does, they take its place.

Cases: null text is empty and has the end id alone; repeated rows, or rows of one or no doc_id, are packed once
each; a text of any length is encoded whole in its task; an empty table gives no rows; other columns aren't
read, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import blocks_for, mapped, stored, text_batches, worker_state
from sablespan.llm.tokens import Encoder

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]

#: Pieces in a group. The loss is about a sequence a group, one in several thousand.
GROUP = 16_384


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids; only the first may have fewer than most."""
    first = (n - 1) % most + 1 if n else 0
    return [(0, first)] + [(s, most) for s in range(first, n, most)] if n else []


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048) -> DataFrame:
    """The pieces of all documents' ids, with the end id."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        end = int(end_id).to_bytes(4, "little")
        for batch in text_batches(batches):
            out = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, most)):
                    check = zlib.crc32(ids[start * 4 : (start + length) * 4])
                    for column, value in zip(out, (doc_id, k, start, length, check), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return mapped(docs.select("doc_id", "text"), encode, PIECES)


def best_two_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each piece its bin and its offset there. Lengths lie from 1 to most."""
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        stacks.setdefault(n, []).append(i)
    here = sum(1 << n for n in stacks)  # bit n: some unpacked piece has n tokens
    bins = np.zeros(len(lengths), np.int64)
    offsets = np.zeros(len(lengths), np.int64)

    def take(n: int) -> int:
        nonlocal here
        i = stacks[n].pop()
        if not stacks[n]:
            here &= ~(1 << n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal here
        stacks[n].append(i)
        here |= 1 << n

    def longest(room: int) -> int:
        return (here & ((2 << room) - 1)).bit_length() - 1 if room > 0 else -1

    def best_pair(room: int, above: int) -> tuple[int, int]:
        """Two unpacked lengths of the greatest sum up to room, if it is over above."""
        best, pair, a = above, (0, 0), longest(room - 1)
        while a > 0 and 2 * a > best:
            b = longest(min(room - a, a))
            if b == a and len(stacks[a]) < 2:
                b = longest(a - 1)
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == room:
                    break
            a = longest(a - 1)
        return pair

    number = 0
    while here:
        room, inside = most, []
        while (n := longest(room)) > 0:
            inside.append((n, take(n)))
            room -= n
        if room and here and len(inside) > 1:
            n, i = inside[-1]
            a, b = best_pair(room + n, n)
            if a:
                inside[-1:] = [(a, take(a)), (b, take(b))]
                give(n, i)
                room += n - a - b
                while (n := longest(room)) > 0:
                    inside.append((n, take(n)))
                    room -= n
        at = 0
        for n, i in inside:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack_pieces(cut_up: DataFrame, most: int = 2048, group: int = GROUP) -> DataFrame:
    """Pieces with the sequence each goes to and its offset there. cut_up: a stored table of pieces, with a
    number of its own, row, for each, so that the pieces of repeated rows fall into different groups."""
    part = cut_up.filter(F.col("length") < most)
    groups = blocks_for(part.count(), group)
    full = cut_up.filter(F.col("length") == most).select(
        *PIECE, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=False, kind="stable", ignore_index=True)
        number, offset = best_two_fit(frame["length"].to_numpy(), most)
        frame["sequence_id"] = (frame["grp"].to_numpy() << 32) + number
        return frame.assign(offset=offset).drop(columns="grp")

    packed = (
        part.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
        .drop("row")
        .groupBy("grp")
        .applyInPandas(one, f"{PIECES}, sequence_id bigint, offset bigint")
    )
    return packed.unionByName(full)


def best_fit_packing(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048) -> DataFrame:
    cut_up = pieces(docs, tokenizer, end_id, most).withColumn("row", F.monotonically_increasing_id())
    return pack_pieces(stored(cut_up, "pieces"), most)
