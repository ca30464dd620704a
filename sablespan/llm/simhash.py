"""SimHash near-duplicates by bit-sliced comparison (operator 9).

Each distinct fingerprint is compared once.  Two fingerprints that differ in at most two bits
agree in two of their four 16-bit quarters at least, so six tables keyed by two quarters bring
every such pair together.  The fingerprints of a task are stored as vertical bit planes, once: plane
k has bit k of 64 fingerprints in each word.  Comparing every fingerprint with the one so many
places on is then an exclusive or of each plane with itself, shifted.  Carry-save counter planes add up the
differences of 64 pairs at once, and a word is abandoned once all of its pairs are beyond the
radius.  A key of very many fingerprints is split into chunks and each pair of chunks is a task
of its own; a task gives a spanning forest of its links, not all of them.

Cases: null or empty text, or one of white space alone, has the zero fingerprint, which links
like any other; equal fingerprints are one component; a null doc_id is the least only of a group
without any other; repeated rows give a row each; a text of any length is read whole, its words and
hashes being held at once; an empty table gives no rows; other columns aren't read, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import chunk_pairs, forest, group_numbers, mapped, stored, text_batches, whole_groups
from sablespan.llm.components import components

#: Fingerprints of one key that a task holds; twice as many when it compares two chunks.
CHUNK = 2048


def fingerprint(text: str | None, width: int = 3) -> int:
    """The SimHash of a text's word shingles."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    ends = starts + sizes
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], 42) for a, b in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)],
        dtype="<u8",
    )
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        bits = np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            fps = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return mapped(docs.select(F.col("doc_id").cast("bigint"), "text"), work, "doc_id bigint, fp bigint")


FULL = ~np.uint64(0)


class Planes:
    """Fingerprints as 64 vertical bit planes, 64 fingerprints a word."""

    def __init__(self, fps: np.ndarray):
        self.n = len(fps)
        self.words = -(-self.n // 64)
        padded = np.zeros(self.words * 64, "<u8")
        padded[: self.n] = fps
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.planes = np.zeros((64, 2 * self.words + 1), "<u8")  # zeros behind, for shifts
        self.planes[:, : self.words] = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")

    def lanes(self, flags: np.ndarray) -> np.ndarray:
        """One flag a fingerprint as words."""
        padded = np.zeros(self.words * 64, np.uint8)
        padded[: len(flags)] = flags
        return np.packbits(padded, bitorder="little").view("<u8")

    def shifted(self, word: np.ndarray, far: np.ndarray):
        """For near(): the lanes of each word beside those far places on, far being a number for each word."""
        q, r = far >> 6, (far & 63).astype(np.uint64)

        def bit(k: int, at: np.ndarray) -> np.ndarray:
            plane, w = self.planes[k], word[at]
            on, down = w + q[at], r[at]
            return plane[w] ^ ((plane[on] >> down) | (plane[on + 1] << (np.uint64(63) - down) << np.uint64(1)))

        return bit

    def near(self, differing, valid: np.ndarray, radius: int) -> np.ndarray:
        """Which lanes that are flagged in the words of valid differ in at most radius bits, as numbers over all of
        valid's lanes. differing(k, at): for the words of valid numbered at, whether bit k differs."""
        words = np.flatnonzero(valid)
        out = ~valid[words]
        counters = [np.zeros(len(words), "<u8") for _ in range(max(1, radius.bit_length()))]
        for k in range(64):
            carry = differing(k, words)
            for i, c in enumerate(counters):
                counters[i], carry = c ^ carry, c & carry
            out = out | carry  # beyond all that the counters hold
            if k % 8 == 7:
                beyond = out | _over(counters, radius)
                going = beyond != FULL
                if not going.all():
                    words, out, beyond = words[going], out[going], beyond[going]
                    counters = [c[going] for c in counters]
                if not len(words):
                    return words
        inside = np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(inside)
        return words[at] * 64 + lane


def _over(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose number, given by counters from the lowest bit on, is over radius."""
    over, same = np.zeros_like(counters[0]), np.full_like(counters[0], FULL)
    for i in range(len(counters) - 1, -1, -1):
        if radius >> i & 1:
            same = same & counters[i]
        else:
            over = over | (same & counters[i])
            same = same & ~counters[i]
    return over


def near_pairs(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of equal key within radius, some at a time. Rows are sorted by key; of two rows on one side
    (0 or 1) none is compared, but side 2 is compared with itself."""
    n = len(keys)
    planes, rows, far = Planes(fps), np.arange(n), 1
    while len(rows):
        words, fars, valid = [], [], []
        while len(rows) and len(words) < 64:  # several distances together, as each may have few words
            rows = rows[rows + far < n]
            rows = rows[keys[rows] == keys[rows + far]]  # a row without a partner at far has none farther
            flags = np.zeros(n, bool)
            flags[rows[(sides[rows] == 2) | (sides[rows] != sides[rows + far])]] = True
            lanes = planes.lanes(flags)
            words.append(np.flatnonzero(lanes))
            valid.append(lanes[words[-1]])
            fars.append(np.full(len(words[-1]), far))
            far += 1
        word, apart = np.concatenate(words), np.concatenate(fars)
        near = planes.near(planes.shifted(word, apart), np.concatenate(valid), radius)
        left = word[near >> 6] * 64 + (near & 63)
        yield left, left + apart[near >> 6]


def _links_within(keys: np.ndarray, fps: np.ndarray, sides: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of near_pairs()."""
    own = np.arange(len(keys))
    root, left_of, right_of, held = own, [], [], 0
    for left, right in near_pairs(keys, fps, sides, radius):
        left_of.append(left)
        right_of.append(right)
        held += len(left)
        if held >= 1 << 20:  # a dense group: what is linked becomes a forest
            root = forest(np.concatenate([*left_of, own]), np.concatenate([*right_of, root]), len(own))
            left_of, right_of, held = [], [], 0
    root = forest(np.concatenate([*left_of, own]), np.concatenate([*right_of, root]), len(own))
    moved = np.flatnonzero(root != own)
    return moved, root[moved]


def near_links(distinct: DataFrame, radius: int = 2, chunk: int = CHUNK) -> DataFrame:
    """Links a - b between distinct fingerprints (fp bigint) that connect all those within radius, 2 at most:
    the tables' two quarters aren't lossless beyond."""
    if not 0 <= radius <= 2:
        raise ValueError("the tables of two quarters hold pairs of at most 2 differing bits")
    quarter = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    pairs = [(i, j) for i in range(4) for j in range(i + 1, 4)]
    keys = F.array(*[F.lit(t).cast("bigint") * (1 << 32) + quarter[i] * 65536 + quarter[j] for t, (i, j) in enumerate(pairs)])
    keyed = distinct.select("fp", F.explode(keys).alias("key"))
    shared = chunk_pairs(keyed, "key", "fp", chunk)
    where = ["key", "low", "high"]
    spread = shared.repartition(*where).sortWithinPartitions(*where, "fp")

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(frames, where):
            fps = frame["fp"].to_numpy(np.int64).view(np.uint64)
            a, b = _links_within(group_numbers(frame, where), fps, frame["side"].to_numpy(), radius)
            yield pd.DataFrame({"a": fps[a].view(np.int64), "b": fps[b].view(np.int64)})

    return spread.mapInPandas(compare, "a bigint, b bigint").distinct()


def simhash_components(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable by links of at most
    radius (1 or 2) differing bits. width: words of a shingle. For similarity of 0.8 see near_copies.py."""
    prints = stored(fingerprints(docs, width), "fingerprints")
    first = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = components(near_links(first.select("fp"), radius))
    classes = first.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = classes.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
