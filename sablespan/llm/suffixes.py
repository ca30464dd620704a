"""Removing repeated byte strings with a distributed suffix array (operator 1).

A window is a byte string of WINDOW bytes within a document.  Its anchor is the place of the least
hash among its KMER-byte substrings (the leftmost of equals), so equal windows have their anchors at
the same distance from their starts.  Only the suffixes at anchors are sorted, one for each 35 bytes
or so; such a suffix stands for the few dozen windows of its anchor.

1. Each task hashes the first KMER bytes of its anchors' suffixes and keeps each hash once; buckets
   of hashes tell which occur elsewhere too. Suffixes of unique prefixes are never exchanged. A
   hash may let a suffix through in vain, but keeps none back.
2. Each task sorts its other suffixes and keeps the first of equal ones; the sorted runs are cut at
   splitters, so that buckets are ranges of the suffix array, and go there front-coded: the
   common prefix with the suffix before, then the rest.
3. A bucket merges its runs with a loser tree over common-prefix lengths: a comparison starts
   behind the prefix that both are known to share with the last winner. The merged common prefixes
   tell which windows agree to the right of their anchors; those of the sorted bytes to the left,
   which agree there. Windows that agree in both, at one distance from the anchor, are equal, byte
   by byte; all but the earliest are repeated.
4. A document's repeated windows cover what is removed.

A prefix that occurs over HOT times would be too large a group for one bucket, as its suffixes
can't be parted without parting equal windows. Its windows are sorted and merged as strings of
their own instead, each content once a task, and fall into buckets by all of their bytes.

Splitters come from a bounded sample of documents, those of least hash, and decide no results:
only how evenly ranges are filled. Ranges of more than a bucket's share are parted by hash.

Cases: null text is empty; texts below WINDOW bytes lose nothing; rows are told apart by doc_id
and text: rows that repeat both are one document, with the same result each; rows that share a doc_id, or have
none, but differ in text are documents of their own, the one of lesser text hash being earlier; a null doc_id sorts
first; a long text is hashed in parts, but its bytes are held at once; an empty table gives no rows;
other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import blocks_for, bytes_of, text_batches, worker_state

WINDOW, KMER, HOT = 100, 32, 100_000
#: Anchors or suffixes that make a run, and bytes of text hashed at a time.
RUN, PART = 1_000_000, 2_000_000
#: Bytes of text for each bucket, the most ranges of the suffix array, and documents that splitters come from.
SHARE, RANGES, SAMPLE = 8_000_000, 4096, 1000
NULL_ID = -(1 << 63)

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and odd multiplications."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


class Hasher:
    """Polynomial hashes modulo 2**64 of byte strings, each byte read as a random number."""

    def __init__(self, seed: int, length: int = 0):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 64, 256, dtype=np.uint64, endpoint=False)
        self.base = rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.length = 0
        self.grow(max(length, 256))

    def grow(self, n: int) -> None:
        if n > self.length:
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(n, self.base)], dtype=np.uint64)
            self.down = np.cumprod(np.r_[np.uint64(1), np.full(n, self.inverse)], dtype=np.uint64)
            self.length = n

    def substrings(self, data: np.ndarray, k: int) -> np.ndarray:
        """The hash of the k bytes from each place on."""
        self.grow(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[: len(data)], out=sums[1:])
        return (sums[k:] - sums[:-k]) * self.down[: len(data) - k + 1]


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each width successive keys, by doubling."""
    reach = 1
    while 2 * reach <= width:
        keys = np.minimum(keys[:-reach], keys[reach:])
        reach *= 2
    more = width - reach
    return np.minimum(keys[: len(keys) - more], keys[more:]) if more else keys


def anchors(data: np.ndarray, bounds: np.ndarray, hasher: Hasher, window: int = WINDOW, kmer: int = KMER):
    """place, prefix hash, and least and greatest distance to the starts of the anchor's windows,
    for each run of windows with one anchor. Documents lie between bounds in data."""
    n = len(data) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none.astype(np.uint64), none, none
    hashes = mixed(hasher.substrings(data, kmer))
    places = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64((1 << 23) - 1)  # a place below 2**23 stands in the low bits, so the leftmost of equals is least
    least = sliding_least((hashes & ~low) | places, window - kmer + 1)[:n]
    starts = np.arange(n)
    whole = np.ones(n, bool)  # windows that lie in one document
    for_each = bounds[1:-1]
    for back in range(1, window):
        at = for_each - back
        whole[at[(at >= 0) & (at < n)]] = False
    whole &= starts + window <= bounds[-1]
    change = np.r_[True, (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])]
    first = np.flatnonzero(change)
    last = np.r_[first[1:], n] - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    place = (least[first] & low).astype(np.int64)
    return place, hashes[place], place - last, place - first


def _pieces(data: np.ndarray, bounds: np.ndarray, hasher: Hasher):
    """anchors() over texts of any length: a long one is cut where pieces overlap by a window less one."""
    if len(data) < 1 << 22:
        yield anchors(data, bounds, hasher)
        return
    for d in range(len(bounds) - 1):
        for at in range(int(bounds[d]), int(bounds[d + 1]), PART):
            part = data[at : min(at + PART + WINDOW - 1, bounds[d + 1])]
            place, h, lo, hi = anchors(part, np.array([0, len(part)]), hasher)
            yield place + at, h, lo, hi


def _hasher() -> Hasher:
    return worker_state("hasher", lambda: Hasher(1))


def prefix_runs(buckets: int):
    """Step 1, in a task: for each bucket the prefix hashes of its anchors, and where each first is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in text_batches(batches, limit=PART - 1):
            ids = batch.column("rid").to_numpy(zero_copy_only=False)
            data, bounds = bytes_of(batch.column("text"))
            for place, h, lo, hi in _pieces(data, bounds, _hasher()):
                doc = np.searchsorted(bounds, place, side="right") - 1
                held.append((h, ids[doc], place - bounds[doc], lo, hi))
                total += len(h)
            if total >= RUN:
                yield flush(held)
                held, total = [], 0
        if total:
            yield flush(held)

    def flush(held) -> pa.RecordBatch:
        h, doc, pos, lo, hi = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        short = h.astype(np.uint32)
        order = np.lexsort((pos, doc, short, bucket))
        bucket, short, doc, pos = bucket[order], short[order], doc[order], pos[order]
        ref = (pos << 16) | (lo[order] << 8) | hi[order]
        first = np.r_[True, (short[1:] != short[:-1]) | (bucket[1:] != bucket[:-1])]
        count = np.diff(np.r_[np.flatnonzero(first), len(first)])
        many = np.repeat(count, count) > 1
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = {"bucket": [], "hash": [], "count": [], "doc": [], "ref": [], "known_doc": [], "known_ref": [], "known_hash": []}
        n_of = np.repeat(count, count)
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            f, m = first[own], many[own] & ~first[own]
            rows["bucket"].append(b)
            rows["hash"].append(short[own][f].tobytes())
            rows["count"].append(np.minimum(n_of[own][f], 65535).astype(np.uint16).tobytes())
            rows["doc"].append(doc[own][f].tobytes())
            rows["ref"].append(ref[own][f].tobytes())
            rows["known_doc"].append(doc[own][m].tobytes())
            rows["known_ref"].append(ref[own][m].tobytes())
            rows["known_hash"].append(short[own][m].tobytes())
        kinds = {"bucket": pa.int32()}
        return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in rows.items()})

    return work, "bucket int, hash binary, count binary, doc binary, ref binary, known_doc binary, known_ref binary, known_hash binary"


def repeated_prefixes(hot: int):
    """Step 1, in a bucket: the anchors whose prefix occurs twice or more; bit 62 of ref marks hot ones."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = [np.frombuffer(b, np.uint32) for b in frame["hash"]]
        counts = np.concatenate([np.frombuffer(b, np.uint16) for b in frame["count"]]).astype(np.int64)
        docs = np.concatenate([np.frombuffer(d, np.int64) for d in frame["doc"]])
        refs = np.concatenate([np.frombuffer(b, np.int64) for b in frame["ref"]])
        known = [np.frombuffer(b, np.uint32) for b in frame["known_hash"]]
        names, number = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(number, weights=counts).astype(np.int64)
        keep = total[number] > 1
        mark = np.int64(1 << 62)
        refs = refs | np.where(total[number] > hot, mark, 0)
        out = [(docs[keep], refs[keep])]
        for h, d, r in zip(known, frame["known_doc"], frame["known_ref"], strict=True):
            many = total[np.searchsorted(names, h)] > hot
            out.append((np.frombuffer(d, np.int64), np.frombuffer(r, np.int64) | np.where(many, mark, 0)))
        doc, ref = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"rid": doc, "ref": ref})

    return work


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and value for each value from lo to hi of each row."""
    n = hi - lo + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + lo[row]


def _words(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as columns of eight bytes each, in an order that sorts as the bytes do."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    padded = padded.view(">u8").astype(np.uint64)
    return [padded[:, k] for k in range(padded.shape[1])]


def _common(rows: np.ndarray) -> np.ndarray:
    """How many leading bytes each row shares with the one before it."""
    out = np.zeros(len(rows), np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        out[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return out


def sampled_heads(kmer: int = KMER):
    """The first kmer bytes at one in eight anchors, with a hash to order them by."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, limit=PART - 1):
            data, bounds = bytes_of(batch.column("text"))
            for place, h, _, _ in _pieces(data, bounds, _hasher()):
                some = h >> np.uint64(61) == 0
                heads = [data[p : p + kmer].tobytes() for p in place[some].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(heads, pa.binary())], names=["hash", "head"])

    return work, "hash bigint, head binary"


def splitters(keyed: DataFrame, documents: int, ranges: int) -> list[bytes]:
    """At most ranges - 1 prefixes between which equally many of the sample's anchors lie."""
    if ranges < 2:
        return []
    some = keyed.filter(F.pmod("rid", F.lit(max(1, documents // SAMPLE))) == 0)
    work, schema = sampled_heads()
    rows = some.select("text").mapInArrow(work, schema).orderBy("hash", "head").limit(16 * RANGES).collect()  # 2 MB at most
    heads = sorted(bytes(r["head"]) for r in rows)
    return sorted({heads[len(heads) * k // ranges] for k in range(1, ranges)}) if heads else []


def suffix_runs(cuts_at: list[bytes], parts: int, window: int = WINDOW, kmer: int = KMER):
    """Step 2, in a task: for each bucket the sorted, front-coded run of its suffixes."""
    reach = window - kmer  # the greatest distance from an anchor to the start of its window
    marks = np.array(cuts_at, f"S{kmer}")
    buckets = (len(marks) + 1) * parts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in text_batches(batches, limit=PART // 4):
            for part in gather(batch):
                held.append(part)
                total += len(part[0])
            if total >= RUN // 4:
                yield flush(held)
                held, total = [], 0
        if total:
            yield flush(held)

    def gather(batch: pa.RecordBatch):
        data, bounds = bytes_of(batch.column("text"))
        refs = batch.column("refs")
        sizes = np.diff(refs.offsets.to_numpy())
        ref = refs.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        hot = (ref >> 62) & 1 == 1
        ref = ref & ~np.int64(1 << 62)
        pos, lo, hi = ref >> 16, (ref >> 8) & 255, ref & 255
        # Rows of equal hash but different text bring each other's places; windows that lie in the text do no harm.
        fits = (pos - lo + window <= (bounds[1:] - bounds[:-1])[row]) & (pos >= hi)
        doc, rid = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "rid"))
        padded = np.zeros(len(data) + window + reach, np.uint8)
        padded[reach : reach + len(data)] = data
        for hot_ones in (False, True):
            for at in _slices(np.flatnonzero(fits & (hot == hot_ones)), 5000 if hot_ones else 100_000):
                r, p, low, high = row[at], pos[at], lo[at], hi[at]
                if hot_ones:  # each window is a string of its own, without anything to its left
                    one, o = spread(low, high)
                    r, p = r[one], p[one] - o
                    low = high = np.zeros(len(r), np.int64)
                place = bounds[r] + p + reach
                right = padded[place[:, None] + np.arange(window)]
                left = padded[place[:, None] - 1 - np.arange(reach)]
                right[np.arange(window) >= (window - low)[:, None]] = 0
                left[np.arange(reach) >= high[:, None]] = 0
                yield doc[r], rid[r], p, low, high, np.full(len(r), hot_ones), right, left

    def bucket_of(right: np.ndarray, hot: np.ndarray) -> np.ndarray:
        """The range of a suffix, and its part of the range by a hash of its prefix; hot windows go by all their bytes."""
        columns = _words(right)
        mix = columns[0]
        for k in range(1, kmer // 8):
            mix = mixed(mix) + columns[k]
        whole = mix
        for c in columns[kmer // 8 :]:
            whole = mixed(whole) + c
        heads = np.ascontiguousarray(right[:, :kmer]).view(f"S{kmer}").ravel()
        ranged = np.searchsorted(marks, heads, side="right") * parts + (mixed(mix) % np.uint64(parts)).astype(np.int64)
        return np.where(hot, (mixed(whole) % np.uint64(buckets)).astype(np.int64), ranged)

    def flush(held) -> pa.RecordBatch:
        doc, rid, pos, lo, hi, hot, right, left = (np.concatenate(c) for c in zip(*held, strict=True))
        bucket = bucket_of(right, hot)
        columns = [*_words(right), *_words(left)]
        order = np.lexsort((pos, rid, doc, hi, lo, *columns[::-1], bucket))
        doc, rid, pos, lo, hi, right, left, bucket = (x[order] for x in (doc, rid, pos, lo, hi, right, left, bucket))
        # Of equal suffixes with equal bytes before them the first stays; the others' windows are repeated.
        same = np.r_[False, (lo[1:] == lo[:-1]) & (hi[1:] == hi[:-1]) & (bucket[1:] == bucket[:-1])]
        for c in columns:
            c = c[order]
            same[1:] &= c[1:] == c[:-1]
        head = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
        late = same & ((doc != doc[head]) | (rid != rid[head]) | (pos != pos[head]))
        known = {"known_rid": rid[late], "known_doc": doc[late], "known_first": (pos - hi)[late], "known_last": (pos - lo)[late]}
        doc, rid, pos, lo, hi, right, left, bucket = (x[~same] for x in (doc, rid, pos, lo, hi, right, left, bucket))
        size = window - lo
        lcp = np.minimum(_common(right), np.minimum(size, np.r_[0, size[:-1]]))
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = {k: [] for k in ("bucket", *RUN_PARTS)}
        column = np.arange(window)
        for b in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[b], cuts[b + 1])
            n_lcp, n_size = lcp[own].copy(), size[own]
            n_lcp[:1] = 0
            rows["bucket"].append(b)
            for name, values in (("doc", doc), ("rid", rid), ("pos", pos)):
                rows[name].append(values[own].tobytes())
            rows["lcp"].append(n_lcp.astype(np.uint8).tobytes())
            rows["size"].append(n_size.astype(np.uint8).tobytes())
            rows["rest"].append(right[own][(column >= n_lcp[:, None]) & (column < n_size[:, None])].tobytes())
            rows["reach"].append(hi[own].astype(np.uint8).tobytes())
            rows["left"].append(left[own][np.arange(reach) < hi[own][:, None]].tobytes())
        # What is known to be repeated already travels with the runs, spread over buckets.
        n = len(rows["bucket"])
        share = np.arange(int(late.sum())) % n
        by_row = np.argsort(share, kind="stable")
        ends = np.searchsorted(share[by_row], np.arange(n + 1))
        for name, values in known.items():
            values = values[by_row]
            rows[name] = [values[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "bucket" else pa.binary()) for k, v in rows.items()})

    return work, "bucket int, " + ", ".join(f"{k} binary" for k in RUN_PARTS)


#: A run of a bucket: its suffixes' places, their front-coded bytes, the bytes before them, and windows known to be repeated.
RUN_PARTS = ("doc", "rid", "pos", "lcp", "size", "rest", "reach", "left", "known_rid", "known_doc", "known_first", "known_last")


def _slices(rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
    for at in range(0, len(rows), most):
        yield rows[at : at + most]


def decode_run(lcp: bytes, size: bytes, rest: bytes) -> list[bytes]:
    """The suffixes of a front-coded run."""
    out, last, at = [], b"", 0
    for h, n in zip(lcp, size, strict=True):
        last = last[:h] + rest[at : at + n - h]
        at += n - h
        out.append(last)
    return out


def merge_runs(runs: list[list[bytes]], lcps: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
    """(run, place) in sorted order over all runs, and each one's common prefix with the one before.

    A loser tree: each inner node keeps the loser of its match with the length it shares with the
    winner that passed. Of two candidates the one that shares more with the last output is the
    smaller; only if both share the same are bytes compared, and from there on only.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    current: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    shared = [0] * k
    loser = [0] * k

    def beats(a: int, b: int) -> bool:
        """Whether run a's candidate comes first; the loser's shared length is brought up to date."""
        x, y = current[a], current[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        h, g = shared[a], shared[b]
        if h != g:
            return h > g
        if x[h:] == y[h:]:
            n = len(x)
            first = a < b
        else:
            s, t = x[h:], y[h:]
            m = min(len(s), len(t))
            d = int.from_bytes(s[:m]) ^ int.from_bytes(t[:m])
            n = h + (m - (d.bit_length() + 7) // 8 if d else m)
            first = s < t
        shared[b if first else a] = n
        return first

    def play(node: int) -> int:
        if node >= k:
            return node - k
        a, b = play(2 * node), play(2 * node + 1)
        won = beats(a, b)
        loser[node] = b if won else a
        return a if won else b

    order, common = [], []
    winner = play(1) if k > 1 else 0
    while current[winner] is not None:
        order.append((winner, at[winner]))
        common.append(shared[winner])
        i = at[winner] = at[winner] + 1
        run = runs[winner]
        if i < len(run):
            current[winner], shared[winner] = run[i], lcps[winner][i]
        else:
            current[winner] = None
        node = (winner + k) >> 1
        while node:
            other = loser[node]
            if not beats(winner, other):
                loser[node], winner = winner, other
            node >>= 1
    return order, common


def late_windows(doc, rid, pos, lo, hi, lcp: np.ndarray, left: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, first and last distance from the anchor of the windows that an earlier equal one has.

    Rows are suffixes in sorted order, lcp what each shares with the one before, left the bytes before
    them, read backwards. The windows o bytes before two anchors are equal if the suffixes share window - o
    bytes, which no lesser lcp lies between, and the bytes to the left share o, likewise.
    """
    n, reach = len(doc), left.shape[1]
    by_left = np.lexsort(_words(left)[::-1])
    left_lcp = _common(left[by_left])
    right_class, left_class = np.zeros(n, np.int64), np.zeros(n, np.int64)
    rank = np.lexsort((pos, rid, doc))
    late = np.zeros((n, reach + 1), bool)
    for o in range(reach + 1):
        rows = rank[(lo[rank] <= o) & (o <= hi[rank])]  # the earliest first
        if len(rows) < 2:
            continue
        np.cumsum(lcp < window - o, out=right_class)
        left_class[by_left] = np.cumsum(left_lcp < o)
        key = right_class[rows] * (n + 1) + left_class[rows]
        order = np.argsort(key, kind="stable")
        rows, key = rows[order], key[order]
        head = rows[np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], np.arange(len(rows)), 0))]
        late[rows, o] = (doc[rows] != doc[head]) | (rid[rows] != rid[head]) | (pos[rows] != pos[head])
    edge = np.diff(np.pad(late, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return row, first, after - 1


def repeated_windows(window: int = WINDOW, kmer: int = KMER):
    """Step 3, in a bucket: the starts of repeated windows, as document, first and last."""
    reach = window - kmer

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        numbers = lambda name, kind=np.int64: np.concatenate([np.frombuffer(b, kind) for b in frame[name]])
        out = {"rid": [numbers("known_rid")], "doc": [numbers("known_doc")], "first": [numbers("known_first")], "last": [numbers("known_last")]}
        runs = [decode_run(a, b, c) for a, b, c in zip(frame["lcp"], frame["size"], frame["rest"], strict=True)]
        order, common = merge_runs(runs, list(frame["lcp"]))
        common = np.array(common, np.int64)
        joined = np.r_[False, common[1:] >= kmer][: len(common)]  # shares its prefix with the one before
        kept = np.flatnonzero(joined | np.r_[joined[1:], False][: len(joined)])
        if len(kept):
            run, place = np.array(order).T
            start = np.cumsum([0] + [len(r) for r in runs])
            del runs
            at = (start[run] + place)[kept]
            doc, rid, pos = (numbers(k)[at] for k in ("doc", "rid", "pos"))
            every_hi = numbers("reach", np.uint8).astype(np.int64)
            lo, hi = window - numbers("size", np.uint8).astype(np.int64)[at], every_hi[at]
            begin = (np.cumsum(every_hi) - every_hi)[at]
            left = np.frombuffer(b"".join(frame["left"]) + bytes(reach), np.uint8)[begin[:, None] + np.arange(reach)]
            left[np.arange(reach) >= hi[:, None]] = 0
            row, first, last = late_windows(doc, rid, pos, lo, hi, np.where(joined, common, 0)[kept], left, window)
            for name, values in (("rid", rid[row]), ("doc", doc[row]), ("first", pos[row] - last), ("last", pos[row] - first)):
                out[name].append(values)
        return pd.DataFrame({k: np.concatenate(v) for k, v in out.items()})

    return work


def covered(first: list[int], last: list[int], n: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """The maximal runs of bytes that windows starting from first to last cover."""
    out: list[list[int]] = []
    for a, b in sorted(zip(first, last, strict=True)):
        b = min(b + window, n)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removal(window: int = WINDOW):
    """What is left of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [[], [], [], []]
            spans, docs = batch.column("spans").to_pylist(), batch.column("doc").to_pylist()
            for text, own, doc in zip(batch.column("text").to_pylist(), spans, docs, strict=True):
                data = (text or "").encode()
                own = [x for x in own or () if x["doc"] == doc]
                gone = covered([x["first"] for x in own], [x["last"] for x in own], len(data), window)
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(data[at:a])
                    at = b
                digest.update(data[at:])
                for column, value in zip(rows, (len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return work


def repeated_spans(docs: DataFrame, hot: int = HOT, share: int = SHARE) -> tuple[DataFrame, DataFrame]:
    """The documents with a hash, rid, of doc_id and text, and for each rid the starts of its repeated windows (doc, first to last)."""
    total = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    buckets = blocks_for(total["bytes"] or 0, share)
    # One shape of this table everywhere, and a key that is never null: both joins then share one exchange of the texts.
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("rid"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc"), "text")
    work, schema = prefix_runs(buckets)
    prefixes = keyed.mapInArrow(work, schema)
    refs = prefixes.groupBy("bucket").applyInPandas(repeated_prefixes(hot), "rid bigint, ref bigint")
    refs = refs.groupBy("rid").agg(F.collect_set("ref").alias("refs")).withColumnRenamed("rid", "r_rid")
    marked = keyed.join(refs, F.col("rid") == F.col("r_rid")).select("rid", "doc", "text", "refs")
    cuts = splitters(keyed, total["n"], min(buckets, RANGES))
    work, schema = suffix_runs(cuts, blocks_for(buckets, len(cuts) + 1))
    suffixes = marked.mapInArrow(work, schema)
    found = suffixes.groupBy("bucket").applyInPandas(repeated_windows(), "rid bigint, doc bigint, first bigint, last bigint")
    spans = found.groupBy("rid").agg(F.collect_list(F.struct("doc", "first", "last")).alias("spans")).withColumnRenamed("rid", "s_rid")
    return keyed, spans


def remove_repeats(docs: DataFrame, hot: int = HOT, share: int = SHARE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document. hot and share are sizes: of a
    prefix's group, and the bytes of text for a bucket; results don't depend on them."""
    keyed, spans = repeated_spans(docs, hot, share)
    joined = keyed.join(spans, F.col("rid") == F.col("s_rid"), "left").select(
        F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "doc", "text", "spans"
    )
    return joined.mapInArrow(removal(), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
