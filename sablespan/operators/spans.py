"""Matches of many patterns at once, by RE2 over Arrow batches in Python workers.

RE2 is the engine that the SQL runs on, so expressions are taken as they are. It reads a batch once for each pattern, without
a call per text; only texts that match are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of texts that are matched together.
SLICE = 1 << 23

FIELDS = [("number", pa.int32()), ("ordinal", pa.int32()), ("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())]


def readable(regex: str) -> bool:
    """Whether RE2 takes an expression: it knows no looking around and no references."""
    try:
        pc.match_substring_regex(pa.array([""]), regex)
    except pa.ArrowInvalid:
        return False
    return True


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    """texts in parts of about SLICE bytes; a longer text is a part of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE, "right")), at + 1)
        yield texts.slice(at, end - at)
        at = end


def _mark(texts: pa.Array) -> str:
    """A character that no text holds: of private use as a rule."""
    every = chain(range(0xE000, 0xF900), range(0x10000, 0x110000), range(1, 0xD800))
    return next(c for c in map(chr, every) if not pc.any(pc.match_substring(texts, c)).as_py())


def spans_of(texts: pa.Array, expressions: list[str], around: int = 0) -> pa.ListArray:
    """Each text's matches as structs of FIELDS, with offsets of code points, by expression and place; with around also d, the
    match with that many characters on either side. Expressions must not match empty strings."""
    rows, found = [], {name: [] for name, _ in FIELDS} | ({"d": []} if around else {})
    for number, expression in enumerate(expressions):
        at = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, expression), False).to_numpy(zero_copy_only=False))
        if not len(at):
            continue
        own = texts.take(pa.array(at))
        mark = _mark(own)
        marked = pc.replace_substring_regex(own, f"({expression})", rf"{mark}\1{mark}")
        for row, text, pieces in zip(at.tolist(), own.to_pylist() if around else at, marked.to_pylist(), strict=True):
            pieces, place = pieces.split(mark), 0
            for i in range(1, len(pieces), 2):
                start = place + len(pieces[i - 1])
                place = start + len(pieces[i])
                rows.append(row)
                for values, value in zip(found.values(), (number, i // 2 + 1, pieces[i], start, place), strict=False):
                    values.append(value)
                if around:
                    found["d"].append(text[max(start - around, 0) : place + around])
    rows = np.array(rows, dtype=np.int64)
    kinds = dict(FIELDS) | {"d": pa.string()}
    structs = pa.StructArray.from_arrays([pa.array(v, kinds[k]) for k, v in found.items()], names=list(found))
    offsets = np.searchsorted(np.sort(rows), np.arange(len(texts) + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), structs.take(pa.array(np.argsort(rows, kind="stable"))))


def matches(text: Column, expressions: list[str], around: int = 0) -> Column:
    """ARRAY<STRUCT> of the matches of expressions in a text; number says which, from 0."""
    kind = "array<struct<number: int, ordinal: int, text: string, start_char: int, end_char: int" + (", d: string>>" if around else ">>")

    @F.arrow_udf(kind)
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [spans_of(part, expressions, around) for part in _parts(batch)]
            yield pa.concat_arrays(parts) if parts else spans_of(batch, [], around)

    return work.asNondeterministic()(text)  # worked out once, whatever reads it
