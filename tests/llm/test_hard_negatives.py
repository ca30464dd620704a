"""Hard negatives against brute force."""

import math

import numpy as np
import pytest

from sablespan.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, negative_id int"


def plain(rows, every):
    ok = []
    for vec_id, v, label, *_ in rows:
        if vec_id is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for a, la, va in ok:
        if a % every:
            continue
        scored = [(-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in ok if i != a and len(v) == len(va)]
        for s, p, _ in sorted(x for x in scored if x[2] == la)[:5]:
            fit = sorted(x for x in scored if x[2] != la and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, p, rank, n, -s, -t) for rank, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("dims,spread", [(3, 1.0), (16, 0.3)])
def test_hard_negatives(spark, monkeypatch, dims, spread):
    monkeypatch.setattr(H, "BLOCK", 16)
    monkeypatch.setattr(H, "SAMPLE", 64)
    rng = np.random.default_rng(dims)
    centres = rng.normal(size=(8, dims))
    rows = [(i, (centres[i % 8] * (0.2 + i % 5) + spread * rng.normal(size=dims)).tolist(), int(rng.integers(0, 4)), "x", 1) for i in range(400)]
    rows += [(1000 + i, rows[20][1], i % 2, "x", 1) for i in range(60)]  # copies
    rows += [(2000, None, 1, "x", 1), (2010, [math.nan] * dims, 1, "x", 1), (2020, [None] * dims, 1, "x", 1), (2030, [0.0] * dims, 1, "x", 1), (2040, rows[3][1], None, "x", 1)]
    rows += [(2050, [1.0, 2.0], 1, "x", 1), (2060, [1.0, 1.0], 2, "x", 1), (2051, [1.0, 2.5], 1, "x", 1), (None, rows[5][1], 1, "x", 1), (2070, [], 1, "x", 1), (3000, rows[7][1], 9, "x", 1)]
    rows += [(20, rows[21][1], 0, "x", 1)]  # an anchor's id again
    got = sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=10).collect())
    assert got == plain(rows, 10)
    assert got


def test_hard_negatives_of_nothing(spark):
    assert H.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(100, [1.0], 1, "x", 1)], SCHEMA)
    assert H.hard_negatives(one).collect() == []


def test_search_leaves_blocks_out(spark, monkeypatch):
    """Well-parted groups: most blocks aren't visited."""
    monkeypatch.setattr(H, "BLOCK", 16)
    rng = np.random.default_rng(1)
    centres = 3 * np.linalg.qr(rng.normal(size=(32, 32)))[0]
    rows = [(i, (centres[i % 32] + 0.02 * rng.normal(size=32)).tolist(), i % 3, "x", 1) for i in range(1600)]
    seen = []
    met = H._met
    monkeypatch.setattr(H, "_met", lambda pairs, asked, blocks: (seen.append((pairs.count(), asked.count() * blocks.count())), met(pairs, asked, blocks))[1])
    got = sorted(tuple(r) for r in H.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain(rows, 100)
    positives, every = sum(a for a, _ in seen[:3]), seen[0][1]
    assert positives < 0.25 * every, seen
    assert sum(a for a, _ in seen) - positives < 0.5 * every, seen
