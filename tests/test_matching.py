"""One-to-one matching against a plain greedy pass, on chains, copies and random spans."""

import random

import pytest

from sablespan.operators import matching as M

TRUTH = "doc_id long, gt_id string, entity_type string, text string, start_char int, end_char int"
FOUND = "doc_id long, det_id string, entity_type string, text string, start_char int, end_char int, points int, source string"


def plain(truth, found):
    """All overlapping pairs in order; each is taken if both sides are free."""
    pairs = []
    for doc, g, gt, gx, a1, b1 in truth:
        for other, d, dt, dx, a2, b2, *_ in found:
            inner = min(b1, b2) - max(a1, a2)
            if doc != other or inner <= 0:
                continue
            ratio = inner * 10_000 // (max(b1, b2) - min(a1, a2))
            same = gt == dt
            grade = 0 if same and gx.lower() == dx.lower() and ratio >= 9000 else 1 if same and 3000 < ratio <= 5000 else 2
            pairs.append((doc, grade, -ratio, a1, a2, g, d))
    out, used = set(), set()
    for doc, _, _, _, _, g, d in sorted(pairs):
        if (doc, "g", g) not in used and (doc, "d", d) not in used:
            used |= {(doc, "g", g), (doc, "d", d)}
            out.add((doc, g, d))
    return out


def matched(spark, truth, found):
    rows = M.match_pairs(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(found, FOUND)).collect()
    assert len({(r["doc_id"], r["gt_gt_id"]) for r in rows}) == len(rows)
    return {(r["doc_id"], r["gt_gt_id"], r["det_det_id"]) for r in rows}


def chain(n, doc=1):
    return [(doc, f"t{i:05}", "A", "x", 10 * i, 10 * i + 8) for i in range(n)], [(doc, f"d{i:05}", "A", "y", 10 * i + 5, 10 * i + 14, 70, "ner") for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_random_spans(spark, seed):
    rng = random.Random(seed)
    truth, found = [], []
    for doc in range(12):
        for i in range(rng.randrange(30)):
            a = rng.randrange(120)
            truth.append((doc, f"g{rng.randrange(1000)}-{i}", rng.choice("AB"), rng.choice("xy"), a, a + rng.randrange(1, 12)))
        for i in range(rng.randrange(30)):
            a = rng.randrange(120)
            found.append((doc, f"d{rng.randrange(1000)}-{i}", rng.choice("AB"), rng.choice("xy"), a, a + rng.randrange(1, 12), 70, "ner"))
    truth += [(20, f"c{i}", "A", "x", 5, 9) for i in range(7)] + [(20, f"e{i}", "A", "x", 5, 10) for i in range(4)]
    found += [(20, f"c{i}", "A", "x", 5, 9, 70, "ner") for i in range(3)] + [(20, f"e{i}", "B", "x", 5, 9, 70, "ner") for i in range(9)]
    assert matched(spark, truth, found) == plain(truth, found)


def test_long_chain_takes_no_more_jobs(spark):
    jobs = []
    for n in (2, 1000):
        truth, found = chain(n)
        spark.sparkContext.setJobGroup(f"chain {n}", "")
        got = matched(spark, truth, found)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"chain {n}")))
        assert got == plain(truth, found)
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1]


def test_copies_make_no_square(spark):
    truth = [(1, f"t{i:04}", "A", "x", 0, 5) for i in range(3000)]
    found = [(1, f"d{i:04}", "A", "x", 0, 5, 70, "ner") for i in range(2000)]
    assert matched(spark, truth, found) == {(1, f"t{i:04}", f"d{i:04}") for i in range(2000)}


def test_no_spans(spark):
    truth, found = chain(1)
    assert matched(spark, truth, []) == set() == matched(spark, [], found)
