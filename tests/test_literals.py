"""The automaton over patterns' literals: what it says, and that rows stay the same."""

import random
import re

import pytest

from sablespan.operators.extract import CUSTOM, DATES, PATTERNS, RECOGNIZERS, Registry, find_spans
from sablespan.operators.literals import literals

ALL = [*Registry().patterns(), *CUSTOM, *DATES, *PATTERNS]


@pytest.mark.parametrize(
    "regex,want",
    [
        ("abc", {"abc"}), ("(?i)ABc+d", {"ab"}), ("a?bc*dd", {"dd"}), ("(?:cat|dog)s", {"cat", "dog"}), ("(?:cat|[0-9])x", set()), ("[0-9]+", set()),
        (r"x@[a-z]+\.com", {".com"}), ("(?:ab){2,}c", {"ab"}), ("(?:ab)*cd", {"cd"}), ("(?:a|(?:bcd|efg)h)", set()), ("token = \"[0-9a-f]{40}\"", {'token = "'}),
    ],
)
def test_literals(regex, want):
    assert literals(regex) == want


def test_every_match_holds_a_literal():
    rng = random.Random(2)
    known = {w for p in ALL for w in literals(p.regex)}
    said = sum(bool(literals(p.regex)) for p in ALL)
    assert said > 0.6 * len(ALL)
    parts = [*known, *map(str.upper, known), "3.5", "GPA: ", "50% ", " ", "street", "12 ", "(she/her)", "Oak ", ", OH 12345", "a.b@c.de", "10.0.0.1"]
    for _ in range(300):
        text = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(30))
        for p in ALL:
            for m in re.finditer(p.regex, text):
                assert not literals(p.regex) or any(w in m[0].lower() for w in literals(p.regex)), p


def test_rows_are_the_same(spark, sf_dir):
    from sablespan.plans import wider

    docs = wider._corpus(spark, sf_dir)
    extra = spark.createDataFrame([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "50% Disabled İ GPA: 3.5 K@x.com " * 3)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    by_index, plain = (sorted(tuple(r) for r in find_spans(docs, ALL, many=n).collect()) for n in (1, 10**6))
    assert by_index == plain and len({r[2] for r in plain}) > 20
    plan = find_spans(docs, ALL, many=1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_recognizers_are_covered():
    assert set(RECOGNIZERS) <= {p.entity_type for p in ALL}


def test_chooser_runs_what_can_match():
    """The table function runs only expressions whose literals a text holds, and finds the same."""
    import re

    from sablespan.operators.extract import RECOGNIZERS
    from sablespan.operators.literals import chooser
    from sablespan.operators.table_function import Detect, Wanted

    expressions = [p.regex for kind in ("PHI", "GPA") for p in RECOGNIZERS[kind]]
    choose = chooser(expressions)
    assert len(choose("plain words of no kind")) < len(expressions) / 2
    texts = ["GPA: 3.5 and 3.25/4.0", "30% Service-connected, taking aspirin", "DIAGNOSED WITH asthma", "P&T disability", "", "plain words of no kind", "ſervice"]
    for text in texts:
        may = choose(text)
        assert may == sorted(may) and {i for i, x in enumerate(expressions) if re.search(x, text, re.ASCII)} <= set(may)
    asked = Wanted.__new__(Wanted)
    asked.types = ["PHI", "GPA"]
    detect = Detect(asked)
    got = [list(detect.eval({"doc_id": 1, "text": t})) for t in (*texts, None)]
    assert all(got[:4]) and not any(got[4:])
    ran = []
    detect.patterns = [(p, type("Counted", (), {"finditer": lambda self, text, x=x: ran.append(1) or x.finditer(text)})()) for p, x in detect.patterns]
    list(detect.eval({"doc_id": 1, "text": "plain words of no kind"}))
    assert len(ran) < len(expressions) / 2
