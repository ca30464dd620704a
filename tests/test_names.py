"""The name labeller: decoding against enumeration, training, held-back lines, and the query."""

import itertools
import random

from sablespan.operators import names as N
from sablespan.operators.names_table import KEPT, TRAIN, generated


def test_decoding_equals_enumeration():
    rng = random.Random(3)
    seen_features = [f"f{i}" for i in range(6)]
    for _ in range(150):
        weights = {(f, t): rng.uniform(-1, 1) for f in (*seen_features, *(f"from={x}" for x in "OBI")) for t in "OBI"}
        seen = [rng.sample(seen_features, 3) for _ in range(rng.randrange(1, 6))]
        every = ("".join(t) for t in itertools.product("OBI", repeat=len(seen)))
        lawful = [t for t in every if all((a, b) in N.ALLOWED for a, b in zip("O" + t, t))]
        best = max(N.score(seen, t, weights) for t in lawful)
        got = N.decode(seen, weights)
        assert got in lawful and abs(N.score(seen, got, weights) - best) < 1e-9


def test_training_lines_are_learnt():
    right, wrong, missed = N.rates(TRAIN + generated(), N.default_weights())
    assert right > 0.95 * (right + missed) and wrong < 0.02 * right


def test_held_back_lines():
    """Names and lines that the fit has not seen."""
    seen = " ".join(TRAIN + generated())
    held = [N.marked(k) for k in KEPT]
    assert not any(text[a:b] in seen for text, spans in held for a, b in spans)
    right, wrong, missed = N.kept_rates()
    assert right / (right + wrong) >= PRECISION and right / (right + missed) >= RECALL


PRECISION, RECALL = 0.85, 0.75


def test_places_and_odd_texts(spark):
    long = "x y " * 100_000 + "Signed by Maria Lind."
    rows = [(1, "Ärger 😀 with Mr. Lind today.\nDear Anna Berg, hello"), (2, None), (3, ""), (4, long), (None, "My name is Anna Berg.")]
    got = N.NameLabeller().detect(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    texts = dict(rows)
    for r in got:
        assert texts[r["doc_id"]][r["start_char"] : r["end_char"]] == r["text"]
    assert {(r["doc_id"], r["text"]) for r in got} >= {(1, "Lind"), (1, "Anna Berg"), (4, "Maria Lind"), (None, "Anna Berg")}
    assert N.NameLabeller().detect(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_equals_plain_loop(spark, sf_dir):
    from sablespan.plans import base, wider

    docs = {r["doc_id"]: r["text"] for r in wider._corpus(spark, sf_dir).collect()}
    got = sorted((r["doc_id"], r["start_char"], r["end_char"]) for r in base.QUERIES["person_spans"](spark, sf_dir).collect())
    assert got == sorted((d, a, b) for d, t in docs.items() for a, b in N.names_in(t or "", N.default_weights()))
    assert got


def test_remembered_parts_equal_features():
    """What a labeller adds up from what it remembers is what the features of each run gain, also when it forgets."""
    weights = N.default_weights()
    lines = [N.marked(k)[0] for k in KEPT + TRAIN + generated()]
    texts = [*lines, " ".join(lines), "macLind and Anna Berg", "x-Anna, O'Neil-Berg. Mr. Lind\nDr. A. Holm", "Anna", ""]

    def plainly(text):
        tokens, out = N.tokens_of(text), []
        for a, b in N.runs_of(tokens):
            for i, tag in zip(range(a, b), N.decode([N.features(tokens, i) for i in range(a, b)], weights), strict=True):
                if tag == "B":
                    out.append(tokens[i][1:])
                elif tag == "I":
                    out[-1] = (out[-1][0], tokens[i][2])
        return out

    for known in (N.KNOWN, 3):
        N.KNOWN, before = known, N.KNOWN
        try:
            labeller = N.Labeller(weights)
            assert [labeller.names_in(t) for t in texts] == [plainly(t) for t in texts]
            assert all(len(k) <= known for k in labeller.known)
        finally:
            N.KNOWN = before
