"""Words of any length are looked at whole."""

from sablespan.llm import private


def test_signals_in_a_long_word_are_looked_at():
    word = "w" * (3 * private.LONG) + "=4111-22;" + "x" * private.LONG + "=id77"
    text = f"some words {word} and more 12 words"
    seen = {p for tokens in private.segments(text) for a, b in tokens for p in range(a, b)}
    assert set(range(text.index("="), text.index("=") + 9)) - {i for i, c in enumerate(text) if c.isspace()} <= seen
    assert {text.index("id77"), text.index("12 words")} <= seen


def test_stretches_neither_overlap_nor_go_back():
    text = ("a" * 2000 + "1") + " b" * 9 + " " + "c2" * 1500 + " d" * 9 + " 3"
    spans = [t for tokens in private.segments(text) for t in tokens]
    assert spans == sorted(spans) and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert {i for i, c in enumerate(text) if c.isdigit()} <= {p for a, b in spans for p in range(a, b)}
