"""The stretches of words that the field looks at."""

from sablespan.llm import private


def test_context_goes_over_any_white_space():
    for gap in (" ", "\n" * 9, " \t" * 300):
        text = gap.join(["one", "call", "me", "x5", "now", "and", "then", "four"])
        (tokens,) = private.segments(text)
        seen = [text[a:b] for a, b in tokens]
        assert seen == ["call", "me", "x5", "now", "and", "then"], gap[:2]
    (only,) = private.segments(" " * 50 + "7" + "\n" * 50)
    assert len(only) == 1


def test_a_long_word_still_ends_it():
    long = "w" * (private.LONG + 1)
    (tokens,) = private.segments(f"a {long} b 5 {long} c")
    assert len(tokens) == 2


def test_the_field_is_fitted_once():
    assert private.default_chain() is private.default_chain()
