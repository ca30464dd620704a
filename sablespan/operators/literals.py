"""Which patterns a text can match, from the literals that each pattern's matches must hold.

A pattern's expression gives a set of literals one of which every match holds, in small letters. One
Aho-Corasick automaton over the literals of all patterns reads a text once and names the patterns worth running, so that
what a text costs doesn't grow with patterns that can't match it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from re import _constants as C
from re import _parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Literals of fewer characters stand in most texts; longer alternations than MOST say little and cost much.
LEAST, MOST = 2, 400


def _sets(parsed: _parser.SubPattern) -> Iterator[set[str]]:
    """Sets of literals; of each set a match of parsed holds one."""
    run = ""
    for op, value in [*parsed, (None, None)]:
        if op is C.LITERAL and chr(value).isascii():
            run += chr(value).lower()
            continue
        if run:
            yield {run}
            run = ""
        if op is C.SUBPATTERN:
            yield from _sets(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            yield from _sets(value[2])
        elif op is C.BRANCH:
            each = [best(branch) for branch in value[1]]
            if all(each):
                yield set().union(*each)
        elif op is C.ATOMIC_GROUP:
            yield from _sets(value)


def best(parsed: _parser.SubPattern) -> set[str]:
    """The set whose shortest literal is longest; none if there is none."""
    found = [s for s in _sets(parsed) if len(s) <= MOST]
    return max(found, key=lambda s: (min(map(len, s)), -len(s)), default=set())


def literals(regex: str) -> set[str]:
    """Literals, in small letters, one of which every match of regex holds; empty if nothing can be said."""
    found = best(_parser.parse(regex))
    return found if found and min(map(len, found)) >= LEAST else set()


def first_characters(parsed: _parser.SubPattern) -> set[str]:
    """Characters one of which every match of parsed begins with, whatever the case; empty if nothing can be said."""
    for op, value in parsed:
        if op is C.AT:
            continue
        if op is C.LITERAL:
            return {chr(value)}
        if op is C.IN:
            kinds = {C.LITERAL: lambda v: {chr(v)}, C.RANGE: lambda v: set(map(chr, range(v[0], v[1] + 1))), C.CATEGORY: lambda v: set("0123456789") if v is C.CATEGORY_DIGIT else set()}
            each = [kinds[k](v) if k in kinds else set() for k, v in value]
        elif op is C.BRANCH:
            each = [first_characters(branch) for branch in value[1]]
        elif op is C.SUBPATTERN:
            return first_characters(value[3])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and value[0] > 0:
            return first_characters(value[2])
        else:
            return set()
        return set().union(*each) if all(each) else set()
    return set()


def chooser(expressions: list[str]) -> Callable[[str], list[int]]:
    """A function of a text that gives the numbers, in order, of the expressions that it can match: those whose literals it
    holds, and those without literals. One scan a text, for Python workers."""
    import ahocorasick

    automaton, always = ahocorasick.Automaton(), []
    of_literal: dict[str, tuple[int, ...]] = {}
    for i, expression in enumerate(expressions):
        own = literals(expression)
        for word in own:
            of_literal[word] = (*of_literal.get(word, ()), i)
        if not own:
            always.append(i)
    for word, own in of_literal.items():
        automaton.add_word(word, own)
    if not of_literal:
        return lambda text: always
    automaton.make_automaton()
    return lambda text: sorted({*always, *(i for _, own in automaton.iter(text.lower().replace("ſ", "s")) for i in own)})


def which_patterns(expressions: list[str]) -> tuple[Callable[[Column], Column], list[int]]:
    """A function of a text column that gives the numbers of expressions whose literals it holds, and the numbers
    of those without literals, which it can't speak of."""
    needs = [literals(x) for x in expressions]
    open_ones = [i for i, n in enumerate(needs) if not n]
    of_literal: dict[str, tuple[int, ...]] = {}
    for i, own in enumerate(needs):
        for word in own:
            of_literal[word] = (*of_literal.get(word, ()), i)

    @F.pandas_udf("array<int>")
    def numbers(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for word, own in of_literal.items():
            automaton.add_word(word, own)
        automaton.make_automaton()
        for texts in batches:
            yield pd.Series([sorted({i for _, own in automaton.iter(t.lower().replace("ſ", "s")) for i in own}) if t else [] for t in texts])

    numbers = numbers.asNondeterministic()  # worked out once, whatever reads it
    return (lambda text: numbers(text)), open_ones
