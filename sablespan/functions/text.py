"""Normal forms, windows and shape features of texts, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sablespan.functions.dialect import ACCENTED, PLAIN


def ensemble_form(text: Column) -> Column:
    """Lower case; only letters, digits and `._- ` stay; runs of spaces become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}._ -]", ""), " +", " "))


def redactor_form(text: Column, preserve: str = "") -> Column:
    """Only letters, digits, `_ . -`, white space and preserve stay; white space becomes one space."""
    kept = F.regexp_replace(F.lower(text), rf"[^\p{{L}}\p{{N}}_\s.\-{preserve}]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def domain_form(text: Column, domain: Column, preserve: dict[str, str]) -> Column:
    """redactor_form() that keeps the further characters of the row's domain; other domains keep none."""
    out = redactor_form(text)
    for name, kept in preserve.items():
        out = F.when(domain == name, redactor_form(text, kept)).otherwise(out)
    return out


def prepared(text: Column) -> Column:
    """White space at the ends removed and runs of it made one space."""
    return F.trim(F.regexp_replace(text, r"[\s]+", " "))


def matcher_form(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def without_accents(text: Column) -> Column:
    return F.translate(text, ACCENTED, PLAIN)


def window(text: Column, start: Column, end: Column, reach: int) -> Column:
    """The span with reach characters on either side."""
    first = F.greatest(start - reach, F.lit(0))
    return F.substring(text, first + 1, end + reach - first)


def words_around(words: Column, at: Column, reach: int) -> Column:
    """Of an array of words those at most reach places from at (counted from 0), with spaces."""
    first = F.greatest(at - reach, F.lit(0))
    return F.array_join(F.slice(words, first + 1, at + reach + 1 - first), " ")


def word_count(text: Column) -> Column:
    """Words between white space; none in empty text."""
    return F.when(F.trim(text) == "", 0).otherwise(F.size(F.split(F.trim(text), r"\s+")))


def all_caps(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def title_case(text: Column) -> Column:
    """Every word is a capital and then no capital."""
    return text.rlike(r"^[A-Z][^A-Z ]*(?: [A-Z][^A-Z ]*)*$")


def clamped(confidence: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))


def at_threshold(confidence: Column, threshold: Column, near: float = 0.01) -> Column:
    """Whether a confidence lies at its threshold; never where there is none."""
    return F.coalesce(F.abs(confidence - threshold) < near, F.lit(False))


def any_term(text: Column, terms: list[str]) -> Column:
    """Whether a lower-cased text contains one of the terms: one pass by an alternation of literals."""
    from re import sub

    return F.lower(text).rlike("|".join(sub(r"([^A-Za-z0-9 _-])", r"\\\1", t) for t in terms))
