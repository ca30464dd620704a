"""One validator per entity type, as an ordered ladder of arms.

A ladder reads t, the entity's text, d, its document, and start_char, its place there.  Its arms are tried in order: an arm
with a verdict ends it, an arm without one adds its points and goes on.  The points of all arms
passed, in hundredths, are the change of confidence; their names are the reasons.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablespan.functions import rules as R
from sablespan.functions.dialect import SparkSQL


@dataclass(frozen=True)
class Arm:
    when: str
    verdict: bool | None
    points: int
    reason: str


def _any(column: str, terms: list[str], q: SparkSQL) -> str:
    """column contains one of the terms."""
    return "(" + " OR ".join(f"contains({column}, {q.text(t)})" for t in terms) + ")"


def _word(terms: list[str], after: str = "[, ]|$") -> str:
    """A pattern for one of the terms as a whole word."""
    return rf"(?i)(?:^|[^A-Za-z])(?:{'|'.join(terms)})\.?(?:{after})"


def education(q: SparkSQL) -> list[Arm]:
    fold = q.folded("t")
    return [
        Arm(f"upper(t) IN ({', '.join(map(q.text, R.EDUCATION['acronyms']))})", True, 40, "acronym"),
        Arm(f"{q.words('t')} < 2", False, -30, "single_word"),
        Arm(_any(fold, R.EDUCATION["generic"], q), False, -100, "generic"),
        Arm(f"NOT {_any(fold, R.EDUCATION['core'], q)}", False, -100, "no_core_term"),
        Arm("true", True, 20, "full_name"),
    ]


def person(q: SparkSQL) -> list[Arm]:
    part = f"[{R.UPPER}][^ ]*"
    caps = f"(upper(t) = t AND {q.matches('t', '[A-Z]')})"
    title = _any("lower(t)", R.PERSON["titles"], q)
    places = " + ".join(f"CASE WHEN contains(lower(d), {q.text(w)}) THEN 1 ELSE 0 END" for w in R.PERSON["address"])
    return [
        Arm(f"length(t) < 2 OR {q.words('t')} < 1", False, -30, "too_short"),
        Arm("start_char = 0 OR substring(d, start_char, 1) = chr(10)", None, 30, "name_first"),
        Arm(q.matches("t", f"^{part} (?:[{R.UPPER}][^ ]? )?{part}$"), None, 20, "full_name"),
        Arm(title, None, 20, "title"),
        Arm(f"source = 'ner' AND {_any('lower(d)', R.PERSON['technical'], q)}", None, -50, "technical_context"),
        Arm(f"({places}) >= 2", None, -30, "address_context"),
        Arm(f"{caps} AND {q.words('t')} < 2 AND NOT {title}", False, -30, "single_caps"),
        Arm(f"NOT {caps} AND {q.matches('t', f'(?:^| )[^ {R.UPPER}]')}", False, -20, "lowercase"),
        Arm("true", None, 20, "proper_case"),
        Arm(f"{q.words('t')} >= 2", None, 20, "multiple_words"),
        Arm("true", True, 0, "accepted"),
    ]


def location(q: SparkSQL) -> list[Arm]:
    city, world, metro = (q.matches("t", R.LOCATION[k]) for k in ("city_state", "international", "metro"))
    single = f"{q.words('t')} = 1"
    state = f"t IN ({', '.join(map(q.text, R.STATES))})"
    return [
        Arm("length(t) < 2", False, -20, "too_short"),
        Arm(f"NOT {q.matches('t', f'^[{R.UPPER}]')}", False, -30, "no_capital"),
        Arm(city, None, 30, "city_state"),
        Arm(f"{city} AND {q.matches('t', R.LOCATION['zip'])}", None, 10, "zip"),
        Arm(f"NOT {city} AND {world}", None, 30, "international"),
        Arm(metro, None, 20, "metro"),
        Arm(f"{single} AND {state}", None, 20, "state"),
        Arm(f"{single} AND NOT {state} AND upper(t) = t", None, 10, "all_caps"),
        Arm(f"{single} AND NOT {state} AND upper(t) <> t AND NOT {metro}", None, -20, "single_word"),
        Arm(f"NOT {single} AND NOT {city} AND NOT {world} AND NOT {metro}", None, 10, "multiple_words"),
        Arm("true", True, 0, "accepted"),
    ]


def address(q: SparkSQL) -> list[Arm]:
    street = q.matches("t", _word(R.ADDRESS["street"]))
    unit = q.matches("t", _word(R.ADDRESS["unit"]))
    toward = q.matches("t", _word(R.ADDRESS["direction"]))
    return [
        Arm("length(t) < 5", False, -50, "too_short"),
        Arm(f"NOT {q.matches('t', '[0-9]')}", False, -50, "no_number"),
        Arm(f"NOT {street}", False, -30, "no_street_type"),
        Arm("true", None, 20, "street_type"),
        Arm(unit, None, 10, "unit"),
        Arm(toward, None, 10, "direction"),
        Arm(f"({unit}) OR ({toward})", None, 20, "full_address"),
        Arm("true", True, 0, "accepted"),
    ]


def email(q: SparkSQL) -> list[Arm]:
    return [
        Arm("length(t) < 5", False, -30, "too_short"),
        Arm("length(t) > 254", False, -20, "too_long"),
        Arm("NOT contains(t, '@')", False, -30, "no_at"),
        Arm(q.matches("t", r"^@|\.@"), False, -30, "bad_local"),
        Arm(q.matches("t", r"\.\.[^@]*@"), False, -30, "double_dot"),
        Arm(f"NOT {q.matches('t', R.EMAIL['basic'])}", False, -30, "bad_format"),
        Arm(q.matches("lower(t)", R.EMAIL["known"]), None, 20, "known_domain"),
        Arm(q.matches("t", R.EMAIL["strict"]), None, 80, "proper_format"),
        Arm(q.matches("d", R.EMAIL["context"]), None, 10, "context"),
        Arm("true", True, 0, "accepted"),
    ]


def phone(q: SparkSQL) -> list[Arm]:
    digits = f"length({q.strip('t', '[^0-9]')})"
    bare = q.strip("t", R.PHONE["extension"])
    known = "(" + " OR ".join(q.matches(bare, p) for p in R.PHONE["formats"]) + ")"
    said = q.matches("d", R.PHONE["context"])
    return [
        Arm(f"{digits} < 10", False, -50, "few_digits"),
        Arm(f"{digits} > 15", False, -50, "many_digits"),
        Arm(q.matches("t", R.PHONE["extension"]), None, 10, "extension"),
        Arm(said, None, 10, "context"),
        Arm(known, None, 40, "format"),
        Arm(f"{known} OR {said}", True, 0, "accepted"),
        Arm("true", False, 0, "no_format"),
    ]


def gpa(q: SparkSQL) -> list[Arm]:
    number = q.first("t", r"-?[0-9]+\.?[0-9]*")
    value = q.number(q.strip(number, r"\.$"))
    scale = q.number(f"trim(split_part(t, '/', 2))")
    said = f"({q.matches('t', R.GPA['indicator'])} OR {q.matches('d', R.GPA['indicator'])})"
    return [
        Arm(f"{number} = ''", False, -50, "no_number"),
        Arm(f"{value} < 0 OR {value} > 4", False, -50, "out_of_range"),
        Arm(f"contains(t, '/') AND coalesce({scale}, -1) <> 4", False, -50, "bad_scale"),
        Arm("contains(t, '/')", None, 10, "scale"),
        Arm(f"NOT {said} AND NOT contains(t, '/')", False, -30, "no_indicator"),
        Arm(said, None, 30, "indicator"),
        Arm(q.matches(number, r"\.[0-9]{2}[0-9]*[1-9]"), False, -20, "many_decimals"),
        Arm(f"{value} >= 2 AND {value} <= 4", None, 20, "usual_range"),
        Arm("true", True, 0, "accepted"),
    ]


def internet(q: SparkSQL) -> list[Arm]:
    url = q.matches("t", R.INTERNET["url"])
    social = q.matches("t", R.INTERNET["social"])
    handle = f"({q.matches('t', R.INTERNET['handle'])} AND length(t) <= 30)"
    return [
        Arm("length(t) < 4 OR length(t) > 512", False, -30, "length"),
        Arm(f"{url} AND {social}", None, 90, "social"),
        Arm(f"{url} AND NOT {social} AND {q.matches('t', R.INTERNET['common'])}", None, 90, "common_domain"),
        Arm(f"{url} AND {q.matches('t', '^https?://')}", None, 10, "scheme"),
        Arm(url, True, 0, "url"),
        Arm(f"{handle} AND {q.matches('d', R.INTERNET['platforms'])}", None, 20, "platform"),
        Arm(handle, True, 0, "handle"),
        Arm("true", False, -30, "no_format"),
    ]


def protected_class(q: SparkSQL) -> list[Arm]:
    term = _any("lower(t)", R.PROTECTED["terms"], q)
    return [
        Arm(q.matches("t", R.PROTECTED["pronouns"]), True, 30, "pronouns"),
        Arm(f"{term} AND {q.matches('d', R.PROTECTED['organizations'])}", True, 30, "organization"),
        Arm(f"{term} AND {q.matches('d', R.PROTECTED['phrases'])}", True, 30, "phrase"),
        Arm(f"{term} AND {q.matches('d', R.PROTECTED['prefixes'])}", True, 30, "prefix"),
        Arm("true", False, -40, "no_context"),
    ]


def phi(q: SparkSQL) -> list[Arm]:
    return [
        Arm(_any("lower(t)", R.PHI["always"], q), True, 30, "always_valid"),
        Arm(_any("lower(t)", R.PHI["conditions"], q), True, 40, "condition"),
        Arm(q.matches("d", R.PHI["context"]), True, 40, "medical_context"),
        Arm(q.matches("d", R.PHI["specific"]), True, 40, "specific"),
        Arm(f"{_any('lower(t)', R.PHI['treatments'], q)} AND {q.matches('d', R.PHI['diagnosis'])}", True, 20, "treatment"),
        Arm("true", False, -70, "no_context"),
    ]


def date(q: SparkSQL) -> list[Arm]:
    forms = [("education", 100), ("range", 85), ("year_month", 80), ("month_year", 90), ("year", 70)]
    marked = q.matches("d", R.DATE["markers"])
    return [
        Arm(marked, None, 20, "marker"),
        *(Arm(q.matches("t", R.DATE[k]), True, n, k) for k, n in forms),
        Arm(marked, True, 0, "marker_only"),
        Arm("true", False, 0, "no_format"),
    ]


#: Entity type to ladder. A type without one is accepted as it is.
LADDERS = {
    "EDUCATIONAL_INSTITUTION": education,
    "PERSON": person,
    "LOCATION": location,
    "ADDRESS": address,
    "EMAIL_ADDRESS": email,
    "PHONE_NUMBER": phone,
    "GPA": gpa,
    "INTERNET_REFERENCE": internet,
    "URL": internet,
    "IP_ADDRESS": internet,
    "PROTECTED_CLASS": protected_class,
    "PHI": phi,
    "DATE_TIME": date,
}


def ladder_sql(arms: list[Arm]) -> dict[str, str]:
    """SQL of is_valid, points and reasons over columns t, d, start_char and source."""
    stop = "CASE " + " ".join(f"WHEN {a.when} THEN {i}" for i, a in enumerate(arms) if a.verdict is not None) + " END"
    passed = {i: (f"{stop} = {i}" if a.verdict is not None else f"({a.when}) AND {stop} > {i}") for i, a in enumerate(arms)}
    verdict = " ".join(f"WHEN {i} THEN {str(a.verdict).lower()}" for i, a in enumerate(arms) if a.verdict is not None)
    points = " + ".join(f"CASE WHEN {passed[i]} THEN {a.points} ELSE 0 END" for i, a in enumerate(arms) if a.points)
    reasons = ", ".join(f"CASE WHEN {passed[i]} THEN '{a.reason}' END" for i, a in enumerate(arms))
    return {"is_valid": f"CASE {stop} {verdict} END", "points": f"CAST({points} AS BIGINT)", "reasons": f"concat_ws('|', {reasons})"}


def verdict(entity_type: str) -> Column:
    """STRUCT<is_valid, points, reasons> for an entity of this type, over columns t, d, start_char and source.

    The arm that ends the ladder is worked out once and bound by transform() over an array of one, so that the
    expression grows with the number of arms and not with its square. It is parsed from SQL as a whole: built of
    columns it would take a call to the JVM for each operator of each arm.
    """
    if entity_type not in LADDERS:
        return F.expr("named_struct('is_valid', true, 'points', 0L, 'reasons', '')")
    arms = LADDERS[entity_type](SparkSQL())
    ends = [i for i, a in enumerate(arms) if a.verdict is not None]
    stop = "CASE " + " ".join(f"WHEN {arms[i].when} THEN {i}" for i in ends) + " END"
    passed = [f"ending = {i}" if a.verdict is not None else f"({a.when}) AND ending > {i}" for i, a in enumerate(arms)]
    valid = "CASE ending " + " ".join(f"WHEN {i} THEN {str(arms[i].verdict).lower()}" for i in ends) + " END"
    points = " + ".join(["0", *(f"CASE WHEN {p} THEN {a.points} ELSE 0 END" for p, a in zip(passed, arms, strict=True) if a.points)])
    reasons = ", ".join(f"CASE WHEN {p} THEN '{a.reason}' END" for p, a in zip(passed, arms, strict=True))
    out = f"named_struct('is_valid', {valid}, 'points', CAST({points} AS BIGINT), 'reasons', concat_ws('|', {reasons}))"
    return F.expr(f"element_at(transform(array({stop}), ending -> {out}), 1)")


def dispatch(entity_type: Column) -> Column:
    """The verdict of the ladder that the row's type has; empty text is invalid."""
    none = F.struct(F.lit(False).alias("is_valid"), F.lit(0).cast("bigint").alias("points"), F.lit("empty").alias("reasons"))
    out = F.when(F.col("t").isNull() | (F.col("t") == ""), none)
    for name in LADDERS:
        out = out.when(entity_type == name, verdict(name))
    return out.otherwise(verdict("other"))


def judged(rows: DataFrame, entity_type: Column) -> DataFrame:
    """rows with is_valid, adjustment and reasons. A generator holds the ladders, so that no later filter or
    projection copies them."""
    return rows.select("*", F.inline(F.array(dispatch(entity_type))).alias("is_valid", "adjustment", "reasons"))
