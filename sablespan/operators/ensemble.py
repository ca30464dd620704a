"""Routing, combining and re-scoring what several detectors found.

Detections have doc_id, entity_type, text, start_char, end_char, points (confidence in hundredths)
and source (`pattern` or `ner`).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sablespan.functions.text import ensemble_form
from sablespan.functions.validators import judged


@dataclass(frozen=True)
class Route:
    entity_type: str
    route: str
    threshold: int | None = None
    minimum: int | None = None
    pattern_weight: int | None = None
    ner_weight: int | None = None


#: Which detector a type is routed to, thresholds and weights in hundredths.
ROUTING = [
    Route("ADDRESS", "pattern_primary", 80),
    Route("EMAIL_ADDRESS", "pattern_primary", 70),
    Route("PHONE_NUMBER", "pattern_primary", 80),
    Route("INTERNET_REFERENCE", "pattern_primary", 70),
    Route("LOCATION", "pattern_primary", 80),
    Route("GPA", "pattern_primary", 90),
    Route("OTHER_ID", "pattern_primary"),
    Route("PERSON", "ner_primary", 60),
    Route("DATE_TIME", "ensemble", 80, 70, 65, 35),
    Route("EDUCATIONAL_INSTITUTION", "ensemble", None, 75, 50, 50),
    Route("PHI", "ensemble", None, 60, 5, 95),
    Route("PROTECTED_CLASS", "ensemble", None, 60, 5, 95),
]

#: Solo rows of these types may pass the ensemble.
SOLO = ("PHI", "PROTECTED_CLASS")


def routing_table(spark: SparkSession) -> DataFrame:
    schema = "entity_type string, route string, threshold int, minimum int, pattern_weight int, ner_weight int"
    return spark.createDataFrame([tuple(vars(r).values()) for r in ROUTING], schema)


def validated(found: DataFrame) -> DataFrame:
    """found with t and d, its text and document: valid rows only, their points adjusted, reasons kept."""
    rows = judged(found, F.col("entity_type")).filter("is_valid").withColumn("original_points", F.col("points"))
    return rows.withColumn("points", F.col("points") + F.col("adjustment")).drop("is_valid", "adjustment")


def detector_pairs(found: DataFrame) -> DataFrame:
    """Pairs of a pattern row and an ner row of one document, type and normal form whose spans touch."""
    form = found.withColumn("form", ensemble_form(F.col("text")))
    p = form.filter("source = 'pattern'").alias("p")
    s = form.filter("source = 'ner'").alias("s")
    same = (F.col("p.doc_id") == F.col("s.doc_id")) & (F.col("p.entity_type") == F.col("s.entity_type")) & (F.col("p.form") == F.col("s.form"))
    touch = (F.col("p.start_char") <= F.col("s.end_char")) & (F.col("s.start_char") <= F.col("p.end_char"))
    return p.join(s, same & touch)


def weights(kind: str) -> Column:
    """The weight of a row's type, by kind (pattern_weight or ner_weight)."""
    out = F.lit(None).cast("int")
    for r in ROUTING:
        if (w := getattr(r, kind)) is not None:
            out = F.when(F.col("entity_type") == r.entity_type, w).otherwise(out)
    return out


def combined(found: DataFrame) -> DataFrame:
    """Ensemble rows: the pattern row's span with the weighted confidence, from 0 to 100."""
    pairs = detector_pairs(found.filter(F.col("entity_type").isin([r.entity_type for r in ROUTING if r.route == "ensemble"])))
    rows = pairs.select("p.doc_id", "p.entity_type", "p.text", "p.start_char", "p.end_char", F.col("p.points").alias("pp"), F.col("s.points").alias("sp"))
    score = (F.col("pp") * weights("pattern_weight") + F.col("sp") * weights("ner_weight")).cast("bigint")  # in ten-thousandths
    return rows.select(
        "doc_id", "entity_type", "text", "start_char", "end_char", F.greatest(F.lit(0), F.least(F.lit(10_000), score)).alias("score"), F.lit("ensemble").alias("source")
    )


def _minimum() -> Column:
    out = F.lit(None).cast("int")
    for r in ROUTING:
        if r.minimum is not None:
            out = F.when(F.col("entity_type") == r.entity_type, r.minimum).otherwise(out)
    return out


def solo(found: DataFrame) -> DataFrame:
    """Rows of SOLO types that pass alone, as ensemble rows, with `through`: whether a row needs no validation.

    Where a document has ner rows of a protected class, those pass as they are and pattern rows of the class
    don't. Else rows pass whose weighted confidence reaches 85 % of the type's minimum, with that confidence.
    """
    rows = found.filter(F.col("entity_type").isin(*SOLO))
    protected = F.col("entity_type") == "PROTECTED_CLASS"
    ner = F.max(F.col("source") == "ner").over(Window.partitionBy("doc_id", "entity_type"))
    rows = rows.withColumn("bypass", protected & ner)
    weight = F.when(F.col("source") == "pattern", weights("pattern_weight")).otherwise(weights("ner_weight"))
    through = F.col("bypass") & (F.col("source") == "ner")
    reach = ~F.col("bypass") & (F.col("points") * weight >= _minimum() * 85)
    points = F.when(through, F.col("points")).otherwise(F.floor(F.col("points") * weight / 100)).cast("int")
    return rows.filter(through | reach).withColumn("points", points).withColumn("through", through).withColumn("source", F.lit("ensemble")).drop("bypass")


def combined_rows(found: DataFrame) -> DataFrame:
    """combined(), as rows of found: with t and d and whole points."""
    pairs = detector_pairs(found.filter(F.col("entity_type").isin([r.entity_type for r in ROUTING if r.route == "ensemble"])))
    rows = pairs.select("p.*", F.col("s.points").alias("sp")).drop("form")
    score = F.greatest(F.lit(0), F.least(F.lit(10_000), F.col("points") * weights("pattern_weight") + F.col("sp") * weights("ner_weight")))
    return rows.withColumn("points", F.floor(score / 100).cast("int")).withColumn("source", F.lit("ensemble")).drop("sp")


def detect_full(found: DataFrame) -> DataFrame:
    """Valid pattern rows of pattern-routed types, valid ner rows, and ensemble rows: valid combinations, valid solo
    rows, and protected-class ner rows as they are. All rows are validated together, once.

    Rows come by document and place within the tasks that hold them; order the whole by doc_id for a report.
    """
    kept = ["doc_id", "entity_type", "text", "start_char", "end_char", F.col("points").cast("bigint").alias("points"), "source"]
    primary = [r.entity_type for r in ROUTING if r.route == "pattern_primary"]
    own = found.filter((F.col("source") == "ner") | F.col("entity_type").isin(primary)).withColumn("through", F.lit(False))
    both = combined_rows(found).withColumn("through", F.lit(False))
    rows = own.unionByName(both).unionByName(solo(found))
    asked = judged(rows, F.when(~F.col("through"), F.col("entity_type")).otherwise("other"))
    out = asked.filter("is_valid").withColumn("points", F.col("points") + F.col("adjustment")).select(*kept)
    return out.sortWithinPartitions("doc_id", "start_char", "end_char")


def detect_target(found: DataFrame, entity_type: str) -> DataFrame:
    """detect_full() of one type: the filter reaches each branch."""
    return detect_full(found.filter(F.col("entity_type") == entity_type))


def above_threshold(found: DataFrame, default: int = 70) -> DataFrame:
    """Rows whose confidence reaches their type's threshold."""
    limit = F.lit(default)
    for r in ROUTING:
        if r.threshold is not None:
            limit = F.when(F.col("entity_type") == r.entity_type, r.threshold).otherwise(limit)
    return found.filter(F.col("points") >= limit)


#: Words that are never redacted.
KEEP_WORDS = ["Python", "Java", "JavaScript", "SQL", "Senior", "Junior", "Lead", "Manager"]


def kept(form: Column, words: list[str]) -> Column:
    """Whether a normal form is a keep word, holds all tokens of one of several, or is a token of one."""
    tokens = F.array_distinct(F.split(form, " "))
    out = F.lit(False)
    for w in words:
        word = w.lower()
        own = F.array(*map(F.lit, dict.fromkeys(word.split())))
        out = out | (form == word) | ((F.size(own) > 1) & (F.size(F.array_except(own, tokens)) == 0))
        out = out | ((F.size(tokens) == 1) & F.array_contains(own, F.element_at(tokens, 1)))
    return out


def without_kept(found: DataFrame, words: list[str] | None = None, always: list[str] | None = None) -> DataFrame:
    """found without keep words; texts among always stay whatever the keep words say."""
    form = ensemble_form(F.col("text"))
    stays = ~kept(form, KEEP_WORDS if words is None else words)
    if always:
        stays = stays | form.isin([w.lower() for w in always])
    return found.filter(stays)
