"""Why detections came out as they did: traces, flags, causes and roll-ups.

Detections have doc_id, entity_type, text, points and source; analysed ones also t and d, their text
and document, original_points and reasons.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sablespan.functions.text import all_caps, at_threshold, title_case, word_count

POSITIVE = ["contact", "write", "call", "address", "name", "signed"]
NEGATIVE = ["example", "sample", "test", "version"]
SOFTWARE = ["docker", "github", "javascript", "database", "code"]


def confidence_trace(original: Column, rules: Column, final: Column) -> Column:
    """The steps of a confidence, as text: its start, after each rule that ends in a number (clamped to 0..100),
    and the final value where that differs. Numbers are hundredths."""
    start = F.struct(original.cast("bigint").alias("now"), F.concat(F.lit("start:"), original.cast("bigint").cast("string")).alias("steps"))

    def step(state: Column, rule: Column) -> Column:
        change = F.try_to_number(F.element_at(F.split(rule, "_"), -1), F.lit("S999")).cast("bigint")
        now = F.greatest(F.lit(0), F.least(F.lit(100), state["now"] + change)).cast("bigint")
        return F.when(change.isNull() | ~rule.startswith("confidence_adj"), state).otherwise(
            F.struct(now.alias("now"), F.concat(state["steps"], F.lit(">"), now.cast("string")).alias("steps"))
        )

    def end(state: Column) -> Column:
        return F.when(state["now"] == final, state["steps"]).otherwise(F.concat(state["steps"], F.lit(">final:"), final.cast("string")))

    return F.aggregate(rules, start, step, end)


def flags(found: DataFrame) -> DataFrame:
    """found with flags, the marks of likely false positives joined by `|`: low confidence, technical words near a
    person, a large loss of confidence."""
    technical = F.exists(F.array(*map(F.lit, SOFTWARE)), lambda w: F.contains(F.lower("d"), w))
    marks = F.array_compact(
        F.array(
            F.when(F.col("points") <= 60, "low_confidence"),
            F.when((F.col("entity_type") == "PERSON") & technical, "technical_context"),
            F.when(F.col("points") - F.col("original_points") < -20, "large_loss"),
        )
    )
    return found.withColumn("flags", F.array_join(marks, "|"))


def miss_causes(missed: DataFrame) -> DataFrame:
    """Missed annotations with the likely causes, joined by `|`."""
    text = F.col("text")
    causes = F.array_compact(
        F.array(
            F.when(F.length(text) < 4, "short"),
            F.when(all_caps(text), "all_caps"),
            F.when(~text.rlike("[0-9]"), "no_digit"),
            F.when(word_count(text) > 3, "many_words"),
        )
    )
    return missed.withColumn("causes", F.array_join(causes, "|"))


def shape_features(found: DataFrame, threshold: Column) -> DataFrame:
    text = F.col("text")
    return found.withColumns(
        {
            "caps": all_caps(text),
            "title": title_case(text),
            "digit": text.rlike("[0-9]"),
            "words": word_count(text).cast("bigint"),
            "chars": F.length(text).cast("bigint"),
            "space": F.contains(text, F.lit(" ")),
            "punct": text.rlike("[^A-Za-z0-9 ]"),
            "at_threshold": at_threshold(F.col("points") / 100.0, threshold),
        }
    )


def indicators(text: Column) -> dict[str, Column]:
    """How many positive, negative and software terms a text has."""
    low = F.lower(text)
    count = lambda terms: F.size(F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains(low, w))).cast("bigint")
    return {"positive": count(POSITIVE), "negative": count(NEGATIVE), "software": count(SOFTWARE)}


def examples(rows: DataFrame, keys: list[str], order: list[str], n: int, text: str = "text") -> DataFrame:
    """keys and examples: the texts of a group's first n rows by order, joined.

    Each task keeps n rows of a group, and only those meet, so a group of any size sends n rows a task.
    """
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") <= n)
    return ranked.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list(F.struct("_n", text)))[text], "|").alias("examples"))


def detector_statistics(found: DataFrame, most: int = 5) -> DataFrame:
    """By source and type: rows, mean points, and the first distinct texts by code point."""
    keys = ["source", "entity_type"]
    some = examples(found.select(*keys, "text").distinct(), keys, ["text"], most)
    sums = found.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.col("points").cast("bigint")).alias("points"))
    return sums.join(some, keys)


def impact(found: DataFrame) -> DataFrame:
    """Raised, lowered and unchanged confidences by type and over all (a null type)."""
    change = F.col("points") - F.col("original_points")
    return found.groupingSets([["entity_type"], []], "entity_type").agg(
        F.count_if(change > 0).alias("raised"), F.count_if(change < 0).alias("lowered"), F.count_if(change == 0).alias("unchanged")
    )


def rule_counts(found: DataFrame) -> DataFrame:
    """How often each reason applied, and for how many types."""
    reasons = found.select("entity_type", F.explode(F.split("reasons", r"\|")).alias("reason")).filter("reason != ''")
    return reasons.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("entity_type").alias("types"))


def adjustments(found: DataFrame) -> DataFrame:
    """Rows, and the sums of all, of positive and of negative adjustments, by type, by detector and over all."""
    change = (F.col("points") - F.col("original_points")).cast("bigint")
    zero = F.lit(0).cast("bigint")
    return found.groupingSets([["entity_type"], ["source"], []], "entity_type", "source").agg(
        F.count("*").alias("n"),
        F.sum(change).alias("total"),
        F.sum(F.greatest(change, zero)).alias("positive"),
        F.sum(F.least(change, zero)).alias("negative"),
    )


def detector_report(found: DataFrame) -> DataFrame:
    """By detector: rows, the sum of points, improvements and reductions, and rows in each fifth of 0 to 100."""
    change = F.col("points") - F.col("original_points")
    fifth = F.when((F.col("points") >= 0) & (F.col("points") < 100), F.floor(F.col("points") / 20))
    return found.groupBy("source").agg(
        F.count("*").alias("n"),
        F.sum(F.col("points").cast("bigint")).alias("points"),
        F.count_if(change > 0).alias("improved"),
        F.count_if(change < 0).alias("reduced"),
        *[F.count_if(fifth == k).alias(f"b{k}") for k in range(5)],
    )


def false_positive_causes(found: DataFrame, routing: DataFrame, terms: dict[str, list[str]], context: list[str]) -> DataFrame:
    """Detections with likely causes of a false positive, joined by `|`: a core term of the type in the text, a confidence
    less than ten above the type's threshold, a context word in the text."""
    low = F.lower("text")
    core = F.lit(False)
    for name, words in terms.items():
        core = core | ((F.col("entity_type") == name) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    near = F.exists(F.array(*map(F.lit, context)), lambda w: F.contains(low, w))
    rows = found.join(routing.select("entity_type", "threshold"), "entity_type", "left")
    marks = F.array_compact(
        F.array(
            F.when(core, "core_term"),
            F.when(F.col("points") < F.coalesce("threshold", F.lit(70)) + 10, "borderline"),
            F.when(near, "context_word"),
        )
    )
    return rows.withColumn("causes", F.array_join(marks, "|")).drop("threshold")


def stages(found: DataFrame, valid: DataFrame, final: DataFrame, entity_type: str) -> DataFrame:
    """How many rows of a type each stage has: raw, by detector, valid, at or over the threshold, final."""
    of_type = lambda df: df.filter(F.col("entity_type") == entity_type)
    named = lambda df, stage: df.select(F.lit(stage).alias("stage"), F.lit(1).alias("one"))
    rows = [named(of_type(found), "1 raw"), named(of_type(found).filter("source = 'pattern'"), "2 pattern"), named(of_type(found).filter("source = 'ner'"), "3 ner")]
    rows += [named(of_type(valid), "4 valid"), named(of_type(final), "5 final")]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.groupBy("stage").agg(F.count("*").alias("n"))
