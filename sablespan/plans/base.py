"""What the queries share: tables, derived inputs, and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sablespan.functions.dialect import DuckSQL
from sablespan.functions.validators import LADDERS, ladder_sql
from sablespan.operators.extract import PATTERNS, Pattern, find_spans
from sablespan.plans.candidates import TEMPLATES, candidates_sql
from sablespan.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    """Register a function as a query under its name, with the SQL that checks it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans_sql(patterns: list[Pattern], source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """DuckDB: the spans of patterns, from what the texts split into."""
    q = DuckSQL()
    return " UNION ALL ".join(
        f"""SELECT {key}, '{p.entity_type}' AS entity_type, '{p.name}' AS pattern, i::int AS ordinal, ms[i] AS text, s0::int AS start_char,
        (s0 + length(ms[i]))::int AS end_char, {p.points} AS points FROM (
          SELECT {key}, ms, i, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s0
          FROM (SELECT {key}, regexp_extract_all({text}, {q.text(p.regex)}) AS ms, string_split_regex({text}, {q.text(p.regex)}) AS gaps
                FROM {source} WHERE regexp_matches({text}, {q.text(p.regex)})) z, unnest(range(1, len(ms) + 1)) u(i)) y"""
        for p in patterns
    )


SPANS = f"spans AS ({spans_sql(PATTERNS)})"

#: Annotations and detections derived from the spans, in SQL that Spark and DuckDB share. By turns a detection
#: is exact, starts late, is missing, is cut, has another type, or has a second one beside it.
TRUTH_SQL = """SELECT doc_id, concat(pattern, ':', CAST(ordinal AS STRING)) AS gt_id, entity_type, text, start_char, end_char, ordinal FROM {spans}"""
DETECTED_SQL = """
SELECT doc_id, gt_id AS det_id, CASE WHEN m = 4 THEN 'OTHER_ID' ELSE entity_type END AS entity_type,
  CASE WHEN m = 1 THEN substring(text, 3, length(text) - 2) WHEN m = 3 THEN substring(text, 1, cut) ELSE text END AS text,
  CASE WHEN m = 1 THEN start_char + 2 ELSE start_char END AS start_char,
  CASE WHEN m = 3 THEN start_char + cut ELSE end_char END AS end_char,
  CAST(40 + (doc_id * 7 + ordinal * 13) % 75 AS INT) AS points, CASE WHEN (doc_id + ordinal) % 2 = 0 THEN 'pattern' ELSE 'ner' END AS source
FROM (SELECT *, (doc_id + ordinal) % 6 AS m, CAST(floor(length(text) * 0.4) AS INT) AS cut FROM {truth}) x WHERE m <> 2
UNION ALL
SELECT doc_id, concat('x', gt_id), entity_type, 'extra', start_char + 100000, start_char + 100005, CAST(50 AS INT), 'ner' FROM {truth} WHERE (doc_id + ordinal) % 6 = 5
"""
TRUTH = f"{SPANS}, truth AS ({TRUTH_SQL.format(spans='spans')})"
BOTH = f"{TRUTH}, detected AS ({DETECTED_SQL.format(truth='truth')})"

#: Detections of two detectors over the candidates, a document each.
FOUND_SQL = """
SELECT cand_id AS doc_id, entity_type, t AS text, t, d, start_char, start_char + length(t) AS end_char,
  CAST(60 + cand_id % 36 AS INT) AS points, 'pattern' AS source FROM {candidates} WHERE cand_id % 3 <> 1 AND t <> ''
UNION ALL
SELECT cand_id, entity_type, upper(t), t, d, start_char + cand_id % 5, start_char + length(t) + cand_id % 5,
  CAST(50 + cand_id % 41 AS INT), 'ner' FROM {candidates} WHERE cand_id % 3 <> 2 AND t <> ''
"""
TYPES = list(TEMPLATES)
CANDIDATES = f"candidates AS ({candidates_sql(TYPES)})"
FOUND = f"{CANDIDATES}, found AS ({FOUND_SQL.format(candidates='candidates')})"


def verdicts_sql(source: str) -> str:
    """DuckDB: source's rows with is_valid, adjustment and reasons of their type's ladder."""
    q = DuckSQL()
    parts = []
    for name in TYPES:
        sql = ladder_sql(LADDERS[name](q)) if name in LADDERS else {"is_valid": "true", "points": "0::bigint", "reasons": "''"}
        parts.append(
            f"SELECT *, {sql['is_valid']} AS is_valid, {sql['points']} AS adjustment, {sql['reasons']} AS reasons FROM {source} WHERE entity_type = '{name}' AND t <> ''"
        )
    parts.append(f"SELECT *, false, 0::bigint, 'empty' FROM {source} WHERE t = ''")
    return " UNION ALL ".join(parts)


#: found, validated: original_points, points and reasons of the valid rows.
VALIDATED = f"""{FOUND}, judged AS ({verdicts_sql('found')}), analysed AS (
  SELECT * REPLACE ((points + adjustment)::bigint AS points), points AS original_points FROM judged WHERE is_valid)"""


def spans(spark: SparkSession, sf_dir: str, patterns: list[Pattern] | None = None) -> DataFrame:
    return find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), patterns or PATTERNS)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRUTH_SQL, spans=spans(spark, sf_dir))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DETECTED_SQL, truth=truth(spark, sf_dir))


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """truth() and detected(), from one pass over the documents."""
    rows = stored(truth(spark, sf_dir), "truth")
    return rows, stored(spark.sql(DETECTED_SQL, truth=rows), "detected")


def candidates(spark: SparkSession, sf_dir: str, types: list[str] | None = None) -> DataFrame:
    # The templates' own braces stand inside string literals.
    sql = candidates_sql(types or TYPES, "@", duck=False).replace("{k}", "{{k}}").replace("FROM @", "FROM {customer}")
    return spark.sql(sql, customer=spread(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"))


#: Keys that one task turns into candidates, of all types.
KEYS = 5_000


#: Documents of which one task reads each character in Python.
TEXTS = 1_000


def spread(keys: DataFrame, by: str, each: int = KEYS) -> DataFrame:
    """keys over as many tasks as their number asks for: a narrow column of one file is one task's, whatever each key costs."""
    tasks = -(-keys.count() // each)
    return keys.repartition(tasks, by) if tasks > 1 else keys


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(FOUND_SQL, candidates=candidates(spark, sf_dir))
