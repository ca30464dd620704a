"""Further queries: variants of extraction, reports, and the redaction of whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sablespan.operators import ensemble as E
from sablespan.operators import matching as M
from sablespan.operators import redact as D
from sablespan.operators import reports as P
from sablespan.operators.extract import DATES, PATTERNS, Pattern, find_spans
from sablespan.plans import base as B
from sablespan.plans import queries as Z
from sablespan.plans.base import query, table

LOOSE_EMAIL = Pattern("EMAIL_ADDRESS", "loose", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", 85)
SHARED = ["doc_id", "pattern", "ordinal", "text", "start_char", "end_char"]


@query(
    f"""SELECT doc_id, ordinal, text, start_char FROM ({B.spans_sql([LOOSE_EMAIL])})
    WHERE contains(string_split(text, '@')[-1], '.') AND right(text, 1) <> '.'"""
)
def email_checked_spans(spark, sf_dir):
    """Loose addresses whose domain has a dot and doesn't end in one."""
    rows = B.spans(spark, sf_dir, [LOOSE_EMAIL])
    fine = F.contains(F.substring_index("text", "@", -1), F.lit(".")) & ~F.endswith("text", F.lit("."))
    return rows.filter(fine).select("doc_id", "ordinal", "text", "start_char")


@query(f"WITH {B.CANDIDATES} SELECT cand_id, pattern, ordinal, text, start_char FROM ({B.spans_sql(DATES, 'candidates', 'cand_id', 'd')})")
def date_spans(spark, sf_dir):
    docs = B.candidates(spark, sf_dir).select("cand_id", "d")
    return find_spans(docs, DATES, text="d", key="cand_id").select("cand_id", "pattern", "ordinal", "text", "start_char")


@query(f"{Z.LAID} SELECT doc_id, word_no, text FROM words WHERE regexp_matches(text, '^[A-Z][a-z]{{5,}}$')")
def word_detections(spark, sf_dir):
    """Words that look like names, by their shape alone."""
    return Z.laid_words(spark, sf_dir).filter(F.col("text").rlike("^[A-Z][a-z]{5,}$")).select("doc_id", "word_no", "text")


@query(
    f"""WITH {B.BOTH} SELECT doc_id, det_id, '{{"entity_type":"' || entity_type || '","start_char":' || start_char || ',"points":' || points || '}}' AS json FROM detected"""
)
def entity_json(spark, sf_dir):
    rows = B.detected(spark, sf_dir).select(F.struct("doc_id", "det_id").alias("key"), "entity_type", "start_char", "points")
    return P.as_json(rows, "key").select("key.*", "json")


@query(f"WITH {B.BOTH} SELECT doc_id, text, det_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY start_char DESC, det_id DESC) AS n FROM detected) x WHERE n = 1")
def last_by_text(spark, sf_dir):
    return P.last_by_text(B.detected(spark, sf_dir), ["start_char", "det_id"]).select("doc_id", "text", "det_id")


@query(f"WITH {B.BOTH} SELECT doc_id, text, det_id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY start_char, det_id) AS n FROM detected) x WHERE n = 1")
def first_by_text(spark, sf_dir):
    return P.first_by_text(B.detected(spark, sf_dir), ["start_char", "det_id"]).select("doc_id", "text", "det_id")


def _percent_sql(column: str) -> str:
    h = f"floor({column} * 10000 + 0.5)::bigint"
    return f"({h} // 100) || '.' || lpad(({h} % 100)::varchar, 2, '0') || '%'"


@query(
    f"""WITH RECURSIVE {Z.OUTCOMES}, c AS (SELECT entity_type, {Z.COUNTS} FROM outcomes GROUP BY entity_type), r AS (SELECT *, {Z.RATES} FROM c)
    SELECT entity_type, 'P: ' || {_percent_sql('precision')} || ', R: ' || {_percent_sql('recall')} || ', F1: ' || {_percent_sql('f1')} AS report FROM r"""
)
def metrics_report(spark, sf_dir):
    rates = M.rates(Z._outcomes(spark, sf_dir).groupBy("entity_type").agg(*M.counted()))
    return P.metrics_report(rates, "entity_type")


@query(f"SELECT how, count(*) AS n, count(*) FILTER (place < 0) AS needs_review FROM ({B.ORACLE['relocate_text']}) GROUP BY how")
def correction_counts(spark, sf_dir):
    return P.correction_counts(B.QUERIES["relocate_text"](spark, sf_dir))


@query(f"SELECT doc_id, ordinal, start_char, end_char FROM ({B.spans_sql([Pattern('LITERAL', 'literal', 'License', 100)])})")
def literal_occurrences(spark, sf_dir):
    return P.occurrences(table(spark, sf_dir, "documents").select("doc_id", "text"), "License")


@query(
    f"""WITH {B.FOUND} SELECT doc_id, source, CASE source WHEN 'pattern' THEN 'digits:' || length(regexp_replace(text, '[^0-9]', '', 'g')) WHEN 'ner' THEN 'chars:' || length(text) END AS analysis FROM found"""
)
def source_analysis(spark, sf_dir):
    return P.source_analysis(B.found(spark, sf_dir)).select("doc_id", "source", "analysis")


@query(f"WITH {B.BOTH} SELECT entity_type, count(*) FILTER (side = 't') AS truth, count(*) FILTER (side = 'pattern') AS pattern, count(*) FILTER (side = 'ner') AS ner FROM (SELECT entity_type, 't' AS side FROM truth UNION ALL SELECT entity_type, source FROM detected) u GROUP BY entity_type")
def source_counts(spark, sf_dir):
    sides = B.truth(spark, sf_dir).select("entity_type", F.lit("truth").alias("side"))
    rows = sides.unionByName(B.detected(spark, sf_dir).select("entity_type", F.col("source").alias("side")))
    return rows.groupBy("entity_type").pivot("side", ["truth", "pattern", "ner"]).agg(F.count(F.lit(1))).na.fill(0)


@query(
    """WITH p AS (SELECT page_id, url, regexp_extract(url, '([^/]+?)(?:\\.[^./]*)?$', 1) AS stem FROM pages), d AS (SELECT doc_id, doc_id::varchar AS stem FROM documents)
    SELECT page_id, doc_id FROM p LEFT JOIN d USING (stem)"""
)
def stem_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("in/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"))
    return P.by_stem(pages, docs, "url", "path").select("page_id", "doc_id")


@query(
    f"""WITH {B.SPANS.replace('spans AS', 'every AS', 1)}, {Z.KEEP}, f AS (SELECT *, {Z.FORM} AS form FROM every),
    spans AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM tokens WHERE word = form OR (len(k) > 1 AND list_has_all(string_split(form, ' '), k))
      OR (len(list_distinct(string_split(form, ' '))) = 1 AND list_contains(k, string_split(form, ' ')[1])))), {Z.MERGED}
    SELECT doc_id, count(*) AS runs, sum(b - a)::bigint AS masked FROM runs GROUP BY doc_id"""
)
def redaction_runs(spark, sf_dir):
    """What a document's redaction covers, keep words left out."""
    runs = D.merged(E.without_kept(B.spans(spark, sf_dir, PATTERNS)))
    return runs.groupBy("doc_id").agg(F.count("*").alias("runs"), F.sum(F.col("end_char") - F.col("start_char")).cast("bigint").alias("masked"))


@query("SELECT page_id, string_split(url, '/')[3] AS host, regexp_matches(url, '^https?://[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}') AS valid FROM pages")
def page_hosts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.element_at(F.split(url, "/"), 3).alias("host"), url.rlike(r"^https?://[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}").alias("valid")
    )
