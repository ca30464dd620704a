"""Many patterns over batches of texts: the same spans as DuckDB's, with their contexts, from one pass over the texts."""

import duckdb
import pytest

from sablespan.operators import spans as S
from sablespan.operators.extract import CUSTOM, Pattern, Registry, find_spans
from sablespan.plans import base, wider
from sablespan.plans.base import spans_sql

ALL = [*Registry().patterns(), *CUSTOM, wider.NAMES.pattern()]
MARKS = "\ue000\ue001\U00010000"
TEXTS = [
    None,
    "",
    "plain words of no kind",
    f"{MARKS} 12 Green street, {MARKS} 50% disabled {MARKS}",
    "😀😀 GPA: 3.5 é (she/her) 😀 call (212) 555-0123 or 212-555-0123é, Anna Berg",
    "é@someone @some_oneß @someone, 130 die stü und 208 er st.",
    "x" * 60 + " Carl B. Lind " + "y" * 60 + " taKing aspirin",
    "K at MIT, Lakeside College of Fine Arts\x00\n\\1 Oslo, NY 12345",
    "9 Long street, " * 400,
]


def by_duck(patterns):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(TEXTS)))
    sql = f"""SELECT doc_id, entity_type, pattern, ordinal, s.text, start_char, end_char, points,
      substring(d.text, greatest(start_char - 50, 0) + 1, end_char + 50 - greatest(start_char - 50, 0)) FROM ({spans_sql(patterns)}) s JOIN documents d USING (doc_id)"""
    return sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("many", [1, 1000])
def test_spans_and_contexts_equal_sql(spark, many):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    got = sorted(tuple(r) for r in find_spans(docs, ALL, many=many, around=50).collect())
    want = by_duck(ALL)
    assert len({r[2] for r in want}) > 10 and len(want) > 400
    assert got == want


def test_texts_of_any_size(monkeypatch):
    """Parts of a batch, and texts longer than one, give what the whole batch gives."""
    import pyarrow as pa

    texts, expressions = pa.array(TEXTS), [p.regex for p in ALL]
    whole = S.spans_of(texts, expressions, 50).to_pylist()
    monkeypatch.setattr(S, "SLICE", 40)
    parts = list(S._parts(texts))
    assert len(parts) > 4 and pa.concat_arrays(parts).equals(texts)
    assert [row for part in parts for row in S.spans_of(part, expressions, 50).to_pylist()] == whole


def test_expressions_beyond_re2(spark):
    docs = spark.createDataFrame([(1, "GPA: 3.5, xy and zy, 50% disabled"), (2, "zy"), (3, None)], "doc_id bigint, text string")
    patterns = [*ALL, Pattern("X", "behind", "(?<=x)y", 50)]
    assert not S.readable("(?<=x)y") and all(S.readable(p.regex) for p in ALL)
    few, lots = (sorted(tuple(r) for r in find_spans(docs, patterns, many=n).collect()) for n in (1000, 1))
    assert few == lots and [r[:7] for r in few if r[2] == "behind"] == [(1, "X", "behind", 1, "y", 11, 12)]


def test_detection_reads_the_texts_once(spark, sf_dir, monkeypatch):
    """Spans and contexts come from one pass; no text is exchanged for the sake of its spans."""
    plans = []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return base.stored(df, label)

    monkeypatch.setattr(wider, "stored", kept)
    found = wider._document_found(spark, sf_dir)
    assert len(plans) == 1 and "Join" not in plans[0] and plans[0].count("ArrowEvalPython") == 1
    assert {r[0] for r in found.select("source").distinct().collect()} == {"pattern", "ner"}
