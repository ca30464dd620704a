"""Validators, extraction, redaction, sources and streams on small rows."""

import json
import re

import pytest
from pyspark.sql import functions as F

from sablespan.functions.validators import LADDERS, verdict
from sablespan.operators import matching, redact
from sablespan.operators.ensemble import without_kept
from sablespan.operators.extract import CUSTOM, PATTERNS, GazetteerDetector, find_spans

CASES = [
    ("EDUCATIONAL_INSTITUTION", "Riverside University", "", True, 20),
    ("EDUCATIONAL_INSTITUTION", "riverside", "", False, None),
    ("EDUCATIONAL_INSTITUTION", "UCLA", "", True, 40),
    ("EDUCATIONAL_INSTITUTION", "École Normale", "", True, 20),
    ("PERSON", "Maria Lind", "", True, 10),
    ("PERSON", "lind", "", False, None),
    ("PERSON", "LIND", "", False, None),
    ("PERSON", "Prof. EVA LIND", "", True, 20),
    ("LOCATION", "Austin, TX", "", True, 20),
    ("LOCATION", "austin", "", False, None),
    ("LOCATION", "Køge", "", True, 10),
    ("ADDRESS", "12 Oak Lane, Unit 3", "", True, 30),
    ("ADDRESS", "oak lane", "", False, None),
    ("EMAIL_ADDRESS", "a.b@college.edu", "", True, 100),
    ("EMAIL_ADDRESS", "a.@example.com", "", False, None),
    ("PHONE_NUMBER", "+44 20 7946 0958", "", True, 30),
    ("PHONE_NUMBER", "555-123-45678", "", False, None),
    ("GPA", "GPA: 3.9/4.0", "", True, 40),
    ("GPA", "GPA: 3.912", "", False, None),
    ("INTERNET_REFERENCE", "github.com/someone", "", True, 90),
    ("INTERNET_REFERENCE", "some@text", "", False, None),
    ("PROTECTED_CLASS", "Hindu Students", "Member of Hindu Students", True, 20),
    ("PROTECTED_CLASS", "Hispanic", "market", False, None),
    ("PHI", "asthma", "has asthma", True, 20),
    ("PHI", "health", "health food", False, None),
    ("DATE_TIME", "May 2022", "", True, 90),
    ("DATE_TIME", "MA 2022", "", False, None),
]


def test_validators(spark):
    for kind in LADDERS:
        own = [c for c in CASES if c[0] == kind]
        if not own:
            continue
        rows = spark.createDataFrame([(i, c[1], c[2], "pattern", max(c[2].find(c[1]), 0)) for i, c in enumerate(own)], "i int, t string, d string, source string, start_char int")
        for r in rows.select("i", verdict(kind).alias("v")).collect():
            _, text, _, valid, least = own[r["i"]]
            assert r["v"]["is_valid"] == valid, text
            assert least is None or r["v"]["points"] >= least, text


def test_spans_equal_finditer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {(r["doc_id"], r["pattern"], r["start_char"], r["end_char"], r["text"]) for r in find_spans(docs, PATTERNS).collect()}
    want = {(i, p.name, *m.span(), m[0]) for i, t in texts.items() for p in PATTERNS for m in re.finditer(p.regex, t)}
    assert got == want and got


def test_custom_patterns(spark):
    docs = spark.createDataFrame([(1, "Has Type 1 diabetes, on medical leave; LGBTQIA group, Women's Network")], "doc_id long, text string")
    assert {r["text"] for r in find_spans(docs, CUSTOM).collect()} == {"Type 1 diabetes", "medical leave", "LGBTQIA", "Women's Network"}


def test_gazetteer(spark):
    docs = spark.createDataFrame([(1, "Ann and Annika met Ann Lee")], "doc_id long, text string")
    found = GazetteerDetector("PERSON", ("Ann", "Ann Lee")).detect(docs).collect()
    assert [(r["text"], r["start_char"], r["source"]) for r in found] == [("Ann", 0, "ner"), ("Ann Lee", 19, "ner")]


def test_redaction_keeps_length_and_unites_spans(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, "xyz"), (3, None)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 1, 4), (1, 3, 6), (1, 8, 9)], "doc_id long, start_char int, end_char int")
    out = {r["doc_id"]: (r["redacted"], r["masked_chars"]) for r in redact.redact(docs, spans).collect()}
    assert out == {1: ("a█████gh█j", 6), 2: ("xyz", 0), 3: (None, 0)}


def test_matching_is_one_to_one(spark):
    truth = spark.createDataFrame([(1, "g1", "A", "abcd", 0, 4)], "doc_id long, gt_id string, entity_type string, text string, start_char int, end_char int")
    det = spark.createDataFrame(
        [(1, "d1", "A", "abcd", 0, 4, 80, "p"), (1, "d2", "A", "abcd", 0, 4, 70, "p"), (1, "d3", "A", "bcd", 1, 4, 60, "p")],
        "doc_id long, det_id string, entity_type string, text string, start_char int, end_char int, points int, source string",
    )
    assert [r["det_det_id"] for r in matching.match_pairs(truth, det).collect()] == ["d1"]
    counts = matching.outcomes(truth, det).groupBy("outcome").count().collect()
    assert {r["outcome"]: r["count"] for r in counts} == {"tp": 1, "fp": 2}


def test_long_spans_meet_once(spark):
    n = 3 * matching.BLOCK
    truth = spark.createDataFrame([(1, "g", "A", "x", 10, n)], "doc_id long, gt_id string, entity_type string, text string, start_char int, end_char int")
    det = spark.createDataFrame([(1, "d", "A", "x", 0, n + 5, 1, "p")], "doc_id long, det_id string, entity_type string, text string, start_char int, end_char int, points int, source string")
    assert matching.overlaps(truth, det).count() == 1


def test_keep_words(spark):
    rows = spark.createDataFrame([("python",), ("Senior Data Manager",), ("Anna Berg",)], "text string")
    assert [r["text"] for r in without_kept(rows, ["Python", "Senior Manager"]).collect()] == ["Anna Berg"]
    assert without_kept(rows, ["Python"], always=["python"]).count() == 3


def test_relocation(spark):
    docs = spark.createDataFrame([(1, "one two  three four five")], "doc_id long, text string")
    ann = spark.createDataFrame([(1, "a", "two"), (1, "b", "two three"), (1, "c", "one two three four zz"), (1, "d", "nowhere")], "doc_id long, gt_id string, text string")
    assert {r["gt_id"]: (r["how"], r["place"]) for r in redact.relocated(ann, docs).collect()} == {
        "a": ("exact", 4),
        "b": ("spaces", 4),
        "c": ("prefix", 0),
        "d": ("missing", -1),
    }


def test_annotation_files(spark, tmp_path):
    from sablespan.sources import annotations as S

    entity = {"text": "Ann", "type": "PERSON", "should_redact": True, "location": {"page": 1, "start_char": 0, "end_char": 3}, "sensitivity": "high", "instance": 1}
    broken = {"text": "Bo", "type": "PERSON"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"document": {"file_name": "a.pdf"}, "entities": [entity, broken]}, indent=1))
    path = str(tmp_path / "in")
    assert [r["text"] for r in S.read_annotations(spark, path).collect()] == ["Ann"]
    assert [r["text"] for r in S.quarantined(spark, path).collect()] == ["Bo"]
    loose = S.read_annotations(spark, path, strict=False).filter("text = 'Bo'").first()
    assert (loose["start_char"], loose["end_char"], loose["sensitivity"]) == (0, 2, "low")
    S.write_annotations(S.read_annotations(spark, path), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_cases_and_manifest(spark, tmp_path):
    from sablespan.sources import annotations as S

    (tmp_path / "c.json").write_text(json.dumps({"x_tests": [{"text": "a", "expected_valid": True}, {"text": "b", "expected_valid": False}]}))
    assert S.read_cases(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"test_cases": [{"id": "1", "original_file": "a.pdf", "annotation_file": "a.json"}]}))
    assert S.read_manifest(spark, str(tmp_path / "m.json")).first()["id"] == "1"


def test_pdf_files(spark, tmp_path):
    from sablespan.sources import files as S

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"no")
    pdfs = S.valid_pdfs(spark, str(tmp_path))
    assert pdfs.count() == 1 and S.catalogue(spark, str(tmp_path), "*.pdf").count() == 2
    pages = S.extracted_text(pdfs, lambda b: b[8:].decode().split("\f"))
    assert S.assembled(pages).first()["text"] == " one\ntwo\n"
    assert S.assembled(pages, newline=False).first()["text"] == " onetwo"


def test_runs_round_trip(spark, tmp_path):
    from sablespan.operators.runs import compared
    from sablespan.sources import files as S

    rows = [("r1", "t", "s", "k", "f1", 0.5), ("r2", "t", "s", "k", "f1", 0.75)]
    metrics = spark.createDataFrame(rows, "run_id string, test_id string, scope string, key string, metric string, value double")
    S.write_run(metrics, str(tmp_path / "runs"))
    got = compared(S.read_runs(spark, str(tmp_path / "runs"), "r1", "r2"), "r1", "r2").first()
    assert (got["difference"], got["ratio"]) == (0.25, 1.5)
    S.write_results(metrics, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).count() == 2


def test_config(tmp_path):
    from sablespan.sources.config import Config

    (tmp_path / "main.json").write_text('{"a": {"b": 1}}')
    config = Config("/nowhere", str(tmp_path))
    assert config.get("main", "a.b") == 1 and config.get("main", "a.c", 5) == 5 and config.missing("main", ["a.b", "z"]) == ["z"]
    with pytest.raises(FileNotFoundError):
        config.load("other")


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from sablespan.streaming import detect as S

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "docs"))
    stream = S.span_stream(S.document_stream(spark, str(tmp_path / "docs"), 1).select("doc_id", "text"), PATTERNS)
    S.to_table(stream, "streamed_spans", str(tmp_path / "cp")).awaitTermination()
    got, want = spark.table("streamed_spans"), find_spans(docs.select("doc_id", "text"), PATTERNS)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_event_windows_stream(spark, sf_dir, tmp_path):
    from sablespan.streaming import detect as S

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev"))
    S.to_table(S.event_windows(stream), "streamed_hours", str(tmp_path / "cp"), "complete").awaitTermination()
    assert spark.table("streamed_hours").exceptAll(S.event_windows(events)).count() == 0


def test_pushdown_reads_two_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = find_spans(docs, PATTERNS).filter(F.col("doc_id") > 5)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "GreaterThan(doc_id,5)" in plan
