"""Files, configuration, recognizers and commands."""

import json

import pytest
from pyspark.sql import functions as F

from sablespan.operators import ensemble, matching
from sablespan.operators.extract import RECOGNIZERS, Pattern, Registry, find_spans, typed

#: What recognizers must find, and look-alikes that they must leave.
FOUND = [
    ("GPA", "Final GPA: 3.85 overall", ["GPA: 3.85"]),
    ("GPA", "Average 3.6/4.0 in 2019", ["3.6/4.0"]),
    ("GPA", "about 3.85 metres", []),
    ("INTERNET_REFERENCE", "see https://example.org/a-b and linkedin.com/in/ab, @anna_b", ["https://example.org/a-b", "linkedin.com/in/ab", "@anna_b"]),
    ("INTERNET_REFERENCE", "mail a@b.org at 5", []),
    ("PHONE_NUMBER", "call (212) 555-0147 or 555-201-7788", ["(212) 555-0147", "555-201-7788"]),
    ("PHONE_NUMBER", "order 555-20-7788", []),
    ("ADDRESS", "Lives at 12 West Oak Street, Apt 4.", ["12 West Oak Street", "Apt 4"]),
    ("ADDRESS", "12 oaks and a stone", []),
    ("OTHER_ID", "SSN 219-09-9999, passport number X1234567", ["219-09-9999", "passport number X1234567"]),
    ("EDUCATIONAL_INSTITUTION", "from Riverside University and MIT in May", ["Riverside University", "MIT"]),
    ("EDUCATIONAL_INSTITUTION", "the summit of learning", []),
    ("PHI", "Diagnosed with asthma, 70% disabled", ["Diagnosed with asthma", "asthma", "70% disabled"]),
    ("PROTECTED_CLASS", "Pronouns: she/her; Women in Physics, Hindu Students", ["Pronouns: she/her", "Women in Physics", "Hindu Students"]),
    ("PROTECTED_CLASS", "women walked home", []),
    ("LOCATION", "from Austin, TX 73301 to Reno, Nevada", ["Austin, TX 73301", "Reno, Nevada"]),
]


def test_recognizers(spark):
    for kind in RECOGNIZERS:
        own = [(i, c[1]) for i, c in enumerate(FOUND) if c[0] == kind]
        got = find_spans(spark.createDataFrame(own, "doc_id long, text string"), Registry().patterns(kind)).collect()
        for i, text in own:
            assert sorted(r["text"] for r in got if r["doc_id"] == i) == sorted(FOUND[i][2]), text


def test_registry(spark):
    own = Registry({}).add(Pattern("X", "x", "x+", 50)).replace("Y", [Pattern("Y", "y", "y", 60)])
    assert [p.name for p in own.patterns()] == ["x", "y"] and own.patterns("Z") == []
    rows = spark.createDataFrame([(1, "org"), (2, "GPE"), (3, "Date")], "doc_id long, label string")
    assert {r["doc_id"]: r["entity_type"] for r in typed(rows).collect()} == {1: "EDUCATIONAL_INSTITUTION", 3: "DATE_TIME"}


def test_full_detection_branches(spark):
    rows = [
        (1, "PROTECTED_CLASS", "chess club", 0, 10, 70, "ner"),  # passes although its validator rejects it
        (1, "PROTECTED_CLASS", "chess club", 0, 10, 100, "pattern"),  # no solo row beside ner rows
        (2, "PHI", "asthma", 4, 10, 70, "ner"),  # valid, and a solo row
        (3, "PHI", "health", 0, 6, 95, "ner"),  # reaches the bar, but isn't valid
        (4, "EMAIL_ADDRESS", "a.b@college.edu", 0, 15, 85, "pattern"),
        (4, "DATE_TIME", "2018", 20, 24, 85, "pattern"),  # routed to the ensemble: alone it goes
    ]
    schema = "doc_id long, entity_type string, text string, start_char int, end_char int, points int, source string"
    found = spark.createDataFrame(rows, schema).withColumn("t", F.col("text")).withColumn("d", F.col("text"))
    got = {(r["doc_id"], r["entity_type"], r["points"], r["source"]) for r in ensemble.detect_full(found).collect()}
    mail = {r for r in got if r[1] == "EMAIL_ADDRESS"}
    assert len(mail) == 1 and got - mail == {(1, "PROTECTED_CLASS", 70, "ensemble"), (2, "PHI", 110, "ner"), (2, "PHI", 106, "ensemble")}


def test_greedy_matching_takes_what_is_left(spark):
    truth = [(1, f"g{i}", "A", "abcd", 0, 4) for i in range(3)] + [(2, "a", "A", "0123456789", 0, 10), (2, "b", "A", "5678901234", 5, 15)]
    det = [(1, f"d{i}", "A", "abcd", 0, 4, 80, "p") for i in range(4)] + [(2, "x", "A", "123456789", 1, 10, 70, "p"), (2, "y", "A", "0123456789", 0, 10, 70, "p")]
    t = spark.createDataFrame(truth, "doc_id long, gt_id string, entity_type string, text string, start_char int, end_char int")
    d = spark.createDataFrame(det, "doc_id long, det_id string, entity_type string, text string, start_char int, end_char int, points int, source string")
    got = sorted((r["gt_gt_id"], r["det_det_id"]) for r in matching.match_pairs(t, d).collect())
    assert got == [("a", "y"), ("b", "x"), ("g0", "d0"), ("g1", "d1"), ("g2", "d2")]


def test_outcomes_read_documents_once(spark, sf_dir):
    from sablespan.plans import base, queries  # noqa: F401

    for name in ("prf_by_type", "batch_rollup"):
        plan = base.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("documents.parquet") <= 2 and "regexp_extract_all" not in plan, name


def test_yaml(tmp_path):
    from sablespan.sources import yaml
    from sablespan.sources.config import Config

    text = """
# settings
app:
  name: "A: b"   # a comment
  sizes: [1, 2.5, 'x, y']
  on: true
  none: ~
rules:
- type: PHI
  words: {low: 1, high: two}
- type: GPA
  list:
    - a
    - b # c
path_file: /no/such/file
"""
    tree = yaml.load(text)
    assert tree["rules"] == [{"type": "PHI", "words": {"low": 1, "high": "two"}}, {"type": "GPA", "list": ["a", "b"]}]
    assert tree["app"]["name"] == "A: b" and tree["app"]["sizes"] == [1, 2.5, "x, y"] and tree["app"]["none"] is None
    (tmp_path / "main.yaml").write_text(text)
    config = Config(str(tmp_path))
    assert config.get("main", "app.name") == "A: b"
    report = config.report({"main": ["app.name", "app.size"], "other": []})
    assert any("is it app.sizes?" in r for r in report) and any("/no/such/file" in r for r in report) and any("other" in r for r in report)


def test_yaml_annotations_and_strict_failure(spark, tmp_path):
    from sablespan.sources import annotations as S

    (tmp_path / "a.yaml").write_text(
        "document:\n  file_name: a.pdf\nentities:\n  - text: Ann\n    type: PERSON\n    should_redact: true\n    location: {page: 1, start_char: 0, end_char: 3}\n    sensitivity: high\n"
    )
    assert [(r["text"], r["end_char"]) for r in S.read_annotations(spark, str(tmp_path), fail=True).collect()] == [("Ann", 3)]
    (tmp_path / "b.json").write_text(json.dumps({"document": {"file_name": "b.pdf"}, "entities": [{"text": "Bo", "type": "PERSON"}]}))
    assert S.quarantined(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="incomplete annotation in b.pdf"):
        S.read_annotations(spark, str(tmp_path), fail=True).collect()


def test_pdf_round_trip(spark, tmp_path):
    import zlib

    from sablespan.sources import files, pdf

    docs = spark.createDataFrame([(1, "first (line)\nsecond ███ line\n" + "\n" * 58 + "next page")], "doc_id long, redacted string")
    made = bytes(files.as_pdf(docs).first()["content"])
    (tmp_path / "a.pdf").write_bytes(made)
    pages = files.extracted_text(files.valid_pdfs(spark, str(tmp_path))).orderBy("page").collect()
    assert pages[0]["text"].split("\n")[:2] == ["first (line)", "second     line"] and "next page" in pages[1]["text"]
    assert b"re f" in made
    packed = zlib.compress(b"BT (deflated) Tj 0 -12 Td [(te) -20 (xt)] TJ ET")
    body = b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< /Filter /FlateDecode /Length 9 >>\nstream\n" + packed + b"\nendstream\nendobj\n"
    assert pdf.pages(body) == ["deflated\ntext"]


def test_commands(spark, sf_dir, tmp_path):
    from sablespan import cli

    docs = f"{sf_dir}/documents.parquet"
    found = cli.main(["detect", "--docs", docs, "--type", "EMAIL_ADDRESS", "--quiet"], spark)
    assert found.count() > 0 and {r[0] for r in found.select("entity_type").distinct().collect()} == {"EMAIL_ADDRESS"}
    for report in cli.REPORTS:
        assert cli.main(["analyze", "--docs", docs, "--pattern", report, "--quiet"], spark).count() >= 0
    truth = found.select("doc_id", F.monotonically_increasing_id().cast("string").alias("gt_id"), "entity_type", "text", "start_char", "end_char")
    truth.write.parquet(str(tmp_path / "truth"))
    for run in ("a", "b"):
        rows = cli.main(["batch", "--docs", docs, "--truth", str(tmp_path / "truth"), "--runs", str(tmp_path / "runs"), "--run-id", run, "--quiet"], spark)
    recall = rows.filter("scope = 'type' AND key = 'EMAIL_ADDRESS' AND metric = 'recall'").first()["value"]
    assert recall == 1.0
    same = cli.main(["compare", "--runs", str(tmp_path / "runs"), "--run-id", "a", "--compare-with", "b", "--quiet"], spark)
    assert same.count() == rows.count() and same.filter("difference <> 0").count() == 0
