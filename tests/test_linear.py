"""Dense and long texts: time grows with the text, and results stay right."""

import re
import time

from sablespan.operators import redact
from sablespan.operators.extract import PATTERNS, Pattern, find_spans


def test_many_matches_in_one_text(spark):
    text = " ".join(f"é{i}@b.example" for i in range(100_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.perf_counter()
    got = find_spans(docs, [PATTERNS[0]]).select("ordinal", "start_char", "end_char").orderBy("ordinal").collect()
    assert time.perf_counter() - began < 60
    want = [(n + 1, *m.span()) for n, m in enumerate(re.finditer(PATTERNS[0].regex, text))]
    assert [tuple(r) for r in got] == want and len(want) == 100_000


def test_many_runs_are_masked(spark):
    text = "abcde" * 50_000
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    spans = find_spans(docs, [Pattern("X", "x", "bc", 50)])
    out = {r["doc_id"]: r["redacted"] for r in redact.redact(docs, spans).collect()}
    assert out == {1: "a██de" * 50_000, 2: ""}


def test_runs_across_blocks(spark):
    n = redact.BLOCK
    text = "".join(chr(97 + i % 26) for i in range(2 * n + 5))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = spark.createDataFrame([(1, n - 2, n + 3), (1, 2 * n - 1, 2 * n), (1, 2 * n + 4, 2 * n + 5)], "doc_id long, start_char int, end_char int")
    masked = redact.redact(docs, spans).first()["redacted"]
    assert masked == text[: n - 2] + "█" * 5 + text[n + 3 : 2 * n - 1] + "█" + text[2 * n : 2 * n + 4] + "█"
    marked = redact.redact(docs, spans, highlight=True).first()["redacted"]
    assert marked.replace("[[", "").replace("]]", "") == text and marked.count("[[") == marked.count("]]") == 3
    assert f"[[{text[n - 2 : n + 3]}]]" in marked


def test_many_words_in_one_line(spark):
    text = " ".join(f"w{i}" for i in range(100_000)) + "\nend"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = redact.words(docs).orderBy("word_no").collect()
    assert len(got) == 100_001 and got[-1]["x0"] == 0 and got[-1]["line"] == 1
    row = text.split("\n")[0]
    assert all(row[r["x0"] : r["x1"]] == r["text"] for r in got[:-1])
