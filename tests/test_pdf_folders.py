"""Folders of many PDF files: what the driver keeps of them, how tasks share them, and pages of plain text read at once."""

import pickle

import duckdb
import pytest

from sablespan.operators.extract import PATTERNS, find_spans
from sablespan.plans import base
from sablespan.plans import wider as _registered  # noqa: F401
from sablespan.sources import pdf, pdf_source


@pytest.fixture()
def many(tmp_path):
    """2,000 files, most in one folder, beside files that aren't shown."""
    for folder in ("", "a", "a/deep", "b", "_gone", ".gone"):
        (tmp_path / folder).mkdir(exist_ok=True)
    names = [*(f"{i:05}-{'x' * 60}.pdf" for i in range(1_900)), *(f"a/deep/{i}.PDF" for i in range(60)), *(f"b/é{i}.pdf" for i in range(40))]
    content = pdf.document("some words")
    for name in [*names, "_gone/1.pdf", ".gone/1.pdf", "_1.pdf", "b/1.txt"]:
        (tmp_path / name).write_bytes(content)
    return tmp_path, sorted(f"file:{tmp_path}/{n}" for n in names)


def test_driver_keeps_no_name_of_each_file(many):
    folder, paths = many
    for most in ("4000", "20000", "0"):
        groups = pdf_source.PdfReader({"path": str(folder), "rows": "files", "partitionbytes": most}).partitions()
        assert sorted(p for g in groups for p in g.paths()) == paths
        assert [g.number for g in groups] == list(range(len(groups)))
        assert most == "0" or len(groups) > 50
        assert most == "4000" or len(pickle.dumps(groups)) < len(pickle.dumps(paths)) / 2
    assert len(groups) <= 2 and len(pickle.dumps(groups)) < 3_000


def test_commit_holds_no_name_of_each_file(spark, tmp_path):
    """Tasks that write to folders of the same names have them merged; a message names its task's folder alone."""
    assert set(pdf_source.Moved.__dataclass_fields__) == {"folder"}
    for turn in range(2):
        rows = [(f"{i % 3}/in/{turn}-{i}.pdf", pdf.document(f"w{turn}-{i}")) for i in range(24)]
        pdf_source.write_files(spark.createDataFrame(rows, "name string, content binary").repartition(4), str(tmp_path / "out"))
    found = sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*") if p.is_file())
    assert found == sorted(f"{i % 3}/in/{turn}-{i}.pdf" for i in range(24) for turn in range(2))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["0", "1", "2"]


def test_redacted_in_parts(spark, many):
    """A group's files are one task's, so its folders aren't dealt to all; each file is there once."""
    folder, paths = many
    (folder / "b/mail.pdf").write_bytes(pdf.document("to ann@site.org"))
    mails = [p for p in PATTERNS if p.entity_type == "EMAIL_ADDRESS"]
    boxes = pdf_source.redact_files(spark, str(folder), str(folder / "_out"), lambda pages: find_spans(pages, mails, key="place"), parts=True)
    assert boxes.count() == 1
    words = pdf_source.read_words(spark, str(folder / "_out"), columns="file text")
    assert words.columns == ["file", "text"]
    got = [tuple(r) for r in words.collect()]
    want = [(p.rpartition("/")[2], w) for p in paths for w in ("some", "words")] + [("mail.pdf", "to")]
    assert sorted(got) == sorted(want)
    assert all(p.name.startswith("part-") for p in (folder / "_out").iterdir())


def test_simple_pages_equal_the_whole_parser():
    texts = ["plain\n\n  text (with \\ brackets)  \n", "é € “x”", "", " ", "a█b ██", "x" * 3000, "1 0 0 1 re f (\nBT ET\nq Q"]
    for content in [pdf.document(t) for t in texts] + [pdf.without(pdf.document(t), {}) for t in texts]:
        file = pdf.File(content)
        (page,) = file.pages()
        data = file.content(page)
        pieces = pdf.simple_pieces(data, file.fonts(page), *file.size(page))
        assert pieces is not None and pieces == pdf.plain_pieces(list(file.shown(page, data)))


@pytest.mark.parametrize("data", [b"2 Tc BT /F1 10 Tf 1 2 Td (a) Tj ET", b"BT /F1 10 Tf 1 2 Td (a) Tj (b) Tj ET", b"q 2 0 0 2 0 0 cm BT /F1 10 Tf 1 2 Td (a) Tj ET Q", b"BT /F1 -10 Tf 1 2 Td (a) Tj ET", b"BT /F1 10 Tf 1 2 Td [(a)] TJ ET"])
def test_other_pages_are_left_to_the_whole_parser(data):
    assert pdf.simple_pieces(data, {}, 0.0, 800.0) is None


@pytest.mark.parametrize("name", ["pdf_words", "pdf_occurrences", "pdf_redacted"])
def test_numbers_of_any_sign(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (-7::BIGINT, 'mail ann@site.org or bo@site.org' || chr(10) || ' é € end'), (9007199254740993, 'x a@b'), (0, ''), (12, 'see /Encrypt 1 0 R there endobj')) t(doc_id, text)")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    rows = base.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(rows.columns)} FROM ({base.ORACLE[name]})").fetchall()
    assert sorted(map(tuple, rows.collect())) == sorted(want) and any(r[0] == -7 for r in want)


def test_occurrences_ask_for_no_more_than_they_need(spark, many):
    """The columns that are asked for are those made, whatever rows are read."""
    folder, _ = many
    for rows, asked in (("placed", "path page text start_char end_char"), ("pages", "text file"), ("files", "part file")):
        assert pdf_source.read_words(spark, str(folder), rows=rows, columns=asked, partitionBytes=200_000).columns == asked.split()
    placed = pdf_source.read_words(spark, str(folder), rows="placed", columns="file text start_char end_char").filter("file LIKE 'é%'")
    assert {tuple(r)[1:] for r in placed.collect()} == {("some", 0, 4), ("words", 5, 10)} and placed.count() == 80
