"""PDF files: places of words, redaction without a trace, the data source."""

import re
import zlib

import pytest

from sablespan.operators.extract import PATTERNS, find_spans
from sablespan.sources import files, pdf, pdf_source


def made(content: bytes, extra: bytes = b"", font: bytes = b"<< /Type /Font /BaseFont /Courier >>") -> bytes:
    packed = zlib.compress(content)
    return (
        b"%%PDF-1.5\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R /Metadata 9 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 600 800] >>\nendobj\n"
        b"3 0 obj\n<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> /Annots [8 0 R] >>\nendobj\n"
        b"4 0 obj\n<< /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n5 0 obj\n%s\nendobj\n"
        b"8 0 obj\n<< /Type /Annot /Contents (note of a.b@site.org) >>\nendobj\n9 0 obj\n<< /Length 12 >>\nstream\na.b@site.org\nendstream\nendobj\n%s" % (len(packed), packed, font, extra)
    )


def laid(content: bytes) -> dict[str, tuple]:
    file = pdf.File(content)
    return {w.text: w for w in pdf.words(file, file.pages()[0])}


def test_two_columns_and_a_moved_matrix():
    got = laid(made(b"BT /F1 10 Tf 1 0 0 1 50 700 Tm (left one) Tj 0 -12 Td (left two) Tj 1 0 0 1 300 700 Tm [(ri) -500 (ght)] TJ ET q 2 0 0 2 100 50 cm BT /F1 10 Tf 10 20 Td (big) Tj ET Q"))
    assert got["left"] == (2, "left", 50, 104, 74, 114)  # the second of the two
    assert got["one"][2:] == (80, 92, 98, 102) and got["two"][2:] == (80, 104, 98, 114)
    assert got["ri"].line == got["ght"].line == 3 and got["ri"].x0 == 300 and got["ght"].x0 == 317
    assert got["big"][2:] == (120, 694, 156, 714)  # twice the size: 100 + 2 * 10, 800 - (50 + 2 * 20) - 16


def test_rotated_and_spaced_text():
    got = laid(made(b"BT /F1 10 Tf 0 1 -1 0 100 100 Tm (up) Tj ET BT 2 Tc 50 Tz 1 0 0 1 10 10 Tm (ab c) Tj ET"))
    assert got["up"][2:] == (92, 688, 102, 700)
    assert got["ab"][2:] == (10, 782, 17, 792) and got["c"].x0 == 22


def test_widths_and_object_streams():
    inner = [b"<< /Type /Font /BaseFont /Own /FirstChar 97 /Widths 7 0 R >>", b"[1000 200]"]
    heads = b"5 0 7 %d " % (len(inner[0]) + 1)
    packed = zlib.compress(heads + b"\n".join(inner))
    extra = b"6 0 obj\n<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(heads), len(packed), packed)
    got = laid(made(b"BT /F1 10 Tf 10 10 Td (abz) Tj ET", extra))
    assert got["abz"][2:] == (10, 782, 27, 792)  # 10, 2 and 5 for what has no width


def test_nothing_of_the_masked_text_is_left():
    content = made(b"/Span << /ActualText (a.b@site.org) >> BDC BT /F1 10 Tf 12 TL 50 700 Td (mail a.b@site.org now) Tj [(or c.d) 0 (@site.org)] ' ET EMC")
    content += b"4 0 obj\n<< /Length 0 >>\nstream\n\nendstream\nendobj\n" + content[content.index(b"4 0 obj") :]  # an older state, then the last
    file = pdf.File(content)
    boxes = {1: [w[2:] for w in pdf.words(file, 3) if "@" in w.text]}
    new = pdf.without(content, boxes)
    after = pdf.File(new)
    streams = b"".join(after.data(n) for n in after.streams)
    for trace in (b"@", b"site", b"a.b", b"612e62", b"ActualText", b"Annot", b"Metadata"):
        assert trace not in new and trace not in streams, trace
    kept = {w.text: w for w in pdf.words(after, after.pages()[0])}
    old = {w.text: w for w in pdf.words(file, 3)}
    assert set(kept) == {"mail", "now", "or"} and all(kept[k][2:] == old[k][2:] for k in kept)
    assert len(re.findall(rb" re f", streams)) == 2
    whole = pdf.without(content, {})
    assert [w for w in pdf.words(pdf.File(whole), pdf.File(whole).pages()[0])] == pdf.words(file, 3)


def test_refusals():
    with pytest.raises(ValueError, match="encrypted"):
        pdf.File(b"%PDF-1.5\ntrailer << /Encrypt 3 0 R >>")
    form = b"7 0 obj\n<< /Subtype /Form /Length 10 >>\nstream\nBT (x) Tj \nendstream\nendobj\n"
    content = made(b"/X Do", form).replace(b"/Font << /F1 5 0 R >> >>", b"/Font << /F1 5 0 R >> /XObject << /X 7 0 R >> >>")
    with pytest.raises(ValueError, match="form with text"):
        pdf.without(content, {1: [(0, 0, 1, 1)]})


def test_source_reads_groups_and_strictly(spark, tmp_path):
    for i in range(7):
        (tmp_path / f"{i}.pdf").write_bytes(pdf.document(f"word {i}\nsecond line"))
    (tmp_path / "_staging-x").mkdir()
    (tmp_path / "_staging-x/9.pdf").write_bytes(pdf.document("half written"))
    rows = pdf_source.read_words(spark, str(tmp_path), partitionBytes=2000)
    assert rows.rdd.getNumPartitions() > 1 and rows.count() == 28
    assert {r["path"] for r in rows.collect()} == {f"file:{tmp_path}/{i}.pdf" for i in range(7)}
    assert pdf_source.read_words(spark, f"{tmp_path}/3.pdf").count() == 4
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.5\ntrailer << /Encrypt 3 0 R >>")
    assert pdf_source.read_words(spark, str(tmp_path)).count() == 28
    with pytest.raises(Exception, match="broken.pdf"):
        pdf_source.read_words(spark, str(tmp_path), mode="failfast").collect()
    (tmp_path / "none").mkdir()
    assert pdf_source.read_words(spark, f"{tmp_path}/none").count() == 0


def test_redacted_folder(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(pdf.document("Write to ann@site.org today\n" + "\n" * 60 + "or bob@site.org"))
    (tmp_path / "in/deep/a.pdf").write_bytes(pdf.document("nothing here"))
    mails = [p for p in PATTERNS if p.entity_type == "EMAIL_ADDRESS"]
    out = str(tmp_path / "out")
    boxes = pdf_source.redact_files(spark, str(tmp_path / "in"), out, lambda pages: find_spans(pages, mails, key="place"))
    order = pdf_source.reading_order(boxes).orderBy("occurrence").collect()
    assert [(r["page"], r["x0"], r["y0"], r["occurrence"]) for r in order] == [(1, 94, 34, 1), (2, 58, 46, 2)]
    words = pdf_source.read_words(spark, out)
    assert {r["text"] for r in words.collect()} == {"Write", "to", "today", "or", "nothing", "here"}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.pdf", "deep"]


def test_writer_leaves_nothing_of_a_broken_job(spark, tmp_path):
    out = tmp_path / "out"
    bad = spark.createDataFrame([("a.pdf", b"1"), ("../b.pdf", b"2")], "name string, content binary").coalesce(1)
    with pytest.raises(Exception, match="can't be named"):
        pdf_source.write_files(bad, str(out))
    assert not out.exists() or not list(out.iterdir())
    for text in (b"1", b"2"):
        pdf_source.write_files(spark.createDataFrame([("a.pdf", text)], "name string, content binary"), str(out))
    assert (out / "a.pdf").read_bytes() == b"2"
    pdf_source.write_files(spark.createDataFrame([("c.pdf", b"3")], "name string, content binary"), str(out), "overwrite")
    assert [p.name for p in out.iterdir()] == ["c.pdf"]


def test_odd_documents(spark):
    rows = [(1, None), (2, ""), (3, "x " * 40_000), (4, "tabs\tand (brackets\\ and \r ends")]
    got = files.as_pdf(spark.createDataFrame(rows, "doc_id long, redacted string")).collect()
    words = {r["doc_id"]: pdf.pages(bytes(r["content"])) for r in got}
    assert words[1] == words[2] == [""] and words[3][0].count("x") == 40_000 and words[4] == ["tabs\tand (brackets\\ and \r ends"]


def test_plain_pages_equal_glyph_by_glyph():
    """Words that are laid out together against those of each glyph: kerning, own widths, jumps back, a word in two strings."""
    font = b"<< /Type /Font /BaseFont /Own /FirstChar 97 /Widths [1000 200 350] >>"
    plain = [
        b"BT /F1 10 Tf 10 700 Td (ab  cz ) Tj [(x a) -900 (b) -20 ( c)] TJ 0 -12 Td (\x80uro \x81 end) Tj 1 0 0 1 5 500 Tm (up) Tj 1 0 0 1 5 520 Tm (  ) Tj ET",
        b"BT /F1 8 Tf 1 0 0 -1 20 30 Tm 3 Ts (mirrored text) Tj 80 Tz 12 TL (narrow) ' ET",
        b"",
    ]
    other = [b"BT /F1 10 Tf 10 700 Td [(ri) 0 (ght on)] TJ 2 Tc (ab c) Tj ET", b"BT /F1 10 Tf 0 1 -1 0 9 9 Tm (up we go) Tj ET"]
    pieces = []
    for content in plain + other:
        file = pdf.File(made(content, font=font))
        shown = list(file.shown(3, file.content(3)))
        one = pdf.plain_pieces(shown)
        assert (one is None) == (content in other)
        assert [tuple(w) for w in pdf.words(file, 3)] == [tuple(w) for w in pdf.single_words(shown)]
        pieces += [one] if one is not None else []
    assert pdf.lay(pieces).page.tolist() == [0] * 10 + [1] * 3


def test_places_in_page_texts(spark, tmp_path):
    """A span over two lines has a box for each; equal spans count once; files are read by many tasks, also where few bytes are exchanged."""
    for i in range(5):
        (tmp_path / f"{i}.pdf").write_bytes(pdf.document(f"first {i}  word\n\n  second € line" + "\n" * 60 + "next page"))
    turned = made(b"BT /F1 10 Tf 0 1 -1 0 100 100 Tm (up we) Tj ET")
    (tmp_path / "t.pdf").write_bytes(turned)
    placed = pdf_source.read_words(spark, str(tmp_path), rows="placed", partitionBytes=1500)
    texts = {(r["path"], r["page"]): r["text"] for r in pdf_source.read_words(spark, str(tmp_path), rows="pages").collect()}
    assert len(texts) == 11 and set(texts.values()) == {*(f"first {i} word\nsecond € line" for i in range(5)), "next page", "up we"}
    rows = placed.collect()
    assert len(rows) == 5 * 8 + 2 and all(texts[r["path"], r["page"]][r["start_char"] : r["end_char"]] == r["text"] for r in rows)
    spans = placed.filter("text = 'word'").selectExpr("struct(path, page) AS place", "'X' AS entity_type", "start_char", "end_char + 2 AS end_char")
    boxes = pdf_source.span_boxes(spark, str(tmp_path), spans.unionByName(spans))
    got = sorted((r["path"][-5:], r["line"], r["n_words"], r["x0"], r["y0"], r["x1"]) for r in boxes.collect())
    assert got == sorted((f"{i}.pdf", *rest) for i in range(5) for rest in ((1, 1, 94.0, 34.0, 118.0), (2, 1, 52.0, 58.0, 88.0)))
    assert pdf_source.redacted_files(spark, str(tmp_path), boxes).rdd.getNumPartitions() == pdf_source.read_words(spark, str(tmp_path)).rdd.getNumPartitions()


def test_parts_are_moved_whole(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i}.pdf", pdf.document(f"w{i}")) for i in range(9)], "name string, content binary").repartition(3)
    pdf_source.write_files(rows, str(tmp_path / "out"), parts=True)
    folders = list((tmp_path / "out").iterdir())
    assert len(folders) <= 3 and all(f.name.startswith("part-") for f in folders)
    assert sorted(r["text"] for r in pdf_source.read_words(spark, str(tmp_path / "out")).collect()) == [f"w{i}" for i in range(9)]
