"""The positional index and bounded examples."""

import random

from pyspark.sql import functions as F

from sablespan.operators import analysis, index, redact


def spots(lines, phrase):
    """Word number, box of each place of a phrase, by reading the words in order."""
    laid, n = [], 0
    for y, line in enumerate(lines.split("\n")):
        x = 0
        for w in line.split(" "):
            if w:
                n += 1
                laid.append((n, y, x, x + len(w), w.lower()))
            x += len(w) + 1
    want = phrase.lower().split(" ")
    out = []
    for i in range(len(laid) - len(want) + 1):
        part = laid[i : i + len(want)]
        if [p[4] for p in part] == want:
            out.append((part[0][0], min(p[2] for p in part), min(p[1] for p in part), max(p[3] for p in part), max(p[1] for p in part)))
    return out


def test_phrases_by_index(spark, tmp_path):
    rng = random.Random(5)
    texts = {i: "".join(rng.choice(["a", "B", "the", "cat"]) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randrange(60))) for i in range(30)}
    texts |= {30: "", 31: "the the the the"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    phrases = ["the", "the the", "a b", "cat A the", "no such", "b B b B", "The Cat"]
    asked = spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")
    built = index.build_index(redact.words(docs), str(tmp_path / "i"))
    rows = index.phrase_boxes(index.read_index(spark, str(tmp_path / "i")), asked).collect()
    got = sorted((r["phrase_id"], r["doc_id"], r["first"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in rows)
    assert got == sorted((p, d, *s) for p, phrase in enumerate(phrases) for d, t in texts.items() for s in spots(t, phrase))
    within = spark.createDataFrame([(3, "a"), (3, "the"), (31, "the the"), (30, "a")], "doc_id long, phrase string")
    got = sorted((r["doc_id"], r["phrase"], r["first"]) for r in index.phrase_boxes_within(built, within).collect())
    assert got == sorted((d, p, s[0]) for d, p in ((3, "a"), (3, "the"), (31, "the the")) for s in spots(texts[d], p))


def test_index_lookups_read_few_files(spark, tmp_path):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 200).cast("string"), F.lit(" common")).alias("text"))
    path = str(tmp_path / "i")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.build_index(redact.words(docs), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = index.read_index(spark, path)
    files = found.postings.select("token", F.input_file_name().alias("f")).distinct()
    assert files.filter("token = 'w7'").count() == 1 < found.postings.select(F.input_file_name()).distinct().count()
    assert {tuple(r) for r in found.tokens.filter("token IN ('common', 'w7')").collect()} == {("common", 400, 400), ("w7", 2, 2)}


def test_examples_send_few_rows(spark):
    rows = spark.range(0, 50_000, 1, 4).select((F.col("id") % 2).alias("k"), F.format_string("%05d", "id").alias("text"))
    got = analysis.examples(rows, ["k"], ["text"], 3)
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(0, "00000|00002|00004"), (1, "00001|00003|00005")}
