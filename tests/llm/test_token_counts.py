"""Token counts against the library."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sablespan.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_tokens string"
TEXTS = [
    None, "", " ", "\n", " \n\t ", "a", " a", "a ", "it's  John's\n\n  we'll  go", "x" * 100_000, " " * 5000 + "end", "tab\tand\x1cfs\x1d \x85 \xa0nb",
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "日本語 テキスト 123４５ ⅷ", "\u2028line\u3000wide", "e\u0301 ñ Ａ", "\U0001F600\U0001F601 ok",
    "\u0870\u2c2f new letters \U00010940", "\uffff \ufffe", "no\u200bspace \u202f x", "1234567 12,345.67 --- ...!?",
]


def plain(text, whole):
    return len(whole.encode(text or "", add_special_tokens=False).ids)


@pytest.mark.parametrize("hot", [None, 3, 10**9])
def test_token_counts(spark, hot):
    whole = Tokenizer.from_file(PATH)
    rows = [(i, t, "z") for i, t in enumerate(TEXTS)] + [(3, "again " * 900, "z"), (None, "no id", "z"), (None, "no id", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in T.token_counts(docs, PATH, hot=hot).collect()), key=str)
    want = [(i, len((t or "").encode()), n := plain(t, whole), n > 1024) for i, t, _ in rows]
    assert got == sorted(want, key=str)


def test_token_counts_of_documents(spark, sf_dir):
    whole = Tokenizer.from_file(PATH)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs, PATH).collect()}
    assert got == {r["doc_id"]: plain(r["text"], whole) for r in docs.collect()}


def test_token_counts_of_nothing(spark):
    assert T.token_counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_sure_characters_are_cut_alike(spark):
    """All characters of the ranges, between letters, digits, signs and spaces, in the JVM and by the library."""
    import re

    sure = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", T.SURE)]
    every = [chr(c) for a, b in sure for c in range(a, b + 1) if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}1{c}!{c} b{c}{c}c {c} {c}" for c in every]
    pattern = F.lit(T.CUT)
    df = spark.createDataFrame([("".join(texts[i : i + 500]), i) for i in range(0, len(texts), 500)], "s string, i int")
    got = {r["i"]: r["n"] for r in df.select("i", F.transform(F.regexp_extract_all("s", pattern, F.lit(0)), lambda x: F.length(x)).alias("n")).collect()}
    cut = Tokenizer.from_file(PATH).pre_tokenizer
    for i in range(0, len(texts), 500):
        assert got[i] == [b - a for _, (a, b) in cut.pre_tokenize_str("".join(texts[i : i + 500]))], i


def test_shared_hashes(spark, monkeypatch):
    """Pre-tokens that share a hash go by their text."""
    monkeypatch.setattr(T, "_number", lambda piece: F.length(piece).cast("bigint"))
    whole = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame([(1, "the cat qzx xqz it's done", "z"), (2, "dog fog zqj", "z")], SCHEMA)
    for hot in (20, 10**6):
        got = {r["doc_id"]: r["n_tokens"] for r in T.token_counts(docs, PATH, hot=hot).collect()}
        assert got == {r["doc_id"]: plain(r["text"], whole) for r in docs.collect()}
