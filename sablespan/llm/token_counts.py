"""Token counts of documents without their ids (operator 12).

A byte-level tokenizer encodes each pre-token by itself, so a document's count is the sum, over its distinct
pre-tokens, of how often it has one times how many tokens that one gives.  One scan finds the distinct
pre-tokens of the corpus and how often each occurs; each goes to the tokenizer's model once.  A second
scan gives each document's pre-token frequencies, which meet the counts by joins.

Pre-tokens follow a law of few common and many rare ones, so a plain join would send most rows to a few keys.
A pre-token that makes up at least one in HOT of all occurrences is common: there can't be more than HOT of them,
two numbers each, so they are broadcast, and a document's common
pre-tokens are summed before anything is shuffled.  Its rare ones are counted by pre-token and joined by shuffle;
none of their keys has as many rows as one in HOT of all occurrences.  Pre-tokens go by a 64-bit hash: all of the
corpus are known, so those that share a hash but not the number of tokens are found, and go by their text.

Texts are cut in the JVM.  Texts with characters that Java's tables of letters, digits and spaces may have
otherwise than the library's, or with strings of special tokens, are cut by the library itself.

Cases: a null text counts as empty, and empty texts have no tokens; strings of special tokens inside a text are
one token each, as the library takes them by default; rows that share a doc_id, or have none, have counts of
their own; an empty table gives no rows; other columns aren't read, whatever their names.  A text, and a
pre-token, may be as long as a worker's memory allows and is counted whole.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import drop, mapped, stored, text_batches, worker_state
from sablespan.llm.tokens import byte_letters

#: The most pre-tokens that are broadcast.
HOT = 2_000_000
#: Rows of an Arrow batch.
BATCH = 65_536
#: Characters whose kind (letter, digit, space, other) all libraries agree on: each was compared.
SURE = r"\x{0}-\x{52F}\x{590}-\x{74F}\x{900}-\x{BFF}\x{1E00}-\x{206F}\x{2100}-\x{2BFF}\x{2E80}-\x{9FFC}\x{AC00}-\x{D7A3}\x{FB00}-\x{FFFD}\x{1F300}-\x{1FAFF}"
#: A pre-token is a contraction or a run of letters, digits, signs or spaces, all but spaces with one space before
#: them; the last space before a word is the word's. Runs come first as they are most, and are possessive.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CUT = rf" ?\p{{L}}++|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}\p{{L}}\p{{N}}]++| ?\p{{N}}++|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


class PreTokens:
    """Cuts texts into pre-tokens and counts a pre-token's tokens, as a byte-level tokenizer of the library does."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(self.whole.to_str())
        before = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or spec["normalizer"]:
            raise ValueError(f"{path} isn't a byte-level tokenizer without normalizer and prefix")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} has added tokens that take in what is beside them")
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        self.special = sorted((t["content"] for t in added), key=len, reverse=True)
        self.marks = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")

    def of(self, text: str) -> Counter:
        """How often a text has each pre-token; special tokens' strings are pre-tokens of their own."""
        out: Counter = Counter()
        at = 0
        for m in [*self.marks.finditer(text), None]:
            for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(text[at : m.start() if m else len(text)]):
                out[bytes(map(self.bytes.__getitem__, piece)).decode()] += 1
            if m:
                out[m[0]] += 1
                at = m.end()
        return out

    def tokens(self, piece: str) -> int:
        if piece in self.special:
            return 1
        return len(self.whole.model.tokenize("".join(map(self.letters.__getitem__, piece.encode()))))


def _kept(path: str) -> PreTokens:
    return worker_state(f"pretokens:{path}", lambda: PreTokens(path))


def _quoted(text: str) -> str:
    """A string as a regular expression of Java's."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def occurrences(docs: DataFrame, path: str) -> DataFrame:
    """row, doc_id, n_bytes, piece and n: the pre-tokens of docs, those of most texts as they come, with n = 1.

    Each text has one row more, whose piece is null.
    """
    hard = "|".join([f"[^{SURE}]", *map(_quoted, PreTokens(path).special)])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", n_bytes, F.coalesce("text", F.lit("")).alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(CUT), F.lit(0))
    easy = rows.filter(~F.col("text").rlike(hard)).select("row", "doc_id", "n_bytes", F.explode(F.concat(F.array(F.lit(None).cast("string")), pieces)).alias("piece"), F.lit(1).cast("bigint").alias("n"))

    names = easy.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _kept(path)
        for batch in text_batches(batches):
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = cutter.of(text)
                head = [batch.column(c).take(pa.array([i] * (len(own) + 1), pa.int64())) for c in ("row", "doc_id", "n_bytes")]
                yield from pa.table([*head, pa.array([None, *own], pa.string()), pa.array([0, *own.values()], pa.int64())], names=names).to_batches(max_chunksize=BATCH)

    # Numbers below zero, so that no two texts share one whatever the two scans number.
    others = rows.filter(F.col("text").rlike(hard)).withColumn("row", -1 - F.col("row"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return easy.unionByName(mapped(others, cut, f"row bigint, doc_id {kind}, n_bytes bigint, piece string, n bigint"))


def distinct_pieces(found: DataFrame, path: str) -> DataFrame:
    """piece, times (how often it occurs) and tokens: a row for each distinct pre-token of the corpus."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _kept(path)
        for batch in text_batches(batches, "piece"):
            tokens = [cutter.tokens(p) for p in batch.column("piece").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tokens, pa.int64())], names=["piece", "times", "tokens"])

    times = found.filter("piece IS NOT NULL").groupBy("piece").agg(F.sum("n").alias("times"))
    return mapped(times, counted, "piece string, times bigint, tokens bigint")


def numbered(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """number, times and tokens by 64-bit hash; and the pre-tokens (piece, tokens) whose hash another one with
    other tokens has, which go by their text."""
    by_number = pieces.groupBy(_number(F.col("piece")).alias("number")).agg(F.sum("times").alias("times"), F.max("tokens").alias("tokens"), F.min("tokens").alias("least"))
    clash = by_number.filter(F.col("tokens") != F.col("least")).select("number")
    named = pieces.withColumn("number", _number(F.col("piece"))).join(clash, "number", "left_semi").select("piece", "tokens")
    return by_number.filter(F.col("tokens") == F.col("least")).drop("least"), named


def _number(piece: Column) -> Column:
    return F.xxhash64(piece)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, hot: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of each row of docs (doc_id, text)."""
    hot = HOT if hot is None else hot
    found = occurrences(docs.select("doc_id", "text"), path)
    pieces = stored(distinct_pieces(found, path), "pieces")
    counts, named = numbered(pieces)
    counts = stored(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    common = counts.filter(F.col("times") * F.lit(hot) >= F.lit(total)).select("number", "tokens")  # hot rows at most

    met = found.withColumn("number", F.when(F.col("piece").isNotNull(), _number(F.col("piece")))).join(F.broadcast(common), "number", "left")
    if n := named.count():
        if n > hot:
            raise ValueError(f"{n} pre-tokens share a hash with another")
        met = met.join(F.broadcast(named.withColumnRenamed("tokens", "own")), "piece", "left").withColumn("tokens", F.coalesce("own", "tokens"))
    else:
        drop(pieces)
    # By row: the tokens of all common pre-tokens, with what is known of the row, and how often it has each rare one.
    met = met.withColumn("rare", F.when(F.col("tokens").isNull(), F.col("number")))
    value = F.when(F.col("piece").isNull(), 0).otherwise(F.col("n") * F.coalesce("tokens", F.lit(1)))
    about = [F.max(F.when(F.col("rare").isNull(), F.col(c))).alias(c) for c in ("doc_id", "n_bytes")]
    sums = stored(met.groupBy("row", "rare").agg(F.sum(value).alias("n"), *about), "sums")
    own = sums.filter("rare IS NULL").select("row", "doc_id", "n_bytes", F.col("n").alias("tokens"))
    others = sums.filter("rare IS NOT NULL").select("row", "rare", "n").join(counts, F.col("rare") == F.col("number"))
    others = others.groupBy("row").agg(F.sum(F.col("n") * F.col("tokens")).alias("others"))
    n_tokens = F.col("tokens") + F.coalesce("others", F.lit(0))
    return own.join(others, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
