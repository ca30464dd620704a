"""Language identification by error-correcting output codes (operator 7).

Each language has a codeword of 15 bits, or of more where there are more than eight languages, chosen for distance; for each bit a logistic
classifier over hashed byte trigrams says which languages' side a text is on.  A text's
language is the codeword of least loss, summed over bits by how well each bit was learned; a
second codeword nearly as close makes it ambiguous.

The classifiers are fitted on the driver on about SAMPLE learning documents at most, an
equal share of each language, chosen by hashed id.  Documents that are held out, the
crc32 of whose id leaves 2 modulo 4, aren't learned from.

Cases: null text, or text without a letter, is `und` with score 0; documents of null language
aren't learned from; without any learning document all are `und`; repeated rows get a row each, with the same
prediction; of equally close codewords the first language by name wins; a text of any length is read whole, in
pieces; an empty table gives no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import bytes_of, has_letter, mapped, text_batches

SAMPLE, SLOTS, BITS, ROUNDS = 8_000, 2048, 15, 60
#: Bytes of text looked at together.
PART = 1 << 20
#: Texts whose best codeword has less than this lead in probability are ambiguous.
LEAD = 0.2


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    """ASCII capitals as small letters, and other ASCII than letters as space."""
    table = np.arange(256, dtype=np.uint32)
    table[65:91] += 32
    table[:65] = table[91:97] = table[123:128] = 32
    return table


def trigram_shares(data: np.ndarray, bounds: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row a document: the square root of the share of its trigrams in each slot."""
    n = len(bounds) - 1
    letters, shift, ends = _letters(), np.uint32(32 - (slots - 1).bit_length()), bounds[1:]
    counts = np.zeros(n * slots, np.int64)
    for at in range(0, len(data) - 2, PART):  # so that memory doesn't grow with the longest text
        b = letters[data[at : at + PART + 2]]
        code = ((b[:-2] * np.uint32(65_599) + b[1:-1]) * np.uint32(65_599) + b[2:]) * np.uint32(2_654_435_761)
        start = np.arange(at, at + len(code))
        row = np.searchsorted(ends, start, side="right")
        inside = start + 3 <= ends[row]
        counts += np.bincount((row * slots + (code >> shift))[inside], minlength=n * slots)
    counts = counts.reshape(n, slots)
    return np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True))).astype(np.float32)


def bits_for(n: int) -> int:
    """The length of the codewords of n languages: five bits for each doubling beyond eight of them."""
    return BITS + 5 * max(0, (max(n, 1) - 1).bit_length() - 3)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: of many random codes the one whose nearest rows are farthest apart."""
    rng, bits = np.random.default_rng(7), bits_for(n)
    best, score = None, 0
    for _ in range(max(10, 400 * 16 // max(n, 16))):
        code = (rng.integers(0, 2, (n, bits)) * 2 - 1).astype(np.float32)
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None]  # no bit is the same for all
        apart = bits if n < 2 else int((((bits - code @ code.T) // 2) + bits * np.eye(n, dtype=int)).min())
        if apart > score:
            best, score = code.astype(int), apart
    if best is None:
        raise ValueError(f"no {n} different codewords of {bits} bits found")
    return best


class OutputCodes:
    """Bit classifiers and the codewords of languages."""

    def __init__(self, names: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.names, self.code, self.weights, self.trust = names, code, weights, trust

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, names: list[str], rounds: int = ROUNDS) -> OutputCodes:
        code = codewords(len(names))
        want = (code[y] > 0).astype(np.float32)
        x = np.c_[x, np.full(len(x), 0.3, np.float32)].astype(np.float32)
        w = np.zeros((x.shape[1], code.shape[1]), np.float32)
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (p - want) / len(x) + 1e-5 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w = w - 0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
        right = ((x @ w > 0) == (want > 0)).mean(axis=0)
        return cls(names, code, w, np.maximum(2 * right - 1, 0.05))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Of each language for each row: codewords by their loss, weighted by the bits' trust."""
        margin = np.clip(x @ self.weights[:-1] + 0.3 * self.weights[-1], -30, 30)
        loss = np.stack([(np.log1p(np.exp(-margin * c)) * self.trust).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        return p / p.sum(axis=1, keepdims=True)


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> OutputCodes | None:
    learn = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}  # a row a language
    if not counts:
        return None
    names = sorted(counts)
    each = max(1, sample // len(names))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int((1 << 20) * min(1.0, each / n)) + 1))])
    drawn = learn.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")))
    number = F.create_map(*[x for i, k in enumerate(names) for x in (F.lit(k), F.lit(i))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = trigram_shares(*bytes_of(batch.column("text"))).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "y", "x"]
            )

    got = mapped(drawn.select("doc_id", "text", F.element_at(number, F.col("lang")).alias("y")), work, "doc_id bigint, y int, x binary")
    got = got.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(2 * sample + 1000)  # a bound that reruns keep to
    rows = sorted(got.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["x"]))
    if not rows:
        return None
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)
    return OutputCodes.fit(x, np.array([r["y"] for r in rows]), names)


def languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every document."""
    model = fit_languages(docs.select("doc_id", "text", "lang"), sample)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text", has_letter(F.col("text")).alias("letter"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            n = batch.num_rows
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            names, score, doubt = np.full(n, "und", object), np.zeros(n), np.ones(n, bool)
            if model is not None:
                p = model.probabilities(trigram_shares(*bytes_of(batch.column("text"))))
                best = p.argmax(axis=1)
                top = p[np.arange(n), best]
                second = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(n)
                names = np.where(letter, np.array(model.names, object)[best], "und")
                score, doubt = np.where(letter, np.clip(top, 0, 1), 0.0), ~letter | (top - second < LEAD)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score.astype(float)), pa.array(doubt)],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return mapped(rows, work, "doc_id bigint, held_out boolean, lang_pred string, score double, ambiguous boolean")
