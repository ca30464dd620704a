"""Quality by ordinal cumulative-link regression on hashed text (operator 6).

A rated document has the grade quality + (1 - toxic), from 0 to 2.  One weight vector over hashed
features gives a document its score s, ordered thresholds t1 < t2 give P(grade >= j) =
sigmoid(s - tj), hence the expected grade and each tail's probability.  A document stays if the
top grade is likelier than not.

Features are the document's distinct lower-cased words and their first letters, and its shape: shares of capitals, of
kinds of symbols and digits, of words or sentences that repeat.  The model is fitted on the driver
on at most SAMPLE rated documents, those of least hashed id; the rest of the work runs over
all texts in tasks.

Cases: null text is empty; unrated or partly rated documents aren't learned from; repeated rows
get a row and the same score each; features that share a slot count once, in fitting and in scoring; a text of any
length is read whole, in memory of a few times its size; without any rating every document stays; an empty table
gives no rows; other columns of documents are kept by score_quality() and not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablespan.llm.common import mapped, text_batches
from sablespan.llm.tokens import Cache

SAMPLE, BITS, ROUNDS = 15_000, 18, 200
#: Features of fewer rated documents than this are not learned.
LEAST = 3
#: The pull of each weight to zero; letters of a word's beginning that are a feature, too.
SPARSITY, STEM = 2e-4, 5
GRADES = 3

_WORDS = re.compile(r"[^\W\d_]+")
_SENTENCES = re.compile(r"[.\n]+")
_STEPS = (0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9)


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def shape(text: str, words: list[str]) -> list[str]:
    """How a text looks, as words of their own: for each share, the steps that it reaches."""
    data = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = max(1, int(data.sum() - data[32]))
    sentences = [s for s in _SENTENCES.split(text) if s.strip()]
    shares = {
        "upper": data[65:91].sum() / max(1, data[65:91].sum() + data[97:123].sum()),
        "digit": data[48:58].sum() / n,
        "bang": data[33] / n,
        "bar": data[124] / n,
        "sign": (data[35:39].sum() + data[42:44].sum() + data[60:63].sum() + data[64] + data[91:97].sum() + data[123] + data[125:127].sum()) / n,
        "control": data[:9].sum() / n,
        "again": sum(map(str.__eq__, words, words[1:])) / max(1, len(words)),
        "sentence": 1 - len(set(sentences)) / max(1, len(sentences)),
    }
    out = [f" {name}>{step}" for name, share in shares.items() for step in _STEPS if share >= step]
    return out + [f" words>{2**k}" for k in range(12) if len(words) >= 2**k]


def features(text: str | None) -> tuple[set[str], list[str]]:
    text = text or ""
    words = _WORDS.findall(text.lower())
    own = set(words)
    return own | {" ^" + w[:STEM] for w in own if len(w) > STEM}, shape(text, words)


def slots(text: str | None) -> np.ndarray:
    """The distinct slots of a document's features."""
    words, looks = features(text)
    return np.unique(np.fromiter(map(slot, [*words, *looks]), np.int32, len(words) + len(looks)))


def rated_sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots and grades of at most sample rated documents."""
    rated = labels.select(F.col("doc_id").alias("l_doc_id"), (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    rated = rated.filter(F.col("grade").between(0, GRADES - 1) & F.col("l_doc_id").isNotNull())
    rated = rated.orderBy(F.xxhash64("l_doc_id"), "l_doc_id", "grade").limit(sample)
    # At most sample rows of two numbers.
    texts = docs.select("doc_id", "text").join(F.broadcast(rated), F.col("doc_id") == F.col("l_doc_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            rows = [slots(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), batch.column("grade")], names=["doc_id", "slots", "grade"])

    got = mapped(texts.select("doc_id", "text", "grade"), work, "doc_id bigint, slots binary, grade int")
    # Ids that repeat may give more rows than were rated: the first by id are taken, so that reruns agree.
    rows = got.orderBy("doc_id", "grade", "slots").limit(2 * sample).toPandas().sort_values(["doc_id", "grade", "slots"])
    return [np.frombuffer(r, np.int32) for r in rows["slots"]], rows["grade"].to_numpy(np.int64)


def loss_and_gradient(free: np.ndarray, row: np.ndarray, index: np.ndarray, grades: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean log-likelihood of the grades and its gradient. free: the first threshold, the logarithms of the steps
    to the later ones, the weights; row and index: the documents' features."""
    n, k = len(grades), GRADES - 1
    at = np.arange(n)
    thresholds = np.cumsum(np.r_[free[0], np.exp(free[1:k])])
    score = np.bincount(row, weights=free[k:][index], minlength=n)
    p = np.c_[np.ones(n), 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -35, 35))), np.zeros(n)]
    mass = np.maximum(p[at, grades] - p[at, grades + 1], 1e-12)
    slope = p * (1 - p)
    up, down = slope[at, grades] / mass, slope[at, grades + 1] / mass
    by_threshold = np.array([down[grades == j - 1].sum() - up[grades == j].sum() for j in range(1, GRADES)])
    gradient = np.r_[
        by_threshold.sum(),
        [by_threshold[j:].sum() * np.exp(free[j]) for j in range(1, k)],
        np.bincount(index, weights=(up - down)[row], minlength=len(free) - k),
    ]
    return float(np.log(mass).mean()), gradient / n


class CumulativeLink:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    @classmethod
    def fit(cls, rows: list[np.ndarray], grades: np.ndarray, rounds: int = ROUNDS, sparsity: float = SPARSITY) -> CumulativeLink:
        """By proximal Adam over all rows; most weights end at zero. The later threshold is the first plus exp of
        a free number."""
        n = len(rows)
        row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
        index = np.concatenate(rows)
        used = np.flatnonzero(np.bincount(index, minlength=1 << BITS) >= LEAST)
        place = np.full(1 << BITS, -1, np.int32)
        place[used] = np.arange(len(used))
        index = place[index]
        row, index = row[index >= 0], index[index >= 0]
        share = np.bincount(grades, minlength=GRADES) + 1.0
        start = np.log(share.sum() / np.cumsum(share[::-1])[::-1][1:] - 1)  # gives the shares without any feature
        free = np.r_[start[0], np.log(np.maximum(np.diff(start), 1e-2)), np.zeros(len(used))]
        m, v = np.zeros_like(free), np.zeros_like(free)
        k = GRADES - 1
        for step in range(1, rounds + 1):
            _, gradient = loss_and_gradient(free, row, index, grades)
            m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
            pace = 0.1 * min(1.0, 3 * (1 - step / rounds) + 0.02)
            scale = np.sqrt(v / (1 - 0.99**step)) + 1e-6
            free = free + pace * (m / (1 - 0.9**step)) / scale
            free[k:] = np.sign(free[k:]) * np.maximum(np.abs(free[k:]) - pace * sparsity / scale[k:], 0)
        weights = np.zeros(1 << BITS, np.float32)
        weights[used] = free[k:]
        return cls(weights, np.cumsum(np.r_[free[0], np.exp(free[1:k])]))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j), a column for each j from 1."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds, -35, 35)))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CumulativeLink | None:
    rows, grades = rated_sample(docs, labels, sample)
    return CumulativeLink.fit(rows, grades) if len(rows) else None


def score_quality(docs: DataFrame, model: CumulativeLink | None) -> DataFrame:
    """docs, and expected_grade, p_1, p_2 (of that grade or more) and keep."""
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(2.0), "p_1": F.lit(1.0), "p_2": F.lit(1.0), "keep": F.lit(True)})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.weights.tolist()
        looked_up = Cache(slot, 400_000)
        for batch in text_batches(batches):
            scores = []
            for text in batch.column("text").to_pylist():
                words, looks = features(text)
                own = {*map(looked_up.__getitem__, words), *map(looked_up.__getitem__, looks)}  # a slot counts once, as in fitting
                scores.append(float(sum(map(weights.__getitem__, sorted(own)))))
            tails = model.tails(np.array(scores, np.float64))
            columns = [*batch.columns, pa.array(tails.sum(axis=1)), *(pa.array(t) for t in tails.T), pa.array(tails[:, -1] >= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "expected_grade", "p_1", "p_2", "keep"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return mapped(docs, work, f"{kinds}, expected_grade double, p_1 double, p_2 double, keep boolean")


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, expected_grade, p_1, p_2 and keep of every document."""
    model = fit_quality(docs, labels, sample)
    return score_quality(docs.select("doc_id", "text"), model).drop("text")
