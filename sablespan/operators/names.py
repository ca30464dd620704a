"""A trained labeller of personal names: an averaged structured perceptron over word shapes.

Tags are B (begins a name), I (goes on) and O.  Only capitalised words can be part of a name, so the words between
fall to O and a text is decoded run by run of capitalised words, exactly, by Viterbi over each run with O on both
sides.  Lines end sentences, as do full stops behind words of more than one letter.

Cases: null and empty texts have no names; texts of any length are decoded run by run; names in small letters aren't found.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sablespan.operators.names_table import KEPT, TRAIN, generated

TAGS = "OBI"
#: Tags that may follow a tag; None is what stands before and after a run.
ALLOWED = {(a, b) for a in (None, *TAGS) for b in (*TAGS, None) if b != "I" or a in ("B", "I")}
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?|\d+|\n|[^\w\s]")
_SPACE = re.compile(r"[^\S\n]*\Z")
ROUNDS = 8
FULL_STOPS = ("\n", ".", "!", "?")

Token = tuple[str, int, int]
Weights = dict[tuple[str, str], float]


def tokens_of(text: str) -> list[Token]:
    """Words, numbers, signs and line ends with their places. A word's full stop is its own unless it is an initial or a title."""
    out = []
    for m in _WORD.finditer(text):
        word, a, b = m[0], *m.span()
        if word.endswith(".") and len(word) > 1 and not (len(word) == 2 and word[0].isupper()) and word not in ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St."):
            out += [(word[:-1], a, b - 1), (".", b - 1, b)]
        else:
            out.append((word, a, b))
    return out


def plain_tokens(text: str) -> list[str]:
    """The words of tokens_of() without their places."""
    out = []
    for word in _WORD.findall(text):
        if word[-1] == "." and len(word) > 1 and not (len(word) == 2 and word[0].isupper()) and word not in ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St."):
            out += (word[:-1], ".")
        else:
            out.append(word)
    return out


def capital(word: str) -> bool:
    return word[0].isupper()


def shape(word: str) -> str:
    """A letter for each run of like characters: X, x, 9 or the sign itself."""
    kinds = ("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word)
    out = ""
    for k in kinds:
        out += "" if out.endswith(k) else k
    return out


def of_word(word: str) -> list[str]:
    low = word.lower()
    return ["bias", f"shape={shape(word)}", f"word={low}", f"end={low[-2:]}", f"end3={low[-3:]}", f"long={min(len(word), 5)}"]


def of_left(two: str, before: str) -> list[str]:
    low, title = before.lower(), before in ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Mr", "Mrs", "Ms", "Dr")
    return [f"before={low}", f"two={two.lower()}|{low}", f"first={before in FULL_STOPS}", f"title={title}"]


def of_right(after: str, next_shape: str) -> list[str]:
    return [f"after={after.lower()}", f"next={shape(after)}|{next_shape}"]


def of_sides(before_shape: str, after_shape: str, first: bool) -> list[str]:
    return [f"shapes={before_shape}|{after_shape}", f"first,after={first}|{after_shape}"]


def features(tokens: list[Token], i: int) -> list[str]:
    """What is seen of a word and its neighbours."""
    two, before, word, after, next_two = (tokens[j][0] if 0 <= j < len(tokens) else "\n" for j in range(i - 2, i + 3))
    sides = of_sides(shape(before), shape(after), before in FULL_STOPS)
    return [*of_word(word), *of_left(two, before), *of_right(after, shape(next_two)), *sides]


def runs_of(tokens: list[Token]) -> list[tuple[int, int]]:
    """Maximal runs of capitalised words, as (begin, end)."""
    out, at = [], 0
    while at < len(tokens):
        if capital(tokens[at][0]):
            end = at
            while end < len(tokens) and capital(tokens[end][0]):
                end += 1
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


def score(seen: list[list[str]], tags: str, weights: Weights) -> float:
    """The weight of a run's tags; O stands on both sides."""
    total, before = 0.0, "O"
    for own, tag in zip(seen, tags, strict=True):
        total += sum(weights.get((f, tag), 0.0) for f in own) + weights.get((f"from={before}", tag), 0.0)
        before = tag
    return total + weights.get((f"from={before}", "O"), 0.0)


def decode(seen: list[list[str]], weights: Weights) -> str:
    """The tags of the highest score; of equal ones those that come first in OBI from the end."""
    return best_tags([tuple(sum(weights.get((f, tag), 0.0) for f in own) for tag in TAGS) for own in seen], steps_of(weights))


def steps_of(weights: Weights) -> dict[tuple[str, str], float]:
    """The weight of each tag behind each."""
    return {(b, tag): weights.get((f"from={b}", tag), 0.0) for b in TAGS for tag in TAGS}


def best_tags(gains: list[tuple[float, ...]], steps: dict[tuple[str, str], float]) -> str:
    """decode() from what each word gains by each of TAGS."""
    best: dict[str, tuple[float, str]] = {"O": (0.0, "")}
    for own in gains:
        now = {}
        for tag, gain in zip(TAGS, own):
            ways = [(s + steps[b, tag], path) for b, (s, path) in best.items() if (b, tag) in ALLOWED]
            if ways:
                s, path = max(ways, key=lambda w: w[0])
                now[tag] = (s + gain, path + tag)
        best = now
    return max(((s + steps[t, "O"], path) for t, (s, path) in best.items()), key=lambda w: w[0])[1]


def marked(line: str) -> tuple[str, list[tuple[int, int]]]:
    """A line without its brackets, and the places of what stood in them."""
    text, spans = "", []
    for part in re.split(r"(\[[^\]]*\])", line):
        if part.startswith("["):
            spans.append((len(text), len(text) + len(part) - 2))
            part = part[1:-1]
        text += part
    return text, spans


def fit(lines: list[str], rounds: int = ROUNDS) -> Weights:
    """Averaged weights of lines with bracketed names. The order of lines is fixed, so fits agree."""
    cases = []
    for line in lines:
        text, spans = marked(line)
        tokens = tokens_of(text)
        for a, b in runs_of(tokens):
            tags = ""
            for word, s, e in tokens[a:b]:
                span = next((x for x in spans if x[0] <= s and e <= x[1]), None)
                tags += "O" if span is None else "B" if s == span[0] else "I"
            cases.append(([features(tokens, i) for i in range(a, b)], tags))
    weights: Weights = defaultdict(float)
    sums: Weights = defaultdict(float)
    step = 0
    for n in range(rounds):
        for k in range(len(cases)):
            seen, gold = cases[(k * 7919 + n) % len(cases)]
            step += 1
            got = decode(seen, weights)
            if got == gold:
                continue
            for tags, sign in ((gold, 1.0), (got, -1.0)):
                before = "O"
                for own, tag in zip(seen, tags, strict=True):
                    for f in (*own, f"from={before}"):
                        weights[f, tag] += sign
                        sums[f, tag] += sign * step
                    before = tag
                weights[f"from={before}", "O"] += sign
                sums[f"from={before}", "O"] += sign * step
    return {k: w - sums[k] / (step + 1) for k, w in weights.items() if w - sums[k] / (step + 1)}


@lru_cache(maxsize=1)
def default_weights() -> Weights:
    return fit(TRAIN + generated())


#: What a labeller remembers of words and of pairs of words, each.
KNOWN = 1 << 16


class Labeller:
    """names_in() for many texts with the same weights.

    features() speak of a word, of the two before it, of the two behind it, or of the shapes around it; what each of these four
    gains is remembered and added up. KNOWN bounds what is held; what isn't known is worked out as ever."""

    def __init__(self, weights: Weights):
        self.weights, self.steps = weights, steps_of(weights)
        self.of_feature: dict[str, tuple[float, ...]] = {f: tuple(weights.get((f, tag), 0.0) for tag in TAGS) for f, _ in weights}
        self.known: tuple[dict, ...] = ({}, {}, {}, {})
        self.shapes: dict[str, str] = {}
        # A run of one word: its best tag is B if that gains more than O by over this.
        self.bar = 2 * self.steps["O", "O"] - self.steps["O", "B"] - self.steps["B", "O"]

    def _shape(self, word: str) -> str:
        if (got := self.shapes.get(word)) is None:
            if len(self.shapes) >= KNOWN:
                self.shapes.clear()
            got = self.shapes[word] = shape(word)
        return got

    def _part(self, kind: int, key: tuple) -> tuple[float, ...]:
        known = self.known[kind]
        if (got := known.get(key)) is None:
            if len(known) >= KNOWN:
                known.clear()
            seen = [g for f in (of_word, of_left, of_right, of_sides)[kind](*key) if (g := self.of_feature.get(f))]
            got = known[key] = tuple(map(sum, zip(*seen))) if seen else (0.0, 0.0, 0.0)
        return got

    def gains(self, two: str, before: str, word: str, after: str, next_two: str) -> tuple[float, ...]:
        """What the third of five words gains by each of TAGS."""
        a, b = self._part(0, (word,)), self._part(1, (two, before))
        c = self._part(2, (after, self._shape(next_two)))
        d = self._part(3, (self._shape(before), self._shape(after), before in FULL_STOPS))
        return a[0] + b[0] + c[0] + d[0], a[1] + b[1] + c[1] + d[1], a[2] + b[2] + c[2] + d[2]

    def tags(self, words: list[str], a: int, b: int) -> str:
        """The tags of a run; words has two more on either side of the text."""
        if b - a == 1:
            gains = self.gains(*words[a - 2 : a + 3])
            return "B" if gains[1] - gains[0] > self.bar else "O"
        return best_tags([self.gains(*words[i - 2 : i + 3]) for i in range(a, b)], self.steps)

    def names_in(self, text: str) -> list[tuple[int, int]]:
        """Places of names, by code points."""
        words = ["\n", "\n", *plain_tokens(text), "\n", "\n"]
        capitals = [i for i, w in enumerate(words) if w[0].isupper()]
        found, at = [], 0
        while at < len(capitals):
            end = at + 1
            while end < len(capitals) and capitals[end] == capitals[end - 1] + 1:
                end += 1
            tags = self.tags(words, capitals[at], capitals[end - 1] + 1)
            found += [(at + k, tag) for k, tag in enumerate(tags) if tag != "O"]
            at = end
        if not found:
            return []
        spots, out = capital_places(text, [words[i] for i in capitals]), []
        for k, tag in found:
            if tag == "B":
                out.append(spots[k])
            else:
                out[-1] = (out[-1][0], spots[k][1])
        return out


def capital_places(text: str, words: list[str]) -> list[tuple[int, int]]:
    """Where the capitalised words of a text stand; words are all of them, in order.

    The next place of the next one is its own unless it lies within another word, as Lind does in macLind."""
    out, at = [], 0
    for word in words:
        begin = text.find(word, at)
        if begin and (text[begin - 1].isalpha() or text[begin - 1] in "'’-"):
            return [t[1:] for t in tokens_of(text) if capital(t[0])]
        at = begin + len(word)
        out.append((begin, at))
    return out


def names_in(text: str, weights: Weights) -> list[tuple[int, int]]:
    """Places of names, by code points."""
    return Labeller(weights).names_in(text)


def rates(lines: list[str], weights: Weights) -> tuple[int, int, int]:
    """Names found right, found wrongly and missed in lines with brackets; a name counts if its place is exact."""
    right = wrong = missed = 0
    for line in lines:
        text, spans = marked(line)
        got, want = set(names_in(text, weights)), set(spans)
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    return right, wrong, missed


def kept_rates() -> tuple[int, int, int]:
    return rates(KEPT, default_weights())


@dataclass(frozen=True)
class NameLabeller:
    """A detector of persons by trained weights."""

    points: int = 70
    source: str = "ner"

    def detect(self, docs: DataFrame) -> DataFrame:
        """doc_id, entity_type, pattern, ordinal, text, start_char, end_char, points and source of the names in docs (doc_id, text)."""
        weights, points, source = default_weights(), self.points, self.source
        kind = docs.schema["doc_id"].dataType.simpleString()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            labeller = Labeller(weights)
            for batch in batches:
                ids, rows = batch.column("doc_id"), []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    rows += [(i, n, text[a:b], a, b) for n, (a, b) in enumerate(labeller.names_in(text or ""), 1)]
                if rows:
                    at, ordinal, text, a, b = zip(*rows, strict=True)
                    fixed = [pa.array([x] * len(rows), k) for x, k in (("PERSON", pa.string()), ("labeller", pa.string()))]
                    ends = [pa.array([points] * len(rows), pa.int32()), pa.array([source] * len(rows), pa.string())]
                    places = [pa.array(text, pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32())]
                    columns = [ids.take(pa.array(at)), *fixed, pa.array(ordinal, pa.int32()), *places, *ends]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "entity_type", "pattern", "ordinal", "text", "start_char", "end_char", "points", "source"])

        schema = f"doc_id {kind}, entity_type string, pattern string, ordinal int, text string, start_char int, end_char int, points int, source string"
        return docs.select("doc_id", "text").mapInArrow(work, schema)
