"""Personal data by a linear-chain conditional random field (operator 10).

Fixed patterns give the base spans: e-mail addresses, IPv4 addresses, card numbers and phone
numbers in international form.  A conditional random field over word shapes, trained on a
small labelled table written by hand (private_table.py), widened by generated lines, adds what the patterns miss:
phone numbers in national form, addresses written with "at" in brackets, card numbers with dots, and kinds of its
own: identity numbers, secrets (passwords, keys, tokens) and names behind a form of address.  Words with a digit, a sign
of an address or a cue, and the words beside them, form sequences; all others are outside by definition.
Sequences of many texts are decoded together by Viterbi's algorithm in numpy.  A span that
overlaps a base span, or has not what its kind needs, isn't added.

Cases: null text is empty; repeated rows get a row each, with the same spans; an empty table gives no rows; other
columns aren't read by personal_data(), and kept by mask_personal_data(), whatever their names.  Offsets count code
points, the end is exclusive.  Time grows with a text's length. A word that has a sign is looked at
whole, whatever its length; LONG bounds only a neighbour that has none. Sequences of over PIECE tokens are decoded in pieces that overlap.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sablespan.llm import private_table
from sablespan.llm.common import mapped, text_batches

#: The kinds of base spans, and those that only the field finds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id", "secret", "name")
#: Characters of a word without a sign that is context still, tokens decoded together, the overlap of two pieces, tokens held at a time.
LONG, PIECE, OVERLAP, HELD = 1024, 512, 32, 20_000
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[int, int, int]  # kind, start, end

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of these begins where a run of digits does, so no start within a run is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_SIGNAL = re.compile(
    r"[0-9@]|[\[({]at[\])}]|\b(?:Mrs?|Ms|Dr|Prof)\.? [A-Z]|\b(?:[Nn]ame(?: is|:)|Dear|Sincerely,|[Rr]egards,|Signed,) "
    r"|\b(?:[Pp]assword|pwd|[Ss]ecret|[Tt]oken|TOKEN|[Aa][Pp][Ii][_ -]?[Kk]ey|Bearer)\b| at [a-z0-9-]+ dot "
)
_TOKEN = re.compile(r"[^\W_]+|[^\s]")
_NOT_SPACE = re.compile(r"\S")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' spans, by kind and start."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((0, start, end))
        at = text.find("@", at + 1)
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def generated_table(seed: int = 3, rows: int = 900) -> list[tuple[str, list[Span]]]:
    """Generated lines with personal data in many forms, and look-alikes without, beside the labelled table."""
    rng = random.Random(seed)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(["an", "the", "or", "in", "re", "st", "en", "mi", "lo", "ver"]) for _ in range(rng.randint(1, 4)))
    cap = lambda: word().capitalize()

    def card(sep: str) -> str:
        body = "4" + digits(14)
        last = next(str(d) for d in range(10) if luhn(body + str(d)))
        d = body + last
        return sep.join((d[:4], d[4:8], d[8:12], d[12:]))

    upper = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
    mixture = lambda n, letters: "".join(rng.choice(letters) for _ in range(n))
    full_name = lambda: " ".join(cap() for _ in range(rng.choice([1, 2, 2, 2, 3])))
    call, to = ["", "", "call", "tel.", "phone:", "ring", "number", "mobile", "text"], ["", "", "mail", "write to", "contact:"]
    who = ["SSN", "ssn", "social security", "tax no.", "id", "passport", "passport no.", "member id", "licence", "patient ID", "insurance"]
    locks = ["password:", "password is", "pwd", "secret =", "secret=", "api_key =", "token =", "key", "the access key", "Bearer", "TOKEN="]
    greet = ["Dear", "Name:", "name is", "My name is", "Sincerely,", "Regards,", "Signed,", "by"]
    title = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof."]
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    #: kind, what may stand before it, and the thing itself
    forms = [
        (0, to, lambda: f"{word()}.{digits(2)}@{word()}.example.com"),
        (0, to, lambda: f"{word()}@{word()}.org"),
        (0, to, lambda: f"{word()} [at] {word()} [dot] com"),
        (0, to, lambda: f"{word()}(at){word()}.org"),
        (0, to, lambda: f"{word()}.{word()} (at) {word()}.{word()}"),
        (0, to, lambda: f"{word()} (at) {word()} (dot) net"),
        (0, to, lambda: f"{word()}{rng.choice(['[at]', '{at}'])}{word()}.com"),
        (0, to, lambda: f"{word()}{rng.choice(['', '_' + word()])} at {word()} dot {rng.choice(['com', 'org', 'net'])}"),
        (1, ["", "host", "server"], lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))),
        (2, ["", "card", "pay with"], lambda: card(rng.choice([" ", "-", "", "."]))),
        (3, call, lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}"),
        (3, call, lambda: f"+{rng.choice(['44', '49', '33', '34'])} {digits(2)} {digits(4)} {digits(4)}"),
        (3, call, lambda: f"({digits(3)}){rng.choice(['', ' '])}{digits(3)}-{digits(4)}"),
        (3, call, lambda: f"{digits(3)}{(s := rng.choice('-. '))}{digits(3)}{s}{digits(4)}"),
        (3, call, lambda: f"1-{digits(3)}-{digits(3)}-{digits(4)}"),
        (3, call, lambda: f"00{digits(2)} {digits(rng.choice([2, 3]))} {digits(rng.choice([3, 7]))}{rng.choice(['', ' ' + digits(3)])}"),
        (3, call, lambda: f"0{digits(rng.choice([2, 3, 4]))} {digits(rng.choice([3, 4]))} {digits(rng.choice([3, 4]))}"),
        (3, call, lambda: f"0{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}"),
        (4, ["", *who], lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        (4, who, lambda: rng.choice([f"{upper(1)}{digits(7)}", digits(9), f"{upper(2)}{digits(6)}{upper(1)}", f"{upper(1)}-{digits(7)}", f"{upper(3)}-{digits(8)}"])),
        (4, ["IBAN", "Konto:", "wire to", ""], lambda: f"{rng.choice(['DE', 'GB', 'FR', 'ES'])}{digits(rng.choice([18, 20]))}"),
        (4, ["IBAN", "Konto:", "wire to"], lambda: f"{rng.choice(['DE', 'GB', 'NL'])}{digits(2)} {rng.choice([digits(4), upper(4)])} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"),
        (5, locks, lambda: mixture(rng.choice([9, 12, 20, 32]), alnum) + digits(1) + rng.choice("ab")),
        (5, locks, lambda: f"{cap()}{digits(2)}{rng.choice('-!_&')}{word()}{digits(1)}"),
        (5, locks, lambda: f"{mixture(31, '0123456789abcdef')}{digits(1)}"),
        (5, ["key", "aws key", "token", "access key"], lambda: "AK" + mixture(17, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") + digits(1)),
        (6, greet, full_name),
        (6, ["", "", *greet], lambda: f"{rng.choice(title)} {full_name()}"),
    ]
    alike = [
        lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
        lambda: f"version {digits(1)}.{digits(1)}.{digits(2)}",
        lambda: f"{digits(2)},{digits(3)}.{digits(2)}",
        lambda: f"{digits(1)}.{digits(2)}",
        lambda: f"{digits(4)}",
        lambda: f"{digits(rng.randint(5, 15))}",
        lambda: f"({digits(4)})",
        lambda: f"{digits(3)}-{digits(2)}",
        lambda: f"[{digits(2)}]",
        lambda: f"{digits(2)}%",
        lambda: f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}",
        lambda: f"ISBN {digits(3)}-{digits(1)}-{digits(5)}-{digits(3)}-{digits(1)}",
        lambda: f"checksum {''.join(rng.choice('0123456789abcdef') for _ in range(40))}",
        lambda: f"@{word()}",
        lambda: f"{word()} @ {digits(2)}",
        lambda: f"{word()}{digits(2)}",
        lambda: f"{digits(4)}/{digits(2)}/{digits(2)}",
        lambda: f"{digits(1)}-{digits(1)}",
        lambda: f"{digits(5)}-{digits(4)}",
        lambda: f"{word()} (at) the {word()}",
        lambda: f"{rng.choice(['section', 'chapter', 'version'])} {digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"{rng.choice(['part no.', 'order', 'invoice', 'lot'])} {digits(2)}-{digits(4)}",
        lambda: f"{rng.choice(['commit', 'md5', 'sha1'])} {''.join(rng.choice('0123456789abcdef') for _ in range(rng.choice([7, 32, 40])))}",
        lambda: f"{rng.choice(['password', 'secret', 'token', 'key'])} {word()} {word()} {digits(1)}",
        lambda: f"Dear {rng.choice(['customer', 'all', 'team'])}, {digits(2)}",
        lambda: f"Regards {word()} {digits(1)}",
    ]
    out = []
    for i in range(rows):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join([cap(), *(word() for _ in range(rng.randint(2, 5)))]) + " "
            if i % 2:
                kind, leads, make = rng.choice(forms)
                lead, body = rng.choice(leads), make()
                text += lead + " " * bool(lead and lead[-1] != "=")
                spans.append((kind, len(text), len(text) + len(body)))
            else:
                body = rng.choice(alike)()
            text += body + rng.choice([" ", ", ", ". ", ".\n"])
        out.append((text + word() + ".", spans))
    return out


def shape(token: str) -> str:
    """Digits by their number, letters by case and length, mixtures by their runs and length, signs as they are."""
    if token.isdigit():
        return f"9{min(len(token), 8)}"
    if token.isalpha():
        return ("A" if token.isupper() else "Aa" if token[0].isupper() else "a") + str(min(len(token), 4))
    if token.isalnum():
        runs = "".join(k for k, _ in itertools.groupby("9" if c.isdigit() else "A" if c.isupper() else "a" for c in token))
        return f"m{runs[:4]}{min(len(token).bit_length(), 5)}"
    return token


_CUES = frozenset(
    "at dot com org net call ring text tel phone fax mobile number telephone nummer version isbn token the order section chapter"
    " card pay password pwd secret key api bearer authorization ssn social security iban passport licence license id konto"
    " tax insurance member patient wire dear name mr mrs ms dr prof sincerely regards signed no part room md5 sha1 commit by is my".split()
)


def token_features(tokens: list[tuple[int, int]], text: str) -> list[list[str]]:
    """What a token's label may depend on: shapes and cue words up to two tokens away, and the gaps."""
    words = [text[a:b] for a, b in tokens]
    shapes = ["^", "^", *map(shape, words), "$", "$"]
    cues = ["", *(w.lower() if w.lower() in _CUES else "" for w in words), ""]
    gaps = [str(int(a > b)) for (_, b), (a, _) in zip(tokens, tokens[1:], strict=False)]
    gaps = ["1", *gaps, "1"]
    out, behind, since = [], "", 9  # the last cue and how many tokens ago it was
    for i in range(len(words)):
        l2, l1, own, r1, r2 = shapes[i : i + 5]
        g, h = gaps[i], gaps[i + 1]
        near = behind if since <= 5 else ""
        out.append(
            [f"s{own}", f"l{l1}{g}", f"r{r1}{h}", f"k{l2}", f"q{r2}", f"ls{l1}{g}{own}", f"sr{own}{h}{r1}", f"lsr{l1}{g}{own}{h}{r1}"]
            + [f"rr{own}{h}{r1}{r2}", f"ll{l2}{l1}{g}{own}", f"c{cues[i + 1]}", f"cl{cues[i]}", f"cr{cues[i + 2]}"]
            + [f"cb{near}", f"cs{near}{own}", f"z{own[:2]}"]
        )
        behind, since = (cues[i + 1], 1) if cues[i + 1] else (behind, since + 1)
    return out


_SPACE = re.compile(r"\s")


def _back(text: str, at: int) -> int:
    """Where the word that ends at or goes on at `at` begins, at most LONG characters before."""
    stop = max(0, at - LONG - 1)
    while at > stop and not text[at - 1].isspace():
        at -= 1
    return at


def _on(text: str, at: int) -> int:
    """Where the word that goes on at `at` ends, at most LONG characters behind."""
    stop = min(len(text), at + LONG + 1)
    while at < stop and not text[at].isspace():
        at += 1
    return at


def _around(text: str, first: int, last: int) -> tuple[int, int]:
    """A stretch with the two words before it and the three behind, over any white space. A long word ends it."""
    a, b = first, last
    for _ in range(2):
        at = a
        while at > 0 and text[at - 1].isspace():
            at -= 1
        begin = _back(text, at)
        if begin == at or at - begin > LONG:
            break
        a = begin
    for _ in range(3):
        word = _NOT_SPACE.search(text, b)
        if word is None:
            break
        end = _on(text, word.start())
        if end - word.start() > LONG:
            break
        b = end
    return a, b


def segments(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token offsets of each stretch of words that carry a signal and of the two words before and three behind, in
    pieces of at most PIECE tokens."""
    upto, first, last = -1, -1, -1
    for m in _SIGNAL.finditer(text):
        if m.start() < upto:
            continue
        # The whole word, whatever its length; signals further on in it are part of the stretch already.
        a, space = m.start(), _SPACE.search(text, m.end())
        while a > upto and a > 0 and not text[a - 1].isspace():
            a -= 1
        upto = b = space.start() if space else len(text)
        a, b = _around(text, a, b)
        if first >= 0 and a <= last:
            last = max(last, b)
        else:
            if first >= 0:
                yield [t.span() for t in _TOKEN.finditer(text, first, last)]
            first, last = a, b
    if first >= 0:
        yield [t.span() for t in _TOKEN.finditer(text, first, last)]


def pieces_of(tokens: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], int, int]]:
    """Pieces that overlap, with the first and the last place where a span of the piece may start."""
    if len(tokens) <= PIECE:
        yield tokens, 0, tokens[-1][1] if tokens else 0
        return
    step, half = PIECE - OVERLAP, OVERLAP // 2
    for at in range(0, len(tokens) - OVERLAP, step):
        part = tokens[at : at + PIECE]
        first = tokens[at + half][0] if at else 0
        last = tokens[at + step + half][0] if at + PIECE < len(tokens) else tokens[-1][1]
        yield part, first, last


class Chain:
    """The trained field: a weight for each feature and tag, and for each pair of successive tags."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray, begin: np.ndarray):
        self.index, self.emit, self.step, self.begin = index, emit, step, begin

    @classmethod
    def fit(cls, table: list[tuple[str, list[Span]]], rounds: int = 80, ridge: float = 0.02) -> Chain:
        rows, tags = [], []
        for text, spans in table:
            for tokens in segments(text):
                rows.append(token_features(tokens, text))
                tags.append([_tag(t, spans) for t in tokens])
        index: dict[str, int] = {}
        for r in rows:
            for token in r:
                for f in token:
                    index.setdefault(f, len(index))
        n, longest, width = len(rows), max(map(len, rows)), len(rows[0][0])
        feats = np.full((n, longest, width), len(index), np.int64)
        gold = np.zeros((n, longest), np.int64)
        live = np.zeros((n, longest), bool)
        for i, (r, t) in enumerate(zip(rows, tags, strict=True)):
            feats[i, : len(r)] = [[index[f] for f in token] for token in r]
            gold[i, : len(t)], live[i, : len(t)] = t, True
        s = len(TAGS)
        parts = [np.zeros((len(index) + 1, s)), np.zeros((s, s)), np.zeros(s)]
        want = [np.zeros_like(p) for p in parts]
        want[0] += _spread_sums(feats[live], np.eye(s)[gold[live]], len(index) + 1)
        both = live[:, 1:]
        np.add.at(want[1], (gold[:, :-1][both], gold[:, 1:][both]), 1)
        np.add.at(want[2], gold[:, 0], 1)
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parts]
        for turn in range(1, rounds + 1):
            have = cls._expected(feats, live, parts)
            for p, w, h, (m, v) in zip(parts, want, have, moments, strict=True):
                g = w - h - ridge * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += 0.1 * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
        return cls(index, *parts)

    @staticmethod
    def _expected(feats: np.ndarray, live: np.ndarray, parts: list[np.ndarray]) -> list[np.ndarray]:
        """Expected counts of features and pairs of tags, by the forward and backward sums."""
        emit, step, begin = parts
        emit[-1] = 0
        (n, longest), s = live.shape, emit.shape[1]
        score = np.zeros((n, longest, s))
        score[live] = sum(emit[f] for f in feats[live].T)
        link, local = np.exp(step), np.exp(score - score.max(axis=2, keepdims=True))
        alpha, beta, scale = np.zeros_like(score), np.ones_like(score), np.ones((n, longest))
        alpha[:, 0] = np.exp(begin - begin.max()) * local[:, 0]
        alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, longest):
            on = (alpha[:, t - 1] @ link) * local[:, t]
            scale[:, t] = np.where(live[:, t], on.sum(axis=1), 1)
            alpha[:, t] = np.where(live[:, t, None], on / scale[:, t, None], alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            back = (local[:, t + 1] * beta[:, t + 1]) @ link.T / scale[:, t + 1, None]
            beta[:, t] = np.where(live[:, t + 1, None], back, 1)
        unary = alpha * beta * live[:, :, None]
        out = [np.zeros_like(p) for p in parts]
        out[0] += _spread_sums(feats[live], unary[live], len(emit))
        for t in range(1, longest):
            ahead = local[:, t] * beta[:, t] * (live[:, t] / scale[:, t])[:, None]
            out[1] += (alpha[:, t - 1].T @ ahead) * link
        out[2] = unary[:, 0].sum(axis=0)
        out[0][-1] = 0
        return out

    def decode(self, rows: list[list[list[str]]]) -> list[np.ndarray]:
        """The best tags of each sequence; sequences of like length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(rows)
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):
            upto, most = at, 0
            while upto < len(order) and (upto == at or (upto - at + 1) * len(rows[order[upto]]) <= 100_000):
                most = len(rows[order[upto]])
                upto += 1
            self._decode([(i, rows[i]) for i in order[at:upto]], most, out)
            at = upto
        return out

    def _decode(self, rows, longest: int, out: list[np.ndarray]) -> None:
        if not longest:
            return
        unknown = len(self.index)
        score = np.zeros((len(rows), longest, len(TAGS)))
        for k, (_, r) in enumerate(rows):
            if r:
                score[k, : len(r)] = self.emit[[[self.index.get(f, unknown) for f in token] for token in r]].sum(axis=1)
        best = self.begin + score[:, 0]
        via = np.zeros((len(rows), longest, len(TAGS)), np.int8)
        sizes = np.array([len(r) for _, r in rows])
        for t in range(1, longest):
            options = best[:, :, None] + self.step
            via[:, t] = options.argmax(axis=1)
            best = np.where((t < sizes)[:, None], options.max(axis=1) + score[:, t], best)
        tag = best.argmax(axis=1)
        path = np.zeros((len(rows), longest), np.int64)
        for t in range(longest - 1, -1, -1):
            inside = t < sizes
            path[inside, t] = tag[inside]
            if t:
                tag = np.where(inside, via[np.arange(len(rows)), t, tag], tag)
        for k, (i, r) in enumerate(rows):
            out[i] = path[k, : len(r)]


def _spread_sums(feats: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """For each feature the sum of the values of the tokens that have it."""
    flat, width = feats.ravel(), feats.shape[1]
    return np.stack([np.bincount(flat, np.repeat(v, width), n) for v in values.T], axis=1)


def _tag(token: tuple[int, int], spans: list[Span]) -> int:
    for kind, a, b in spans:
        if a <= token[0] and token[1] <= b:
            return 1 + 2 * kind + (token[0] != a)
    return 0


def spans_of(tags: np.ndarray, tokens: list[tuple[int, int]]) -> list[Span]:
    out: list[Span] = []
    inside = -1
    for tag, (a, b) in zip(tags.tolist(), tokens, strict=True):
        kind, starts = (tag - 1) // 2, tag % 2 == 1
        if not tag:
            inside = -1
        elif starts or kind != inside:
            out.append((kind, a, b))
            inside = kind
        else:
            out[-1] = (kind, out[-1][1], b)
    return out


_BARE_AT = re.compile(r"\S\s*(?:[\[({]at[\])}]|@)\s*[A-Za-z0-9-]+\s*(?:\.|[\[({]dot[\])}])\s*[A-Za-z]")
_NATIONAL = re.compile(r"[0-9()+][0-9().\x20+-]*[0-9]\Z")


_IDENTITY = re.compile(r"[A-Z0-9][A-Z0-9 -]*[A-Z0-9]\Z")
_PERSON = re.compile(r"(?:(?:Mrs?|Ms|Dr|Prof)\.? )?[^\W\d_][^\W\d_'.-]*(?:['. -]+[^\W\d_]+)*\Z")


def plausible(kind: int, body: str) -> bool:
    """Whether a decoded span has what its kind needs."""
    digits = _NOT_DIGIT.sub("", body)
    if kind == 0:
        return bool(_BARE_AT.search(body)) or " dot " in body and " at " in body
    if kind == 1:
        parts = body.split(".")
        return len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 10 <= len(digits) <= 15 and len(body) > len(digits) and bool(_NATIONAL.match(body))
    if kind == 4:
        return len(digits) >= 6 and bool(_IDENTITY.match(body))
    if kind == 5:
        return len(body) >= 8 and not _SPACE.search(body) and bool(digits) and len(digits) < len(body)
    words = body.split()
    return len(words) <= 5 and all(w[0].isupper() for w in words) and bool(_PERSON.match(body))


def find_spans(texts: list[str], chain: Chain) -> list[tuple[list[Span], list[Span]]]:
    """Base spans, and all spans, of each text; both by kind and start."""
    found: list[tuple[list[Span], list[Span]]] = []
    rows, where, held = [], [], 0

    def decode() -> None:
        for tags, (i, tokens, first, last) in zip(chain.decode(rows), where, strict=True):
            base, more = found[i]
            for kind, a, b in spans_of(tags, tokens):
                if first <= a < last and plausible(kind, texts[i][a:b]) and not any(a < y and x < b for _, x, y in base):
                    more.append((kind, a, b))
        rows.clear()
        where.clear()

    for i, text in enumerate(texts):
        signal = _SIGNAL.search(text)
        found.append((base_spans(text) if signal else [], []))
        for tokens in segments(text) if signal else ():
            for part, first, last in pieces_of(tokens):
                rows.append(token_features(part, text))
                where.append((i, part, first, last))
                held += len(part)
            if held > HELD:
                decode()
                held = 0
    decode()
    return [(base, sorted([*base, *more])) for base, more in found]


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


@functools.cache
def default_chain() -> Chain:
    """The field of the labelled table, fitted once in a driver's life."""
    return Chain.fit([*private_table.table(KINDS, held_out=False), *generated_table()])


def personal_data(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, and all spans of every document."""
    chain = chain or default_chain()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            found = find_spans([t or "" for t in batch.column("text").to_pylist()], chain)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(BASE))]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([written(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *counts, digest, spans], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"]
            )

    numbers = ", ".join(f"n_{k} bigint" for k in BASE)
    return mapped(docs.select("doc_id", "text"), work, f"doc_id bigint, {numbers}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or each group of overlapping spans, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind]}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, chain: Chain | None = None) -> DataFrame:
    """docs with all spans masked in text; null text stays null."""
    chain = chain or default_chain()
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            texts = batch.column("text").to_pylist()
            found = find_spans([t or "" for t in texts], chain)
            new = pa.array([t and masked(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string())
            yield batch.set_column(at, "text", new)

    return docs.mapInArrow(work, docs.schema)


def spans_table(spans: DataFrame) -> DataFrame:
    """From personal_data(): a row a span, with doc_id, kind, start and end."""
    each = spans.filter(F.col("spans") != "").select("doc_id", F.explode(F.split("spans", ",")).alias("span"))
    p = F.split("span", ":")
    return each.select("doc_id", p[0].alias("kind"), p[1].cast("bigint").alias("start"), p[2].cast("bigint").alias("end"))
