"""One plain PDF file: its words with their boxes, its pages as text, text as pages, and a copy without what boxes cover.

Text is placed as the format says: by the text matrix, the matrices below it, sizes, spacing and the widths of simple
fonts (500 thousandths where a font gives none). Boxes count points from the upper left corner of the page.
Objects may stand in object streams, content may be deflated. Not read: encrypted files (an error), text
in forms that a page draws, and fonts with codes of their own; any PDF library's function can be passed to
files.extracted_text() for these.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np

_START = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_BODY_END = re.compile(rb"\bendobj\b|\bstream\r?\n")
_STRING = rb"\((?:[^()\\]++|\\.|\((?:[^()\\]++|\\.|\([^()]*+\))*+\))*+\)"
_TOKEN = re.compile(
    rb"%[^\r\n]*|" + _STRING + rb"|<<|>>|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s()<>\[\]{}/%]*|[+-]?(?:\d+\.?\d*|\.\d+)|\bID\s.*?\sEI\b|[A-Za-z'\"][A-Za-z0-9*'\"]*",
    re.S,
)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
_NUMBER = rb"[+-]?(?:\d+\.?\d*|\.\d+)"
#: What pages of plain text are made of: one string in a text object, set by font, size and place; boxes; states that nothing changes.
_SIMPLE = re.compile(
    rb"\s*(?:BT\s+(/[^\s()<>\[\]{}/%%]+)\s+(%(n)s)\s+Tf\s+(%(n)s)\s+(%(n)s)\s+Td\s*(%(s)s)\s*Tj\s+ET|%(n)s\s+%(n)s\s+%(n)s\s+%(n)s\s+re\s+f|[qQ]|%(n)s\s+g)(?=\s|\Z)"
    % {b"n": _NUMBER, b"s": _STRING}
)
#: What of a page may hold its text once more, or what readers have noted on it.
_ASIDE = ("Annots", "Metadata", "PieceInfo", "StructParents", "Thumb", "Contents")
Matrix = tuple[float, float, float, float, float, float]
Box = tuple[float, float, float, float]
_ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
_CHARS = bytes(range(256)).decode("cp1252", "replace")
#: The bytes that each code takes in UTF-8.
_WIDE = np.array([len(c.encode()) for c in _CHARS], np.int32)


class Ref(NamedTuple):
    number: int


class Glyph(NamedTuple):
    """A character, its box in points, its string among those of its operator, its place there, its advance, and the two ends of
    its baseline with the height above it."""

    char: str
    box: Box
    piece: int
    at: int
    advance: float
    begin: tuple[float, float]
    end: tuple[float, float]
    tall: float


class Font(NamedTuple):
    """The width of each code, in thousandths, the least and the greatest of them."""

    widths: tuple[float, ...]
    least: float
    most: float

    def width(self, codes: bytes) -> float:
        return len(codes) * self.most if self.least == self.most else sum(map(self.widths.__getitem__, codes))


_NO_FONT = Font((500.0,) * 256, 500.0, 500.0)


class Place(NamedTuple):
    """How text is set: its font, size, spacing between glyphs and behind spaces, width, rise, matrix, and the page's corner."""

    font: Font
    size: float
    between: float
    behind: float
    wide: float
    rise: float
    matrix: Matrix
    left: float
    top: float

    def plain(self) -> bool:
        """Whether glyphs go from left to right without gaps, so that they needn't be placed one by one."""
        a, b, c = self.matrix[:3]
        return b == c == self.between == self.behind == 0 and a > 0 and self.wide > 0 and self.size > 0 and self.font.least > 0

    def edges(self) -> tuple[float, float]:
        """The upper and the lower edge of plain text."""
        (_, _, _, d, _, y), rise, size = self.matrix, self.rise, self.size
        low, high = sorted(((rise - 0.2 * size) * d, (rise + 0.8 * size) * d))
        return self.top - y - high, self.top - y - low


class Shown(NamedTuple):
    """One operator that shows text: where it stands in the content, what it is, its strings and numbers, and their place."""

    start: int
    end: int
    before: bytes
    pieces: list
    place: Place

    def glyphs(self) -> list[Glyph]:
        return _glyphs(self.pieces, self.place)


class Piece(NamedTuple):
    """A string of plain text: its line, its left edge, its edges, the points of a thousandth of its font, and the font."""

    line: int
    codes: bytes
    x: float
    y0: float
    y1: float
    unit: float
    font: Font


class Word(NamedTuple):
    line: int
    text: str
    x0: float
    y0: float
    x1: float
    y1: float


def _parsed(data: bytes) -> Any:
    """The value that stands in data: dictionaries and arrays as such, references as Ref, all else as it is written.
    Short ones are mostly those of the file before; no one changes them."""
    return _short(data) if len(data) <= 512 else _read(data)


def _read(data: bytes) -> Any:
    stack: list[list] = [[]]
    for m in _TOKEN.finditer(data):
        t = m[0]
        if t in (b"<<", b"["):
            stack.append([])
        elif t in (b">>", b"]") and len(stack) > 1:
            items = stack.pop()
            stack[-1].append({k[1:].decode("latin-1"): v for k, v in zip(items[::2], items[1::2]) if isinstance(k, bytes)} if t == b">>" else items)
        elif t == b"R" and len(stack[-1]) > 1:
            del stack[-1][-1]
            stack[-1][-1] = Ref(int(stack[-1][-1]))
        elif t[:1] != b"%":
            stack[-1].append(t)
    return stack[0][0] if stack[0] else {}


_short = lru_cache(4096)(_read)


def _written(value: Any) -> bytes:
    if isinstance(value, Ref):
        return b"%d 0 R" % value.number
    if isinstance(value, dict):
        return b"<< %s >>" % b" ".join(b"/" + k.encode("latin-1") + b" " + _written(v) for k, v in value.items())
    return b"[ %s ]" % b" ".join(map(_written, value)) if isinstance(value, list) else value


class File:
    """The objects of a file, by number; the last of a number counts."""

    def __init__(self, content: bytes) -> None:
        if re.search(rb"/Encrypt\b\s*(?:\d+\s+\d+\s+R|<<)", content):
            raise ValueError("the file is encrypted")
        self.values: dict[int, Any] = {}
        self.known: dict[int, Font] = {}
        self.streams: dict[int, bytes] = {}
        at = 0
        while m := _START.search(content, at):
            stop = _BODY_END.search(content, m.end())
            if not stop:
                break
            number, value, at = int(m[1]), _parsed(content[m.end() : stop.start()]), stop.end()
            self.values[number] = value
            self.streams.pop(number, None)
            if stop[0] != b"endobj":
                size = value.get("Length", b"") if isinstance(value, dict) else b""
                until = at + int(size) if isinstance(size, bytes) and size.isdigit() else -1
                if until < 0 or not content[until : until + 12].lstrip().startswith(b"endstream"):
                    until = content.find(b"endstream", at)
                    until = len(content) if until < 0 else until
                self.streams[number], at = content[at:until], until
                if isinstance(value, dict) and value.get("Type") == b"/ObjStm":
                    self._unpack(number, value)

    def _unpack(self, number: int, value: dict) -> None:
        data, first = self.data(number), int(value["First"])
        heads = [int(n) for n in data[:first].split()]
        ends = [*heads[3::2], len(data) - first]
        for n, a, b in zip(heads[::2], heads[1::2], ends):
            self.values[n] = _parsed(data[first + a : first + b])
            self.streams.pop(n, None)

    def get(self, value: Any) -> Any:
        return self.values.get(value.number, {}) if isinstance(value, Ref) else value

    def data(self, number: int) -> bytes:
        raw = self.streams.get(number, b"")
        kind = self.get(self.values[number].get("Filter", [])) if raw else []
        if kind not in ([], b"/FlateDecode", [b"/FlateDecode"]):
            raise ValueError(f"content with the filter {kind!r}")
        return zlib.decompressobj().decompress(raw) if kind else raw

    def pages(self) -> list[int]:
        """The numbers of the page objects, in the order of the page tree, or of their numbers if there is none."""
        is_a = lambda v, kind: isinstance(v, dict) and v.get("Type") == kind
        out, seen = [], set()
        roots = [v["Pages"] for v in self.values.values() if is_a(v, b"/Catalog") and isinstance(v.get("Pages"), Ref)]
        todo = [roots[-1]] if roots else []
        while todo:
            ref = todo.pop()
            if ref.number in seen:
                continue
            seen.add(ref.number)
            node = self.get(ref)
            if is_a(node, b"/Page"):
                out.append(ref.number)
            todo += [k for k in reversed(self.get(node.get("Kids", [])) or []) if isinstance(k, Ref)]
        return out or sorted(n for n, v in self.values.items() if is_a(v, b"/Page"))

    def inherited(self, page: int, key: str) -> Any:
        node = self.values[page]
        for _ in range(64):  # deeper trees are broken ones
            if key in node:
                return self.get(node[key])
            node = self.get(node.get("Parent", {}))
        return None

    def content(self, page: int) -> bytes:
        part = self.values[page].get("Contents", [])
        if isinstance(part, Ref) and part.number not in self.streams:
            part = self.get(part)
        parts = part if isinstance(part, list) else [part]
        return b"\n".join(self.data(p.number) for p in parts if isinstance(p, Ref))

    def size(self, page: int) -> tuple[float, float]:
        """The left and the upper edge of a page."""
        box = self.inherited(page, "MediaBox") or [b"0", b"0", b"612", b"792"]
        xs, ys = [float(box[0]), float(box[2])], [float(box[1]), float(box[3])]
        return min(xs), max(ys)

    def fonts(self, page: int) -> dict[bytes, Font]:
        """By name; a page's fonts are mostly those of the page before."""
        fonts = self.get((self.inherited(page, "Resources") or {}).get("Font", {})) or {}
        return {b"/" + name.encode("latin-1"): self._font(ref) for name, ref in fonts.items()}

    def _font(self, ref: Any) -> Font:
        if isinstance(ref, Ref) and ref.number in self.known:
            return self.known[ref.number]
        font = self.get(ref) or {}
        widths = [float(self.get(w)) for w in self.get(font.get("Widths", [])) or []]
        other = float((self.get(font.get("FontDescriptor", {})) or {}).get("MissingWidth", 600 if b"Courier" in font.get("BaseFont", b"") else 500))
        first = int(font.get("FirstChar", 0))
        all_widths = tuple(widths[code - first] if first <= code < first + len(widths) else other for code in range(256)) if widths else (other,) * 256
        made = Font(all_widths, min(all_widths), max(all_widths))
        if isinstance(ref, Ref):
            self.known[ref.number] = made
        return made

    def shown(self, page: int, data: bytes) -> Iterator[Shown]:
        left, top = self.size(page)
        return _shown(data, self.fonts(page), left, top)


def _times(a: Matrix, b: Matrix) -> Matrix:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


def _string(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


def _shown(data: bytes, fonts: dict, left: float, top: float) -> Iterator[Shown]:
    """What a page's content shows, operator by operator."""
    state: dict[str, Any] = {"ctm": _ONE, "font": _NO_FONT, "size": 10.0, "Tc": 0.0, "Tw": 0.0, "Tz": 100.0, "TL": 0.0, "Ts": 0.0}
    saved: list[dict] = []
    tm = line = _ONE
    operands: list = []
    array: list | None = None
    start = -1
    for m in _TOKEN.finditer(data):
        t = m[0]
        start = m.start() if start < 0 else start
        if t == b"[":
            array = []
        elif t == b"]":
            operands.append(array or [])
            array = None
        elif t[:1] in b"(<" and t[:2] != b"<<":
            (operands if array is None else array).append(_string(t))
        elif t[:1] in b"+-.0123456789":
            (operands if array is None else array).append(float(t))
        elif t[:1] == b"/" or t in (b"<<", b">>"):
            operands.append(t)
        elif t[:1] != b"%":
            numbers = [o for o in operands if isinstance(o, float)]
            if t == b"q":
                saved.append(dict(state))
            elif t == b"Q" and saved:
                state = saved.pop()
            elif t == b"cm" and len(numbers) == 6:
                state["ctm"] = _times(tuple(numbers), state["ctm"])
            elif t == b"BT":
                tm = line = _ONE
            elif t == b"Tf" and numbers:
                state["size"] = numbers[-1]
                state["font"] = fonts.get(next((o for o in operands if isinstance(o, bytes)), b""), _NO_FONT)
            elif t in (b"Tc", b"Tw", b"Tz", b"TL", b"Ts") and numbers:
                state[t.decode()] = numbers[-1]
            elif t in (b"Td", b"TD") and len(numbers) == 2:
                if t == b"TD":
                    state["TL"] = -numbers[1]
                tm = line = _times((1.0, 0.0, 0.0, 1.0, *numbers), line)
            elif t == b"Tm" and len(numbers) == 6:
                tm = line = tuple(numbers)
            elif t == b"T*" or t in (b"'", b'"'):
                if t == b'"' and len(numbers) == 2:
                    state["Tw"], state["Tc"] = numbers
                tm = line = _times((1.0, 0.0, 0.0, 1.0, 0.0, -state["TL"]), line)
            if t in (b"Tj", b"TJ", b"'", b'"') and operands:
                pieces = operands[-1] if isinstance(operands[-1], list) else operands[-1:]
                place = Place(state["font"], state["size"], state["Tc"], state["Tw"], state["Tz"] / 100, state["Ts"], _times(tm, state["ctm"]), left, top)
                tm = _times((1.0, 0.0, 0.0, 1.0, sum(_step(p, place) for p in pieces), 0.0), tm)
                before = b"" if t[:1] == b"T" else b"T* " if t == b"'" else b"%f Tw %f Tc T* " % (state["Tw"], state["Tc"])
                yield Shown(start, m.end(), before, pieces, place)
            operands, array, start = [], None, -1


def _step(piece: bytes | float, place: Place) -> float:
    """How far a string, or a number between strings, moves along the baseline."""
    if isinstance(piece, float):
        return -piece / 1000 * place.size * place.wide
    width = place.font.width(piece) / 1000 * place.size
    return (width + len(piece) * place.between + piece.count(b" ") * place.behind) * place.wide


def _glyphs(pieces: list, place: Place) -> list[Glyph]:
    font, size, between, behind, wide, rise, (a, b, c, d, x, y), left, top = place
    # A box is the sum of a step along the baseline and one across it, so its edges are sums too.
    across_x, across_y = sorted(((rise - 0.2 * size) * c, (rise + 0.8 * size) * c)), sorted(((rise - 0.2 * size) * d, (rise + 0.8 * size) * d))
    tall, out = max(math.hypot(c, d) * abs(size), 1e-6), []
    for p, piece in enumerate(pieces):
        if isinstance(piece, float):
            step = _step(piece, place)
            x, y = x + step * a, y + step * b
            continue
        for k, (code, char) in enumerate(zip(piece, piece.decode("cp1252", "replace"), strict=True)):
            width = font.widths[code] / 1000 * size
            dx, dy = width * wide * a, width * wide * b
            box = (x + min(0.0, dx) + across_x[0] - left, top - y - max(0.0, dy) - across_y[1], x + max(0.0, dx) + across_x[1] - left, top - y - min(0.0, dy) - across_y[0])
            advance = width + between + (behind if code == 32 else 0.0)
            out.append(Glyph(char, box, p, k, advance, (x, y), (x + dx, y + dy), tall))
            step = advance * wide
            x, y = x + step * a, y + step * b
    return out


def _runs(glyphs: Iterator[Glyph]) -> Iterator[tuple[Glyph, bool, bool]]:
    """Each glyph, whether it begins a line, and whether it stands apart from the one before, along their baseline."""
    last: Glyph | None = None
    for g in glyphs:
        along = aside = 0.0
        if last is not None and g.begin != last.end:
            dx, dy = g.begin[0] - last.end[0], g.begin[1] - last.end[1]
            ux, uy = g.end[0] - g.begin[0], g.end[1] - g.begin[1]
            wide = math.hypot(ux, uy) or 1.0
            along, aside = (dx * ux + dy * uy) / wide, abs(dx * uy - dy * ux) / wide
        new = last is None or aside > g.tall / 2 or along < -g.tall
        yield g, new, not new and along > g.tall / 4
        last = g


def plain_pieces(shown: list[Shown]) -> list[Piece] | None:
    """The strings of a page if all are plain and none goes on with a word of the one before; else None.

    Lines and gaps are those of _runs(): between glyphs of one string there are none."""
    out: list[Piece] = []
    line, end, level = 0, 0.0, 0.0
    for s in shown:
        place = s.place
        if not place.plain():
            return None
        a, _, _, d, x, y = place.matrix
        tall, unit = max(abs(d) * place.size, 1e-6), place.size * place.wide * a / 1000
        y0, y1 = place.edges()
        for p in s.pieces:
            if isinstance(p, float):
                x -= p * unit
            elif p:
                along = x - end
                new = not out or abs(y - level) > tall / 2 or along < -tall
                if not new and along <= tall / 4 and out[-1].codes[-1] != 32 and p[0] != 32:
                    return None
                line += new
                out.append(Piece(line, p, x - place.left, y0, y1, unit, place.font))
                x += place.font.width(p) * unit
                end, level = x, y
    return out


def simple_pieces(data: bytes, fonts: dict[bytes, Font], left: float, top: float) -> list[Piece] | None:
    """plain_pieces() of content that is made of _SIMPLE alone, without a look at each of its signs; None of any other."""
    out: list[Piece] = []
    at, line, end, level = 0, 0, 0.0, 0.0
    while m := _SIMPLE.match(data, at):
        at = m.end()
        if m[1] is None:
            continue
        codes = m[5][1:-1] if b"\\" not in m[5] else _string(m[5])
        font, size, x, y = fonts.get(m[1], _NO_FONT), float(m[2]), float(m[3]), float(m[4])
        if size <= 0 or font.least <= 0:
            return None
        if not codes:
            continue
        tall, unit, along = max(size, 1e-6), size / 1000, x - end
        new = not out or abs(y - level) > tall / 2 or along < -tall
        if not new and along <= tall / 4 and out[-1].codes[-1] != 32 and codes[0] != 32:
            return None
        line += new
        out.append(Piece(line, codes, x - left, top - y - 0.8 * size, top - y + 0.2 * size, unit, font))
        end, level = x + font.width(codes) * unit, y
    return None if data[at:].strip() else out


class Laid(NamedTuple):
    """Words of many pages as arrays: each one's page (by its number among them), line, box and number of characters, the UTF-8
    bytes of all words and where each begins there."""

    page: np.ndarray
    line: np.ndarray
    boxes: np.ndarray
    sizes: np.ndarray
    text: bytes
    starts: np.ndarray

    def sizes_of_bytes(self) -> np.ndarray:
        return np.diff(self.starts)


def lay(pages: list[list[Piece]]) -> Laid:
    """The words of pages of plain pieces, all at once."""
    pieces = [p for page in pages for p in page]
    codes = np.frombuffer(b"".join(p.codes for p in pieces), np.uint8)
    sizes = np.array([len(p.codes) for p in pieces], np.int64)
    firsts = np.cumsum(sizes) - sizes
    unit = np.array([p.unit for p in pieces])
    some = codes != 32
    edge = np.zeros(len(codes), bool)
    edge[firsts] = True
    begin = np.flatnonzero(some & (edge | np.r_[True, ~some[:-1]]))
    last = np.flatnonzero(some & np.r_[edge[1:] | ~some[1:], True]) if len(codes) else begin
    of = np.searchsorted(firsts, begin, "right") - 1
    left, right = begin - firsts[of], last + 1 - firsts[of]
    if all(f.least == f.most for f in {id(p.font): p.font for p in pieces}.values()):
        wide = np.array([p.font.most for p in pieces])[of]
        left, right = left * wide, right * wide
    else:
        tables: dict[Font, int] = {}
        font = np.array([tables.setdefault(p.font, len(tables)) for p in pieces], np.int64)
        before = np.r_[0.0, np.cumsum(np.array([f.widths for f in tables])[np.repeat(font, sizes), codes])]
        left, right = before[begin] - before[firsts[of]], before[last + 1] - before[firsts[of]]
    x = np.array([p.x for p in pieces])
    x0, x1 = x[of] + left * unit[of], x[of] + right * unit[of]
    box = np.round(np.stack([x0, np.array([p.y0 for p in pieces])[of], x1, np.array([p.y1 for p in pieces])[of]]), 3) if len(of) else np.zeros((4, 0))
    lengths = last + 1 - begin
    kept = codes[some]
    text, starts = kept.tobytes(), np.r_[0, np.cumsum(lengths)].astype(np.int64)
    if not text.isascii():
        text, starts = text.decode("cp1252", "replace").encode(), np.r_[0, np.cumsum(_WIDE[kept])].astype(np.int64)[starts]
    page = np.repeat(np.arange(len(pages)), [len(p) for p in pages])[of]
    line = np.array([p.line for p in pieces], np.int32)[of]
    return Laid(page, line, box, lengths, text, starts)


def laid(words: list[Word]) -> Laid:
    """The words of one page in the form of lay()."""
    texts = [w.text.encode() for w in words]
    starts = np.cumsum([0, *map(len, texts)])
    return Laid(np.zeros(len(words), np.int64), np.array([w.line for w in words], np.int32), np.array([w[2:] for w in words], float).reshape(-1, 4).T, np.array([len(w.text) for w in words], np.int64), b"".join(texts), starts)


def words(file: File, page: int) -> list[Word]:
    """The words of a page in the order in which it shows them. Columns beside each other are lines of their own
    if one is shown after the other."""
    shown = list(file.shown(page, file.content(page)))
    plain = plain_pieces(shown)
    return single_words(shown) if plain is None else laid_words(lay([plain]))


def laid_words(found: Laid) -> list[Word]:
    texts = (found.text[a:b].decode() for a, b in zip(found.starts[:-1].tolist(), found.starts[1:].tolist()))
    return [Word(*w) for w in zip(found.line.tolist(), texts, *found.boxes.tolist())]


def single_words(shown: list[Shown]) -> list[Word]:
    """Words of text that is set in any way, glyph by glyph."""
    out: list[Word] = []
    line, chars, box = 0, [], (0.0, 0.0, 0.0, 0.0)

    def close() -> None:
        if chars:
            out.append(Word(line, "".join(chars), *(round(v, 3) for v in box)))
            chars.clear()

    for g, new, apart in _runs(g for s in shown for g in s.glyphs()):
        if new or apart or g.char == " ":
            close()
        line += new
        if g.char != " ":
            box = (min(box[0], g.box[0]), min(box[1], g.box[1]), max(box[2], g.box[2]), max(box[3], g.box[3])) if chars else g.box
            chars.append(g.char)
    close()
    return out


def pages(content: bytes) -> list[str]:
    """The text of each page, a line for each line shown."""
    file = File(content)
    texts = []
    for page in file.pages():
        glyphs = (g for s in file.shown(page, file.content(page)) for g in s.glyphs())
        texts.append("".join("\n" * new + " " * apart + g.char for g, new, apart in _runs(glyphs)).removeprefix("\n"))
    return texts


def _covered(box: Box, boxes: list[Box]) -> bool:
    return any(min(box[2], b[2]) - max(box[0], b[0]) > 0.01 and min(box[3], b[3]) - max(box[1], b[1]) > 0.01 for b in boxes)


def _hull(s: Shown) -> Box | None:
    """The box of all glyphs of one plain string."""
    if len(s.pieces) != 1 or not isinstance(s.pieces[0], bytes) or not s.place.plain():
        return None
    (a, *_, x, _), (y0, y1) = s.place.matrix, s.place.edges()
    return x - s.place.left, y0, x - s.place.left + _step(s.pieces[0], s.place) * a, y1


def _blacked(file: File, page: int, boxes: list[Box]) -> bytes:
    """A page's content without the glyphs that boxes cover, whose room stays, and with the boxes drawn over it."""
    # Marked content may name its text once more; its properties go.
    data = re.sub(rb"(/[^\s()<>\[\]{}/%]+)\s*(?:/[^\s()<>\[\]{}/%]+|<<(?:[^<>()]|" + _STRING + rb"|<[0-9A-Fa-f\s]*>)*>>)\s*BDC\b", rb"\1 BMC", file.content(page))
    out, at = [b"q\n"], 0
    for s in file.shown(page, data) if boxes else ():
        if (whole := _hull(s)) and not _covered(whole, boxes):
            continue
        gone = {(g.piece, g.at): g.advance for g in s.glyphs() if _covered(g.box, boxes)}
        if not gone:
            continue
        parts = []
        for p, piece in enumerate(s.pieces):
            if isinstance(piece, float):
                parts.append(b"%f" % piece)
                continue
            for k in range(len(piece)):
                away = gone.get((p, k))
                parts.append(b"<%02x>" % piece[k] if away is None else b"%f" % (-away * 1000 / (s.place.size or 1.0)))
        out += [data[at : s.start], s.before, b"[", b" ".join(parts), b"] TJ"]
        at = s.end
    left, top = file.size(page)
    drawn = [b"%f %f %f %f re f\n" % (left + b[0], top - b[3], b[2] - b[0], b[3] - b[1]) for b in boxes]
    return b"".join([*out, data[at:], b"\nQ\nq 0 g\n", *drawn, b"Q"])


def without(content: bytes, boxes: dict[int, list[Box]]) -> bytes:
    """A new file without what stands in boxes (by page, from 1). Black boxes take its place.

    It has the pages, what they draw and their fonts, and nothing else of the old one: no older states of the file,
    notes, forms to fill in, outline, tags or facts about the document. A page with boxes that draws a form with text is an
    error, as that text isn't read.
    """
    file = File(content)
    kept: dict[int, Any] = {}
    streams: dict[int, bytes] = {}
    last = max(file.values, default=0)
    order = file.pages()
    tree = last + len(order) + 1
    for number, page in enumerate(order, 1):
        resources = dict(file.inherited(page, "Resources") or {})
        resources.pop("Properties", None)
        for form in (file.get(resources.get("XObject", {})) or {}).values() if boxes.get(number) else ():
            if isinstance(form, Ref) and (file.get(form) or {}).get("Subtype") == b"/Form" and re.search(rb"\bT[jJ]\b", file.data(form.number)):
                raise ValueError(f"page {number} draws a form with text")
        last += 1
        streams[last] = zlib.compress(_blacked(file, page, boxes.get(number, [])), 1)  # less effort, half the time
        kept[last] = {"Length": b"%d" % len(streams[last]), "Filter": b"/FlateDecode"}
        plain = {k: v for k, v in file.values[page].items() if k not in _ASIDE}
        box = file.inherited(page, "MediaBox") or [b"0", b"0", b"612", b"792"]
        kept[page] = plain | {"Contents": Ref(last), "Resources": resources, "MediaBox": box, "Parent": Ref(tree)}
    kept[tree] = {"Type": b"/Pages", "Kids": [Ref(p) for p in order], "Count": b"%d" % len(order)}
    kept[tree + 1] = {"Type": b"/Catalog", "Pages": Ref(tree)}
    todo = [v for n in order for v in kept[n].values()]
    while todo:
        value = todo.pop()
        if isinstance(value, Ref) and value.number not in kept and value.number in file.values:
            found = file.values[value.number]
            if isinstance(found, dict):
                found = {k: v for k, v in found.items() if k not in ("Metadata", "PieceInfo")}
            kept[value.number] = found
            if value.number in file.streams:
                streams[value.number] = file.streams[value.number]
                kept[value.number] = found | {"Length": b"%d" % len(streams[value.number])}
            todo.append(found)
        elif isinstance(value, dict):
            todo += value.values()
        elif isinstance(value, list):
            todo += value
    return _assembled({n: _written(v) + (b"\nstream\n%s\nendstream" % streams[n] if n in streams else b"") for n, v in kept.items()}, tree + 1)


def _assembled(objects: dict[int, bytes], root: int) -> bytes:
    out, rows = bytearray(b"%PDF-1.5\n"), {0: b"0000000000 65535 f \n"}
    for n, body in sorted(objects.items()):
        rows[n] = b"%010d 00000 n \n" % len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at, most = len(out), max(rows)
    out += b"xref\n0 %d\n" % (most + 1) + b"".join(rows.get(n, rows[0]) for n in range(most + 1))
    out += b"trailer\n<< /Size %d /Root %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (most + 1, root, at)
    return bytes(out)


def document(text: str, lines: int = 60, mask: str = "█", deflate: bool = False) -> bytes:
    """A PDF of text, a page for so many lines. Runs of the mask are drawn as black boxes and hold no text."""
    rows = text.split("\n")
    blocks = [rows[at : at + lines] for at in range(0, len(rows), lines)]
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(blocks))), len(blocks))}
    objects[3] = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"
    for i, block in enumerate(blocks):
        drawn = []
        for k, row in enumerate(block):
            y = 800 - 12 * k
            for m in re.finditer(re.escape(mask) + "+", row):
                drawn.append(b"%.1f %d %.1f 10 re f" % (40 + 6 * m.start(), y - 2, 6.0 * (m.end() - m.start())))
            shown = row.replace(mask, " ").encode("cp1252", "replace")
            shown = re.sub(rb"([()\\])", rb"\\\1", shown).replace(b"\r", b"\\r")
            drawn.append(b"BT /F1 10 Tf 40 %d Td (%s) Tj ET" % (y, shown))
        stream = b"\n".join(drawn)
        stream, kind = (zlib.compress(stream, 1), b" /Filter /FlateDecode") if deflate else (stream, b"")
        objects[4 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 842 842] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % (5 + 2 * i)
        objects[5 + 2 * i] = b"<< /Length %d%s >>\nstream\n%s\nendstream" % (len(stream), kind, stream)
    return _assembled(objects, 1)
