"""Encoding texts with a public tokenizer, word by word.

The tokenizers library spends most of its time on pre-tokenizing and on bookkeeping for each
word, and the words of a corpus repeat.  Here a text is cut where its tokenizer surely cuts
too, each distinct piece goes to the library's own model once in a worker (until a bounded
cache is emptied), and a document is a join of what the pieces gave.  A text with any
character for which that isn't certain is encoded by the library as a whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

#: Entries that a worker keeps, of words as written and of pieces as the model gets them; a full
#: cache is emptied.
WORDS, RUNS = 400_000, 800_000

#: Characters that Python, but not the tokenizers' patterns, count as white space.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

#: Letters whose lower case is one letter by any rule, which are in composed form already.
_PLAIN = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
_PLAIN_WORD = re.compile(rf"([{_PLAIN}]+)([.,;:!?)\-]*)\Z")
_SURE_CUT = re.compile(r" (?!\S)")


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level tokenizers write for each byte: those that print
    stand for themselves, the others follow from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Cache(dict):
    """A dict that works out missing entries, and starts anew when it is full."""

    def __init__(self, make, most):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.make(key)
        return out


class Encoder:
    """Texts to token ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # Strings of special tokens in a text are ordinary text.
        self.whole.encode_special_tokens = True
        self.vocabulary = self.whole.get_vocab_size()
        self.model = self.whole.model
        letters = byte_letters()
        self.letters = {b: letters[b] for b in range(256)}
        spec = json.loads(self.whole.to_str())
        kind = (spec["pre_tokenizer"] or {}).get("type"), (spec["normalizer"] or {}).get("type")
        self.words = Cache(self._lower_word, WORDS)
        self.firsts, self.spaced = Cache(self._chunk, WORDS), Cache(self._spaced_word, WORDS)
        if kind == ("ByteLevel", None) and not spec["pre_tokenizer"]["add_prefix_space"]:
            import public_tokenizers
            import regex

            self.encode = self._by_spaces
            self.pieces = regex.compile(public_tokenizers.PATTERN)
        elif spec["pre_tokenizer"] and '"Lowercase"' in json.dumps(spec["normalizer"]) and spec["model"].get("end_of_word_suffix"):
            self.encode = self._by_words
        else:
            self.encode = self._all
        self.runs = Cache(self._run, RUNS)

    def _all(self, text: str) -> bytes:
        import numpy as np

        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of what the pre-tokenizer leaves in one piece."""
        if not (run.isascii() and run.isalpha()):
            run = "".join(map(self.letters.__getitem__, run.encode()))
        ids = [t.id for t in self.model.tokenize(run)]
        return struct.pack(f"<{len(ids)}I", *ids)

    # A tokenizer that drops white space and lower-cases: words are independent of each other.
    def _lower_word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self.runs[word.lower()]
        found = _PLAIN_WORD.match(word)
        if found:
            head, tail = found.groups()
            return self.runs[head.lower()] + (self.runs[tail] if tail else b"")
        return self._all(word)

    def _by_words(self, text: str) -> bytes:
        if _ODD_SPACE.search(text) or not unicodedata.is_normalized("NFC", text):
            return self._all(text)
        return b"".join(map(self.words.__getitem__, text.split()))

    # A tokenizer that keeps white space: it always cuts before a space that a word follows.
    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.runs.__getitem__, self.pieces.findall(chunk)))

    def _spaced_word(self, word: str) -> bytes:
        word = " " + word
        return self._run(word) if word.isascii() and word[1:].isalpha() else self._chunk(word)

    def _by_spaces(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self._all(text)
        if _SURE_CUT.search(text):
            return b"".join(map(self.firsts.__getitem__, re.split(r"(?= \S)", text)))
        first, *rest = text.split(" ")
        return self.firsts[first] + b"".join(map(self.spaced.__getitem__, rest))
