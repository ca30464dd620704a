"""Configuration and annotation files in the plain part of YAML.

Nested maps and lists by indentation, scalars with or without quotes, inline lists and maps, and
comments; anchors, tags and block text aren't read.  Where a YAML library is installed it is used instead.
"""

from __future__ import annotations

import json
import re
from typing import Any

_NUMBER = re.compile(r"[-+]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][-+]?[0-9]+)?\Z")
_WORDS = {"": None, "~": None, "null": None, "true": True, "false": False, "yes": True, "no": False}


def load(text: str) -> Any:
    """The value of a document."""
    try:
        import yaml
    except ImportError:
        lines = [(len(s) - len(s.lstrip()), s.strip()) for s in map(_bare, text.splitlines()) if s.strip() and s.strip() != "---"]
        return _block(lines, 0, lines[0][0])[0] if lines else None
    return yaml.safe_load(text)


def _bare(line: str) -> str:
    """A line without its comment."""
    quote = ""
    for i, c in enumerate(line):
        if quote:
            quote = "" if c == quote and line[i - 1] != "\\" else quote
        elif c in "'\"" and (not i or line[i - 1] in " :-[{,"):
            quote = c
        elif c == "#" and (not i or line[i - 1] == " "):
            return line[:i]
    return line


def _block(lines: list[tuple[int, str]], at: int, indent: int) -> tuple[Any, int]:
    """The map or list whose entries stand at indent, and the line after it."""
    out: Any = [] if lines[at][1].startswith("-") and lines[at][1][1:2] in ("", " ") else {}
    while at < len(lines) and lines[at][0] == indent:
        body = lines[at][1]
        if isinstance(out, list):
            if not (body == "-" or body.startswith("- ")):
                break
            rest = body[1:].strip()
            if rest and _key(rest):  # a map that starts on the dash's line
                lines = [*lines[:at], (indent + len(body) - len(body[1:].lstrip()), rest), *lines[at + 1 :]]
                value, at = _block(lines, at, lines[at][0])
            elif rest:
                value, at = scalar(rest), at + 1
            else:
                value, at = _below(lines, at, indent)
            out.append(value)
        else:
            key = _key(body)
            if not key:
                raise ValueError(f"no key in {body!r}")
            rest = body[key.end() :].strip()
            name = scalar(key[1].strip())
            if rest:
                out[name], at = scalar(rest), at + 1
            else:
                out[name], at = _below(lines, at, indent, same=True)
    return out, at


def _key(body: str) -> re.Match | None:
    return re.match(r"(\"[^\"]*\"|'[^']*'|[^\s\[{\"'][^:]*?)\s*:(?=\s|\Z)", body)


def _below(lines: list[tuple[int, str]], at: int, indent: int, same: bool = False) -> tuple[Any, int]:
    """What is nested under line at; a list may stand at its key's own indent."""
    after = at + 1
    if after < len(lines) and (lines[after][0] > indent or (same and lines[after][0] == indent and lines[after][1].startswith("- "))):
        return _block(lines, after, lines[after][0])
    return None, after


def scalar(text: str) -> Any:
    if text[:1] == '"':
        return json.loads(text)
    if text[:1] == "'":
        return text[1:-1].replace("''", "'")
    if text[:1] in "[{":
        return _inline(text)
    if text.lower() in _WORDS:
        return _WORDS[text.lower()]
    if _NUMBER.match(text):
        return int(text) if text.lstrip("+-").isdigit() else float(text)
    return text


def _inline(text: str) -> Any:
    parts, depth, quote, last = [], 0, "", 1
    for i, c in enumerate(text[1:-1], 1):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "[{":
            depth += 1
        elif c in "]}":
            depth -= 1
        elif c == "," and not depth:
            parts.append(text[last:i].strip())
            last = i + 1
    parts += [text[last:-1].strip()] if text[last:-1].strip() else []
    if text[0] == "[":
        return [scalar(p) for p in parts]
    pairs = [p.partition(":") for p in parts]
    return {scalar(k.strip()): scalar(v.strip()) for k, _, v in pairs}
