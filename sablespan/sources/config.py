"""Configuration: JSON or YAML files found in one of several places, read once, looked up by dotted keys."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from sablespan.sources import yaml


class Config:
    """A tree of settings. Files are read on first use."""

    def __init__(self, *places: str):
        self.places = [Path(p) for p in places]
        self._trees: dict[str, dict] = {}

    def load(self, name: str) -> dict:
        if name not in self._trees:
            files = (p / f"{name}.{kind}" for p in self.places for kind in ("json", "yaml", "yml"))
            found = next((f for f in files if f.exists()), None)
            if found is None:
                raise FileNotFoundError(f"{name}.json or .yaml in none of {', '.join(map(str, self.places))}")
            self._trees[name] = json.loads(found.read_text()) if found.suffix == ".json" else yaml.load(found.read_text()) or {}
        return self._trees[name]

    def get(self, name: str, key: str, default: Any = None) -> Any:
        """The value at a dotted key, or default."""
        node: Any = self.load(name)
        for part in key.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def missing(self, name: str, required: list[str]) -> list[str]:
        """The required keys that aren't set."""
        absent = object()
        return [k for k in required if self.get(name, k, absent) is absent]

    def report(self, sections: dict[str, list[str]]) -> list[str]:
        """What is wrong with the configuration: files that aren't there, keys that are missing (with the nearest known
        key as a suggestion), and keys that point to files which don't exist."""
        from difflib import get_close_matches

        out = []
        for name, required in sections.items():
            try:
                tree = self.load(name)
            except FileNotFoundError as e:
                out.append(str(e))
                continue
            known = list(_paths(tree))
            for key in self.missing(name, required):
                near = get_close_matches(key, known, 1)
                out.append(f"{name}: no {key}" + (f"; is it {near[0]}?" if near else ""))
            for key in known:
                value = self.get(name, key)
                if key.endswith(("_path", "_file")) and isinstance(value, str) and not Path(value).exists():
                    out.append(f"{name}: {key} names {value}, which doesn't exist")
        return out


def _paths(tree: dict, before: str = ""):
    for k, v in tree.items():
        yield f"{before}{k}"
        if isinstance(v, dict):
            yield from _paths(v, f"{before}{k}.")
