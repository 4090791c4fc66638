"""Thresholds and custom rules from TOML files; what is missing or broken means the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import fields, replace
from pathlib import Path

from loomgraph.operators.analysis import Thresholds


def _load(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text())
    except (OSError, tomllib.TOMLDecodeError, UnicodeDecodeError):
        return {}


def thresholds(folder: str | Path) -> Thresholds:
    found = _load(Path(folder) / "thresholds.toml").get("default", {})
    known = {f.name for f in fields(Thresholds)}
    return replace(Thresholds(), **{k: v for k, v in found.items() if k in known and isinstance(v, (int, float))})


def custom_rules(folder: str | Path) -> list[tuple[str, list[str], str]]:
    """(name, patterns, severity) of every complete rule."""
    rules = _load(Path(folder) / "smells.toml").get("rules", [])
    return [(r["name"], list(r["patterns"]), r["severity"]) for r in rules if isinstance(r, dict) and {"name", "patterns", "severity"} <= r.keys()]
