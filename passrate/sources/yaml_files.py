"""YAML files of rule sets and of named regular expressions."""

from __future__ import annotations

from pathlib import Path
from typing import Any

import yaml


def read(path: str | Path) -> dict[str, Any]:
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no such file: {path}")
    with path.open(encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def read_patterns(path: str | Path) -> dict[str, str]:
    patterns = read(path)
    if not isinstance(patterns, dict) or not all(isinstance(v, str) for v in patterns.values()):
        raise ValueError(f"{path} must hold a name and a text for every regular expression")
    return patterns


def with_patterns(rules: list[dict], patterns: dict[str, str]) -> list[dict]:
    """Rules whose regex_pattern is a name get the pattern of that name."""
    return [r | {"regex_pattern": patterns[r["regex_pattern"]]} if r.get("regex_pattern") in patterns else r for r in rules]


def write(path: str | Path, content: dict[str, Any], overwrite: bool = False) -> None:
    path = Path(path)
    if path.exists() and not overwrite:
        raise FileExistsError(f"{path} exists; overwrite=True replaces it")
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8") as file:
        yaml.safe_dump(content, file, sort_keys=False, allow_unicode=True)
