"""Nested paths: `a.b[*].c[]`.  `[*]` explodes an array, `[]` takes its first non-null element, `.` enters a struct."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Step:
    name: str
    mark: str  # "", "[*]" or "[]"


def parse(path: str) -> list[Step]:
    steps = []
    for part in path.split("."):
        m = re.fullmatch(r"(.*?)(\[\*\]|\[\])?", part, re.DOTALL)
        steps.append(Step(m[1], m[2] or ""))
    return steps


def is_nested(path: str) -> bool:
    return "." in path or path.endswith(("[*]", "[]"))


def safe_name(path: str) -> str:
    """A flat column name for a path; a flat path is its own."""
    if not is_nested(path):
        return path
    return path.replace("[*]", "_all").replace("[]", "_first").replace(".", "_").strip("_")


def validate(schema: T.StructType, path: str) -> T.DataType:
    """The type a path leads to; ValueError if the schema has no such path."""
    if path in schema.fieldNames():
        kind = schema[path].dataType
        if isinstance(kind, T.ArrayType) and path.endswith(("[*]", "[]")):
            kind = kind.elementType
        return kind
    kind: T.DataType = schema
    for step in parse(path):
        if isinstance(kind, T.MapType):
            kind = kind.valueType
            continue
        if not isinstance(kind, T.StructType):
            raise ValueError(f"'{step.name}' in path '{path}' is looked up in {kind.simpleString()}, which has no fields")
        if step.name not in kind.fieldNames():
            raise ValueError(f"Column '{step.name}' in path '{path}' not found; there are {kind.fieldNames()}")
        kind = kind[step.name].dataType
        if step.mark and not isinstance(kind, T.ArrayType):
            raise ValueError(f"Column '{step.name}' in path '{path}' is no array")
        if not step.mark and isinstance(kind, T.ArrayType):
            raise ValueError(f"Column '{step.name}' in path '{path}' is an array and must end with '[*]' or '[]'")
        if step.mark:
            kind = kind.elementType
    return kind


def prefixes(path: str, marks: tuple[str, ...] = ("[*]", "[]")) -> list[str]:
    """The array prefixes of a path, shallow to deep, each up to and with its mark."""
    out, parts = [], []
    for step in parse(path):
        parts.append(step.name + step.mark)
        if step.mark in marks and step.mark:
            out.append(".".join(parts))
    return out


def exploded(paths: list[str], columns: list[str]) -> frozenset[str]:
    """All array prefixes that the paths explode: rules with equal sets see the same rows."""
    return frozenset(p for path in paths if path not in columns for p in prefixes(path, ("[*]",)))


def check_marks(paths: list[str]) -> None:
    """One array is either exploded or picked from, not both."""
    seen: dict[str, str] = {}
    for path in paths:
        for prefix in prefixes(path):
            base, mark = re.fullmatch(r"(.*?)(\[\*\]|\[\])", prefix, re.DOTALL).groups()
            if seen.setdefault(base, mark) != mark:
                raise ValueError(f"The array '{base}' has both [*] and [] in {paths}")


def flatten_as(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """A frame of the paths under the names given.  Each array prefix is exploded once; siblings multiply."""
    names = df.columns
    check_marks([p for p in wanted if p not in names])
    for path in wanted:
        validate(df.schema, path)
    levels = sorted(exploded(list(wanted), names), key=lambda p: (len(parse(p)), p))
    alias = {p: f"__exploded_{i}" for i, p in enumerate(levels)}

    def reach(path: str, stop_at_array: bool) -> Column:
        if path in names and not stop_at_array:
            return F.col(f"`{path}`")
        steps, parts = parse(path), []
        column: Column | None = None
        for k, step in enumerate(steps):
            parts.append(step.name + step.mark)
            here = ".".join(parts)
            last = k == len(steps) - 1
            if here in alias and not (last and stop_at_array):
                column = F.col(alias[here])
                continue
            column = F.col(f"`{step.name}`") if column is None else column.getItem(step.name)
            if step.mark == "[]":
                column = F.get(F.filter(column, lambda x: x.isNotNull()), F.lit(0))
        return column

    for prefix in levels:
        df = df.select("*", F.explode_outer(reach(prefix, True)).alias(alias[prefix]))
    return df.select(*(reach(path, False).alias(name) for path, name in wanted.items()))


def flatten(df: DataFrame, flatten_cols: list[str]) -> DataFrame:
    """The requested paths under their safe names; the frame as it is when none of them is nested.

    An empty or null array keeps its row with a null.
    """
    if not any(is_nested(p) and p not in df.columns for p in flatten_cols):
        return df
    for path in flatten_cols:
        if path in df.columns and isinstance(df.schema[path].dataType, T.ArrayType):
            raise ValueError(f"Column '{path}' is an array and must end with '[*]' or '[]'")
    return flatten_as(df, {p: safe_name(p) for p in dict.fromkeys(flatten_cols)})
