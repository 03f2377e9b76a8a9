"""Python regular expressions as the JVM's.

A pattern is translated and matched in the JVM; one that has no equivalent, or
that either side's compiler refuses, is matched by Python in a pandas UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Untranslatable(ValueError):
    """A construct without a JVM equivalent."""


def translate(pattern: str) -> str:
    """The JVM pattern that matches the same strings, without flags or anchors of its own."""
    re.compile(pattern)
    out, i, inside = [], 0, 0  # inside: where a class's first member stands
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            following = pattern[i + 1]
            if following == "Z" and not inside:
                out.append("\\z")
            elif following in "zGXRQEhHKkNpP" and following.isalpha():
                raise Untranslatable(pattern)
            elif following in "vV":
                out.append("\\x0B" if following == "v" else "V")
            else:
                out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "]" and i > inside:
                inside = 0
                out.append("]")
            elif c == "[":
                out.append("\\[")
            elif c == "]":
                out.append("\\]")
            elif c in "&^":
                out.append("\\" + c)
            else:
                out.append(c)
            i += 1
            continue
        if c == "[":
            i += 1
            out.append("[")
            if i < len(pattern) and pattern[i] == "^":
                out.append("^")
                i += 1
            inside = i
            if i < len(pattern) and pattern[i] == "]":
                out.append("\\]")
                i += 1
            continue
        if pattern.startswith("(?P<", i):
            name, rest = pattern[i + 4 :].split(">", 1)
            out.append(f"(?<{_group(name)}>")
            i = len(pattern) - len(rest)
            continue
        if pattern.startswith("(?P=", i):
            name, rest = pattern[i + 4 :].split(")", 1)
            out.append(f"\\k<{_group(name)}>")
            i = len(pattern) - len(rest)
            continue
        if pattern.startswith("(?#", i):
            i = pattern.index(")", i) + 1
            continue
        if pattern.startswith("(?(", i):
            raise Untranslatable(pattern)
        flags = re.match(r"\(\?([aiLmsux]+)(-[ims]+)?([:)])", pattern[i:])
        if flags:
            if set(flags[1]) & set("aLx"):
                raise Untranslatable(pattern)
            kept = flags[1].replace("u", "")
            out.append(f"(?{kept}{flags[2] or ''}{flags[3]}" if kept or flags[2] or flags[3] == ":" else "")
            i += flags.end()
            continue
        out.append(c)
        i += 1
    return "".join(out)


def _group(name: str) -> str:
    """JVM group names have letters and digits only."""
    safe = re.sub(r"[^A-Za-z0-9]", lambda m: f"x{ord(m[0]):x}", name)
    return safe if safe[0].isalpha() else f"g{safe}"


def quoted(text: str) -> str:
    """A JVM pattern for the text itself."""
    return re.sub(r"([^A-Za-z0-9_\s])", r"\\\1", text)


def replacement(template: str) -> str:
    """Python's replacement template as the JVM's: groups by number or name."""
    out = template.replace("$", r"\$")
    out = re.sub(r"\\g<(\w+)>", lambda m: f"${m[1]}" if m[1].isdigit() else "${" + _group(m[1]) + "}", out)
    return re.sub(r"\\(\d)", r"$\1", out)


def _jvm_accepts(pattern: str) -> bool:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    jvm = getattr(spark, "_jvm", None)
    if jvm is None:
        return True
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except Exception:
        return False
    return True


def matches(column: Column, pattern: str, mode: str = "match", ignore_case: bool = False) -> Column:
    """Python's re.match, re.fullmatch or re.search against a text column; null where the text is null."""
    try:
        core = translate(pattern)
        prefix = "(?dUi)" if ignore_case else "(?dU)"
        jvm = prefix + {"match": rf"\A(?:{core})", "fullmatch": rf"\A(?:{core})\z", "search": f"(?:{core})"}[mode]
        if re.search(r"\(\?[imsu]+\)", core):  # flags for a whole pattern would end with our group
            raise Untranslatable(pattern)
        if _jvm_accepts(jvm):
            return column.rlike(jvm)
    except (Untranslatable, IndexError):
        pass
    return _in_python(pattern, mode, ignore_case)(column)


def _in_python(pattern: str, mode: str, ignore_case: bool):
    re.compile(pattern)

    @F.pandas_udf("boolean")
    def match(texts: pd.Series) -> pd.Series:
        test = getattr(re.compile(pattern, re.IGNORECASE if ignore_case else 0), mode)
        return texts.map(lambda t: None if t is None or t != t else test(t) is not None).astype("boolean")

    return match
