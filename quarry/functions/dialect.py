"""A text pass in front of spark.sql for spellings that Spark's parser does not take."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Quoted strings and comments, which stay as they are.
_OPAQUE = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", re.S)
_RULES = [
    (re.compile(r"\bto_timestamp_seconds\s*\(", re.I), "timestamp_seconds("),
    (re.compile(r"(\binterval\s+\x00\d+\x00\s+(?:year|month|day|hour|minute|second))\s*\(\s*\d+\s*\)", re.I), r"\1"),
]
_SCAN = re.compile(r"\b(parquet|json|csv|orc)_scan\s*\(\s*(\x00\d+\x00)\s*\)", re.I)


def rewrite(text: str) -> str:
    """Leading interval precision, `to_timestamp_seconds` and `parquet_scan('f')` and its like in Spark's spelling."""
    kept: list[str] = []

    def hide(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    out = _OPAQUE.sub(hide, text)
    for rule, to in _RULES:
        out = rule.sub(to, out)
    out = _SCAN.sub(lambda m: f"{m[1].lower()}.`{kept[int(m[2].strip(chr(0)))][1:-1]}`", out)
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])], out)


def sql(spark: SparkSession, text: str, **args) -> DataFrame:
    return spark.sql(rewrite(text), args=args or None)


def split_statements(script: str) -> list[str]:
    """Statements of a script, parted by semicolons outside strings and comments."""
    out, last = [], 0
    spans = [m.span() for m in _OPAQUE.finditer(script)]
    for m in re.finditer(";", script):
        if not any(a <= m.start() < b for a, b in spans):
            out.append(script[last : m.start()])
            last = m.end()
    return [s.strip() for s in [*out, script[last:]] if s.strip()]
