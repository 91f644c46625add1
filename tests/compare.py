"""Rows of both engines in one form: sorted columns, numbers as floats, dates as text."""

from __future__ import annotations

import decimal

import pandas as pd


def _cell(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, (bool, bytes)):
        return x
    if isinstance(x, (int, float, decimal.Decimal)):
        return float(x)
    s = str(x)
    return s.removesuffix(" 00:00:00") if len(s) == 19 else s


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(map(_cell, r)) for r in df.itertuples(index=False)), key=repr)


def same(a: list[tuple], b: list[tuple]) -> bool:
    """Equal up to a relative 1e-6: the order of a sum can turn the last digit that a rounded number keeps."""
    if len(a) != len(b):
        return False
    return a == b or all(len(x) == len(y) and all(map(_near, x, y)) for x, y in zip(a, b, strict=True))


def _near(u, v) -> bool:
    return u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) <= max(1e-6 * max(abs(u), abs(v)), 1e-9)
