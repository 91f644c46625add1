"""The query catalog: every query with its oracle."""

from __future__ import annotations

from .registry import Catalog


def catalog() -> Catalog:
    from . import aggregates, benchmarks, decision, extended, functions, joins, more, scans, surface

    out = Catalog()
    for m in (benchmarks, scans, joins, aggregates, functions, more, decision, extended, surface):
        twice = out.keys() & m.C.keys()
        assert not twice, twice
        out.update(m.C)
    return out
