"""A golden harness: replay SQL scripts and compare with recorded results, strictly or by meaning; pass counts may only rise."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..functions.dialect import rewrite, split_statements


@dataclass
class Block:
    sql: str
    schema: str
    rows: list[str]


def run_script(spark: SparkSession, script: str) -> list[Block]:
    """One block for each statement; an error is recorded by its class."""
    out = []
    for s in split_statements(script):
        try:
            df = spark.sql(rewrite(s))
            rows = ["\t".join("NULL" if v is None else str(v) for v in r) for r in df.collect()]
            out.append(Block(s, df.schema.simpleString(), rows if re.search(r"\border\s+by\b", s, re.I) else sorted(rows)))
        except Exception as e:  # noqa: BLE001  some errors come as the JVM's own
            known = e.getCondition() if isinstance(e, PySparkException) else None
            named = re.search(r"\[([A-Z][A-Z_.0-9]+)\]", str(e))
            out.append(Block(s, "struct<>", [known or (named[1] if named else type(e).__name__)]))
    return out


def save(blocks: list[Block], path: Path) -> None:
    path.write_text(json.dumps([b.__dict__ for b in blocks], indent=1))


def compare(blocks: list[Block], path: Path) -> dict[str, int]:
    """Counts of blocks, of equal ones (strict) and of those equal but for number formats (semantic)."""
    want = [Block(**b) for b in json.loads(path.read_text())]
    pairs = [(a, b) for a, b in zip(blocks, want, strict=False) if a.sql == b.sql]
    return {"blocks": len(want), "strict": sum(a == b for a, b in pairs), "semantic": sum(_plain(a) == _plain(b) for a, b in pairs)}


def _plain(b: Block) -> list[str]:
    return [re.sub(r"-?\d+\.\d+(?:E[+-]?\d+)?", lambda m: f"{float(m[0]):.6g}", r) for r in b.rows]


def ratchet(counts: dict[str, int], path: Path) -> None:
    """Fail if a count fell below the recorded one; record it if it rose."""
    old = json.loads(path.read_text()) if path.exists() else {}
    fallen = {k: (old[k], v) for k, v in counts.items() if v < old.get(k, 0)}
    if fallen:
        raise AssertionError(f"fewer blocks pass than recorded: {fallen}")
    path.write_text(json.dumps({**old, **counts}))
