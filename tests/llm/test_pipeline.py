"""The pipeline against its stages worked out in plain Python, and the registration of its queries."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F
from test_pairs_and_lines import LOWER, brute_lines, brute_overlap, shingle_set

SF = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op")] == [f"op{i}" for i in range(1, 11)] and "pipeline" in names


def test_pipeline(spark):
    import corpus_pipeline as p

    library = pytest.importorskip("tokenizers").Tokenizer.from_file(p.tokens.default_path())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = {d: t for d, t in docs.items() if t and any(c.isalpha() for c in t)}
    # lines
    digest = {d: h for d, _, _, h in brute_lines(sorted(docs.items()))}
    strip = " \t\n\x0b\x0c\r"
    first: dict[str, int] = {}
    for d, t in sorted(docs.items()):
        for line in t.split("\n"):
            first.setdefault(line.strip(strip).translate(LOWER), d)
    kept = {}
    for d, t in docs.items():
        lines = [x for x in t.split("\n") if len(k := x.strip(strip).translate(LOWER)) < 10 or first[k] == d]
        assert hashlib.sha256("\n".join(lines).encode()).hexdigest() == digest[d]
        if lines:
            kept[d] = "\n".join(lines)
    # near copies
    sets, low = {d: shingle_set(t, 5) for d, t in kept.items()}, {d: d for d in kept}
    changed = True
    links = [(a, b) for a in kept for b in kept if a < b and (n := len(sets[a] & sets[b])) and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    while changed:
        changed = False
        for a, b in links:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    kept = {d: t for d, t in kept.items() if low[d] == d}
    bad = {d for d, n, hit, _ in brute_overlap(list(kept.items()), items) if hit and 20 * hit >= n}
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in kept.items() if d not in bad}
    got = {r.doc_id: r.ids_sha256 for r in p.run(spark, SF).collect()}
    assert got == {d: hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest() for d, ids in want.items()}
    assert re.fullmatch(r"[0-9a-f]{64}", next(iter(got.values())))


def test_stages_keep_the_columns(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    assert p.drop_lines(spark, docs, SF).where(F.col("n_chars") != F.char_length("text")).count() == 0


def _stages(spark, rows, fields):
    """The columns and rows after each stage, each over the rows it is given."""
    import corpus_pipeline as p

    docs = spark.createDataFrame(rows, fields)
    for name, stage in p.STAGES:
        yield name, docs.columns, stage(spark, docs, SF)


FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_on_an_empty_table(spark):
    for name, columns, out in _stages(spark, [], FIELDS):
        assert out.count() == 0 and (out.columns == columns or name.startswith("bpe"))


def test_stages_with_odd_rows_and_clashing_columns(spark):
    """Null ids and texts, repeated rows, ties, one very long text, and extra columns named like those used inside."""
    names = ["cls", "key", "row", "gone", "items", "_id", "_kept", "root", "n_words"]
    text = "the cat sat on the mat and looked at the dog for a long time\nsecond line of this text here"
    texts = [(1, text), (1, text), (2, text), (None, text), (None, None), (3, None), (4, ""), (5, "123 456"), (6, "word " * 60_000), (7, "another text that nobody else has written down")]
    rows = [(i, t, "en", "s", len(t or ""), *range(len(names))) for i, t in texts]
    fields = FIELDS + "".join(f", {n} int" for n in names)
    ids = {}
    for name, columns, out in _stages(spark, rows, fields):
        got = out.collect()
        ids[name] = sorted((r.doc_id for r in got), key=repr)
        if not name.startswith("bpe"):
            assert out.columns == columns and all(tuple(r[n] for n in names) == tuple(range(len(names))) for r in got)
    assert ids["language id"] == [1, 1, 2, 7, None, None]  # nothing the model has learned explains one word over and over
    assert ids["line dedup"] == [1, 1, 3, 4, 5, 6, 7, None]  # the null text stays; 2 and the copy without an id lose every line
    assert ids["n-gram jaccard join"] == [1, 1, 3, 4, 5, 6, 7, None, None]
    assert ids["benchmark decontamination"] == ids["bpe encoding and decoding"] == [1, 1, 2, 3, 4, 5, 6, 7, None, None]


def test_queries_against_their_sql(spark, duck):
    from compare import rows, same

    from quarry.llm import catalog

    own = catalog.queries()
    for name, text in catalog.oracle_sql().items():
        got, want = own[name](spark, SF).toPandas(), duck.sql(text).df()
        assert sorted(got.columns) == sorted(want.columns) and same(rows(got), rows(want)), name
