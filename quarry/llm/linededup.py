"""Line dedup: explode normalised lines, hash them, find the first document of each, drop the rest, put the lines back.

DataFrame operations only. The text itself crosses no shuffle but one: the join that brings each
document the places of its dropped lines. Lines travel as a 128-bit key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Blanks stripped from both ends of a line, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """A line without blanks at its ends and with A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _marked(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """row (a struct of all columns of docs), lines, and gone: the places, ascending, of the lines that go."""
    whole = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))
    whole = whole.withColumns({"id": F.coalesce(F.col(f"row.`{id_col}`").cast("long"), F.lit(_NO_ID)), "print": F.xxhash64(text)})
    parts = F.split(text, "\n", -1)
    lines = (
        whole.select("id", "print", F.posexplode(parts).alias("at", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("id", "print", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )
    held = lines.groupBy("h1", "h2")
    if min_docs <= 2:  # smallest and largest holder differ: a combine of two numbers on the map side
        first = held.agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").drop("last")
    else:
        by_doc = lines.select("h1", "h2", "id").distinct().groupBy("h1", "h2")
        first = by_doc.agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).drop("n")
    # read back as a table, both sides of the join are plain exchanges, which Spark splits where a line is hot
    first = materialize(first, "repeated-lines")
    gone = lines.join(first, ["h1", "h2"]).where("id <> first").groupBy("id", "print").agg(F.array_sort(F.collect_set("at")).alias("gone"))
    out = whole.join(gone, ["id", "print"], "left")
    return out.select("row", parts.alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))


def _kept() -> Column:
    places = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    return F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.transform(places, lambda at: F.element_at("lines", at + 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """All columns of docs, with the columns `_lines` (array), `_kept` (array), `_n_dropped` (int) added.

    A key of at least min_chars code points that at least min_docs documents hold keeps its lines
    only in the smallest id that holds it. Defined cases: a null or empty text is one empty line;
    all rows without an id count as one document, which comes after all others; rows that repeat an
    id are one document; a document that loses every line keeps the empty text; an empty table
    gives an empty result. Columns of docs named like the three that are added are replaced; others
    may have any name.
    """
    own = [F.col(f"m.row.`{c}`").alias(c) for c in docs.columns if c not in ("_lines", "_kept", "_n_dropped")]
    marked = _marked(docs, id_col, text_col, min_chars, min_docs).select(F.struct("row", "lines", _kept().alias("kept"), F.size("gone").alias("n")).alias("m"))
    return marked.select(*own, F.col("m.lines").alias("_lines"), F.col("m.kept").alias("_kept"), F.col("m.n").alias("_n_dropped"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """docs with the text of the lines that stay; a document none of whose lines stay is dropped.

    Cases as in `dedup_lines`; a null text stays null. Columns of docs may have any names.
    """
    marked = _marked(docs, id_col, text_col, min_chars, min_docs).where("size(gone) < size(lines)")
    new = F.when(F.size("gone") == 0, F.col(f"row.`{text_col}`")).otherwise(F.array_join(_kept(), "\n"))
    marked = marked.select(F.struct("row", new.alias("text")).alias("m"))
    return marked.select(*[F.col("m.text" if c == text_col else f"m.row.`{c}`").alias(c) for c in docs.columns])
