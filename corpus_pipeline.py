"""The corpus pipeline: five filtering and encoding stages over `documents`, each written as Parquet and read again.

All stages but the last return the columns of their input, whatever their names. An empty table goes
through all stages and gives no rows. Rows without an id are judged by their own text and never fall
to another row's id; rows that repeat an id stay or go together where a stage drops by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontaminate, jaccard, langid, linededup, tokens
from quarry.llm.common import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null or empty texts, texts without a letter, or n-grams that no learned language explains.

    Learned from the labelled rows of docs outside the held-out third; without any, only texts without a
    letter go. Equal shares go to the name that sorts first. Rows without an id stay.
    """
    return langid.keep_identified(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more stay in the smallest id that holds them; a document that keeps no line goes. n_chars follows the text.

    A null or empty text is one empty line and stays as it is; rows without an id count as one last document,
    rows that repeat an id as one document.
    """
    out = linededup.drop_repeated_lines(docs)
    return out.selectExpr(*[("cast(char_length(text) as bigint) as n_chars" if c == "n_chars" else f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles with a similarity of 0.8 or more, the smallest doc_id stays.

    Null and empty texts link with nothing and stay, as do rows without an id; a text of fewer than five
    words has one shingle. Rows that repeat an id stay or go together.
    """
    return jaccard.keep_one_of_each(docs, k=5, num=80, den=100)


def drop_benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth or more of their words inside benchmark windows go.

    Null and empty texts have no words and stay, as do rows without an id; rows that repeat an id go together;
    an empty benchmark hits nothing.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded text of every document that is left; a null text counts as empty."""
    return tokens.round_trip(docs, tokens.default_path())


STAGES = [
    ("language id", identify_language),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_text),
    ("bpe encoding and decoding", encode),
]

#: Language ID and encoding have no SQL form; tests/llm/test_pipeline.py holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
