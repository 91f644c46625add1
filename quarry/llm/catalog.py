"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, langid, linededup, passages, shards, tokens, topk, urlfilter
from .oracles import ORACLES

TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules of the URL contract.
RULES = [
    urlfilter.rule("block", "com/en/"),
    urlfilter.rule("allow", "example.com/en/7"),
    urlfilter.rule("allow", "net/de/"),
    urlfilter.rule("block", "example.net/de/8"),
    urlfilter.rule("block", "org/es/"),
]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.exact_top_k(vectors, F.col("id") % 20 == 0, 20)


def op2_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = urlfilter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.count_tokens(_table(spark, sf_dir, "documents"), tokens.default_path())
    return out.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.encode(F.array_join("_kept", "\n"), "UTF-8"), 256)
    return out.select("doc_id", F.size("_lines").cast("long").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), kept.alias("kept_sha256"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"), tokens.default_path())


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.find_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(names, "UTF-8"), 256).alias("items_sha256"), decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.model_for(spark, docs))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
