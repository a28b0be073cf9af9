"""The text operators' queries over the driver's tables, with production parameters, and SQL for an independent engine."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, hmm, neardup, oracles, packing, pii, quality, suffix, topk, vecdup
from .common import fold, importable, table

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return f(spark, sf_dir)

        _queries[name] = run
        if sql:
            _oracle[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


@query("op1_hmm")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"), fold("doc_id", 5) == 1)


@query("op2_bpe")
def op2(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    ranks = bpe.load_ranks(vocabulary or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op3_minhash", oracles.NEARDUP)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.dedup(table(spark, sf_dir, "documents")).rows.select("doc_id", "n_shingles", "component_id", "kept")


@query("op4_chat", oracles.CHAT)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse(table(spark, sf_dir, "conversations"))


@query("op5_suffix_dedup", oracles.PASSAGES)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"))


@query("op6_topk", oracles.TOPK)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return quality.score(docs, model).select(
        "doc_id",
        (fold("doc_id", 4) == 2).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= model.settings.threshold).cast("int").alias("predicted"),
    )


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query("op9_vector_dedup", oracles.VECTORS)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vecdup.dedup(table(spark, sf_dir, "embeddings"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
