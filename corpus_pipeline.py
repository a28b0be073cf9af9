"""The corpus pipeline: documents through quality, near-dedup, repeated passages, personal data and packing.

Each stage is a function of (spark, docs, sf_dir), docs being what the stage before kept, and calls one operator. All
stages but the last return the columns of ``documents``; where a stage changes a text, n_chars follows it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import neardup, packing, pii, quality, suffix
from siltstone.llm.common import delete, dropping, importable, shared_folder, table, tidy

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars as the text has them now."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    out = docs.withColumn("n_chars", F.length("text"))
    return out.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects. It learns from the labelled documents among its input.

    Where it has not seen labels of both kinds, as with an empty table of labels, it rejects nothing. Null and empty texts
    have the score of the bias; null ids and repeated rows are judged row by row; an empty table gives no rows; further
    columns are left out."""
    importable(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    if not model.learned:
        return _columns(docs)
    rows = quality.score(docs, model, keep=tuple(COLUMNS))
    return _columns(rows.where(F.col("quality_score") >= model.settings.threshold))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id (of repeated rows one).

    Texts without words, null ones too, are in no group and stay; a null id stays only where its group has no other; an
    empty table gives no rows; further columns are left out."""
    importable(spark)
    docs = docs.select(*COLUMNS)
    result = neardup.dedup(docs, keep=("doc_id", "lang", "source", "n_chars"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _columns(neardup.survivors(result, schema, COLUMNS))


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller id has too; documents of which nothing is left go.

    A null text becomes empty and stays; a row with a null id loses nothing and takes nothing from others; repeated rows of
    one id do not remove each other's; an empty table gives no rows; further columns are left out."""
    importable(spark)
    rows = suffix.dedup(docs, texts_too=True, keep=("lang", "source"))
    gone = (F.col("n_removed") > 0) & (F.trim("kept_text") == "")
    return _columns(rows.where(~gone).withColumnRenamed("kept_text", "text"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and what discloses it.

    A null text stays null; null ids and repeated rows are treated row by row; an empty table gives no rows; further columns
    are left out."""
    return _columns(pii.sanitise(docs.select(*COLUMNS)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences, piece by piece.

    A null or empty text is one piece of length 0 in no bin; a null source conflicts with nothing; repeated rows are packed
    each, never into one bin; an empty table gives no rows; further columns are not read, whatever their names."""
    importable(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("neardup", neardup_stage),
    ("passages", passages_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Learned scores and the other stages' methods have no SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared checkpoint folder and read again. What a stage
    kept, and the steps inside a stage, are deleted once the next rows are written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        here = f"{folder}/{k}-{name}"
        with dropping(spark):
            stage(spark, docs, sf_dir).write.parquet(here)
        tidy(spark)
        docs = spark.read.parquet(here)
        if before:
            delete(spark, before)
        before = here
    return docs
