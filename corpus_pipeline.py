"""A corpus pipeline: language, near duplicates, personal data, mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Columns are renamed inside a stage, so that documents may have columns of any other names as well.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.llm import common, language, mixing, near, packing, pii

#: Texts whose language is less sure than this are rejected, as are those without a letter.
LEAST_SCORE = 0.35
ORACLE_SQL = None  # the trained network, the joins by similarity and the packing have no SQL


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns named by place, and the new name of each."""
    names = {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    model = language.learn(plain, c["doc_id"], c["text"], c["lang"])
    told = language.predict(plain, model, plain.columns, c["text"])
    return told.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*plain.columns).toDF(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    return near.deduplicate(plain, c["doc_id"], c["text"]).toDF(*docs.columns)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    clean = pii.redact(pii.find(plain, c["doc_id"], c["text"]), c["text"])
    if "n_chars" in c:
        clean = clean.withColumn(c["n_chars"], F.when(F.size("found") > 0, F.length(c["text"]).cast("long")).otherwise(F.col(c["n_chars"])))
    return clean.select(*plain.columns).toDF(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    return mixing.repeat(mixing.plan(plain, c["doc_id"], c["text"], c["source"]), plain.columns).toDF(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain, c = _plain(docs)
    return packing.pack(plain, c["doc_id"], c["text"], c["source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", by_language),
    ("near_duplicates", without_near_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared checkpoint folder and read again."""
    common.ready_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
