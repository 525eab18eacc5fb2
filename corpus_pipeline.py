"""A training-data pipeline over ``documents``: quality rules, toxicity, near duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents that the
one before it kept; its result is written as Parquet and read again.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from corpuslode.llm import near_duplicates, packing, quality, toxicity
from corpuslode.llm.common import cut, id_crc, placed
from corpuslode.llm.queries import ship, table
from corpuslode.session import ensure_checkpoint_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie near their language's reference."""
    return quality.quality_rules(docs).where("quality.kept").select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; labels are learned with the same split as the query."""
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), id_crc("doc_id") % 4 != 2)
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: five-word shingles, similarity 0.8 or more, the least id stays.

    Rows are told apart by their position, so ids may repeat or be null; of rows
    with equal ids the first written stays, null ids come last.
    """
    ship(spark)
    rows = placed(docs)
    groups = near_duplicates.near_duplicates(rows, doc_id="_position").select(F.col("doc_id").alias("_position"), "component_id")
    ranked = groups.join(rows.select("_position", "doc_id"), "_position").select(
        "component_id", "_position", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_position").alias("place"))
    ranked = cut(ranked)
    best = ranked.groupBy("component_id").agg(F.count("*").alias("n"), F.min("place").alias("best")).where("n > 1").drop("n")
    dropped = ranked.join(best, "component_id").where(F.col("_position") != F.col("best._position")).select("_position")
    return rows.join(dropped, "_position", "left_anti").select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and offset."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, 1024)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

# Hashing, tokenizing and learning are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the results of the others are written under the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    folder = posixpath.join(ensure_checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}")
    for name, stage in STAGES[:-1]:
        path = posixpath.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
