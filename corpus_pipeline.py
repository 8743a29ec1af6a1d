"""The training-data pipeline: five stages over ``documents``, each one of the operators of ``evidentia.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage's rows as Parquet and reads them again as the next one's docs. All but the
last return the columns of ``docs`` as they came, extra ones included. Rows, not
ids, are kept or dropped: repeated rows are told apart by their place.

Ties go by the least doc_id and then by file order, so each group keeps one row.
Texts of any length are read whole in every stage.

Null texts: no n-gram speaks for them in stage 1, they are one empty text in
stage 2, link to nothing in stage 3, hold no word in stage 4, and have no id in
stage 5. Empty tables stay empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import bpe, exact, jaccard, quality, storage, winnow
from evidentia.llm.queries import VOCABULARY


def _chosen(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose place is among ``verdicts``, with their own columns."""
    ids = list(storage.ROW_ID)
    return storage.with_row_ids(docs).join(verdicts.select(*ids), ids, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` as a file scan, so that an operator and the filter behind it see the same places."""
    return docs if "_metadata" in docs._jdf.queryExecution().analyzed().metadataOutput().mkString(" ") else storage.saved(docs, "stage")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels of ``docs`` themselves, does not reject."""
    docs = _placed(docs)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _chosen(docs, quality.score(docs, model).where("predicted = 1"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    docs = _placed(docs)
    return _chosen(docs, exact.exact_dedup(docs).where("kept"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each linked group: the first row of the group's least doc_id. Empty sets link to nothing and stay."""
    docs = _placed(docs)
    found = jaccard.linked_components(docs)
    group = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("doc_id", *storage.ROW_ID)).alias("one"))
    nothing = found.where("n_shingles = 0").select(*storage.ROW_ID)
    return _chosen(docs, group.select(*[F.col(f"one.{c}").alias(c) for c in storage.ROW_ID]).unionByName(nothing))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    docs = _placed(docs)
    found = winnow.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _chosen(docs, found.where(F.size("spans") == 0))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of what is left."""
    return bpe.encode_decode(docs, VOCABULARY).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram Jaccard join", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", encoded),
]

#: SQL cannot express the classifier, the join at this size, or BPE; the tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
