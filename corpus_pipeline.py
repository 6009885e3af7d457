"""A corpus pipeline: raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vibespark.llm.common import drop_spilled, one_space, spill, text_of
from vibespark.llm.exact import exact_dedup
from vibespark.llm.mix import mixed_documents
from vibespark.llm.near import near_duplicates
from vibespark.llm.pack import pack_documents
from vibespark.llm.quality import fit_quality


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Importance resampling by the labels of sf_dir; documents that it rejects go."""
    model, _ = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.keep(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id stays; null ids are larger than any other.

    Rows are told by id and content, as an id may be null or repeat with other texts.
    """
    dropped = exact_dedup(docs).filter(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    sha = F.sha2(one_space(text_of("text")), 256)
    return docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("_id")) & (sha == F.col("_sha")), "left_anti")


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8), the document with the smallest doc_id stays.

    Rows are linked and dropped by a key of their own, as an id may repeat with other texts. Null ids link with nothing.
    """
    keyed = spill(docs.withColumn("_row", F.monotonically_increasing_id()))
    linked = near_duplicates(keyed.withColumn("_key", F.when(F.col("doc_id").isNotNull(), F.col("_row"))), id_col="_key")
    # of each group, near_duplicates keeps the least key alone: its other rows and that one are all its members
    others = spill(linked.filter(~F.col("kept")).select(F.col("_key").alias("_row"), "component_id"))
    drop_spilled(linked)
    members = others.unionByName(others.select(F.col("component_id").alias("_row"), "component_id").distinct())
    members = spill(members.join(keyed.select("_row", "doc_id"), "_row"))
    least = members.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    dropped = members.join(least, "component_id").filter("doc_id > least").select("_row")
    return keyed.join(dropped, "_row", "left_anti").select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to target weights: a row per document and epoch, with the words that the epoch takes."""
    return mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised documents packed into sequences of at most 2048 tokens."""
    return pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_duplicates),
    ("near_dedup", near_duplicate_groups),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: No SQL states the classifier or the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = spill(docs)
    return docs
