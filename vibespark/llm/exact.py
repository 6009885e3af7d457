"""Exact deduplication by skew-safe combining (DataFrame operations only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_space, spill, text_of


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16, digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """Groups equal texts; of each group the row with the smallest id stays.

    Texts are equal when identical after each run of white space has become one space. Three stages combine copies,
    each grouping by the whole normalised content: within a task (map-side), among the tasks of one salt, and among
    the salts. So a group holding any share of all rows reaches the last stage as at most ``salts`` rows.
    The rows then meet their group by digest; contents that share a digest are told apart by a join on the content.

    Returns a row per input row: id, keep_id, group_size, kept, text_sha256. Null texts count as empty. Null ids are
    larger than any other id: a group of null ids only has a null keep_id, and its rows are kept. Rows that repeat
    an id in one group count in group_size and are all marked alike. No rows give no rows. Other columns are ignored.
    """
    sha = F.sha2(F.col("content"), 256)
    rows = docs.select(F.col(id_col).alias("id"), one_space(text_of(text_col)).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")) if digest else sha)

    def groups() -> DataFrame:
        local = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        merged = local.groupBy("digest", "salt", "content").agg(F.min("id").alias("keep"), F.count(F.lit(1)).alias("n"))
        return merged.groupBy("digest", "content").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))

    found = spill(groups().select("digest", "keep", "n", F.lit(True).alias("hit")))
    clashes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("digest")
    slim = rows.select("id", "digest", sha.alias("sha"))
    if clashes.isEmpty():  # a digest has one content: only groups of more than one row need their join
        out = slim.join(found.filter("n > 1"), "digest", "left")
    else:
        mixed = groups().join(clashes, "digest", "left_semi")
        apart = rows.join(clashes, "digest", "left_semi").join(mixed, ["digest", "content"]).select("id", sha.alias("sha"), "keep", "n", F.lit(True).alias("hit"))
        plain = slim.join(clashes, "digest", "left_anti").join(found.filter("n > 1"), "digest", "left").select("id", "sha", "keep", "n", "hit")
        out = plain.unionByName(apart)
    keep = F.when(F.col("hit"), F.col("keep")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS c FROM documents),
g AS (SELECT c, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY c)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.c) AS text_sha256
FROM t JOIN g ON t.c = g.c"""
