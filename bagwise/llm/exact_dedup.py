"""Exact duplicates: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups.

Only hashes and ids are shuffled for the grouping. The texts of groups with more than one document are
read again and compared as the smallest and largest text of each group, which combines before the
shuffle: a group with a third of all documents is one text per task. A hash that two texts share is
split by its texts' SHA-256, and those groups are compared in their turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import SPACES, lookup, table, text_of, without
from bagwise.plans.scratch import stored


def normalised(text: Column) -> Column:
    """The text with each run of white space as one space; texts are equal when these are."""
    return F.regexp_replace(text, SPACES, " ")


def _collided(docs: DataFrame, groups: DataFrame, digest: Callable[[Column], Column], by: list[str]) -> DataFrame:
    """The keys among ``groups`` under which texts of different bytes stand."""
    norm = normalised(text_of())
    texts = docs.select(norm.alias("_text")).select(
        "_text", digest(F.col("_text")).alias("_hash"), F.sha2(F.col("_text"), 256).alias("_sha")
    )
    members = lookup(texts.select("_text", *by), groups.select(*by), by, "inner")
    spread = members.groupBy(*by).agg(F.min("_text").alias("_low"), F.max("_text").alias("_high"))
    return spread.where(F.col("_low") != F.col("_high")).select(*by)


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Null text is the empty text. A null id is never the smallest; a group of nothing but null ids keeps
    one of them (``keep_id`` null). Of rows that repeat an id and a text, one is kept. An empty table
    gives an empty result; other columns are not read.
    """
    norm = docs.select("doc_id", normalised(text_of()).alias("_text"))
    hashed = norm.select("doc_id", digest(F.col("_text")).alias("_hash"), F.sha2(F.col("_text"), 256).alias("_sha"))
    rows = stored(hashed.groupBy("doc_id", "_hash", "_sha").agg(F.count(F.lit(1)).alias("_copies")), "hashes")

    def repeated(of: DataFrame, by: list[str]) -> DataFrame:
        sums = of.groupBy(*by).agg(F.min("doc_id").alias("keep_id"), F.sum("_copies").alias("group_size"))
        return sums.where(F.col("group_size") > 1)

    by_hash = stored(repeated(rows, ["_hash"]), "groups")
    bad = stored(_collided(docs, by_hash, digest, ["_hash"]), "collided")
    part = F.lit("")
    if not bad.isEmpty():
        rows = lookup(rows, bad.withColumn("_bad", F.lit(True)), ["_hash"])
        part = F.when(F.col("_bad"), F.col("_sha")).otherwise(part)
        by_sha = rows.where("_bad").groupBy("_hash", "_sha").agg(F.sum("_copies").alias("n")).where("n > 1")
        if not _collided(docs, stored(by_sha, "split"), digest, ["_hash", "_sha"]).isEmpty():
            raise ValueError("two texts share both hashes")
    rows = rows.withColumn("_part", part)
    by_text = by_hash.withColumn("_part", F.lit("")) if bad.isEmpty() else stored(repeated(rows, ["_hash", "_part"]), "groups")
    own = F.coalesce(F.col("keep_id"), F.col("doc_id"))
    size = F.coalesce(F.col("group_size"), F.col("_copies"))
    joined = lookup(rows, by_text, ["_hash", "_part"]).select(
        "doc_id", own.alias("keep_id"), size.alias("group_size"), F.col("_sha").alias("text_sha256"), "_copies"
    )
    copies = F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))
    return joined.withColumn("_copy", copies).select(
        "doc_id", "keep_id", "group_size", ((F.col("_copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256"
    )


def keep_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns; rows repeating an id and a text stay as one.

    Rows that share an id but not a text are different documents and judged by their texts.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    judged = exact_groups(docs)
    told = judged.groupBy("doc_id", "text_sha256").agg(
        F.max("kept").alias("_kept"), F.count(F.lit(1)).alias("_copies")
    )
    told = stored(told.where(~F.col("_kept") | (F.col("_copies") > 1)), "verdicts")
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.col("_llm_sha").alias("sha")).alias("_llm_key")
    keyed = told.withColumnRenamed("text_sha256", "_llm_sha").select(
        F.to_json(key).alias("_llm_key"), F.col("_kept").alias("_llm_kept")
    )
    rows = docs.withColumn("_llm_sha", F.sha2(normalised(text_of()), 256)).withColumn("_llm_key", F.to_json(key))
    rows = lookup(rows, keyed, ["_llm_key"])
    once = rows.where(F.col("_llm_kept").isNull()).select(*names)
    # What is listed and kept is there several times over.
    again = rows.where("_llm_kept").dropDuplicates(["_llm_key"]).select(*names)
    return once.unionByName(again)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH hashed AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""
