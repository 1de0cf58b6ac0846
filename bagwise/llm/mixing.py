"""Mixing sources to target weights by Efraimidis–Spirakis sampling.

Each source gets a word budget by water filling. What a budget holds of complete epochs is taken of
every document; the rest goes to the documents with the smallest exponential keys, scaled by a quality
weight, until their words fill it. Keys depend on ids alone, so reruns agree on any cluster.

The order within a source is cut into ranges that are summed by themselves and put end to end, so a
source with most of the corpus is spread over all tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import WORD, lookup, table, text_of
from bagwise.llm.quality_rules import SYMBOLS
from bagwise.plans.ordered import global_rank, in_slices, running_totals
from bagwise.plans.scratch import settle, stored


@dataclass(frozen=True)
class Mix:
    """Weights go to the sources by code point, null last, and repeat; the budget is a share of all words."""

    weights: tuple[int, ...] = (3, 1, 2)
    budget: float = 1.5
    most_epochs: int = 2


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def uniform() -> Column:
    """A number between 0 and 1 from 52 bits of a hash of the id; a null id has that of an empty one."""
    bits = F.conv(F.substr(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(1), F.lit(13)), 16, 10)
    return (bits.cast("long") + 0.5) / float(1 << 52)


def sampling_key(text: Column) -> Column:
    """An exponential variate over the quality weight, which falls with the symbols per word."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    weight = 1 / (1 + symbols / F.greatest(word_count(text), F.lit(1)))
    return -F.ln(uniform()) / weight


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` and key of each document. Null text has size 0; a null source is a source."""
    rows = docs.select("doc_id", "source", text_of().alias("_text"))
    text = F.col("_text")
    return rows.select("doc_id", "source", word_count(text).alias("size"), sampling_key(text).alias("_key"), source_key().alias("_source"))


def targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: ``source_size, target`` and its epochs and rest.

    A source never gets more than ``most_epochs`` times its size; what it cannot take is shared out to
    the others by weight. With the sources in order of cap over weight, that is one running sum, taken
    over ranges of the sources: there may be as many as there are hosts.
    """
    sizes = rows.groupBy("_source", "source").agg(F.sum("size").alias("source_size"))
    by_name = F.col("source").asc_nulls_last()
    turn = F.col("_turn") - 1
    weight = F.get(F.array(*[F.lit(w) for w in mix.weights]), turn % len(mix.weights))
    capped = global_rank(sizes, [by_name], "_turn").withColumn("_w", weight.cast("double"))
    capped = capped.withColumn("_cap", F.col("source_size") * float(mix.most_epochs))
    order = [F.col("_cap") / F.col("_w"), by_name]
    summed = settle(running_totals(in_slices(capped, order), order, {"_caps": F.col("_cap"), "_ws": F.col("_w")}))
    words, all_weights = summed.agg(F.sum("source_size"), F.sum("_w")).first()
    # What is left behind the sources before this one, shared by this one and those after it.
    left = F.lit((words or 0) * mix.budget) - F.col("_caps") + F.col("_cap")
    levels = summed.withColumn("_level", left / (F.lit(all_weights or 1.0) - F.col("_ws") + F.col("_w")))
    fits = F.col("_level") <= F.col("_cap") / F.col("_w")
    first = levels.where(fits).agg(F.min(F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))["level"]).first()[0]
    settled = F.lit(float("inf") if first is None else first)
    share = F.least(F.col("_cap"), F.col("_w") * settled)
    epochs = F.when(F.col("source_size") > 0, F.floor(share / F.col("source_size"))).otherwise(0)
    return levels.withColumn("target", share).select(
        "_source", "source_size", "target",
        epochs.cast("long").alias("_epochs"),
        F.floor(F.col("target") - epochs * F.col("source_size") + 0.5).cast("long").alias("_rest"),
    )


def mixture(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` and the key's parts.

    The document at the edge of a budget is taken in part. Repeated rows are documents of their own.
    An empty table gives an empty result. Other columns are not read.
    """
    rows = stored(keyed(docs), "keys")
    goals = stored(targets(rows, mix), "targets")
    order = [F.col("_source"), F.col("_key"), F.col("doc_id").asc_nulls_last(), F.col("size")]
    summed = running_totals(in_slices(rows, order), order, {"_upto": F.col("size")}, ["_source"])
    held = lookup(summed, goals, ["_source"])
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("_rest") - F.col("_upto") + F.col("size")))
    return held.withColumn("_part", part).withColumn("taken", F.col("_epochs") * F.col("size") + F.col("_part"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken, with all their columns.

    Per source, one key is the edge of its budget: a document below it is taken once more than the
    source's complete epochs. The document at the edge is taken if half of it or more fits. Documents
    are judged where they stand; only the edges, one per source, are sent to them.
    """
    names = [F.col(f"`{c}`") for c in docs.columns]
    picked = F.struct("_key", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    plan = mixture(docs, mix)
    taken = (F.col("_part") > 0) & (2 * F.col("_part") >= F.col("size"))
    edges = plan.groupBy("_source").agg(
        F.first("_epochs").alias("_epochs"), F.max(F.when(taken, picked)).alias("_edge")
    )
    goals = stored(edges.select(F.col("_source").alias("_llm_source"), F.col("_epochs").alias("_llm_epochs"), F.col("_edge").alias("_llm_edge")), "edges")
    identity = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    own = docs.withColumns({"_llm_key": sampling_key(text_of()), "_llm_id": identity, "_llm_source": source_key()})
    held = lookup(own, goals, ["_llm_source"])
    mine = F.struct(F.col("_llm_key").alias("_key"), F.col("_llm_id").alias("id"))
    times = F.col("_llm_epochs") + F.coalesce((mine <= F.col("_llm_edge")).cast("long"), F.lit(0))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_llm_times")))
    return held.withColumn("_llm_times", times).where("_llm_times > 0").withColumn("_llm_copy", copies).select(*names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
keyed AS (
  SELECT k, doc_id, source, size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / (1 / (1 + (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) / greatest(size, 1))) AS key
  FROM d),
s AS (
  SELECT source, source_size, w, source_size * 2.0::DOUBLE AS cap
  FROM (SELECT source, sum(size)::BIGINT AS source_size,
               [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w
        FROM keyed GROUP BY source)),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
goals AS (
  SELECT source, source_size,
         least(cap, w * coalesce((SELECT arg_min(level, cap / w) FROM levels WHERE level <= cap / w), 'inf'::DOUBLE)) AS target
  FROM levels),
rest AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM goals),
cut AS (SELECT *, floor(target - epochs * source_size + 0.5)::BIGINT AS rest FROM rest)
SELECT doc_id, size, source_size, target,
       epochs * size + least(size, greatest(0, rest - coalesce(sum(size) OVER (
         PARTITION BY keyed.source ORDER BY key, doc_id NULLS LAST, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken
FROM keyed JOIN cut ON keyed.source IS NOT DISTINCT FROM cut.source
"""
