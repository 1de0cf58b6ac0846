from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagwise.functions.columns import md5_fraction, md5_of
from bagwise.plans.lookup import BROADCAST_BYTES, lookup_join
from bagwise.plans.ordered import global_rank
from bagwise.plans.scratch import settle, stored

# Digits of a digest by which rows are counted: 16 to that power of bins per group.
BIN_DIGITS = 3


def bernoulli_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Keep each row with the given probability; depends on how the rows are partitioned."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def hash_sample(df: DataFrame, key: Column | str, fraction: float, seed: int) -> DataFrame:
    """Keep the rows whose hashed key falls below the fraction; the same rows under any partitioning."""
    return df.where(md5_fraction(seed, key) < fraction)


def exact_sample(
    df: DataFrame, key: Column | str, fraction: float, seed: int, by: Sequence[str] = (), *, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Of each group's n rows the ``floor(n * fraction + 0.5)`` with the smallest digests of seed and key.

    The same rows on any cluster, if keys are unique in their group; rows that share a key stay together,
    even if that makes one group's sample larger. Rows are counted by group and first digits of the
    digest; only those of the bin in which a group's share ends are ordered. The rows are read three
    times and do not move; jobs run when called.
    """
    by = list(by)
    rows = df.withColumn("_digest", md5_of(F.lit(seed), F.col(key) if isinstance(key, str) else key))
    rows = rows.withColumn("_bin", F.substring("_digest", 1, BIN_DIGITS))
    counts = settle(rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("n")))
    upto = Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A group has 16 ** BIN_DIGITS bins at most.
    placed = counts.withColumns({"_upto": F.sum("n").over(upto), "_all": F.sum("n").over(Window.partitionBy(*by))})
    share = F.floor(F.col("_all") * F.lit(fraction) + 0.5)
    last = F.min(F.when(F.col("_upto") >= share, F.struct("_bin", (share - F.col("_upto") + F.col("n")).alias("need"))))
    goals = placed.withColumn("_share", share).groupBy(*by).agg(last.alias("_last"), F.max("_share").alias("_share"))
    goals = settle(goals.where(F.col("_share") > 0).select(*by, F.col("_last._bin").alias("_edge_bin"), F.col("_last.need").alias("_need")))
    # Null keys of groups are told from others by a key that is never null.
    name = F.to_json(F.struct(*by)) if by else F.lit("")
    named = rows.withColumn("_group", name)
    goals = goals.select(name.alias("_group"), "_edge_bin", "_need")
    met = lookup_join(named, goals, ["_group"], "inner", budget=budget)
    border = met.where(F.col("_bin") == F.col("_edge_bin")).groupBy("_group", "_digest", "_need").agg(F.count(F.lit(1)).alias("n"))
    ranked = global_rank(border, [F.col("_group"), F.col("_digest")], "_nth", ["_group"])
    edges = stored(ranked.where(F.col("_nth") <= F.col("_need")).groupBy("_group").agg(F.max("_digest").alias("_edge")), "edges")
    held = lookup_join(named, edges, ["_group"], "inner", budget=budget)
    return held.where(F.col("_digest") <= F.col("_edge")).select(*[F.col(f"`{c}`") for c in df.columns])
