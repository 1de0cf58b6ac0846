"""Shuffled orders, folds and fold summaries over bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.functions.columns import md5_of
from bagwise.plans.ordered import global_rank


def shuffled_rank(bags: DataFrame, *seeds: int, name: str = "rank") -> DataFrame:
    """Number the bags in an order drawn from the seeds; the same for the same seeds."""
    digest = md5_of(*[F.lit(s) for s in seeds], F.col("bag_id"))
    keyed = bags.withColumn("_digest", digest)
    return global_rank(keyed, [F.col("_digest"), F.col("bag_id")], name).drop("_digest")


def tile(rank: Column, n: Column, k: int) -> Column:
    """Zero-based share of ``rank`` when n rows are cut into k shares, the first n % k one larger."""
    small = F.floor(n / F.lit(k))
    larger = n % F.lit(k)
    border = larger * (small + 1)
    early = F.floor((rank - 1) / (small + 1))
    late = larger + F.floor((rank - 1 - border) / F.greatest(small, F.lit(1)))
    return F.when(rank <= border, early).otherwise(late).cast("int")


def kfold_assign(bags: DataFrame, k: int = 10, seed: int = 42) -> DataFrame:
    """Add ``fold`` in 0..k-1: shuffled, unstratified, sizes differing by one at most."""
    ranked = shuffled_rank(bags, seed, name="_rank")
    n = bags.agg(F.count(F.lit(1))).first()[0]
    if k < 2 or n < k:
        raise ValueError(f"cannot cut {n} bags into {k} folds")
    return ranked.withColumn("fold", tile(F.col("_rank"), F.lit(n), k)).drop("_rank")


def cv_summary(fold_aucs: DataFrame) -> DataFrame:
    """One row: fold AUCs in fold order, their mean and population deviation over valid folds.

    There is one row per fold, so the list is as short as the number of folds. A fold with one class
    has no AUC and counts in ``n_folds`` only.
    """
    listed = F.sort_array(F.collect_list(F.struct("fold", "auc")))
    return fold_aucs.agg(
        F.transform(listed, lambda r: r["auc"]).alias("aucs"),
        F.avg("auc").alias("mean_auc"),
        F.stddev_pop("auc").alias("std_auc"),
        F.count("auc").alias("n_valid_folds"),
        F.count(F.lit(1)).alias("n_folds"),
    )
