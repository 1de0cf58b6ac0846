"""Global order without a one-task window.

Rows are range-partitioned by the order, each range is numbered or summed by itself, and the ranges
are put end to end by a table with one row per range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagwise.plans.scratch import settle

SLICE = "_slice"


def in_slices(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Settle the rows with the number of the range each one falls into; equal keys share a range."""
    return settle(df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()))


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which a null one equals a null one; the keys come from the left."""
    other = right.withColumnsRenamed({k: f"_other_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys])
    return left.join(other, same).drop(*[f"_other_{k}" for k in keys])


def running_totals(
    sliced: DataFrame, order: Sequence[Column], sums: dict[str, Column], by: Sequence[str] = ()
) -> DataFrame:
    """Add, per group ``by``, the sums over all rows up to and including each row in the order."""
    by = list(by)
    per_slice = sliced.groupBy(*by, SLICE).agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_slice.select(
        *by, SLICE, *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums]
    )
    within = (
        Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = sliced.withColumns({f"_in_{n}": F.sum(c).over(within) for n, c in sums.items()})
    # The slice totals are far fewer than the rows; without a hint, runtime statistics decide.
    joined = join_by(local, starts, [*by, SLICE])
    return joined.withColumns({n: F.col(f"_{n}") + F.col(f"_in_{n}") for n in sums}).select(
        *[c for c in sliced.columns if c != SLICE], *sums
    )


def global_rank(df: DataFrame, order: Sequence[Column], name: str = "rank", by: Sequence[str] = ()) -> DataFrame:
    """Number the rows 1, 2, … in the order, per group ``by``; the order must be total."""
    return running_totals(in_slices(df, order), order, {name: F.lit(1)}, by)
