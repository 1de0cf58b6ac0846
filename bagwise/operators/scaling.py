"""Per-bag ranges and min-max scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.plans.lookup import BROADCAST_BYTES, lookup_join
from bagwise.plans.scratch import settle


def _no_nan(c: str) -> Column:
    value = F.col(f"`{c}`").cast("double")
    return F.when(F.isnan(value), F.raise_error(F.lit(f"NaN in column {c}")).cast("double")).otherwise(value)


def feature_ranges(df: DataFrame, columns: Sequence[str], bag: str = "bag_id") -> DataFrame:
    """Minimum and maximum of every column per bag, in one aggregate; NaN is an error."""
    ends = [f(_no_nan(c)).alias(f"{c}_{end}") for c in columns for end, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(bag).agg(*ends)


def packed_ends(ends: DataFrame, columns: Sequence[str], bag: str = "bag_id") -> DataFrame:
    """``bag, _low, _span``: the minimum of each column and how far its maximum is from it, in the columns' order.

    There is no span where both are the same. Two arrays instead of two columns per feature, of which each
    element is read once: joins and scaling stay small enough for generated code that the JVM compiles.
    """
    low, high = ([F.col(f"`{c}_{end}`") for c in columns] for end in ("min", "max"))
    spans = [F.when(a != b, b - a) for a, b in zip(low, high)]
    return ends.select(bag, F.array(*low).alias("_low"), F.array(*spans).alias("_span"))


def scale_packed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scale each column to [0, 1] by the row's own ``_low`` and ``_span``, which are dropped."""
    scaled = {}
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`").cast("double")
        scaled[c] = F.coalesce((value - F.col("_low")[i]) / F.col("_span")[i], value * 0.0)
    kept = [c for c in df.columns if c not in ("_low", "_span")]
    return df.select(*[scaled[c].alias(c) if c in scaled else F.col(f"`{c}`") for c in kept])


def scale_by(
    df: DataFrame, columns: Sequence[str], ends: DataFrame, bag: str = "bag_id", *, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Scale each column to [0, 1] by known ends, ``<column>_min`` and ``<column>_max`` of each bag.

    A column constant in the bag becomes 0. Runs a job when called, over the ends.
    """
    return scale_packed(lookup_join(df, settle(packed_ends(ends, columns, bag)), [bag], "left", budget=budget), columns)


def minmax_scale(
    df: DataFrame, columns: Sequence[str], bag: str = "bag_id", *, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Scale each column to [0, 1] within its bag; a column constant in the bag becomes 0.

    The rows are read twice: a job finds the ranges when called.
    """
    return scale_by(df, columns, feature_ranges(df, columns, bag), bag, budget=budget)
