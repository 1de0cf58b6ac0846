"""Renaming, dropping, cleaning and assembling of instance columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.functions.columns import FAULTS, cell_fault, clean_numeric, is_malformed

# The positional names of a fragment file.
FRAGMENT_COLUMNS = (
    "chromosome",
    "frag_start",
    "frag_end",
    "length_bin",
    "out5p",
    "in5p",
    "gc_content",
    "gc_weight",
    "is_shifted",
    "cnv_weight",
)


def name_fragment_columns(df: DataFrame, names: Sequence[str] = FRAGMENT_COLUMNS) -> DataFrame:
    """Name columns by position; missing tail columns are allowed, further ones keep their names."""
    have = df.columns
    return df.toDF(*names[: len(have)], *have[len(names) :])


def suffix_columns(df: DataFrame, suffix: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}{suffix}" for c in df.columns})


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop the named columns; absent ones are ignored."""
    return df.drop(*names)


def clean_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Turn columns into doubles in one projection; null, blank and malformed cells become 0."""
    wanted = set(columns)

    def cleaned(field: T.StructField) -> Column:
        value = F.col(f"`{field.name}`")
        if field.name not in wanted:
            return value
        if isinstance(field.dataType, T.NumericType):
            return F.coalesce(value.cast("double"), F.lit(0.0)).alias(field.name)
        return clean_numeric(value).alias(field.name)

    return df.select(*[cleaned(f) for f in df.schema.fields])


def malformed_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of replaced malformed cells per column."""
    counts = df.agg(*[F.count_if(is_malformed(F.col(f"`{c}`"))).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n_malformed")) for c in columns])
    return counts.select(F.inline(pairs))


def _faults(numbers: Sequence[str], positions: Sequence[str]) -> dict[str, Column]:
    own = {c: cell_fault(F.col(f"`{c}`")) for c in numbers}
    return {**own, **{c: cell_fault(F.col(f"`{c}`"), whole=True) for c in positions}}


def cell_faults(
    df: DataFrame, numbers: Sequence[str], positions: Sequence[str] = (), by: str = "sample_name"
) -> DataFrame:
    """``by, column, n_malformed, n_nan, n_infinite`` of each file and column with unreadable cells.

    One aggregate over the cells as text; only rows with a fault are grouped.
    """
    each = [F.struct(F.lit(c).alias("column"), fault.alias("fault")) for c, fault in _faults(numbers, positions).items()]
    found = F.filter(F.array(*each), lambda x: x["fault"].isNotNull())
    counts = [F.count_if(F.col("fault") == f).alias(f"n_{f}") for f in FAULTS]
    return df.select(by, F.inline(found)).groupBy(by, "column").agg(*counts)


def observe_faults(df: DataFrame, numbers: Sequence[str], positions: Sequence[str], seen: Observation) -> DataFrame:
    """The rows as they are; ``seen`` gets ``<column>_<fault>`` counts from the job that reads them."""
    counts = [F.count_if(fault == f).alias(f"{c}_{f}") for c, fault in _faults(numbers, positions).items() for f in FAULTS]
    return df.observe(seen, *counts)


def feature_array(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def assemble_features(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ("bag_id", "instance_id")) -> DataFrame:
    """Pack feature columns, in the given order, into one array per row."""
    return df.select(*keep, feature_array(columns).alias("features"))


def feature_dim(instances: DataFrame, *, every_row: bool = False) -> int:
    """Width of the feature arrays, from one row; with ``every_row``, an error if rows disagree.

    The scorers refuse rows of another width themselves, so reading one is enough before training.
    """
    width = F.size("features")
    if every_row:
        low, high = instances.agg(F.min(width), F.max(width)).first()
    else:
        low = high = next((r[0] for r in instances.select(width).take(1)), None)
    if low is None or low != high:
        raise ValueError(f"feature arrays must all have the same width, found {low} to {high}")
    return int(low)
