"""Joins of many rows to a keyed table, by the table's measured size.

A table that fits the budget is broadcast, so the rows do not move. A larger one is joined by a
shuffle in which hot keys are spread over salted copies. A key is hot when it holds more rows than an
even shuffle partition would, so there are never more hot keys than shuffle partitions and their list
is always small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.plans.scratch import settle

BROADCAST_BYTES = 64 << 20
LEAST_SHARES = 200
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"
ROW_OVERHEAD = 32


def _cell_bytes(field: T.StructField) -> Column:
    c, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 32
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) * 2 + 32
    return F.lit(8)


def row_bytes(table: DataFrame) -> Column:
    """Size of each row of the table in a hash relation."""
    return sum((_cell_bytes(f) for f in table.schema.fields), F.lit(ROW_OVERHEAD)).cast("long")


def measured_bytes(table: DataFrame) -> int:
    """Size of a table once built into a hash relation; one aggregate, one number to the driver."""
    return int(table.agg(F.coalesce(F.sum(row_bytes(table)), F.lit(0))).first()[0])


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    budget: int = BROADCAST_BYTES,
    table_bytes: int | None = None,
) -> DataFrame:
    """Join ``rows`` to ``table`` on equal keys; ``how`` is ``left`` or ``inner``.

    ``table_bytes`` is for callers that know a bound already and save the measuring job. The table
    is read more than once, so settle it first when it is costly to compute.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    size = measured_bytes(table) if table_bytes is None else table_bytes
    if size <= budget:
        return rows.join(F.broadcast(table), list(on), how)
    return salted_join(rows, table, on, how)


def even_shares(rows: DataFrame) -> int:
    """Into how many parts a shuffle of the rows should be able to cut them."""
    return max(LEAST_SHARES, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def hot_keys(rows: DataFrame, on: Sequence[str], share: int | None = None) -> DataFrame:
    """Keys above one ``share``-th of all rows, with the number of salted copies each one needs.

    The rows are read once; their total is the sum of the counts.
    """
    share = share or even_shares(rows)
    counted = settle(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    slot = max(1, total // share)
    above = counted.where(F.col("_n") > slot)
    return above.select(*on, F.ceil(F.col("_n") / F.lit(slot)).cast("int").alias("_salts"))


@dataclass(frozen=True)
class Salting:
    """Copies of a keyed table for its hot keys, and the copy each row has to meet.

    Rows are spread by a hash of all their columns; give them an id of their own, so that equal rows
    spread too.
    """

    on: list[str]
    hot: DataFrame
    share: int

    @classmethod
    def of(cls, rows: DataFrame, on: Sequence[str], share: int | None = None) -> Salting:
        on, share = list(on), share or even_shares(rows)
        return cls(on, hot_keys(rows.where(_all_set(on)), on, share), share)

    def rows(self, rows: DataFrame) -> DataFrame:
        spread = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
        # Rows without a complete key match nothing: they may go anywhere.
        salt = (
            F.when(~_all_set(self.on), F.pmod(spread, F.lit(self.share)))
            .when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts")))
            .otherwise(F.lit(0))
        )
        return rows.join(F.broadcast(self.hot), self.on, "left").withColumn("_salt", salt.cast("int")).drop("_salts")

    def copies(self, table: DataFrame) -> DataFrame:
        every = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
        return table.join(F.broadcast(self.hot), self.on, "left").withColumn("_salt", F.explode(every)).drop("_salts")


def salted_join(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left", *, share: int | None = None
) -> DataFrame:
    salting = Salting.of(rows, on, share)
    joined = salting.rows(rows).join(salting.copies(table), [*on, "_salt"], how)
    return joined.select(*rows.columns, *[c for c in table.columns if c not in on])


def salted_lookups(
    rows: DataFrame, tables: Sequence[tuple[DataFrame, Sequence[str]]], shared: Sequence[str], *, share: int | None = None
) -> DataFrame:
    """Left-join several tables whose keys all include the ``shared`` columns.

    Hot keys are sought once, among the shared columns. With
    ``spark.sql.requireAllClusterKeysForCoPartition`` off, the rows are partitioned once by those and the
    salt, and all joins use that one partitioning. With it on, as it is by default, each join deals the rows
    by all of its own keys anyway, and they are not dealt once more before.
    """
    salting = Salting.of(rows, shared, share)
    once = str(rows.sparkSession.conf.get(ALL_KEYS, "true")).lower() == "false"

    def dealt(some: DataFrame) -> DataFrame:
        return some.repartition(*shared, "_salt") if once else some

    out = dealt(salting.rows(rows))
    for table, on in tables:
        out = out.join(dealt(salting.copies(table)), [*on, "_salt"], "left")
    added = [c for table, on in tables for c in table.columns if c not in on]
    return out.select(*rows.columns, *added)


def _all_set(on: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in on:
        ok = ok & F.col(f"`{c}`").isNotNull()
    return ok
