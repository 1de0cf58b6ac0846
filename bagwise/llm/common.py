"""What several corpus operators share: reading tables, the white space of the contracts, keeping rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.plans.lookup import lookup_join
from bagwise.plans.scratch import discard, scratch_path

#: White space as a regular expression class, and what is not.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table, as measured, that an operator sends to every executor.
LOOKUP_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def id_key(column: str = "doc_id") -> Column:
    """A key for joins that a null id has too."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


#: Rows of text that go to a Python worker at a time: their bytes are held there and beside the JVM's heap.
TEXT_ROWS = 1000


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send texts to Python in batches of ``TEXT_ROWS`` at most; the setting is put back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Tables:
    """Written tables of one job, by name, each removed after its last reader."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, name: str, frame: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, name)
        frame.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            discard(self.spark, self.paths.pop(name))


def lookup(rows: DataFrame, keyed: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that broadcasts the keyed table if it is small, as measured, and else shuffles with salts."""
    return lookup_join(rows, keyed, on, how, budget=LOOKUP_BYTES)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id is not in the one column ``doc_id`` of ``dropped``; all columns stay as they are.

    The ids that go are the lookup side, so documents move only if that list outgrows a broadcast.
    """
    names = docs.columns
    gone = dropped.select(id_key().alias("_llm_key"), F.lit(True).alias("_llm_gone")).distinct()
    held = lookup(docs.withColumn("_llm_key", id_key()), gone, ["_llm_key"])
    return held.where(F.col("_llm_gone").isNull()).select(*[F.col(f"`{c}`") for c in names])
