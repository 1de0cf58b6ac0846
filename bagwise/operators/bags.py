"""Counting, guarding, uniting and assembling bags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.plans.lookup import lookup_join
from bagwise.plans.scratch import settle


def bag_sizes(instances: DataFrame, bag: str = "bag_id") -> DataFrame:
    return instances.groupBy(bag).agg(F.count(F.lit(1)).alias("n"))


def empty_bags(bags: DataFrame, instances: DataFrame, bag: str = "bag_id") -> DataFrame:
    """Bags without any instance. Counting first keeps a hot bag from moving."""
    return bags.select(bag).distinct().join(bag_sizes(instances, bag), bag, "left_anti")


def require_instances(bags: DataFrame, instances: DataFrame, bag: str = "bag_id") -> None:
    """Raise if some bag has no instance."""
    missing = [r[0] for r in empty_bags(bags, instances, bag).take(5)]
    if missing:
        raise ValueError(f"bags without instances, among them {missing}")


def require_unique(bags: DataFrame, bag: str = "bag_id") -> None:
    """Raise if some bag is listed twice: joining its rows would double them."""
    repeated = [r[0] for r in bag_sizes(bags, bag).where("n > 1").take(5)]
    if repeated:
        raise ValueError(f"bags listed more than once, among them {repeated}")


def union_bags(*frames: DataFrame) -> DataFrame:
    """All rows of all frames by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def assemble_bags(instances: DataFrame, bags: DataFrame, chunk_rows: int = 4096) -> DataFrame:
    """Bags as dense blocks: ``bag_id, label, n, chunk, n_chunks, instance_ids, features``.

    A bag of any size is cut into blocks of about ``chunk_rows`` rows by the hash of its rows, so no
    task ever holds a whole large bag. Blocks of one bag together hold each instance once.
    """
    sizes = settle(
        bag_sizes(instances)
        .withColumn("n_chunks", F.ceil(F.col("n") / F.lit(chunk_rows)).cast("int"))
        .join(bags.select("bag_id", "label"), "bag_id", "left")
    )
    spread = F.xxhash64("instance_id", "features")
    chunked = lookup_join(instances, sizes, ["bag_id"], "inner").withColumn(
        "chunk", F.pmod(spread, F.col("n_chunks")).cast("int")
    )
    block = F.sort_array(F.collect_list(F.struct("instance_id", "features")))
    return (
        chunked.groupBy("bag_id", "label", "n", "n_chunks", "chunk")
        .agg(block.alias("block"))
        .select(
            "bag_id",
            "label",
            "n",
            "n_chunks",
            "chunk",
            F.col("block.instance_id").alias("instance_ids"),
            F.col("block.features").alias("features"),
        )
    )
