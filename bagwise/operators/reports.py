"""The tables behind attention plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagwise.plans.lookup import lookup_join
from bagwise.plans.ordered import global_rank
from bagwise.plans.scratch import settle

# Fixed value: bars of the attention histogram.
HISTOGRAM_BINS = 50


def bag_attention_series(attention: DataFrame, bag_id) -> DataFrame:
    """``position, instance_id, attention`` of one bag in instance order; empty for an unknown bag."""
    one = attention.where(F.col("bag_id") == F.lit(bag_id)).select("instance_id", "attention")
    ranked = global_rank(one, [F.col("instance_id"), F.col("attention")], "position")
    return ranked.select((F.col("position") - 1).alias("position"), "instance_id", "attention")


def attention_histogram(attention: DataFrame, bags: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """``label, bin, lo_edge, hi_edge, log10_lo_edge, n``: equal bins over each label's own range.

    Empty bins are listed. A range of no width is widened by one half on both sides. The attention
    frame is read twice, once when called; store it first if computing it is dear.
    """
    rows = lookup_join(attention, bags.select("bag_id", "label"), ["bag_id"], "inner").select("label", "attention")
    ends = rows.groupBy("label").agg(F.min("attention").alias("lo"), F.max("attention").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.withColumns(
        {
            "lo": F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")),
            "hi": F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")),
        }
    )
    # A row per label, of which there are few.
    ends = settle(ends)
    nth = F.least(F.width_bucket("attention", "lo", "hi", F.lit(bins)), F.lit(bins))
    counted = lookup_join(rows, ends, ["label"], "inner").groupBy("label", nth.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    slots = ends.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    lo_edge = F.col("lo") + step * (F.col("bin") - 1)
    return (
        slots.join(counted, ["label", "bin"], "left")
        .select(
            "label",
            "bin",
            lo_edge.alias("lo_edge"),
            (F.col("lo") + step * F.col("bin")).alias("hi_edge"),
            F.when(lo_edge > 0, F.log10(lo_edge)).alias("log10_lo_edge"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )
