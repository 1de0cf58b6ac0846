"""Headline timings, one JSON line: ``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores.

Every timing ends in an aggregate or a noop write over all rows, after one warm-up of the Python
workers. A query's time is the median of ``BENCH_RUNS`` (3) runs, but
for the one-bag steps; ``first`` has the first ones.
``rows_per_sec`` is instances over seconds for the scans that touch every instance.
"""

from __future__ import annotations

import json
import os
import resource
import sys
import time
from dataclasses import replace
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from bagwise import local_session  # noqa: E402
from bagwise.catalogue import fixtures as fx  # noqa: E402
from bagwise.operators import joins, metrics, pooling, reports, sampling, scaling  # noqa: E402
from bagwise.operators.model import AttentionModel, GatedAttentionModel  # noqa: E402
from bagwise.plans.crossval import cross_validate  # noqa: E402
from bagwise.plans.evaluation import evaluate  # noqa: E402
from bagwise.plans.instances import signature_instances  # noqa: E402
from bagwise.plans.scratch import settle, stored  # noqa: E402
from bagwise.plans.training import TrainSettings, train_attention  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
HIDDEN = 128
RUNS = int(os.environ.get("BENCH_RUNS", 3))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def line_instances(spark):
    """Order lines as instances of four numbers; suppliers are bags."""
    rows = fx.table(spark, FOLDER, "lineitem").select(
        F.col("l_suppkey").alias("bag_id"),
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey").alias("instance_id"),
        F.array(
            F.col("l_quantity") / 50, F.col("l_extendedprice") / 1e5, F.col("l_discount") * 10, F.col("l_tax") * 10
        ).alias("features"),
    )
    return rows.repartition(CPUS).persist(StorageLevel.MEMORY_AND_DISK)


def main() -> None:
    spark = local_session("bench", CPUS, "12g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(CPUS * 10).repartition(CPUS).mapInArrow(lambda batches: batches, "id long").count()
    times: dict[str, float] = {}
    first: dict[str, float] = {}

    def clock(name, f, runs=RUNS):
        took = []
        for _ in range(runs):
            begin = time.perf_counter()
            out = f()
            took.append(round(time.perf_counter() - begin, 3))
        first[name], times[name] = took[0], median(took)
        return out

    # The table is one file with one row group: store it as the several files it would be.
    fragments = stored(
        fx.line_fragments(spark, FOLDER).withColumn("instance_id", F.xxhash64("chromosome")).repartition(CPUS)
    )
    tables = fx.line_signature_tables(spark, FOLDER)
    clock("signature_instances", lambda: drain(signature_instances(fragments, tables)))
    lines = stored(fx.table(spark, FOLDER, "lineitem").repartition(CPUS))
    clock("frequency_encode", lambda: drain(joins.frequency_encode(lines, ["l_returnflag", "l_linestatus"], "l_suppkey")))
    clock("minmax_scale", lambda: drain(scaling.minmax_scale(lines, ["l_quantity", "l_extendedprice", "l_discount"], "l_suppkey")))

    rows = line_instances(spark)
    n = rows.count()
    labels = settle(
        fx.table(spark, FOLDER, "supplier").select(
            F.col("s_suppkey").alias("bag_id"), (F.col("s_acctbal") >= 5000).cast("int").alias("label")
        )
    )
    model = AttentionModel.random(4, HIDDEN)
    clock("score_bags", lambda: drain(pooling.score_bags(rows, model)))
    clock("attention_pool", lambda: drain(pooling.attention_pool(rows, model)))
    clock("attention_weights", lambda: drain(pooling.attention_weights(rows, model)))
    clock("score_bags_gated", lambda: drain(pooling.score_bags(rows, GatedAttentionModel.random(4, HIDDEN))))
    clock("exact_sample", lambda: drain(sampling.exact_sample(lines, F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey"), 0.4, 42, ["l_suppkey"])))
    result = clock("evaluate", lambda: evaluate(rows, labels, model))
    clock("auc", lambda: metrics.auc(result.scores).collect())
    clock("roc_curve", lambda: drain(metrics.roc_curve(result.scores)))
    weights = stored(result.attention)
    clock("attention_histogram", lambda: drain(reports.attention_histogram(weights, labels)))

    epoch = TrainSettings(epochs=1, hidden=HIDDEN, batch_bags=None, cache=False)
    clock("train_first_epoch", lambda: train_attention(rows, labels, epoch, model))
    three = TrainSettings(epochs=3, hidden=HIDDEN, batch_bags=None)
    clock("train_three_epochs", lambda: train_attention(rows, labels, three, model))
    gated = GatedAttentionModel.random(4, HIDDEN)
    clock("train_first_epoch_gated", lambda: train_attention(rows, labels, epoch, gated))
    clock("train_three_epochs_single", lambda: train_attention(rows, labels, replace(three, single=True), model))
    events = fx.event_instances(spark, FOLDER).repartition(CPUS).persist()
    event_bags = settle(fx.event_bags(spark, FOLDER))
    nations, nation_bags = fx.nation_instances(spark, FOLDER), settle(fx.nation_bags(spark, FOLDER))
    clock("train_25_one_bag_steps", lambda: train_attention(nations, nation_bags, TrainSettings(epochs=1, hidden=HIDDEN)), 1)
    cv = TrainSettings(epochs=1, hidden=16, batch_bags=None)
    clock("cross_validate_10_folds", lambda: cross_validate(events, event_bags, cv).summary.collect())

    whole_scans = ("signature_instances", "frequency_encode", "minmax_scale", "score_bags", "attention_weights", "train_first_epoch")
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first": first,
                "runs": RUNS,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": CPUS,
                "instances": n,
                "rows_per_sec": {q: round(n / times[q]) for q in whole_scans},
                "driver_python_mb": resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024,
            }
        )
    )


if __name__ == "__main__":
    main()
