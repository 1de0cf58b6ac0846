"""Parquet stores of bags and of model parameters.

A bag store is a folder of immutable commits and a list of manifests. A write adds a commit, which no
reader sees, and then publishes the next manifest, a small file that names for every split the commits
it consists of. So a writer that dies halfway leaves the store as it was, and readers of one manifest
read one state of all splits. The commits of the manifest before the newest stay for readers at work.
"""

from __future__ import annotations

import dataclasses
import itertools
import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.operators.bags import union_bags
from bagwise.operators.model import AttentionModel, GatedAttentionModel
from bagwise.plans.scratch import children, discard, publish

# Fixed value: the kinds of stored model.
MODEL_KINDS = {"attention": AttentionModel, "gated": GatedAttentionModel}


def bag_bucket(bag: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(bag), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, *, buckets: int, within: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Write rows under ``<within>=…/bag_bucket=…`` folders.

    Rows meet by partition value; a bucket above the advisory size, as a hot bag makes it, is split
    over several tasks at run time. Sorting by bag within each file lets a reader skip row groups.
    """
    folders = [*within, "bag_bucket"]
    keyed = rows.withColumn("bag_bucket", bag_bucket("bag_id", buckets))
    (
        keyed.hint("rebalance", *folders)
        .sortWithinPartitions(*folders, "bag_id")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


@dataclasses.dataclass(frozen=True)
class Part:
    """What one commit holds of one split."""

    split: str
    commit: str
    buckets: int
    schema: str


def _versions(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n[:-5]) for n in children(spark, f"{path}/manifests") if n.endswith(".json"))


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifests/{version:010d}.json"


def _parts(spark: SparkSession, path: str, version: int) -> list[Part]:
    text = spark.read.text(_manifest(path, version), wholetext=True).first()[0]
    return [Part(**p) for p in json.loads(text)]


def stored_parts(spark: SparkSession, path: str, split: str | None = None) -> list[Part]:
    """What the newest manifest lists: a few entries per split."""
    versions = _versions(spark, path)
    if not versions:
        raise ValueError(f"no bag store at {path}")
    return [p for p in _parts(spark, path, versions[-1]) if split in (None, p.split)]


def write_bags(instances: DataFrame, path: str, *, buckets: int = 64, mode: str = "overwrite") -> None:
    """Store labelled instances (``split`` and ``label`` included), bucketed by bag within each split.

    Overwriting replaces the splits that are written, appending adds to them; other splits stay. A row
    without a split is an error. Nothing changes before the manifest is published, at the end.
    """
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be 'overwrite' or 'append'")
    spark, seen, commit = instances.sparkSession, Observation(), uuid.uuid4().hex
    versions = _versions(spark, path)
    old = _parts(spark, path, versions[-1]) if versions else []
    rows = instances.withColumn("split", F.col("split").cast("string"))
    facts = [F.collect_set("split").alias("splits"), F.count_if(F.col("split").isNull()).alias("without")]
    write_bucketed(rows.observe(seen, *facts), f"{path}/commits/{commit}", buckets=buckets, within=("split",))
    if seen.get["without"]:
        discard(spark, f"{path}/commits/{commit}")
        raise ValueError(f"{seen.get['without']} rows without a split")
    data = [f for f in rows.schema.fields if f.name not in ("split", "bag_bucket")]
    schema = T.StructType([*data, T.StructField("split", T.StringType()), T.StructField("bag_bucket", T.IntegerType())])
    written = set(seen.get["splits"])
    kept = [p for p in old if mode == "append" or p.split not in written]
    parts = [*kept, *[Part(s, commit, buckets, schema.json()) for s in sorted(written)]]
    version = versions[-1] + 1 if versions else 1
    publish(spark, _manifest(path, version), json.dumps([dataclasses.asdict(p) for p in parts]))
    # Commits that only older manifests than the last one name.
    live = {p.commit for p in [*parts, *old]}
    for v in versions[:-1]:
        for c in {p.commit for p in _parts(spark, path, v)} - live:
            discard(spark, f"{path}/commits/{c}")
        discard(spark, _manifest(path, v))


def sweep_bags(spark: SparkSession, path: str) -> list[str]:
    """Remove commits that no manifest names, as dead writers leave them; only while nobody writes."""
    live = {p.commit for v in _versions(spark, path) for p in _parts(spark, path, v)}
    dead = sorted(set(children(spark, f"{path}/commits")) - live)
    for c in dead:
        discard(spark, f"{path}/commits/{c}")
    return dead


def _read_parts(spark: SparkSession, path: str, parts: list[Part], where: Callable[[Part, T.StructType], Column | None]) -> DataFrame:
    """The rows of some parts: one scan for each commit they are in."""
    frames = []
    for commit in dict.fromkeys(p.commit for p in parts):
        own = [p for p in parts if p.commit == commit]
        schema = T.StructType.fromJson(json.loads(own[0].schema))
        rows = spark.read.schema(schema).parquet(f"{path}/commits/{commit}")
        rows = rows.where(F.col("split").isin([p.split for p in own]))
        further = where(own[0], schema)
        frames.append(rows if further is None else rows.where(further))
    if not frames:
        raise ValueError(f"no such split at {path}")
    return union_bags(*frames)


def read_bags(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Stored instances, all as of one manifest; ``split`` prunes folders."""
    return _read_parts(spark, path, stored_parts(spark, path, split), lambda part, schema: None)


def store_buckets(spark: SparkSession, path: str, split: str | None = None) -> int:
    """Number of buckets of the store, as training takes it; an error if appended parts differ in it."""
    found = {p.buckets for p in stored_parts(spark, path, split)}
    if len(found) != 1:
        raise ValueError(f"parts with {sorted(found)} buckets")
    return found.pop()


def read_bag(spark: SparkSession, path: str, bag_id, *, split: str | None = None) -> DataFrame:
    """One bag of the store: its bucket's folder in each commit, and within it the pages that may hold it."""

    def of_bag(part: Part, schema: T.StructType) -> Column:
        key = F.lit(bag_id).cast(schema["bag_id"].dataType)
        return (F.col("bag_bucket") == bag_bucket(key, part.buckets)) & (F.col("bag_id") == key)

    return _read_parts(spark, path, stored_parts(spark, path, split), of_bag)


def write_run(df: DataFrame, path: str) -> None:
    """Store a table with a ``run_id``, one folder per run; a run written again replaces itself only."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def save_model(spark: SparkSession, model: AttentionModel, path: str, run_id: str) -> None:
    """Add the parameters as ``run_id, kind, name, idx, value`` rows, replacing the run's earlier ones."""
    kind = next(k for k, c in MODEL_KINDS.items() if type(model) is c)
    rows = [
        (kind, name, list(idx), float(a[idx]))
        for name, a in model.arrays().items()
        for idx in itertools.product(*map(range, a.shape))
    ]
    frame = spark.createDataFrame(
        pd.DataFrame(rows, columns=["kind", "name", "idx", "value"]),
        "kind string, name string, idx array<int>, value double",
    )
    write_run(frame.withColumn("run_id", F.lit(run_id)).coalesce(1), path)


def load_model(spark: SparkSession, path: str, run_id: str) -> AttentionModel:
    """The parameters of one run; as many rows as the model has numbers."""
    rows = spark.read.parquet(path).where(F.col("run_id") == run_id).toPandas()
    if rows.empty:
        raise ValueError(f"no model stored for run {run_id!r}")
    cls = MODEL_KINDS[rows["kind"].iloc[0]]
    arrays = {}
    for name in [f.name for f in dataclasses.fields(cls)]:
        part = rows[rows["name"] == name]
        idx = np.array(part["idx"].tolist())
        a = np.empty(idx.max(axis=0) + 1)
        a[tuple(idx.T)] = part["value"].to_numpy()
        arrays[name] = a
    return cls(**arrays)
