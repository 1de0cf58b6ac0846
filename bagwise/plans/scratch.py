"""Reliable places to cut lineage: the shared folder the cluster names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; a local session without one gets a temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if configured is None:
            if not re.match(r"local(\[[^-]*\])?$", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
            configured = tempfile.mkdtemp(prefix="bagwise-")
        context.setCheckpointDir(configured)
    return configured or context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Compute a frame once and keep it where a lost executor does not take it away."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table under the checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Like :func:`settle` for frames with many rows: a columnar table in the scratch folder."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(place)] if system.exists(place) else []


def publish(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all; one that is there already is never replaced."""
    context, parent = spark._jvm.org.apache.hadoop.fs, path.rpartition("/")[0]
    place, draft = context.Path(path), context.Path(f"{parent}/.{uuid.uuid4().hex}")
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(place) or not system.rename(draft, place):
        system.delete(draft, False)
        raise FileExistsError(path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a written table; nothing happens if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
