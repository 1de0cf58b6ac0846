"""Many small text files: rows of one name go into a folder of their own."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The folder of rows without a name, as Spark calls it.
NAMELESS = "__HIVE_DEFAULT_PARTITION__"


def plain_folder(spark: SparkSession, path: str) -> str | None:
    """The folder's name in the file system if it is on a disk that is mounted; else nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme = place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    return place.toUri().getPath() if scheme == "file" else None


def write_parts(lines: DataFrame, path: str) -> None:
    """Write ``file, line`` as text under ``file=<file>`` folders; a large file is written by several tasks.

    On a mounted disk the tasks write the files themselves: Hadoop's local file system starts a process for
    each folder, file and checksum to set its mode, which takes longer than writing a small file. Names go
    into paths as they are there, so they hold no ``/`` and need no escapes.
    """
    dealt = lines.hint("rebalance", "file")
    folder = plain_folder(lines.sparkSession, path)
    if folder is None:
        dealt.withColumnRenamed("line", "value").write.partitionBy("file").text(path)
        return
    ended = F.concat("line", F.lit("\n")).cast("binary").alias("line")
    named = dealt.select(F.coalesce("file", F.lit(NAMELESS)).alias("file"), ended).sortWithinPartitions("file")
    named.mapInArrow(_part_writer(folder), "file string").write.format("noop").mode("overwrite").save()


def _part_writer(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A part appears under its name when it is whole; a task that is run again replaces it."""
        task = TaskContext.get()
        name, draft = f"part-{task.partitionId():05d}", f".{task.taskAttemptId()}"
        current, out = None, None

        def close() -> None:
            if out is not None:
                out.close()
                os.replace(f"{folder}/file={current}/{draft}", f"{folder}/file={current}/{name}")

        for batch in batches:
            if not batch.num_rows:
                continue
            files, lines = batch.column(0).dictionary_encode(), batch.column(1).cast(pa.binary())
            codes = files.indices.to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), batch.num_rows]
            ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + batch.num_rows + 1]
            text = memoryview(lines.buffers()[2])
            for begin, end in zip(starts, starts[1:]):
                file = files.dictionary[int(codes[begin])].as_py()
                if file != current:
                    close()
                    current = file
                    os.makedirs(f"{folder}/file={file}", exist_ok=True)
                    out = open(f"{folder}/file={file}/{draft}", "wb")
                out.write(text[ends[begin] : ends[end]])
        close()
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], ["file"])

    return write
