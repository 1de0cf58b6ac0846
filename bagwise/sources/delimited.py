"""Scans of the delimited inputs: manifest, fragment files, signature tables, labels."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.functions.columns import WHITESPACE, binarise_label, clean_position, label_key, plain_path, sample_from_path
from bagwise.operators.bags import union_bags
from bagwise.operators.prepare import FRAGMENT_COLUMNS, observe_faults
from bagwise.plans.lookup import BROADCAST_BYTES, ROW_OVERHEAD, lookup_join
from bagwise.plans.scratch import scratch_path, settle

# Cells of a fragment file that hold whole numbers, and those that hold any.
POSITIONS = ("frag_start", "frag_end")
NUMBERS = ("gc_content", "gc_weight")
# No file is cut below this size where only its head is read.
WHOLE = 1 << 50
HEAD_LINES = 64
# Files up to this size are read whole for their first lines, but for compressed ones.
SMALL_FILE = 32 << 20
COMPRESSED = r"\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"
FIRST_LINE = r"^\x{FEFF}?[\r\n]*([^\r\n]+)"
# Paths are listed this many in a task.
PATHS_A_TASK = 200
# Copies of a row that are made at a time, and rows that a task makes.
COPIES = 10_000
ROWS_A_TASK = 1_000_000
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
# Rows that are kept come from this many paths at a time, and a file counts as this much more than its bytes.
PATHS_A_SCAN = 20_000
OPENING = "spark.sql.files.openCostInBytes"
OPENING_BYTES = 128 << 10


def read_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    """``path, split, sample_name, label_key`` of each non-blank line."""
    line = F.btrim(F.col("value"), F.lit(WHITESPACE))
    sample = sample_from_path(F.col("path"))
    return (
        spark.read.text(path)
        .select(line.alias("path"))
        .where(F.col("path") != "")
        .withColumns({"split": F.lit(split), "sample_name": sample, "label_key": label_key(sample)})
    )


def fragment_schema(width: int) -> T.StructType:
    """All cells stay text at the scan, so that what cannot be read is still there to be counted."""
    names = [FRAGMENT_COLUMNS[i] if i < len(FRAGMENT_COLUMNS) else f"_c{i}" for i in range(width)]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def listing_tasks(spark: SparkSession, paths: Sequence[str]) -> str:
    """Into how many tasks a listing of the paths is cut: by default there are as many as paths, up to 10,000."""
    least = spark.sparkContext.defaultParallelism
    return str(min(int(spark.conf.get(LISTING)), max(least, len(paths) // PATHS_A_TASK)))


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The setting has the value inside and is put back after."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def listed_in_few_tasks(spark: SparkSession, paths: Sequence[str]):
    """Scans that are made inside list their paths in fewer tasks; the setting is put back after."""
    return _setting(spark, LISTING, listing_tasks(spark, paths))


def _unsplit_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, size, value`` of every line that is not blank; each file is one partition.

    The scan has a session of its own for that; settings of the caller's session stay as they are.
    """
    heads = spark.newSession()
    heads.conf.set(LISTING, listing_tasks(spark, paths))
    heads.conf.set("spark.sql.files.maxPartitionBytes", str(WHOLE))
    heads.conf.set("spark.sql.files.openCostInBytes", str(WHOLE))
    heads.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(HEAD_LINES))
    named = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")]
    return heads.read.text(list(paths)).select(*named, "value").where(F.col("value") != "")


def first_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, value``: the first line of every file that has one, in one scan that stops behind it.

    Each file is one partition and each task ends with its first line, so a file costs its head only.
    """
    return _heads(_unsplit_lines(spark, paths))


def _heads(lines: DataFrame) -> DataFrame:
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    return lines.select("file", "value").mapInArrow(first, "file string, value string")


def first_widths(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``file, width``: the number of cells in the first line of every file that has one.

    Small files are read as one value each, many in a task and without Python, as a task of its own would
    cost more than such a file, and so would a row for every line. Of large ones a task reads the head.
    Sizes select the files: those of small ones only are opened first.
    """
    with listed_in_few_tasks(spark, paths):
        files = spark.read.format("binaryFile").load(list(paths))
    small = (F.col("_metadata.file_size") <= SMALL_FILE) & ~F.col("_metadata.file_path").rlike(COMPRESSED)
    line = F.regexp_extract(F.col("content").cast("string"), FIRST_LINE, 1)
    heads = files.where(small).select(F.col("_metadata.file_path").alias("file"), line.alias("value")).where(F.col("value") != "")
    if not files.where(~small).select("length").isEmpty():
        large = (F.col("size") > SMALL_FILE) | F.col("file").rlike(COMPRESSED)
        heads = _heads(_unsplit_lines(spark, paths).where(large)).union(heads)
    return heads.select("file", F.size(F.split("value", "\t")).alias("width"))


def fragment_widths(spark: SparkSession, paths: Sequence[str]) -> dict[int, list[str]]:
    """The files of each width, by their first lines; if there is one width only, ``paths`` as they are."""
    widths = first_widths(spark, paths)
    found = widths.agg(F.collect_set("width")).first()[0]
    if len(found) <= 1:
        return {w: list(paths) for w in found}
    groups: dict[int, list[str]] = defaultdict(list)
    for r in widths.select(plain_path("file").alias("file"), "width").collect():
        groups[r.width].append(r.file)
    return dict(groups)


def with_row_ids(rows: DataFrame, *, distinct: bool = True) -> DataFrame:
    """Add ``instance_id``, the same for the same rows of a sample however files are split or scanned.

    It is a hash of the sample and the row's cells. Equal rows of a sample are numbered, which gives them
    different ids; which of them gets which does not matter, as they are equal. So nothing is ordered: they
    are counted, and each is made again as often as it was there. Counting moves one number per row; rows
    move if they repeat, or if so many ids do that their list cannot be broadcast. Without ``distinct``,
    equal rows share an id and no job runs.
    """
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in rows.columns]
    marked = rows.withColumn("instance_id", F.xxhash64(*cells))
    if not distinct:
        return marked
    counted = marked.groupBy("instance_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = settle(counted)
    n_ids, n_rows = repeated.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if not n_ids:
        return marked
    size = n_ids * (ROW_OVERHEAD + 2 * 8)
    if size > BROADCAST_BYTES:
        return _numbered(marked, marked.count())
    known = repeated.select("instance_id", F.lit(True).alias("_again"))
    flagged = lookup_join(marked, known, ["instance_id"], "left", table_bytes=size)
    once = flagged.where(F.col("_again").isNull()).drop("_again")
    again = flagged.where("_again").drop("_again")
    return once.unionByName(_numbered(again, n_rows))


def _numbered(marked: DataFrame, n_rows: int) -> DataFrame:
    """The marked rows, equal ones with an id for each copy.

    Rows are counted and each is unfolded into its copies: a run of at most ``COPIES`` at a time, dealt to
    as many tasks as the number of rows asks for. Different rows of one hash share its numbers.
    """
    keys = {c: f"_key{i}" for i, c in enumerate(c for c in marked.columns if c != "instance_id")}
    # Grouping makes one value of -0.0 and 0.0; the id tells them apart, and any row of a group has its value.
    own = [c for c in keys if not _groups_exactly(marked.schema[c].dataType)]
    counted = marked.groupBy("instance_id", *[F.col(f"`{c}`").alias(k) for c, k in keys.items()]).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(F.col(f"`{c}`")).alias(f"_own{keys[c]}") for c in own]
    )
    before = Window.partitionBy("instance_id").orderBy(*[k for c, k in keys.items() if c not in own], "_n")
    earlier = F.coalesce(F.sum("_n").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = F.col("_before") + F.col("_n")
    runs = counted.withColumn("_before", earlier).withColumn("_from", F.explode(F.sequence(F.col("_before") + 1, last, F.lit(COPIES))))
    dealt = runs.withColumn("_to", F.least(last, F.col("_from") + (COPIES - 1))).repartition(
        max(1, -(-n_rows // ROWS_A_TASK)), "instance_id", "_from"
    )
    copies = dealt.withColumn("_copy", F.explode(F.sequence("_from", "_to")))
    values = [F.col(f"_own{k}" if c in own else k).alias(c) for c, k in keys.items()]
    first = F.col("_copy") == 1
    return copies.select(*values, F.when(first, F.col("instance_id")).otherwise(F.xxhash64("instance_id", "_copy")).alias("instance_id"))


def _groups_exactly(kind: T.DataType) -> bool:
    """Whether equal group keys of the type are the same value, and the type can be ordered."""
    return not any(word in kind.simpleString() for word in ("float", "double", "map", "struct", "array"))


def _fragment_scan(spark: SparkSession, width: int, paths: Sequence[str]) -> DataFrame:
    with listed_in_few_tasks(spark, paths):
        return spark.read.schema(fragment_schema(width)).option("sep", "\t").csv(list(paths))


def _scans(
    spark: SparkSession, paths: Sequence[str], width: int | None, extra_features: str, sample_of: Callable[[Column], Column]
) -> dict[int, DataFrame]:
    """A scan of the files of each width; none if no file has a line."""
    groups = {width: list(paths)} if width else fragment_widths(spark, paths)
    scans = {}
    for w, some in groups.items():
        scan = _fragment_scan(spark, w, some)
        scan = scan.select("*", sample_of(plain_path(F.col("_metadata.file_path"))).alias("sample_name"))
        scans[w] = scan if extra_features == "keep" else scan.drop(*[f"_c{i}" for i in range(len(FRAGMENT_COLUMNS), w)])
    return scans


def _kept_scans(
    spark: SparkSession, paths: Iterable[str], width: int | None, extra_features: str, sample_of: Callable[[Column], Column]
) -> dict[int, DataFrame]:
    """The same rows from a table for each width, written to the scratch folder.

    The text is parsed once, however often the rows are read. What the driver knows of the files (their
    states, their places in tasks) it knows of ``PATHS_A_SCAN`` paths at a time, and small files are packed
    into tasks by their bytes.
    """
    root, schemas = scratch_path(spark, "fragment-rows"), {}
    set_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for some in batched(paths, PATHS_A_SCAN):
        with _setting(spark, OPENING, str(min(set_bytes(spark.conf.get(OPENING)), OPENING_BYTES))):
            for w, scan in _scans(spark, some, width, extra_features, sample_of).items():
                scan.write.mode("append").parquet(f"{root}/width-{w}")
                schemas[w] = scan.schema
    return {w: spark.read.schema(schema).parquet(f"{root}/width-{w}") for w, schema in schemas.items()}


def read_fragments(
    spark: SparkSession,
    paths: Iterable[str],
    *,
    width: int | None = None,
    extra_features: str = "keep",
    sample_of: Callable[[Column], Column] = sample_from_path,
    distinct_ids: bool = True,
    faults: Observation | None = None,
) -> DataFrame:
    """All fragment files, each scanned once, with ``sample_name`` and ``instance_id`` per row.

    Files of different width are scanned once per width and united by name. Give ``width`` to skip
    looking at first lines. Columns past the tenth are kept as further features or dropped.
    Ids are those of :func:`with_row_ids`; counting equal rows for them runs jobs: the rows are kept in the
    scratch folder, as they are read again, and the paths need not be a list. With ``distinct_ids`` off,
    nothing is kept and the scan is the frame's own. Positions that are no whole numbers become null.
    ``faults`` receives the numbers of unreadable cells (:func:`observe_faults`) from whatever job reads
    the rows.
    """
    if extra_features not in ("keep", "drop"):
        raise ValueError("extra_features must be 'keep' or 'drop'")
    if distinct_ids:
        scans = _kept_scans(spark, paths, width, extra_features, sample_of)
    else:
        paths = list(paths)
        scans = _scans(spark, paths, width, extra_features, sample_of)
    if not scans:
        none = [F.lit(None).cast("string").alias(c) for c in (*FRAGMENT_COLUMNS, "sample_name")]
        scans = {len(FRAGMENT_COLUMNS): spark.range(0).select(*none)}
    rows = with_row_ids(union_bags(*[scans[w] for w in sorted(scans)]), distinct=distinct_ids)
    if faults is not None:
        rows = observe_faults(rows, number_columns(rows), [c for c in POSITIONS if c in rows.columns], faults)
    return rows.withColumns({c: clean_position(c) for c in POSITIONS if c in rows.columns})


def read_fragment_cells(
    spark: SparkSession, paths: Sequence[str], *, sample_of: Callable[[Column], Column] = sample_from_path
) -> DataFrame:
    """The rows with all cells as text, as :func:`cell_faults` counts them by file."""
    groups = fragment_widths(spark, paths) or {len(FRAGMENT_COLUMNS): list(paths)}
    scans = [_fragment_scan(spark, w, some) for w, some in sorted(groups.items())]
    return union_bags(*[s.select("*", sample_of(plain_path(F.col("_metadata.file_path"))).alias("sample_name")) for s in scans])


def number_columns(fragments: DataFrame) -> list[str]:
    """The file's own numbers, in feature order."""
    return [*[c for c in NUMBERS if c in fragments.columns], *extra_columns(fragments)]


def extra_columns(fragments: DataFrame) -> list[str]:
    """Columns past the named ones, in file order."""
    extras = [c for c in fragments.columns if c.startswith("_c") and c[2:].isdigit()]
    return sorted(extras, key=lambda c: int(c[2:]))


def read_signatures(spark: SparkSession, path: str) -> DataFrame:
    """A signature table as text columns; its header names them."""
    return spark.read.option("header", True).csv(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """``label_key, tissue, label, row_no`` of a label file; ``row_no`` follows the file's order."""
    return (
        spark.read.option("header", True)
        .option("sep", "\t")
        .csv(path)
        .select(
            F.col("V1").alias("label_key"),
            F.col("Tissue").alias("tissue"),
            binarise_label("Tissue").alias("label"),
            F.monotonically_increasing_id().alias("row_no"),
        )
    )
