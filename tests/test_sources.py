import re

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from bagwise.functions.columns import sample_from_path
from bagwise.operators.joins import attach_labels
from bagwise.operators.model import AttentionModel, GatedAttentionModel
from bagwise.operators.pooling import attention_weights
from bagwise.operators.prepare import cell_faults, clean_columns
from bagwise.operators.scaling import feature_ranges
from bagwise.plans import lookup
from bagwise.plans.instances import bags_of, frequency_instances, signature_features, signature_instances
from bagwise.plans.scratch import settle
from bagwise.sources import (
    load_model,
    read_bags,
    read_fragment_cells,
    read_fragments,
    read_labels,
    read_manifest,
    read_signatures,
    save_model,
    write_bags,
    write_run,
)
from bagwise.sources.delimited import first_lines, fragment_widths
from bagwise.sources import store
from bagwise.sources.store import read_bag, store_buckets, stored_parts, sweep_bags


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("inputs")
    rows = {
        "S1raw_frag.bed": [
            "chr1\t100\t260\t160-169\tCCCA\tTGGA\t0.42\t1.03\t0\t1.0",
            "chr1\t300\t470\t170-179\tCCCA\tAAAA\t  \t\t0\t1.0",
            "chr2\t5\t165\t160-169\tGGGG\t\t0.5\t2.0\t1\t1.0",
        ],
        "S2raw_frag.bed": ["chr3\t1\t151\t150-159\tCCCA\tTGGA\t0.1\t0.2", "chr3\t2\t202\t200-209\tTTTT\tTGGA\tbad\t0.4"],
        "S3raw_frag.bed": ["chr4\t10\t20\t10-19\tCCCA\tTGGA\t0.9\t0.8\t0\t1.0\t7.5"],
        "S4raw_frag.bed": [],
    }
    for name, lines in rows.items():
        (root / name).write_text("".join(f"{line}\n" for line in lines))
    (root / "manifest.txt").write_text("\n".join(["", *[f"  {root / n} " for n in rows], " \t"]) + "\n")
    signature = {
        "out5p": ["x_filtered_S1raw_v7,CCCA,0.5,1.5", "x_filtered_S1raw_v7,GGGG, ,2.5", "x_filtered_S2raw_v7,CCCA,0.7,1.7"],
        "in5p": ["x_filtered_S1raw_v7,TGGA,0.1,0.2", "x_filtered_S2raw_v7,TGGA,0.3,0.4", "nothing,TGGA,9,9"],
        "length_bin": ["x_filtered_S1raw_v7,160_169,3,4", "x_filtered_S2raw_v7,150_159,5,6", "x_filtered_S2raw_v7,150_159,7,8"],
    }
    for token, lines in signature.items():
        (root / f"{token}.csv").write_text("Sample,Motif,a,b\n" + "\n".join(lines) + "\n")
    (root / "labels.tsv").write_text("id\tV1\tTissue\n1\tS1\tHealthy\n2\tS2\tHealthy\n3\tS2\tBreast\n4\tS3\t\n")
    return root


def paths(spark, files):
    return [r.path for r in read_manifest(spark, str(files / "manifest.txt"), "train").collect()]


def test_manifest_and_labels(spark, files):
    manifest = read_manifest(spark, str(files / "manifest.txt"), "train")
    assert sorted(r.sample_name for r in manifest.collect()) == ["S1raw", "S2raw", "S3raw", "S4raw"]
    labels = read_labels(spark, str(files / "labels.tsv"))
    found = {r.bag_id: (r.label, r.label_source) for r in attach_labels(bags_of(manifest), labels).collect()}
    assert found == {"S1raw": (0, "table"), "S2raw": (1, "table"), "S3raw": (1, "table"), "S4raw": (1, "default")}


def test_unknown_label_can_be_an_error(spark, files):
    manifest = read_manifest(spark, str(files / "manifest.txt"), "train")
    with pytest.raises(Exception, match="no label for S4"):
        attach_labels(bags_of(manifest), read_labels(spark, str(files / "labels.tsv")), on_missing="error").collect()


def test_widths_and_extra_columns(spark, files):
    some = paths(spark, files)
    widths = fragment_widths(spark, some)
    names = {w: [p.rsplit("/", 1)[1] for p in some] for w, some in widths.items()}
    assert names == {10: ["S1raw_frag.bed"], 8: ["S2raw_frag.bed"], 11: ["S3raw_frag.bed"]}
    kept = read_fragments(spark, some)
    assert "_c10" in kept.columns
    assert {(r.sample_name, r._c10) for r in kept.collect()} == {("S1raw", None), ("S2raw", None), ("S3raw", "7.5")}
    assert "_c10" not in read_fragments(spark, some, extra_features="drop").columns
    ids = [(r.sample_name, r.instance_id) for r in kept.collect()]
    assert len(set(ids)) == 6
    fixed = read_fragments(spark, some, width=8)
    assert fixed.count() == 6 and dict(fixed.dtypes)["frag_start"] == "bigint"


def test_only_empty_files(spark, files):
    assert read_fragments(spark, [str(files / "S4raw_frag.bed")]).count() == 0


def test_signature_path(spark, files):
    rows = read_fragments(spark, paths(spark, files))
    tables = {t: read_signatures(spark, str(files / f"{t}.csv")) for t in ("out5p", "in5p", "length_bin")}
    names = signature_features(rows, tables)
    assert names == ["gc_content", "gc_weight", "_c10", "a_out", "b_out", "a_in", "b_in", "a_len", "b_len"]
    with pytest.warns(UserWarning, match="length_bin"):
        made = signature_instances(rows, tables)
    found = sorted((r.bag_id, r.features) for r in made.collect())
    assert found == sorted(
        [
            ("S1raw", [0.42, 1.03, 0, 0.5, 1.5, 0.1, 0.2, 3, 4]),
            ("S1raw", [0, 0, 0, 0.5, 1.5, 0, 0, 0, 0]),
            ("S1raw", [0.5, 2.0, 0, 0, 2.5, 0, 0, 3, 4]),
            ("S2raw", [0.1, 0.2, 0, 0.7, 1.7, 0.3, 0.4, 5, 6]),
            ("S2raw", [0.1, 0.2, 0, 0.7, 1.7, 0.3, 0.4, 7, 8]),
            ("S2raw", [0, 0.4, 0, 0, 0, 0.3, 0.4, 0, 0]),
            ("S3raw", [0.9, 0.8, 7.5, 0, 0, 0, 0, 0, 0]),
        ]
    )
    assert made.select("bag_id", "instance_id").distinct().count() == 7
    # Without broadcasting, the same rows come out of the salted shuffle.
    with pytest.warns(UserWarning):
        shuffled = signature_instances(rows, tables, budget=-1)
    assert sorted((r.bag_id, r.features) for r in shuffled.collect()) == found
    with pytest.warns(UserWarning):
        scaled = signature_instances(rows, tables, scale=True)
    s1 = sorted(r.features[0] for r in scaled.where("bag_id = 'S1raw'").collect())
    assert s1 == pytest.approx([0, 0.84, 1.0])
    assert scaled.where("bag_id = 'S3raw'").first().features == [0.0] * 9


def test_kept_rows_are_parsed_once_by_few_paths(spark, tmp_path, monkeypatch):
    """Rows that are read again come from a table: some paths at a time, many small files in a task."""
    from bagwise.sources import delimited

    line = "chr{0}\t{0}\t260\t160-169\tCCCA\t\t0.42\t1.03".format
    lines = {i: line(i) + "\t\"0\"\t1.0\t7.5"[: 4 * (i % 100 == 0) + 9 * (i % 200 == 0)] for i in range(300)}
    for i, line in lines.items():
        (tmp_path / f"S{i}raw_x.bed").write_text(f"\n{line}\n" * (i % 2 + 1))
    (tmp_path / "S300raw_x.bed").write_text("")
    some = sorted(str(p) for p in tmp_path.iterdir())
    plain = read_fragments(spark, some, distinct_ids=False)
    scanned, batches = delimited._fragment_scan, []
    monkeypatch.setattr(delimited, "_fragment_scan", lambda s, w, p: batches.append((w, len(p))) or scanned(s, w, p))
    monkeypatch.setattr(delimited, "PATHS_A_SCAN", 160, raising=False)
    settings = {"spark.sql.files.openCostInBytes": "4m", "spark.sql.files.maxPartitionBytes": "4m"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = read_fragments(spark, iter(some))
        assert {k: spark.conf.get(k) for k in settings} == settings
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert sum(n for _, n in batches) in (300, 301) and max(n for _, n in batches) <= 160
    cells = [c for c in plain.columns if c != "instance_id"]
    assert sorted(map(str, rows.select(cells).collect())) == sorted(map(str, plain.select(cells).collect()))
    assert len({r.instance_id for r in rows.collect()}) == rows.count() == 450
    parts = rows.inputFiles()
    assert not any(f"{tmp_path.name}/S" in p for p in parts) and len(parts) < 60


def test_scaled_rows_are_joined_once(spark, files, monkeypatch):
    """Hot samples are counted once, in rows that are not joined yet; ends of bags are joined along."""
    rows = read_fragments(spark, paths(spark, files))
    tables = {t: read_signatures(spark, str(files / f"{t}.csv")) for t in ("out5p", "in5p", "length_bin")}
    hot, counted = lookup.hot_keys, []
    with pytest.warns(UserWarning):
        wide = signature_instances(rows, tables, scale=True)
    monkeypatch.setattr(lookup, "hot_keys", lambda rows, *a: counted.append(rows) or hot(rows, *a))
    with pytest.warns(UserWarning):
        narrow = signature_instances(rows, tables, scale=True, budget=-1)
    own = [r for r in counted if "instance_id" in r.columns]
    assert len(own) == 1 and "Join" not in own[0]._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, narrow.collect())) == sorted(map(str, wide.collect()))


def test_scaling_is_compiled(spark, files, capsys):
    """The JVM interprets methods of over 8,000 bytes, which is many times slower."""
    rows = read_fragments(spark, paths(spark, files), width=8)
    tables = {t: read_signatures(spark, str(files / f"{t}.csv")) for t in ("out5p", "in5p", "length_bin")}
    with pytest.warns(UserWarning):
        scaled = signature_instances(rows, tables, scale=True)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        scaled.groupBy("bag_id").agg(*[F.sum(F.col("features")[i]) for i in range(8)]).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert 0 < max(sizes) < 8000


def test_frequency_path(spark, files):
    made = frequency_instances(read_fragments(spark, paths(spark, files)))
    found = sorted((r.bag_id, r.features) for r in made.collect())
    assert found == sorted(
        [
            ("S1raw", [0.42, 0.0, 0.0, 1.0, 0.0]),
            ("S1raw", [0.0, 0.0, 1.0, 1.0, 0.0]),
            ("S1raw", [0.5, 0.0, 0.0, 0.0, 0.0]),
            ("S2raw", [0.1, 0.0, 0.0, 0.0, 0.0]),
            ("S2raw", [0.0, 0.0, 1.0, 0.0, 0.0]),
            ("S3raw", [0.9, 7.5, 0.0, 0.0, 0.0]),
        ]
    )


def test_bag_store(spark, tmp_path):
    rows = spark.range(500).select(
        (F.col("id") % 7).alias("bag_id"),
        F.col("id").alias("instance_id"),
        F.array(F.col("id").cast("double")).alias("features"),
        F.lit(1).alias("label"),
        F.when(F.col("id") % 7 < 3, "train").otherwise("test").alias("split"),
    )
    path = str(tmp_path / "bags")
    write_bags(rows, path, buckets=4)
    assert read_bags(spark, path).count() == 500
    assert {r.bag_id for r in read_bags(spark, path, "train").collect()} == {0, 1, 2}
    one = read_bag(spark, path, 5)
    assert one.count() == rows.where("bag_id = 5").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bag_bucket" in plan and "EqualTo(bag_id,5)" in plan


def test_splits_are_written_in_turn(spark, tmp_path):
    def rows(ids, split):
        return spark.createDataFrame([(b, b, [1.0], 1, split) for b in ids], "bag_id long, instance_id long, features array<double>, label int, split string")

    path = str(tmp_path / "bags")
    write_bags(rows(range(20), "train"), path, buckets=4)
    write_bags(rows(range(5), "test"), path, buckets=4)
    assert read_bags(spark, path, "train").count() == 20 and read_bags(spark, path, "test").count() == 5
    write_bags(rows([3], "train"), path, buckets=4)
    assert [r.bag_id for r in read_bags(spark, path, "train").collect()] == [3]
    assert read_bags(spark, path, "test").count() == 5


@pytest.mark.parametrize("name", ["S 1raw", "S%1raw", "S+1raw", "S#1raw"])
def test_sample_names_with_escapes(spark, tmp_path, name):
    path = tmp_path / f"{name}_x.bed"
    path.write_text("chr1\t100\t260\t160-169\tCCCA\tTGGA\t0.42\t1.03\n")
    assert read_fragments(spark, [str(path)], width=8).first().sample_name == name


def test_hot_bag_is_split_when_written(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 50).alias("bag_id"),
        F.col("id").alias("instance_id"),
        F.array(F.rand(1), F.rand(2), F.rand(3)).alias("features"),
        F.lit(1).alias("label"),
        F.lit("train").alias("split"),
    )
    path = str(tmp_path / "bags")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        write_bags(rows, path, buckets=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = read_bags(spark, path)
    per_bag = {r.bag_id: r for r in stored.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.col("_metadata.file_path")).alias("files")).collect()}
    assert per_bag[-1].n == 20_000 and per_bag[-1].files > 1
    assert stored.count() == 60_000


def test_run_tables_replace_only_their_run(spark, tmp_path):
    path = str(tmp_path / "history")
    for run, loss in (("a", 1.0), ("b", 2.0), ("a", 3.0)):
        write_run(spark.createDataFrame([(run, 1, loss)], "run_id string, epoch int, loss double"), path)
    assert {(r.run_id, r.loss) for r in spark.read.parquet(path).collect()} == {("a", 3.0), ("b", 2.0)}


def test_model_store(spark, tmp_path):
    path = str(tmp_path / "models")
    models = {"a": AttentionModel.random(3, 4, 1), "b": GatedAttentionModel.random(2, 3, 2), "c": AttentionModel.random(5, 2, 3)}
    for run, model in models.items():
        save_model(spark, model, path, run)
    save_model(spark, models["a"], path, "c")
    models["c"] = models["a"]
    for run, model in models.items():
        loaded = load_model(spark, path, run)
        assert type(loaded) is type(model)
        for name, a in model.arrays().items():
            np.testing.assert_array_equal(loaded.arrays()[name], a)
    with pytest.raises(ValueError):
        load_model(spark, path, "absent")


def identified(spark, folder, **options):
    """Rows with their ids, under a size of scan splits."""
    rows = read_fragments(spark, [str(p) for p in sorted(folder.iterdir())], **options)
    return sorted(map(str, rows.collect()))


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    """Files with equal rows in one file and in two files of a sample."""
    root = tmp_path_factory.mktemp("many")
    line = "chr{}\t{}\t{}\t160-169\tCCCA\tTGGA\t0.42\t1.03"
    for name in ("S1raw_a.bed", "S1raw_b.bed", "S2raw_a.bed"):
        lines = [line.format(i % 3, i % 50, i % 50 + 160) for i in range(400)] + [line.format(9, 1, 2)] * 300
        (root / name).write_text("\n".join(lines) + "\n")
    return root


def test_ids_do_not_depend_on_the_scan(spark, many):
    found = identified(spark, many)
    assert len(set(found)) == len(found) == 2100
    for size in (1000, 4096):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            assert identified(spark, many) == found
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    shared = identified(spark, many, distinct_ids=False)
    assert len(shared) == 2100 and len(set(shared)) == 2 * 151


@pytest.mark.parametrize("budget", [64 << 20, -1])
def test_equal_rows_are_counted_not_ordered(spark, monkeypatch, budget):
    """Every copy has an id of its own, and the rows are as they were; plain rows keep theirs."""
    from bagwise.sources import delimited

    monkeypatch.setattr(delimited, "BROADCAST_BYTES", budget, raising=False)
    monkeypatch.setattr(delimited, "COPIES", 7, raising=False)
    monkeypatch.setattr(delimited, "ROWS_A_TASK", 50, raising=False)
    kinds = "sample_name string, cell string, x double, parts array<double>"
    twins = [("S1", None, -0.0, [0.0]), ("S1", "\0", -0.0, [0.0]), ("S1", "a", 0.0, [-0.0]), (None, "b", float("nan"), None)]
    given = [(twins[0], 3), (twins[1], 2), (twins[2], 100), (twins[3], 2), (("S2", "one", 1.0, []), 1)]
    rows = spark.createDataFrame([r for r, n in given for _ in range(n)], kinds).repartition(3)
    found = delimited.with_row_ids(rows)
    assert sorted(map(str, found.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    ids = {r.instance_id for r in found.collect()}
    assert len(ids) == rows.count() == 108
    # Rows of one hash share its numbers: a null and the cell that stands for it.
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rows.columns]
    hashes = rows.groupBy(F.xxhash64(*cells).alias("h")).agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    assert ids == {r[0] for r in hashes.select(F.when(F.col("k") == 1, F.col("h")).otherwise(F.xxhash64("h", "k"))).collect()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_nth" not in plan and "RepartitionByExpression" in plan


def test_ids_survive_another_name(spark, many, tmp_path):
    for p in many.iterdir():
        (tmp_path / p.name.replace("_", "_moved_")).write_text(p.read_text())
    assert identified(spark, tmp_path) == identified(spark, many)


def test_attention_joins_back_to_fragments(spark, files):
    rows = read_fragments(spark, paths(spark, files)).where("sample_name <> 'S3raw'").cache()
    tables = {t: read_signatures(spark, str(files / f"{t}.csv")) for t in ("out5p", "in5p", "length_bin")}
    twice = {**tables, "length_bin": tables["length_bin"].union(tables["length_bin"])}  # equal signature rows
    only = {"out5p": tables["out5p"], "in5p": tables["in5p"]}
    made = signature_instances(rows, only)
    weights = attention_weights(made, AttentionModel.random(7, 4)).join(rows, "instance_id")
    assert weights.count() == rows.count() == 5
    with pytest.warns(UserWarning):
        several = signature_instances(rows, twice, fragment_ids=True).collect()
    assert len({r.instance_id for r in several}) == len(several) == 2 + 1 + 2 + 4 + 1
    ids = {r.instance_id for r in rows.collect()}
    assert {r.fragment_id for r in several} == ids and ids <= {r.instance_id for r in several}
    with pytest.warns(UserWarning):
        again = signature_instances(rows, twice, fragment_ids=True, budget=-1).collect()
    assert sorted(map(str, again)) == sorted(map(str, several))


def test_first_lines_come_from_one_scan(spark, files, tmp_path):
    big = tmp_path / "S9raw_big.bed"
    big.write_text("\n\n" + "a\tb\n" * 300_000)
    some = [*paths(spark, files), str(big)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    heads = first_lines(spark, some)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "Union" not in plan
    assert sorted(r.value.count("\t") + 1 for r in heads.collect()) == [2, 8, 10, 11]
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


@pytest.mark.parametrize("small", [32 << 20, 30])
def test_small_files_share_tasks(spark, tmp_path, monkeypatch, small):
    """Widths of many small files, by first lines that are not blank; larger ones are read by their heads."""
    from bagwise.sources import delimited

    for i in range(80):
        cells = "\t".join("x" * (8 + i % 3))
        (tmp_path / f"S{i}raw_x.bed").write_text("" if i == 79 else f"\n\n{cells}\n" + "a\tb\n" * (i // 2))
    some = [str(p) for p in tmp_path.iterdir()]
    monkeypatch.setattr(delimited, "SMALL_FILE", small, raising=False)
    before, context = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism"), spark.sparkContext
    context.setJobGroup(f"widths-{small}", "widths")
    try:
        widths = fragment_widths(spark, some)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    names = {w: sorted(int(p.rsplit("/S", 1)[1].split("raw")[0]) for p in found) for w, found in widths.items()}
    assert names == {8 + k: [i for i in range(79) if i % 3 == k] for k in range(3)}
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
    if small > 30:
        tracker = context.statusTracker()
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"widths-{small}") for s in tracker.getJobInfo(j).stageIds]
        assert 0 < max(s.numTasks for s in stages if s) < 40


def test_faults_are_counted_while_rows_are_read(spark, tmp_path):
    cells = [("1e3", "10", "NaN", "1"), ("1", " 2 ", "x", " inf "), ("", "x", "1e3", "0.5"), ("7", "NaN", " ", "-Infinity")]
    for name, some in (("S1raw_x.bed", cells[:2]), ("S2raw_x.bed", cells[2:])):
        (tmp_path / name).write_text("".join(f"chr1\t{a}\t{b}\t1-2\tC\tT\t{c}\t{d}\n" for a, b, c, d in some))
    some = [str(p) for p in tmp_path.iterdir()]
    seen = Observation()
    rows = read_fragments(spark, some, faults=seen).collect()
    assert sorted((r.frag_start, r.frag_end) for r in rows if r.frag_start) == [(1, 2), (7, None)]
    assert {k: v for k, v in seen.get.items() if v} == {
        "frag_start_malformed": 1, "frag_end_malformed": 2, "gc_content_nan": 1, "gc_content_malformed": 1, "gc_weight_infinite": 2,
    }
    found = cell_faults(read_fragment_cells(spark, some), ["gc_content", "gc_weight"], ["frag_start", "frag_end"])
    assert sorted(map(tuple, found.collect())) == [
        ("S1raw", "frag_start", 1, 0, 0), ("S1raw", "gc_content", 1, 1, 0), ("S1raw", "gc_weight", 0, 0, 1),
        ("S2raw", "frag_end", 2, 0, 0), ("S2raw", "gc_weight", 0, 0, 1),
    ]
    # One bad cell is no reason to stop: it is 0 from here on.
    assert sorted(r.features[0] for r in frequency_instances(read_fragments(spark, some)).collect()) == [0, 0, 0, 1000]


def test_frequency_path_reads_its_rows_twice(spark, files, monkeypatch):
    from bagwise.plans import instances

    rows, settled = read_fragments(spark, paths(spark, files), width=10, distinct_ids=False), []
    monkeypatch.setattr(instances, "settle", lambda df: settled.append(df) or settle(df))
    made = frequency_instances(rows)
    scans = [df._jdf.queryExecution().optimizedPlan().toString().count("] csv") for df in (*settled, made)]
    assert scans == [1, 0, 1]


def test_part_files_can_be_samples(spark):
    path = spark.range(1).select(F.lit("/x/S1_a/part-7_b.bed").alias("p"))
    assert path.select(sample_from_path("p")).first()[0] == "S1"
    assert path.select(sample_from_path("p", part_folders=False)).first()[0] == "part-7"


def bag_rows(spark, ids, split):
    return spark.createDataFrame([(b, b, [float(b)], 1, split) for b in ids], "bag_id long, instance_id long, features array<double>, label int, split string")


def test_a_writer_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "bags")
    write_bags(bag_rows(spark, range(20), "train"), path, buckets=4)
    before = sorted(map(str, read_bags(spark, path).collect()))
    # Within the write, after some files are there.
    broken = bag_rows(spark, range(20, 60), "train").repartition(8).withColumn(
        "label", F.when(F.col("bag_id") == 57, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("label"))
    )
    with pytest.raises(Exception, match="lost"):
        write_bags(broken, path, buckets=4)
    assert sorted(map(str, read_bags(spark, path).collect())) == before
    # Between the write and the manifest.
    with monkeypatch.context() as m:
        m.setattr(store, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("driver lost")))
        with pytest.raises(RuntimeError):
            write_bags(bag_rows(spark, [99], "train"), path, buckets=4)
    assert sorted(map(str, read_bags(spark, path).collect())) == before
    assert len(sweep_bags(spark, path)) >= 1 and sweep_bags(spark, path) == []
    assert sorted(map(str, read_bags(spark, path).collect())) == before
    with pytest.raises(ValueError, match="without a split"):
        write_bags(bag_rows(spark, [1], None), path)
    with pytest.raises(ValueError, match="no bag store"):
        read_bags(spark, str(tmp_path / "none"))


def test_a_reader_at_work_keeps_its_state(spark, tmp_path):
    path = str(tmp_path / "bags")
    write_bags(bag_rows(spark, range(20), "train"), path, buckets=4)
    reading = read_bags(spark, path, "train")
    write_bags(bag_rows(spark, [3], "train"), path, buckets=8)
    assert reading.count() == 20 and read_bags(spark, path, "train").count() == 1
    write_bags(bag_rows(spark, [4], "train"), path, buckets=8)
    assert len({p.commit for p in stored_parts(spark, path)}) == 1


def test_bucket_counts_come_from_the_store(spark, tmp_path):
    path = str(tmp_path / "bags")
    write_bags(bag_rows(spark, range(20), "train"), path, buckets=4)
    assert store_buckets(spark, path) == 4
    write_bags(bag_rows(spark, range(15, 30), "train"), path, buckets=7, mode="append")
    write_bags(bag_rows(spark, range(30, 33), "a/b=c"), path, buckets=2)
    assert read_bags(spark, path, "train").count() == 35 and read_bags(spark, path, "a/b=c").count() == 3
    for bag, n in ((3, 1), (17, 2), (29, 1), (31, 1), (50, 0)):
        assert read_bag(spark, path, bag).count() == n
    with pytest.raises(ValueError, match="buckets"):
        store_buckets(spark, path, "train")
    assert store_buckets(spark, path, "a/b=c") == 2


def test_scaled_path_joins_its_rows_once(spark, files, monkeypatch):
    """Ranges from tokens are those of the joined rows, and only a scan of its own is spent on them."""
    from bagwise.plans import instances

    rows, settled = read_fragments(spark, paths(spark, files), width=10, distinct_ids=False), []
    tables = {t: read_signatures(spark, str(files / f"{t}.csv")) for t in ("out5p", "in5p", "length_bin")}
    names = signature_features(rows, tables)
    with pytest.warns(UserWarning):
        plain = signature_instances(rows, tables)
    flat = plain.select("bag_id", *[F.col("features")[i].alias(n) for i, n in enumerate(names)])
    expected = {r.bag_id: r for r in feature_ranges(flat, names).collect()}
    typed = {t: clean_columns(tables[t], ["a", "b"]) for t in tables}
    named = rows.withColumn("length_bin", F.replace("length_bin", F.lit("-"), F.lit("_"))).withColumnRenamed("sample_name", "bag_id")
    monkeypatch.setattr(instances, "settle", lambda df: settled.append(df) or settle(df))
    found = instances.signature_ranges(named, typed, ["gc_content", "gc_weight"])
    assert {r.bag_id: {c: r[c] for c in r.asDict()} for r in found.collect()} == {b: r.asDict() for b, r in expected.items()}
    assert len(settled) == 1 and settled[0]._jdf.queryExecution().optimizedPlan().toString().count("] csv") == 1


def test_tasks_write_many_small_files(spark, tmp_path):
    """What Spark's writer would have written, without a process for each file's mode, and no drafts left."""
    from bagwise.sources.parts import write_parts

    rows = spark.range(3000).select(
        F.when(F.col("id") % 71 != 5, F.concat(F.lit("S"), F.col("id") % 71)).alias("file"),
        F.when(F.col("id") % 3 == 0, " x ").when(F.col("id") % 3 == 1, 'a"b\tc').alias("a"),
        F.when(F.col("id") % 2 == 0, "").alias("b"),
        F.lit("\u00e9\u4e00").alias("c"),
        "id",
    )
    cells = F.struct("a", "b", "c", "id")
    write_parts(rows.select("file", F.to_csv(cells, {"sep": "\t"}).alias("line")), f"{tmp_path}/ours")
    rows.write.partitionBy("file").option("sep", "\t").csv(f"{tmp_path}/spark")

    def lines(root):
        return sorted((p.parent.name, line) for p in root.glob("file=*/part-*") for line in p.read_bytes().split(b"\n")[:-1])

    assert lines(tmp_path / "ours") == lines(tmp_path / "spark") and len(lines(tmp_path / "ours")) == 3000
    assert not list((tmp_path / "ours").glob("*/.*"))
    assert spark.read.csv(f"{tmp_path}/ours", sep="\t").where("file = 'S7'").count() == 43


def test_a_file_may_span_batches_and_tasks(spark, tmp_path):
    from bagwise.sources.parts import write_parts

    rows = spark.range(40_000).select(F.when(F.col("id") % 4 > 0, "big").otherwise(F.col("id").cast("string")).alias("file"), F.sha2(F.col("id").cast("string"), 256).alias("line"), "id")
    for n, size in enumerate(("64MB", "200KB")):
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        try:
            write_parts(rows.where("id % 4 > 0 or id < 400").drop("id"), f"{tmp_path}/{n}")
        finally:
            spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
        found = spark.read.text(f"{tmp_path}/{n}").selectExpr("file", "value as line")
        assert found.exceptAll(rows.drop("id")).isEmpty() and found.count() == 30_100
    assert len(list((tmp_path / "1" / "file=big").glob("part-*"))) > 1


def test_another_file_system_gets_its_files_from_spark(spark, tmp_path, monkeypatch):
    from bagwise.sources import parts

    monkeypatch.setattr(parts, "plain_folder", lambda *a: None)
    parts.write_parts(spark.createDataFrame([("S1", "a\tb"), ("S2", "c")], "file string, line string"), f"{tmp_path}/x")
    assert sorted(map(tuple, spark.read.text(f"{tmp_path}/x").collect())) == [("a\tb", "S1"), ("c", "S2")]


def test_widths_make_no_row_of_every_line(spark, tmp_path):
    """A small file is one value; a mark at its start, other line ends and packed files are as in a scan of lines."""
    import gzip

    from bagwise.sources.delimited import first_widths

    some = {"S1_x.bed": b"\xef\xbb\xbf\n\r\na\tb\tc\nd\n", "S2_x.bed": b"a\tb\rc\n", "S3_x.bed": b"\n\n", "S4_x.bed": b"one"}
    for name, content in some.items():
        (tmp_path / name).write_bytes(content)
    (tmp_path / "S5_x.bed.gz").write_bytes(gzip.compress(b"\na\tb\tc\td\n"))
    paths = [str(p) for p in tmp_path.iterdir()]
    widths = first_widths(spark, paths)
    assert {r.file.rsplit("/", 1)[1]: r.width for r in widths.collect()} == {"S1_x.bed": 3, "S2_x.bed": 2, "S4_x.bed": 1, "S5_x.bed.gz": 4}
    plan = first_widths(spark, [p for p in paths if not p.endswith("gz")])._jdf.queryExecution().executedPlan().toString()
    assert "binaryFile" in plan and "text" not in plan and "Aggregate" not in plan and "Exchange" not in plan
