"""The queries: one per operator or plan, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.catalogue import fixtures as fx
from bagwise.functions import columns as fn
from bagwise.operators import bags as bag_ops
from bagwise.operators import folds, joins, metrics, pooling, prepare, reports, sampling, scaling
from bagwise.plans.crossval import cross_validate
from bagwise.plans.evaluation import evaluate as run_evaluation
from bagwise.plans.evaluation import label_scores
from bagwise.plans.instances import bags_of, frequency_features, frequency_instances, signature_features, signature_instances
from bagwise.plans.lookup import lookup_join
from bagwise.plans.scratch import scratch_path, settle, stored
from bagwise.plans.training import TrainSettings, train_attention, training_history, training_roc
from bagwise.sources import (
    load_model,
    read_bags,
    read_fragment_cells,
    read_fragments,
    read_labels,
    read_manifest,
    read_signatures,
    save_model,
    with_row_ids,
    write_bags,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters the SQL restates.
DIGITS = 6
SAMPLE_FRACTION = 0.4
SEED = 42
FOLDS = 10
CHOSEN_BAG = 7
BATCHES = 8
SCALED = ("l_quantity", "l_extendedprice", "l_discount", "always_one")
TRAIN = {"epochs": 3, "lr": 0.05}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, DIGITS)


def round_all(df: DataFrame) -> DataFrame:
    """Round every double, so that the order of a sum does not show."""
    return df.select(*[rounded(n).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes])


def scored_events(spark: SparkSession, d: str) -> DataFrame:
    """``bag_id, label, p, pred`` of the event bags under the fixed scorer."""
    scores = pooling.score_bags(fx.event_instances(spark, d), fx.EVENT_MODEL)
    return label_scores(scores, settle(fx.event_bags(spark, d))).select("bag_id", "label", "p", "pred")


# Preparation


@query
def sample_id_extract(spark, d):
    docs = fx.table(spark, d, "documents")
    name = F.concat("lang", F.col("doc_id"), F.when(F.col("n_chars") % 2 == 0, "raw").otherwise(""))
    sample = F.concat(F.lit("a_filtered_"), name, F.lit("_filtered_raw_v7"))
    path = F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), name, F.lit("_all_fragments.bed"))
    named = docs.select("doc_id", sample.alias("sample"), path.alias("path"))
    out = named.select(
        "doc_id", fn.extract_sample_id("sample").alias("sample_id"), fn.sample_from_path("path").alias("sample_name")
    )
    return out.withColumn("label_key", fn.label_key("sample_name"))


@query
def normalise_bin(spark, d):
    lines = fx.table(spark, d, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", fn.normalise_bin(fx.length_bin(F.col("l_quantity"))).alias("length_bin"))


def _event_cells(spark, d):
    value = F.col("value").cast("string")
    cell = (
        F.when(F.col("event_type") == "view", F.lit("   "))
        .when(F.col("event_type") == "error", F.lit(None))
        .when(F.col("event_type") == "signup", F.concat(F.lit("n/a "), value))
        .when(F.col("event_type") == "click", F.concat(F.lit("  "), value, F.lit(" ")))
        .otherwise(value)
    )
    k = F.get_json_object("props", "$.k")
    return fx.table(spark, d, "events").select("event_id", cell.alias("cell"), k.alias("k"))


@query
def clean_numeric(spark, d):
    return prepare.clean_columns(_event_cells(spark, d), ["cell", "k"])


@query
def malformed_cells(spark, d):
    return prepare.malformed_cells(_event_cells(spark, d), ["cell", "k"])


@query
def suffix_and_drop(spark, d):
    return prepare.drop_columns(prepare.suffix_columns(fx.table(spark, d, "part"), "_out"), "p_name_out", "absent")


@query
def name_fragment_columns(spark, d):
    lines = fx.line_fragments(spark, d).drop("sample_name")
    unnamed = lines.toDF(*[f"_c{i}" for i in range(len(lines.columns))])
    named = prepare.name_fragment_columns(unnamed)
    return named.groupBy("out5p", "in5p", "length_bin").agg(F.count(F.lit(1)).alias("n"), F.max("frag_end").alias("last_end"))


@query
def fragment_length(spark, d):
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    days = {n: F.unix_date(F.col(c).cast("date")) for n, c in (("frag_start", "o_orderdate"), ("frag_end", "l_shipdate"))}
    rows = lines.join(orders, "l_orderkey").withColumns(days)
    length = fn.fragment_length("frag_start", "frag_end").alias("fragment_length")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", length)


@query
def assemble_features(spark, d):
    events = fx.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    keyed = events.withColumnsRenamed({"user_id": "bag_id", "event_id": "instance_id"})
    packed = prepare.assemble_features(keyed, ["value", "k"])
    return packed.select(
        "bag_id",
        "instance_id",
        F.col("features")[0].alias("first"),
        F.col("features")[1].alias("second"),
        F.size("features").alias("width"),
    )


# Sampling


@query
def hash_sample(spark, d):
    lines = fx.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    return sampling.hash_sample(lines, key, SAMPLE_FRACTION, SEED)


@query
def exact_sample(spark, d):
    names = ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    lines = fx.table(spark, d, "lineitem").select(*names)
    return sampling.exact_sample(lines, F.concat_ws("-", *names[1:]), SAMPLE_FRACTION, SEED, ["l_suppkey"])


@query
def bernoulli_sample(spark, d):
    """Which rows it takes depends on partitions; what holds of any: all are rows of the table, about the
    right share of them, and the same ones again for the same seed and partitions."""
    lines = fx.table(spark, d, "lineitem")
    n = lines.count()
    drawn, again = (sampling.bernoulli_sample(lines, SAMPLE_FRACTION, SEED) for _ in range(2))
    mark = F.bit_xor(F.xxhash64(*lines.columns))
    facts = drawn.agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))
    once_more = again.agg(mark.alias("again"))
    strange = drawn.exceptAll(lines).agg(F.count(F.lit(1)).alias("n_strange"))
    spread = 6 * (n * SAMPLE_FRACTION * (1 - SAMPLE_FRACTION)) ** 0.5
    return facts.select(
        F.lit(n).cast("long").alias("n_rows"),
        strange.scalar().alias("n_strange"),
        (F.abs(F.col("n") - n * SAMPLE_FRACTION) <= spread).alias("near_share"),
        F.col("mark").eqNullSafe(once_more.scalar()).alias("repeats"),
    )


# Joins and labels


@query
def label_binarise_lookup(spark, d):
    nations = fx.table(spark, d, "nation")
    first = nations.select(
        F.col("n_nationkey").cast("string").alias("label_key"),
        F.when(F.col("n_regionkey") < 2, "Healthy").when(F.col("n_regionkey") == 2, "healthy").alias("tissue"),
        F.col("n_nationkey").alias("row_no"),
    )
    again = nations.where(F.col("n_regionkey") == 1).select(
        F.col("n_nationkey").cast("string").alias("label_key"),
        F.lit("Breast").alias("tissue"),
        (F.col("n_nationkey") + 1000).alias("row_no"),
    )
    labels = first.union(again).withColumn("label", fn.binarise_label("tissue"))
    suppliers = fx.table(spark, d, "supplier")
    key = F.when(F.col("s_acctbal") > 0, F.col("s_nationkey").cast("string")).otherwise("unknown")
    bags = suppliers.select(F.col("s_suppkey").alias("bag_id"), key.alias("label_key"))
    return joins.attach_labels(bags, labels).select("bag_id", "label", "label_source")


@query
def join_signatures(spark, d):
    rows = fx.line_fragments(spark, d).withColumn("length_bin", fn.normalise_bin("length_bin"))
    joined = joins.join_signatures(rows, fx.line_signature_tables(spark, d))
    likelihoods = ["llh_out", "plain_out", "llh_in", "plain_in", "llh_len", "plain_len"]
    cleaned = prepare.clean_columns(joined, likelihoods)
    return round_all(cleaned.select("sample_name", "chromosome", "out5p", "in5p", "length_bin", *likelihoods))


@query
def duplicate_signatures(spark, d):
    rows = fx.line_fragments(spark, d)
    return joins.duplicate_signatures(fx.line_signatures(rows, "out5p").union(fx.line_signatures(rows, "in5p")).union(
        fx.line_signatures(rows, "out5p")
    ))


@query
def frequency_encode(spark, d):
    lines = fx.table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return joins.frequency_encode(lines, ["l_returnflag", "l_linestatus"], "l_suppkey")


# Aggregation and scaling


def _scaled_lines(spark, d):
    lines = fx.table(spark, d, "lineitem").withColumn("always_one", F.lit(1.0))
    return lines.select("l_suppkey", "l_orderkey", "l_linenumber", *SCALED)


@query
def feature_ranges(spark, d):
    return scaling.feature_ranges(_scaled_lines(spark, d), SCALED, "l_suppkey")


@query
def minmax_scale(spark, d):
    return round_all(scaling.minmax_scale(_scaled_lines(spark, d), SCALED, "l_suppkey"))


@query
def bag_sizes(spark, d):
    return bag_ops.bag_sizes(fx.table(spark, d, "lineitem"), "l_suppkey")


@query
def empty_bags(spark, d):
    orders = fx.table(spark, d, "orders").select(F.col("o_orderkey").alias("bag_id"))
    lines = fx.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("bag_id"))
    return bag_ops.empty_bags(orders, lines)


@query
def union_bags(spark, d):
    events = fx.table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    narrow = events.where(F.col("event_type") == "purchase").select("event_id", "value")
    wide = events.where(F.col("event_type") != "purchase").select("k", "event_id", "value")
    return bag_ops.union_bags(narrow, wide)


@query
def assemble_bags(spark, d):
    blocks = bag_ops.assemble_bags(fx.event_instances(spark, d), settle(fx.event_bags(spark, d)), chunk_rows=16)

    def total(i: int) -> Column:
        return F.sum(F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v[i]))

    per_bag = blocks.groupBy("bag_id", "label", "n").agg(
        F.sum(F.size("instance_ids")).alias("n_in_blocks"), total(0).alias("sum_first"), total(1).alias("sum_second")
    )
    return round_all(per_bag)


# Scoring


@query
def embed_instances(spark, d):
    made = pooling.embed_instances(fx.event_instances(spark, d), fx.EVENT_MODEL)
    parts = [F.col("embedding")[i].alias(f"h{i + 1}") for i in range(2)]
    return round_all(made.select("bag_id", "instance_id", *parts))


@query
def attention_logits(spark, d):
    return round_all(pooling.attention_logits(fx.event_instances(spark, d), fx.EVENT_MODEL))


@query
def attention_weights(spark, d):
    return round_all(pooling.attention_weights(fx.event_instances(spark, d), fx.EVENT_MODEL))


@query
def attention_pool(spark, d):
    pooled = pooling.attention_pool(fx.event_instances(spark, d), fx.EVENT_MODEL)
    parts = [F.col("pooled")[i].alias(f"m{i + 1}") for i in range(2)]
    return round_all(pooled.select("bag_id", "top", "mass", *parts))


@query
def score_bags(spark, d):
    scores = pooling.score_bags(fx.event_instances(spark, d), fx.EVENT_MODEL)
    return round_all(scores.select("bag_id", "p", "pred"))


@query
def score_bags_vector(spark, d):
    scores = pooling.score_bags(fx.embedding_instances(spark, d), fx.EMBEDDING_MODEL)
    return round_all(scores.select("bag_id", "logit", "p", "pred"))


@query
def gated_attention_pool(spark, d):
    pooled = pooling.gated_attention_pool(fx.event_instances(spark, d), fx.EVENT_GATED_MODEL)
    return round_all(pooled.select("bag_id", *[F.col("pooled")[i].alias(f"m{i + 1}") for i in range(2)]))


@query
def gated_attention_weights(spark, d):
    weights = pooling.gated_attention_weights(fx.event_instances(spark, d), fx.EVENT_GATED_MODEL)
    parts = [F.col("attention")[i].alias(f"a{i + 1}") for i in range(2)]
    return round_all(weights.select("bag_id", "instance_id", *parts))


@query
def score_bags_gated(spark, d):
    scores = pooling.score_bags(fx.event_instances(spark, d), fx.EVENT_GATED_MODEL)
    return round_all(scores.select("bag_id", "p", "pred"))


# Metrics


@query
def bag_nll(spark, d):
    return round_all(pooling.bag_nll(scored_events(spark, d)).select("bag_id", "label", "nll"))


@query
def classification_error(spark, d):
    return round_all(pooling.classification_error(scored_events(spark, d)))


@query
def auc(spark, d):
    return round_all(metrics.auc(scored_events(spark, d)))


@query
def roc_curve(spark, d):
    return round_all(metrics.roc_curve(scored_events(spark, d)))


@query
def confusion_matrix(spark, d):
    return metrics.confusion_matrix(scored_events(spark, d))


@query
def confusion_matrix_norm(spark, d):
    return round_all(metrics.confusion_matrix(scored_events(spark, d), normalize=True))


@query
def evaluate(spark, d):
    result = run_evaluation(fx.event_instances(spark, d), settle(fx.event_bags(spark, d)), fx.EVENT_MODEL)
    cells = [F.sum(F.when((F.col("label") == y) & (F.col("pred") == q), F.col("n"))).alias(f"c{y}{q}") for y in (0, 1) for q in (0, 1)]
    counts = result.confusion.agg(*cells)
    return round_all(counts.select("*", result.auc.scalar().alias("auc")))


@query
def bag_attention_series(spark, d):
    # One bag's attention needs that bag's rows only.
    chosen = fx.event_instances(spark, d).where(F.col("bag_id") == CHOSEN_BAG)
    weights = pooling.attention_weights(chosen, fx.EVENT_MODEL)
    return round_all(reports.bag_attention_series(weights, CHOSEN_BAG))


@query
def attention_histogram(spark, d):
    weights = stored(pooling.attention_weights(fx.event_instances(spark, d), fx.EVENT_MODEL))
    return round_all(reports.attention_histogram(weights, settle(fx.event_bags(spark, d))))


# Orders, folds, training


@query
def shuffled_order(spark, d):
    return folds.shuffled_rank(fx.event_bags(spark, d), SEED, 1).select("bag_id", "rank")


@query
def kfold_assign(spark, d):
    return folds.kfold_assign(settle(fx.event_bags(spark, d)), FOLDS, SEED).select("bag_id", "fold")


@query
def cv_summary(spark, d):
    scores = settle(scored_events(spark, d))
    assigned = folds.kfold_assign(scores, FOLDS, SEED)
    summary = folds.cv_summary(metrics.auc(assigned, ["fold"]))
    return round_all(summary.drop("aucs"))


def _history(spark, d, model=fx.EVENT_MODEL, **settings):
    trained = train_attention(
        fx.event_instances(spark, d),
        settle(fx.event_bags(spark, d)),
        TrainSettings(seed=SEED, **{"batch_bags": None, **TRAIN, **settings}),
        model,
    )
    return trained.scores


@query
def train_attention_bce(spark, d):
    return round_all(training_history(_history(spark, d)))


@query
def train_attention_focal(spark, d):
    return round_all(training_history(_history(spark, d, loss="focal", weight_decay=1e-5)))


@query
def train_attention_gated(spark, d):
    return round_all(training_history(_history(spark, d, fx.EVENT_GATED_MODEL)))


@query
def train_attention_minibatch(spark, d):
    return round_all(training_history(_history(spark, d, epochs=1, n_batches=BATCHES)))


@query
def train_attention_stepwise(spark, d):
    """A step per bag, in a drawn order: 25 nations of customers."""
    bags = settle(fx.nation_bags(spark, d))
    settings = TrainSettings(epochs=1, lr=TRAIN["lr"], seed=SEED)
    scores = train_attention(fx.nation_instances(spark, d), bags, settings, fx.EVENT_MODEL).scores
    return round_all(scores.select("epoch", "bag_id", "label", "p", "loss"))


@query
def train_roc(spark, d):
    return round_all(training_roc(_history(spark, d)))


def _cross_validated(spark, d):
    settings = TrainSettings(batch_bags=None, seed=SEED, epochs=2, lr=0.05)
    bags = settle(fx.event_bags(spark, d))
    fold_models = {f: fx.EVENT_MODEL for f in range(FOLDS)}
    return cross_validate(fx.event_instances(spark, d), bags, settings, k=FOLDS, fold_seed=SEED, models=fold_models)


@query
def cross_validation(spark, d):
    return round_all(_cross_validated(spark, d).scores.select("fold", "bag_id", "label", "p"))


@query
def cv_reports(spark, d):
    """Every fold's confusion, AUC, and the number and sum of its ROC points."""
    reports = _cross_validated(spark, d).reports
    cells = [F.sum(F.when((F.col("label") == y) & (F.col("pred") == q), F.col("n"))).alias(f"c{y}{q}") for y in (0, 1) for q in (0, 1)]
    points = reports.roc.groupBy("fold").agg(F.count(F.lit(1)).alias("n_points"), F.sum(F.col("fpr") + F.col("tpr")).alias("area"))
    return round_all(reports.confusion.groupBy("fold").agg(*cells).join(reports.auc, "fold").join(points, "fold"))


# Sources and sinks


@query
def bag_store(spark, d):
    split = F.when(fn.md5_fraction(SEED, "bag_id") < 0.7, "train").otherwise("test")
    labelled = fx.event_instances(spark, d).join(fx.event_bags(spark, d), "bag_id").withColumn("split", split)
    path = scratch_path(spark, "bags")
    write_bags(labelled, path, buckets=8)
    stored = read_bags(spark, path, "train").unionByName(read_bags(spark, path, "test"))
    parts = [F.col("features")[0].alias("first"), F.col("features")[1].alias("second")]
    return stored.select("bag_id", "instance_id", "label", F.col("split").cast("string").alias("split"), *parts)


@query
def model_store(spark, d):
    path = scratch_path(spark, "models")
    save_model(spark, fx.EVENT_MODEL, path, "run1")
    scores = pooling.score_bags(fx.event_instances(spark, d), load_model(spark, path, "run1"))
    return round_all(scores.select("bag_id", "p", "pred"))


def _feature_sums(instances: DataFrame, names: list[str]) -> DataFrame:
    sums = [F.sum(F.col("features")[i]).alias(n) for i, n in enumerate(names)]
    return round_all(instances.groupBy("bag_id").agg(F.count(F.lit(1)).alias("n"), *sums))


def _paths(spark, files) -> Iterator[str]:
    """A manifest is a list of files; it passes the driver, the rows in them stay on the executors."""
    manifest = read_manifest(spark, files["manifest"], "train")
    return (r.path for r in manifest.select("path").toLocalIterator())


def _scanned(spark, d, wide=False, signatures=False, **options):
    files = fx.write_line_files(spark, d, wide, signatures)
    return files, read_fragments(spark, _paths(spark, files), sample_of=fx.sample_of_folder, **options)


@query
def fragment_scan(spark, d):
    _, rows = _scanned(spark, d, distinct_ids=False)
    return rows.drop("instance_id")


@query
def fragment_ids(spark, d):
    """Lines without what tells them apart: equal rows of a supplier have as many ids as there are rows."""
    lines = fx.line_fragments(spark, d).select("sample_name", "length_bin", "out5p", "in5p")
    ids = with_row_ids(lines)
    n = F.count(F.lit(1)).alias("n")
    return ids.groupBy(*lines.columns).agg(n, F.countDistinct("instance_id").alias("n_ids"))


@query
def cell_faults(spark, d):
    files = fx.write_line_files(spark, d, wide=True, signatures=False)
    cells = read_fragment_cells(spark, list(_paths(spark, files)), sample_of=fx.sample_of_folder)
    return prepare.cell_faults(cells, ["gc_content", "gc_weight", "_c10"], ["frag_start", "frag_end"])


@query
def label_scan(spark, d):
    files = fx.write_line_files(spark, d, signatures=False)
    manifest = read_manifest(spark, files["manifest"], "train").withColumn("sample_name", fx.sample_of_folder(F.col("path")))
    bags = joins.attach_labels(bags_of(manifest), read_labels(spark, files["labels"]))
    return bags.select("bag_id", "split", "label", "label_source")


@query
def signature_path(spark, d):
    files, rows = _scanned(spark, d, signatures=True)
    tables = {t: read_signatures(spark, files[t]) for t in ("out5p", "in5p", "length_bin")}
    return _feature_sums(signature_instances(rows, tables), signature_features(rows, tables))


@query
def signature_path_scaled(spark, d):
    files, rows = _scanned(spark, d, signatures=True)
    tables = {t: read_signatures(spark, files[t]) for t in ("out5p", "in5p", "length_bin")}
    return _feature_sums(signature_instances(rows, tables, scale=True), signature_features(rows, tables))


@query
def frequency_path(spark, d):
    _, rows = _scanned(spark, d, distinct_ids=False)
    return _feature_sums(frequency_instances(rows), frequency_features(rows))


@query
def frequency_path_wide(spark, d):
    """Files with an eleventh column, which is a feature, and unreadable cells, which are 0."""
    _, rows = _scanned(spark, d, wide=True, distinct_ids=False)
    return _feature_sums(frequency_instances(rows), [n.strip("_") for n in frequency_features(rows)])


@query
def whole_job(spark, d):
    """From text files to the scores of a trained scorer: scan, features, labels, store, training, evaluation."""
    files, rows = _scanned(spark, d, signatures=True)
    tables = {t: read_signatures(spark, files[t]) for t in ("out5p", "in5p", "length_bin")}
    manifest = read_manifest(spark, files["manifest"], "train").withColumn("sample_name", fx.sample_of_folder(F.col("path")))
    bags = settle(joins.attach_labels(bags_of(manifest), read_labels(spark, files["labels"])))
    labelled = lookup_join(signature_instances(rows, tables), bags.select("bag_id", "label", "split"), ["bag_id"], "inner")
    path = scratch_path(spark, "bags")
    write_bags(labelled, path, buckets=8)
    instances = read_bags(spark, path, "train")
    settings = TrainSettings(batch_bags=None, seed=SEED, **TRAIN)
    trained = train_attention(instances, bags, settings, fx.LINE_MODEL)
    scores = run_evaluation(instances, bags, trained.model).scores
    return round_all(scores.select("bag_id", "label", "p", "pred"))
