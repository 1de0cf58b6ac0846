"""Training by distributed gradients.

A step over many bags is two passes over their rows. The first folds them into one record per bag and
yields each bag's probability, loss and loss slope. The second sends those few numbers per bag back
to the rows and sums the gradient. Only parameters, gradients and one total per model reach the
driver; bag records are written to the scratch folder, where they also serve as training history.

A step over a few bags is one pass: each bag's rows are summed into moments that hold its logit and
the logit's gradient, as softmax pooling is a ratio of sums. Rows are stored by bag for such steps.

Several models train in the same two passes: model ``f`` sees every bag whose ``fold`` is not ``f``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.functions import losses
from bagwise.operators import kernels
from bagwise.operators.bags import require_instances, require_unique
from bagwise.operators.folds import shuffled_rank, tile
from bagwise.operators.metrics import auc, roc_curve
from bagwise.operators.model import AttentionModel, GatedAttentionModel
from bagwise.operators.pooling import _dot, _list_array, fold_batches, folded_table, key_codes, merged_records, merged_units, unit_partials
from bagwise.operators.prepare import feature_dim
from bagwise.plans.lookup import BROADCAST_BYTES, ROW_OVERHEAD, lookup_join
from bagwise.plans.ordered import join_by
from bagwise.plans.scratch import children, discard, scratch_path, settle
from bagwise.sources.store import bag_bucket, write_bucketed

NO_FOLD = -1
# Task gradients are added up in this many slots before the final sum.
GRADIENT_SLOTS = 64
# Fixed values of the optimiser.
ADAM_BETAS = (0.9, 0.999)
ADAM_EPS = 1e-8
# A step over at most this many (bag, model) pairs takes one pass; their moments come to the driver.
ONE_PASS_RECORDS = 16
# Beyond this bound on attention logits, exponentials relative to the bound could vanish.
LARGEST_BOUND = 300.0
SCORES_PER_FLUSH = 1000
MOST_BUCKETS = 1024
# Batches are fetched this many bags at a time, or one by one if they are larger.
LISTED_BAGS = 1000
# Bags that one scan of a batch names, but for further bags of its last folder.
PRUNED_BAGS = 200
# Batches of more bags than this touch most pages: the rows of an epoch are written by batch instead.
PICKED_BAGS = 1000


@dataclass(frozen=True)
class TrainSettings:
    """How to train.

    ``batch_bags=1`` takes one step per bag, bags in a new order every epoch. Larger batches average
    the gradient over their bags, ``None`` over all bags: fewer passes, but a different optimiser.
    ``n_batches`` cuts the order into that many shares instead, whatever the number of bags. Batches are slices
    of the epoch's order at every size of the table. Rows of such steps are stored by bag once, unless they are read
    from a bag store already: then ``stored_buckets`` is its number of buckets. Rows of batches over ``PICKED_BAGS``
    bags are written once an epoch, by batch. ``single`` evaluates rows in single precision, several times faster; sums stay in double.
    ``gated`` draws a scorer with a softmax per hidden unit, whose steps take two passes at every batch size.
    ``run_folder`` keeps every epoch's parameters, moments and scores under ``run_id``: the same call after an
    interruption goes on behind the last complete epoch.
    """

    epochs: int = 10
    lr: float = 1e-3
    hidden: int = 128
    batch_bags: int | None = 1
    n_batches: int | None = None
    loss: str = "bce"
    alpha: float = losses.FOCAL_ALPHA
    gamma: float = losses.FOCAL_GAMMA
    alpha_mode: str = "constant"
    weight_decay: float = 0.0
    seed: int = 42
    run_id: str = "run0"
    cache: bool = True
    stored_buckets: int | None = None
    single: bool = False
    gated: bool = False
    run_folder: str | None = None
    budget: int = BROADCAST_BYTES

    @property
    def kind(self) -> type[AttentionModel]:
        return GatedAttentionModel if self.gated else AttentionModel

    def loss_columns(self, logit: Column, label: Column) -> tuple[Column, Column]:
        """Loss and its slope at the logit."""
        if self.loss == "bce":
            return losses.bce_loss(logit, label), losses.bce_slope(logit, label)
        if self.loss == "focal":
            options = (self.alpha, self.gamma, self.alpha_mode)
            return losses.focal_loss(logit, label, *options), losses.focal_slope(logit, label, *options)
        raise ValueError(f"loss must be 'bce' or 'focal', not {self.loss!r}")


@dataclass
class Adam:
    """Adaptive moments, with weight decay added to the gradient."""

    lr: float
    weight_decay: float
    steps: int = 0
    first: np.ndarray | float = 0.0
    second: np.ndarray | float = 0.0

    def step(self, values: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        g = gradient + self.weight_decay * values
        b1, b2 = ADAM_BETAS
        self.steps += 1
        self.first = b1 * self.first + (1.0 - b1) * g
        self.second = b2 * self.second + (1.0 - b2) * g * g
        mean = self.first / (1.0 - b1**self.steps)
        spread = np.sqrt(self.second / (1.0 - b2**self.steps)) + ADAM_EPS
        return values - self.lr * mean / spread


@dataclass(frozen=True)
class Trained:
    """Fitted models by fold (a single model under ``NO_FOLD``) and every bag score of the training.

    ``scores``: ``run_id, fold, epoch, bag_id, label, p, loss``, each taken before its bag's step.
    """

    models: dict[int, AttentionModel]
    scores: DataFrame

    @property
    def model(self) -> AttentionModel:
        return self.models[NO_FOLD]


def training_history(scores: DataFrame) -> DataFrame:
    """``run_id, fold, epoch, loss, auc``: summed bag losses and running AUC of each epoch."""
    keys = ["run_id", "fold", "epoch"]
    total = scores.groupBy(*keys).agg(F.sum("loss").alias("loss"))
    return join_by(total, auc(scores, keys), keys)


def training_roc(scores: DataFrame) -> DataFrame:
    """ROC curve over the scores of all epochs together, per run and fold."""
    return roc_curve(scores, ["run_id", "fold"])


def is_gated(models: dict[int, AttentionModel]) -> bool:
    kinds = {isinstance(m, GatedAttentionModel) for m in models.values()}
    if len(kinds) != 1:
        raise ValueError("plain and gated scorers do not train together")
    return kinds.pop()


# What a row needs to know of its bag for the gradient, by kind of scorer.
SENT = {False: ("fold", "top", "mass", "logit", "slope"), True: ("fold", "ends", "pooled", "slope")}


def bag_states(
    rows: DataFrame, models: dict[int, AttentionModel], *, held_out: bool = False
) -> DataFrame:
    """``fold, bag_id, label, top, mass, logit, p`` of each bag under each model that may see it.

    ``rows`` carry ``bag_id, label, fold, features``. Model ``f`` sees the bags outside fold ``f``,
    or only those inside with ``held_out``. A gated scorer has arrays over its hidden units in place of
    ``top, mass``: ``ends``, the logarithms of the summed exponentials, and ``pooled``.
    """
    gated = is_gated(models)
    kind = T.ArrayType(T.DoubleType()) if gated else T.DoubleType()
    schema = T.StructType(
        [
            T.StructField("model", T.IntegerType()),
            rows.schema["bag_id"],
            T.StructField("label", T.IntegerType()),
            *[T.StructField(n, kind) for n in ("top", "mass", "mean")],
        ]
    )
    keys = ["model", "bag_id", "label"]

    def to_partial(batch: pa.RecordBatch) -> pa.Table:
        x = kernels.feature_matrix(batch.column("features"))
        fold = batch.column("fold").to_numpy(zero_copy_only=False)
        parts = []
        for f, model in models.items():
            seen = np.flatnonzero((fold == f) if held_out else (fold != f) | (f == NO_FOLD))
            if not len(seen):
                continue
            source = pa.table(
                {
                    "model": pa.array(np.full(len(seen), f, dtype=np.int32)),
                    "bag_id": batch.column("bag_id").take(pa.array(seen)),
                    "label": batch.column("label").take(pa.array(seen)),
                }
            )
            if gated:
                parts.append(unit_partials(model, x[seen], source, keys))
            else:
                s, unit = kernels.row_scores(model, x[seen])
                parts.append(folded_table(source, keys, s, np.ones(len(s)), unit))
        return pa.concat_tables(parts) if parts else schema_table

    number = pa.list_(pa.float64()) if gated else pa.float64()
    names = {"model": pa.int32(), "top": number, "mass": number, "mean": number}
    schema_table = pa.table({n: pa.array([], type=t) for n, t in names.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fold_batches(batches, to_partial, keys)

    records = rows.select("bag_id", "label", "fold", "features").mapInArrow(run, schema)
    bound = max(kernels.logit_bound(m) for m in models.values())
    if gated:
        ends = F.zip_with("tops", "masses", lambda top, mass: top + F.ln(mass)).alias("ends")
        of = [F.when(F.col("model") == f, _dot(F.col("pooled"), m.cls_w) + F.lit(float(m.cls_b[0]))) for f, m in models.items()]
        merged = merged_units(records, keys, bound).select(*keys, ends, "pooled", F.coalesce(*of).alias("logit"))
    else:
        merged = merged_records(records, keys, bound).withColumnRenamed("mean", "logit")
    return merged.withColumnRenamed("model", "fold").withColumn("p", losses.sigmoid(F.col("logit")))


def _gradients(rows: DataFrame, states: DataFrame, models: dict[int, AttentionModel], state_bytes: int, budget: int) -> dict[int, np.ndarray]:
    """Summed loss gradient of each model over the rows' bags."""
    gated = is_gated(models)
    sent = SENT[gated]
    gradient = kernels.gated_gradient if gated else kernels.pooled_gradient
    if len(models) == 1:
        per_bag = states.select("bag_id", *[F.array(n).alias(n) for n in sent])
    else:
        # One entry per model: a list of fixed length.
        listed = F.sort_array(F.collect_list(F.struct(*sent)))
        per_bag = states.groupBy("bag_id").agg(listed.alias("s")).select("bag_id", *[F.col(f"s.{n}").alias(n) for n in sent])
    joined = lookup_join(rows.select("bag_id", "features"), per_bag, ["bag_id"], "inner", budget=budget, table_bytes=state_bytes)

    def values(column: pa.Array) -> np.ndarray:
        """A number, or one row of numbers, for each entry of each row's list."""
        flat = column.flatten()
        return kernels.feature_matrix(flat) if pa.types.is_list(flat.type) else flat.to_numpy(zero_copy_only=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = kernels.feature_matrix(batch.column("features"))
            lists = batch.column("fold")
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            of, *of_bag = (values(batch.column(n)) for n in sent)
            for f, model in models.items():
                at = np.flatnonzero(of == f)
                if len(at):
                    g = gradient(model, x[owner[at]], *(v[at] for v in of_bag))
                    sums[f] = sums[f] + g if f in sums else g
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), type=pa.int32()), _list_array(np.stack(list(sums.values())))],
                names=["model", "gradient"],
            )

    slots = joined.mapInArrow(run, "model int, gradient array<double>").select(
        "model",
        F.pmod(F.spark_partition_id(), F.lit(GRADIENT_SLOTS)).alias("slot"),
        array_to_vector("gradient").alias("gradient"),
    )
    per_slot = slots.groupBy("model", "slot").agg(Summarizer.sum(F.col("gradient")).alias("gradient"))
    total = per_slot.groupBy("model").agg(vector_to_array(Summarizer.sum(F.col("gradient"))).alias("gradient"))
    return {r.model: np.array(r.gradient) for r in total.collect()}


def labelled_rows(instances: DataFrame, bags: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Instances with the label and fold of their bag on every row."""
    fold = F.col("fold").cast("int") if "fold" in bags.columns else F.lit(NO_FOLD)
    known = bags.select("bag_id", F.col("label").cast("int").alias("label"), fold.alias("fold"))
    place = [c for c in ("bag_bucket",) if c in instances.columns]
    return lookup_join(instances.select("bag_id", "features", *place), known, ["bag_id"], "inner", budget=budget)


def _bag_moments(rows: DataFrame, models: dict[int, AttentionModel]) -> DataFrame:
    """``bag_id, label, model, moments`` of every bag in ``rows`` under every model that may see it."""
    key = rows.schema["bag_id"]
    fields = [key, T.StructField("label", T.IntegerType()), T.StructField("model", T.IntegerType())]
    schema = T.StructType([*fields, T.StructField("moments", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema.field("bag_id").type
            x = kernels.feature_matrix(batch.column("features"))
            order, starts, _ = kernels.grouped(key_codes(batch, ["bag_id"]))
            for at in np.split(order, starts[1:]):
                bag, label, fold = (batch.column(n)[int(at[0])].as_py() for n in ("bag_id", "label", "fold"))
                for f, model in models.items():
                    if f == NO_FOLD or f != fold:
                        found = kernels.bag_moments(model, x[at])
                        k = (bag, label, f)
                        sums[k] = sums[k] + found if k in sums else found
        if sums:
            bag, label, f = zip(*sums)
            columns = [pa.array(bag, type=kind), pa.array(label, type=pa.int32()), pa.array(f, type=pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, _list_array(np.stack(list(sums.values())))], names=schema.names)

    records = rows.select("bag_id", "label", "fold", "features").mapInArrow(run, schema)
    slots = records.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(GRADIENT_SLOTS))).withColumn(
        "moments", array_to_vector("moments")
    )
    keys = ["bag_id", "label", "model"]
    per_slot = slots.groupBy(*keys, "slot").agg(Summarizer.sum(F.col("moments")).alias("moments"))
    return per_slot.groupBy(*keys).agg(vector_to_array(Summarizer.sum(F.col("moments"))).alias("moments"))


def _one_pass_step(
    rows: DataFrame, models: dict[int, AttentionModel], settings: TrainSettings
) -> tuple[dict[int, np.ndarray], list[Row]]:
    """Mean loss gradient of each model, and bag scores, from one job over a few bags' rows."""
    moments = F.col("moments")
    logit = moments[1] / moments[0]
    loss, slope = settings.loss_columns(F.col("logit"), F.col("label"))
    found = (
        _bag_moments(rows, models)
        .withColumn("logit", logit)
        .withColumns({"p": losses.sigmoid(F.col("logit")), "loss": loss, "slope": slope})
        .collect()
    )
    gradients: dict[int, list[np.ndarray]] = {}
    for r in found:
        gradients.setdefault(r.model, []).append(r.slope * kernels.logit_gradient(np.array(r.moments)))
    return {f: np.mean(gs, axis=0) for f, gs in gradients.items()}, found


def _two_pass_step(rows: DataFrame, models: dict[int, AttentionModel], settings: TrainSettings, folder: str) -> dict[int, np.ndarray]:
    """Mean loss gradient of each model over any number of bags; bag scores are written to ``folder``."""
    loss, slope = settings.loss_columns(F.col("logit"), F.col("label"))
    states = bag_states(rows, models).withColumns({"loss": loss, "slope": slope})
    states.write.parquet(folder)
    states = rows.sparkSession.read.schema(states.schema).parquet(folder)
    counts, size = _totals(states)
    gradients = _gradients(rows, states, models, size, settings.budget)
    return {f: g / counts[f] for f, g in gradients.items()}


def train_models(
    instances: DataFrame, bags: DataFrame, models: dict[int, AttentionModel], settings: TrainSettings
) -> Trained:
    """Train the given models on ``bags``: ``bag_id, label`` and maybe ``fold``.

    A bag without instances is an error, found once the first epoch has scored every other bag.
    """
    if settings.epochs < 1:
        raise ValueError("no epoch to train")
    spark = instances.sparkSession
    # Equal keys must be of equal type to hash into the same bucket.
    bags = settle(bags.withColumn("bag_id", F.col("bag_id").cast(instances.schema["bag_id"].dataType)))
    require_unique(bags)
    rows = labelled_rows(instances, bags, settings.budget)
    whole = settings.batch_bags is None and settings.n_batches is None
    n_bags = bags.count()
    size = None if whole else -(-n_bags // settings.n_batches) if settings.n_batches else settings.batch_bags
    buckets = settings.stored_buckets or max(1, min(MOST_BUCKETS, n_bags))
    models = dict(models)
    optimisers = {f: Adam(settings.lr, settings.weight_decay) for f in models}
    path = f"{settings.run_folder}/{settings.run_id}" if settings.run_folder else scratch_path(spark, f"train-{settings.run_id}")
    done = resume(spark, path, models, optimisers, settings) if settings.run_folder else 0
    copies: list[str] = []
    large = not whole and size > PICKED_BAGS
    if done >= settings.epochs:
        pass
    elif large:
        rows = rows.drop("bag_bucket")
    elif not whole and settings.stored_buckets is None:
        copies.append(scratch_path(spark, f"rows-{settings.run_id}"))
        rows = _bucketed(rows.drop("bag_bucket"), copies[-1], buckets)
    elif whole and settings.cache:
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    few = not whole and size * len(models) <= ONE_PASS_RECORDS and not is_gated(models)
    scored = T.StructType(
        [
            T.StructField("fold", T.IntegerType()),
            instances.schema["bag_id"],
            T.StructField("label", T.IntegerType()),
            *[T.StructField(n, T.DoubleType()) for n in ("p", "loss")],
        ]
    )
    held: list[tuple] = []
    bound = LARGEST_BOUND / 10 if settings.single else LARGEST_BOUND

    def flush(epoch: int) -> None:
        """Write the bag scores of one-pass steps; they come a few at a time."""
        if held:
            spark.createDataFrame(held, scored).coalesce(1).write.mode("append").parquet(f"{path}/epoch={epoch}")
            held.clear()

    try:
        for epoch in range(done + 1, settings.epochs + 1):
            if large:
                copies.append(scratch_path(spark, f"rows-{settings.run_id}"))
                written, n_batches = _write_batches(rows, bags, copies[-1], epoch, settings)
                batches = _one_by_one(written, n_batches)
                rows = written.drop("batch")  # of which the next epoch is written
                while len(copies) > 1:
                    discard(spark, copies.pop(0))
            else:
                batches = iter([rows]) if whole else _batches(rows, bags, buckets, epoch, settings)
            for step, some in enumerate(batches):
                bounded = max(kernels.logit_bound(m) for m in models.values()) <= bound
                sent = {f: m.as_type(np.float32) for f, m in models.items()} if settings.single else models
                if few and bounded:
                    gradients, scores = _one_pass_step(some, sent, settings)
                    held += [(r.model, r.bag_id, r.label, r.p, r.loss) for r in scores]
                    if len(held) >= SCORES_PER_FLUSH:
                        flush(epoch)
                else:
                    gradients = _two_pass_step(some, sent, settings, f"{path}/epoch={epoch}/step={step}")
                for f, g in gradients.items():
                    models[f] = models[f].with_flat(optimisers[f].step(models[f].flat(), g))
            flush(epoch)
            if epoch == 1:
                seen = spark.read.option("recursiveFileLookup", True).schema(scored).parquet(f"{path}/epoch={epoch}")
                require_instances(bags, seen)
            if settings.run_folder:
                save_epoch(spark, path, epoch, models, optimisers, settings)
    finally:
        if whole and settings.cache:
            rows.unpersist()
        for copy in copies:
            discard(spark, copy)
    read = spark.read.option("recursiveFileLookup", True).schema(scored)
    of_epoch = [
        read.parquet(f"{path}/epoch={e}").select(F.lit(settings.run_id).alias("run_id"), F.lit(e).alias("epoch"), *scored.names)
        for e in range(1, settings.epochs + 1)
    ]
    return Trained(models, reduce(DataFrame.unionByName, of_epoch))


# What may differ between a run and its continuation.
FREE_SETTINGS = ("epochs", "cache", "stored_buckets", "run_folder", "budget")
STATE = "epoch int, fold int, steps int, settings string, value array<double>, first array<double>, second array<double>"


def _settings_said(settings: TrainSettings) -> str:
    return repr({k: v for k, v in asdict(settings).items() if k not in FREE_SETTINGS})


def save_epoch(
    spark: SparkSession, path: str, epoch: int, models: dict[int, AttentionModel], optimisers: dict[int, Adam], settings: TrainSettings
) -> None:
    """Parameters and moments behind an epoch, a row per model. Complete once its ``_SUCCESS`` is there."""
    rows = [
        (epoch, f, o.steps, _settings_said(settings), m.flat().tolist(), o.first.tolist(), o.second.tolist())
        for f, m in models.items()
        for o in (optimisers[f],)
    ]
    folder = f"{path}/state-{epoch}"
    discard(spark, folder)
    spark.createDataFrame(rows, STATE).coalesce(1).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)


def resume(spark: SparkSession, path: str, models: dict[int, AttentionModel], optimisers: dict[int, Adam], settings: TrainSettings) -> int:
    """Put models and optimisers into their state behind the last complete epoch, and say which one it is.

    Scores of an epoch that was not completed are removed.
    """
    kept = [int(n[6:]) for n in children(spark, path) if n.startswith("state-") and "_SUCCESS" in children(spark, f"{path}/{n}")]
    last = max((e for e in kept if e <= settings.epochs), default=0)
    for name in children(spark, path):
        if name.startswith("epoch=") and int(name[6:]) > max(kept, default=0):
            discard(spark, f"{path}/{name}")
    if last:
        rows = spark.read.schema(STATE).parquet(f"{path}/state-{last}").collect()
        if {r.fold for r in rows} != set(models) or {r.settings for r in rows} != {_settings_said(settings)}:
            raise ValueError(f"run {settings.run_id!r} was begun with other models or settings")
        for r in rows:
            models[r.fold] = models[r.fold].with_flat(np.array(r.value))
            optimisers[r.fold].steps = r.steps
            optimisers[r.fold].first, optimisers[r.fold].second = np.array(r.first), np.array(r.second)
    return last


def _totals(states: DataFrame) -> tuple[dict[int, int], int]:
    """Bags per model, and the size the states have once broadcast; one row per model."""
    kind = states.schema["bag_id"].dataType
    key = F.octet_length("bag_id") + 16 if isinstance(kind, T.StringType) else F.lit(8)
    arrays = [F.size(f.name) * 8 + 32 for f in states.schema.fields if isinstance(f.dataType, T.ArrayType)]
    size = F.sum(sum(arrays, key + ROW_OVERHEAD + 5 * 16).cast("long")).alias("size")
    rows = states.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), size).collect()
    return {r.fold: r.n for r in rows}, sum(r["size"] for r in rows)


def _bucketed(rows: DataFrame, path: str, buckets: int) -> DataFrame:
    """The rows stored by bag, so that a step reads its own bags' folders only."""
    write_bucketed(rows, path, buckets=buckets)
    schema = T.StructType([*rows.schema.fields, T.StructField("bag_bucket", T.IntegerType())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def _numbered_bags(bags: DataFrame, epoch: int, settings: TrainSettings) -> tuple[DataFrame, int, int]:
    """``bag_id, batch`` of the epoch's order, the number of batches, and the most bags that one has."""
    n, size = bags.count(), settings.batch_bags
    ranked = shuffled_rank(bags.select("bag_id"), settings.seed, epoch)
    if settings.n_batches:
        if not 1 <= settings.n_batches <= n:
            raise ValueError(f"cannot cut {n} bags into {settings.n_batches} batches")
        batch, size = tile(F.col("rank"), F.lit(n), settings.n_batches), -(-n // settings.n_batches)
        n_batches = settings.n_batches
    else:
        batch, n_batches = F.floor((F.col("rank") - 1) / size), -(-n // size)
    return ranked.select("bag_id", batch.cast("int").alias("batch")), n_batches, size


def _write_batches(rows: DataFrame, bags: DataFrame, path: str, epoch: int, settings: TrainSettings) -> tuple[DataFrame, int]:
    """The rows with the ``batch`` of their bag, written by batch in one shuffle, and the number of batches.

    A batch above the advisory size is split over several tasks.
    """
    ranked, n_batches, _ = _numbered_bags(bags, epoch, settings)
    keyed = lookup_join(rows, settle(ranked), ["bag_id"], "inner", budget=settings.budget)
    keyed.hint("rebalance", "batch").write.partitionBy("batch").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())])
    return rows.sparkSession.read.schema(schema).parquet(path), n_batches


def _one_by_one(written: DataFrame, n_batches: int) -> Iterator[DataFrame]:
    """Each batch is one scan of one folder, however many bags it has."""
    for b in range(n_batches):
        yield written.where(F.col("batch") == b).drop("batch")


def _batches(
    rows: DataFrame, bags: DataFrame, buckets: int, epoch: int, settings: TrainSettings
) -> Iterator[DataFrame]:
    """The stored rows of each batch of bags: slices of the epoch's order, read where they are.

    A batch names its folders and ids. Rows are sorted by bag within their files, so the smallest and
    largest ids that Parquet keeps of every page are an index from bags to pages: a scan reads the
    footers of its folders and the pages that may hold its bags. An epoch so reads each row about once
    and writes none.
    """
    ranked, n_batches, size = _numbered_bags(bags, epoch, settings)
    ranked = settle(ranked.withColumn("bag_bucket", bag_bucket("bag_id", buckets)))
    # Ids of a few batches at a time; a large batch comes as ids alone, a few numbers a bag.
    at_once = max(1, LISTED_BAGS // size)
    for start in range(0, n_batches, at_once):
        listed = ranked.where(F.col("batch").between(start, start + at_once - 1)).collect()
        for number in range(start, min(start + at_once, n_batches)):
            yield in_place(rows, [(r.bag_bucket, r.bag_id) for r in listed if r.batch == number])


def in_place(rows: DataFrame, chosen: list[tuple]) -> DataFrame:
    """The stored rows of the chosen (bucket, bag) pairs.

    Each folder is in one scan, and each scan has few enough ids to compare every one with a page's ends.
    """
    chosen = sorted(chosen, key=lambda c: c[0])
    scans, at = [], 0
    while at < len(chosen):
        end = min(at + PRUNED_BAGS, len(chosen))
        while end < len(chosen) and chosen[end][0] == chosen[end - 1][0]:
            end += 1  # the rest of the folder
        part = chosen[at:end]
        folders, ids = sorted({b for b, _ in part}), [i for _, i in part]
        scans.append(rows.where(F.col("bag_bucket").isin(folders) & any_of([F.col("bag_id") == F.lit(i) for i in ids])))
        at = end
    return reduce(DataFrame.union, scans)


def any_of(conditions: list[Column]) -> Column:
    """Their disjunction, as a tree of small depth: unlike a long list of values, it reaches the pages' ends as it is."""
    while len(conditions) > 1:
        conditions = [reduce(Column.__or__, conditions[i : i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]


def train_attention(
    instances: DataFrame, bags: DataFrame, settings: TrainSettings = TrainSettings(), model: AttentionModel | None = None
) -> Trained:
    """Train one scorer, plain or gated, on all bags, from seeded random parameters unless given."""
    if model is None:
        model = settings.kind.random(feature_dim(instances), settings.hidden, settings.seed)
    return train_models(instances, bags.select("bag_id", "label"), {NO_FOLD: model}, settings)


def fold_models(dim: int, folds: Sequence[int], settings: TrainSettings) -> dict[int, AttentionModel]:
    """A fresh model per fold, each from its own seed."""
    return {f: settings.kind.random(dim, settings.hidden, settings.seed + 1 + f) for f in folds}
