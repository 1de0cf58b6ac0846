"""Softmax-attention pooling as a mergeable aggregate.

Every task folds its rows into one small record per bag: the largest logit (``top``), the softmax
mass relative to it, and means under that mass. Records are merged by plain sums, which Spark combines
before the shuffle: no window, and a bag of any size is one record per task. A scorer's parameters bound
its logits; within ``PLAIN_LOGIT``, exponentials are summed as they are. Beyond it, sums are kept per
range of logits, and the few ranges that a bag's records fall into are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bagwise.functions.columns import threshold
from bagwise.functions.losses import nll, sigmoid
from bagwise.operators import kernels
from bagwise.operators.model import AttentionModel, GatedAttentionModel
from bagwise.plans.lookup import BROADCAST_BYTES, lookup_join
from bagwise.plans.scratch import settle

# Records a task holds before it hands them on; bounds a worker's memory, not the result.
FOLD_ROWS = 20_000
# Sums of exponentials of logits up to this size stay within doubles.
PLAIN_LOGIT = 300.0
# Width of the ranges by which larger logits are summed.
RANGE = 300.0


def _list_array(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    offsets = np.arange(0, rows * width + 1, width, dtype=np.int32) if width else np.zeros(rows + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def _instance_schema(instances: DataFrame, *extra: T.StructField) -> T.StructType:
    return T.StructType([instances.schema["bag_id"], instances.schema["instance_id"], *extra])


def _per_instance(instances: DataFrame, compute, fields: list[T.StructField]) -> DataFrame:
    """Add computed columns to (bag_id, instance_id); ``compute`` maps a feature matrix to arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                made = compute(kernels.feature_matrix(batch.column("features")))
                columns = [batch.column("bag_id"), batch.column("instance_id"), *made]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = _instance_schema(instances, *fields)
    names = schema.names
    return instances.select("bag_id", "instance_id", "features").mapInArrow(run, schema)


def embed_instances(instances: DataFrame, model: AttentionModel) -> DataFrame:
    """``bag_id, instance_id, embedding``."""
    return _per_instance(
        instances,
        lambda x: [_list_array(kernels.embed(model, x))],
        [T.StructField("embedding", T.ArrayType(T.DoubleType()))],
    )


def attention_logits(instances: DataFrame, model: AttentionModel) -> DataFrame:
    """``bag_id, instance_id, logit``."""
    return _per_instance(
        instances,
        lambda x: [pa.array(kernels.row_scores(model, x)[0])],
        [T.StructField("logit", T.DoubleType())],
    )


def fold_batches(batches: Iterator[pa.RecordBatch], to_partial, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Turn batches into partial records and fold records with equal keys within the task.

    ``to_partial`` maps a batch to a table ``keys…, top, mass, mean``, already folded.
    """
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = to_partial(batch)
        held.append(part)
        rows += part.num_rows
        if rows > FOLD_ROWS:
            held = [fold_partials(pa.concat_tables(held), keys)]
            rows = held[0].num_rows
            if rows > FOLD_ROWS // 2:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from fold_partials(pa.concat_tables(held), keys).to_batches()


def key_codes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """One integer per distinct combination of the key columns."""
    codes = np.zeros(table.num_rows, dtype=np.int64)
    for key in keys:
        column = table.column(key)
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        encoded = column.dictionary_encode(null_encoding="encode")
        codes = codes * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
    return codes


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type):
        return kernels.feature_matrix(column)
    return column.to_numpy(zero_copy_only=False)


def _column(values: np.ndarray) -> pa.Array:
    return _list_array(values) if values.ndim == 2 else pa.array(values)


def folded_table(source: pa.Table | pa.RecordBatch, keys: list[str], logits, masses, values) -> pa.Table:
    """Fold rows of ``source`` by its key columns into records."""
    codes = key_codes(source, keys)
    found, top, mass, mean = kernels.softmax_partials(codes, logits, masses, values)
    first = np.zeros(len(found), dtype=np.int64)
    order, starts, _ = kernels.grouped(codes)
    first[:] = order[starts]
    named = {k: source.column(k).take(pa.array(first)) for k in keys}
    return pa.table({**named, "top": _column(top), "mass": _column(mass), "mean": _column(mean)})


def fold_partials(table: pa.Table, keys: list[str]) -> pa.Table:
    return folded_table(table, keys, _matrix(table.column("top")), _matrix(table.column("mass")), _matrix(table.column("mean")))


def bag_partials(instances: DataFrame, model: AttentionModel, *, vectors: bool = True) -> DataFrame:
    """Records ``bag_id, top, mass, mean``: at most a few per (task, bag).

    ``mean`` holds the pooled embedding of the record's rows; without ``vectors`` only the logit of
    that embedding, which is all that a bag's probability needs.
    """
    schema = T.StructType(
        [
            instances.schema["bag_id"],
            T.StructField("top", T.DoubleType()),
            T.StructField("mass", T.DoubleType()),
            T.StructField("mean", T.ArrayType(T.DoubleType()) if vectors else T.DoubleType()),
        ]
    )

    def to_partial(batch: pa.RecordBatch) -> pa.Table:
        x = kernels.feature_matrix(batch.column("features"))
        s, unit = kernels.row_scores(model, x)
        values = kernels.embed(model, x) if vectors else unit
        return folded_table(batch, ["bag_id"], s, np.ones(len(s)), values)

    def run(batches):
        return fold_batches(batches, to_partial, ["bag_id"])

    return instances.select("bag_id", "features").mapInArrow(run, schema)


def _range_of(top: Column, plain: bool) -> Column:
    return F.lit(0).cast("long") if plain else F.floor(top / RANGE)


def _is_array(records: DataFrame, name: str) -> bool:
    return isinstance(records.schema[name].dataType, T.ArrayType)


def _plus(a: Column, b: Column, vector: bool) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y) if vector else a + b


def _times(a: Column, factor: Column, vector: bool) -> Column:
    return F.transform(a, lambda x: x * factor) if vector else a * factor


def merged_records(records: DataFrame, keys: list[str], bound: float) -> DataFrame:
    """``keys…, top, mass, mean`` of all records with equal keys; ``mean`` is a number or an array.

    ``bound`` is the largest size a logit can have (:func:`kernels.logit_bound`).
    """
    plain, vector = bound <= PLAIN_LOGIT, _is_array(records, "mean")
    weight = F.col("mass") * F.exp(F.col("top") - F.col("_range") * RANGE)
    if vector:
        # A record whose weight is zero adds nothing.
        mean = vector_to_array(Summarizer.mean(array_to_vector("mean"), F.col("_weight")))
    else:
        mean = F.sum(F.col("_weight") * F.col("mean")) / F.sum("_weight")
    placed = records.withColumn("_range", _range_of(F.col("top"), plain)).withColumn("_weight", weight)
    summed = placed.groupBy(*keys, *([] if plain else ["_range"])).agg(
        F.max("top").alias("top"), F.sum("_weight").alias("_weight"), mean.alias("mean")
    )
    if plain:
        return summed.select(*keys, "top", (F.col("_weight") * F.exp(-F.col("top"))).alias("mass"), "mean")
    # At most 2 * bound / RANGE + 1 ranges of a bag meet here.
    each = F.collect_list(F.struct("_range", "_weight", "mean"))
    listed = summed.groupBy(*keys).agg(F.max("top").alias("top"), F.max("_range").alias("_highest"), each.alias("_each"))
    none = F.transform(F.col("_each")[0]["mean"], lambda _: F.lit(0.0)) if vector else F.lit(0.0)

    def weighed(r: Column) -> Column:
        return r["_weight"] * F.exp((r["_range"] - F.col("_highest")) * RANGE)

    total = F.aggregate("_each", none, lambda acc, r: _plus(acc, _times(r["mean"], weighed(r), vector), vector))
    mass = F.aggregate("_each", F.lit(0.0), lambda acc, r: acc + weighed(r))
    lifted = F.exp(F.col("_highest") * RANGE - F.col("top"))
    merged = listed.select(*keys, "top", mass.alias("_mass"), total.alias("_total"), lifted.alias("_lifted"))
    return merged.select(*keys, "top", (F.col("_mass") * F.col("_lifted")).alias("mass"), _times(F.col("_total"), 1 / F.col("_mass"), vector).alias("mean"))


def attention_pool(instances: DataFrame, model: AttentionModel) -> DataFrame:
    """``bag_id, top, mass, pooled``: the attention-weighted mean embedding of each bag."""
    merged = merged_records(bag_partials(instances, model), ["bag_id"], kernels.logit_bound(model))
    return merged.withColumnRenamed("mean", "pooled")


def _dot(array: Column, weights: np.ndarray) -> Column:
    literal = F.array(*[F.lit(float(w)) for w in weights])
    products = F.zip_with(array, literal, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def score_bags(instances: DataFrame, model: AttentionModel, at: float = 0.5) -> DataFrame:
    """``bag_id, [top, mass,] logit, p, pred``: probability and predicted label of each bag."""
    if isinstance(model, GatedAttentionModel):
        logit = _dot(F.col("pooled"), model.cls_w) + F.lit(float(model.cls_b[0]))
        scored = gated_attention_pool(instances, model).select("bag_id", logit.alias("logit"))
    else:
        records = bag_partials(instances, model, vectors=False)
        merged = merged_records(records, ["bag_id"], kernels.logit_bound(model))
        scored = merged.select("bag_id", "top", "mass", F.col("mean").alias("logit"))
    return scored.withColumn("p", sigmoid(F.col("logit"))).withColumn("pred", threshold("p", at))


def attention_weights(
    instances: DataFrame, model: AttentionModel, bags: DataFrame | None = None, *, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """``bag_id, instance_id, attention``; the weights of a bag add up to 1.

    ``bags`` are settled ``top, mass`` per bag from :func:`score_bags`, if already at hand; else a job
    finds them when called. A gated scorer gives an array of weights, one per hidden unit.
    """
    if isinstance(model, GatedAttentionModel):
        return gated_attention_weights(instances, model, budget=budget)
    if bags is None:
        bags = settle(score_bags(instances, model))
    ends = bags.select("bag_id", "top", "mass")
    joined = lookup_join(attention_logits(instances, model), ends, ["bag_id"], "left", budget=budget)
    return joined.select(
        "bag_id", "instance_id", (F.exp(F.col("logit") - F.col("top")) / F.col("mass")).alias("attention")
    )


def score_with_attention(instances: DataFrame, model: AttentionModel, at: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Bag scores (settled) and instance attention from one model."""
    bags = settle(score_bags(instances, model, at))
    return bags, attention_weights(instances, model, bags)


def unit_partials(model: GatedAttentionModel, x: np.ndarray, source: pa.Table | pa.RecordBatch, keys: list[str]) -> pa.Table:
    """Records of the rows' bags under a gated scorer."""
    hidden = kernels.embed(model, x)
    logits = kernels.gated_attention(model, hidden)
    return folded_table(source, keys, logits, np.ones_like(logits), hidden)


def gated_partials(instances: DataFrame, model: GatedAttentionModel) -> DataFrame:
    """Records ``bag_id, top, mass, mean``, each an array over hidden units."""
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType([instances.schema["bag_id"], *[T.StructField(n, vector) for n in ("top", "mass", "mean")]])

    def to_partial(batch: pa.RecordBatch) -> pa.Table:
        return unit_partials(model, kernels.feature_matrix(batch.column("features")), batch, ["bag_id"])

    def run(batches):
        return fold_batches(batches, to_partial, ["bag_id"])

    return instances.select("bag_id", "features").mapInArrow(run, schema)


def merged_units(records: DataFrame, keys: list[str], bound: float) -> DataFrame:
    """``keys…, tops, masses, pooled``: finished softmax sums, arrays with one entry per hidden unit.

    Records are added up as whole vectors. Each unit's mass is relative to its own entry of ``tops``.
    """
    plain, top, mass, mean = bound <= PLAIN_LOGIT, F.col("top"), F.col("mass"), F.col("mean")
    # A record's units may fall into several ranges: it adds to each of them, with zeros for its other units.
    ranges = F.array_distinct(F.transform(top, lambda t: _range_of(t, plain)))
    placed = records.select(*keys, "top", "mass", "mean", F.explode(ranges).alias("_range"))
    inside = F.zip_with(top, mass, lambda t, m: F.when(
        _range_of(t, plain) == F.col("_range"), m * F.exp(t - F.col("_range") * RANGE)
    ).otherwise(0.0))
    weighed = placed.select(*keys, "_range", inside.alias("_weights"), "mean")
    totals = F.zip_with("_weights", mean, lambda w, m: w * m)
    sums = vector_to_array(Summarizer.sum(array_to_vector(F.concat("_weights", totals))))
    summed = weighed.groupBy(*keys, "_range").agg(sums.alias("_sums"))
    half = (F.size("_sums") / 2).cast("int")
    units = F.zip_with(
        F.slice("_sums", F.lit(1), half), F.slice("_sums", half + 1, half),
        lambda w, t: F.struct(F.col("_range").alias("range"), w.alias("weight"), t.alias("total")),
    )
    if plain:
        one = summed.select(*keys, units.alias("_units"))
    else:
        listed = summed.select(*keys, "_range", units.alias("_units")).groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("_range", "_units")), asc=False).alias("_each")
        )

        def under(a: Column, u: Column) -> Column:
            """A unit's sums in its highest range, with those of a lower one added."""
            factor = F.exp((u["range"] - a["range"]) * RANGE)
            both = F.struct(
                a["range"].alias("range"), (a["weight"] + u["weight"] * factor).alias("weight"), (a["total"] + u["total"] * factor).alias("total")
            )
            return F.when(a["weight"] == 0, u).otherwise(both)

        rest = F.slice("_each", F.lit(2), F.size("_each"))
        folded = F.aggregate(rest, F.col("_each")[0]["_units"], lambda acc, r: F.zip_with(acc, r["_units"], under))
        one = listed.select(*keys, folded.alias("_units"))
    unit = F.col("_units")
    return one.select(
        *keys,
        F.transform(unit, lambda u: u["range"] * RANGE).alias("tops"),
        F.transform(unit, lambda u: u["weight"]).alias("masses"),
        F.transform(unit, lambda u: u["total"] / u["weight"]).alias("pooled"),
    )


def _gated_units(instances: DataFrame, model: GatedAttentionModel) -> DataFrame:
    return merged_units(gated_partials(instances, model), ["bag_id"], kernels.logit_bound(model))


def gated_attention_pool(instances: DataFrame, model: GatedAttentionModel) -> DataFrame:
    """``bag_id, pooled`` with a softmax of its own for every hidden unit."""
    return _gated_units(instances, model).select("bag_id", "pooled")


def gated_attention_weights(
    instances: DataFrame, model: GatedAttentionModel, *, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """``bag_id, instance_id, attention array``: over a bag, each unit's weights add up to 1."""
    ends = settle(_gated_units(instances, model).select("bag_id", "tops", "masses"))
    logits = _per_instance(
        instances,
        lambda x: [_list_array(kernels.gated_attention(model, kernels.embed(model, x)))],
        [T.StructField("logits", T.ArrayType(T.DoubleType()))],
    )
    joined = lookup_join(logits, ends, ["bag_id"], "left", budget=budget)
    shifted = F.zip_with("logits", "tops", lambda s, top: F.exp(s - top))
    return joined.select("bag_id", "instance_id", F.zip_with(shifted, "masses", lambda e, z: e / z).alias("attention"))


def bag_nll(scores: DataFrame) -> DataFrame:
    """Add the clamped negative log-likelihood of each labelled bag."""
    return scores.withColumn("nll", nll(F.col("p"), F.col("label")))


def classification_error(scores: DataFrame) -> DataFrame:
    """One row: the share of bags whose predicted label is wrong."""
    right = F.avg((F.col("pred") == F.col("label")).cast("double"))
    return scores.agg((F.lit(1.0) - right).alias("error"))
