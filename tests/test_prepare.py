import warnings

import pytest
from pyspark.sql import functions as F

from bagwise.operators import bags as bag_ops
from bagwise.operators.joins import duplicate_signatures, frequency_encode, join_signatures
from bagwise.operators.prepare import assemble_features, clean_columns, feature_dim, malformed_cells, name_fragment_columns
from bagwise.operators.sampling import bernoulli_sample, hash_sample
from bagwise.operators.scaling import feature_ranges, minmax_scale
from bagwise.plans import lookup
from bagwise.plans.lookup import hot_keys, lookup_join, measured_bytes, salted_join
from bagwise.plans.ordered import global_rank


def skewed(spark, n=2000):
    """A third of the rows hold one key, another part none."""
    i = F.col("id")
    key = F.when(i % 3 == 0, "hot").when(i % 11 == 0, None).otherwise(F.concat(F.lit("k"), i % 97))
    return spark.range(n).select(i.alias("row"), key.alias("key"), (i % 5).alias("token"))


def test_names(spark):
    row = spark.createDataFrame([tuple(str(i) for i in range(12))], ", ".join(f"_c{i} string" for i in range(12)))
    assert name_fragment_columns(row).columns[-3:] == ["cnv_weight", "_c10", "_c11"]
    assert name_fragment_columns(row.select("_c0", "_c1")).columns == ["chromosome", "frag_start"]


def test_clean_and_assemble(spark):
    cells = spark.createDataFrame([(1, " 1 ", "x"), (2, None, ""), (3, "bad", "2")], "bag_id int, a string, b string")
    assert {tuple(r) for r in malformed_cells(cells, ["a", "b"]).collect()} == {("a", 1), ("b", 1)}
    keyed = clean_columns(cells, ["a", "b"]).withColumn("instance_id", F.col("bag_id"))
    packed = assemble_features(keyed, ["b", "a"])
    assert sorted(r.features for r in packed.collect()) == [[0.0, 0.0], [0.0, 1.0], [2.0, 0.0]]
    assert feature_dim(packed) == feature_dim(packed, every_row=True) == 2
    with pytest.raises(ValueError):
        feature_dim(packed.union(packed.withColumn("features", F.array(F.lit(1.0)))), every_row=True)
    with pytest.raises(ValueError):
        feature_dim(packed.limit(0))


def test_hash_sample_ignores_partitioning(spark):
    rows = spark.range(5000)
    kept = {r.id for r in hash_sample(rows, "id", 0.3, 1).collect()}
    assert kept == {r.id for r in hash_sample(rows.repartition(13), "id", 0.3, 1).collect()}
    assert 1300 < len(kept) < 1700
    assert kept != {r.id for r in hash_sample(rows, "id", 0.3, 2).collect()}
    assert 1300 < bernoulli_sample(rows, 0.3, 1).count() < 1700


def test_hot_keys_are_few(spark):
    hot = {r.key: r._salts for r in hot_keys(skewed(spark).where("key is not null"), ["key"], share=10).collect()}
    assert set(hot) == {"hot"} and hot["hot"] >= 3


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    rows = skewed(spark)
    table = rows.select("key").distinct().where("key is not null and key <> 'k5'").withColumn("v", F.length("key"))
    table = table.union(spark.createDataFrame([("hot", 99), ("unused", 1)], "key string, v int"))
    plain = sorted(map(str, rows.join(table, ["key"], how).select("row", "key", "token", "v").collect()))
    for joined in (
        salted_join(rows, table, ["key"], how, share=20),
        lookup_join(rows, table, ["key"], how),
        lookup_join(rows, table, ["key"], how, budget=0),
    ):
        assert sorted(map(str, joined.select("row", "key", "token", "v").collect())) == plain


def test_salted_join_spreads_the_hot_key(spark):
    rows = skewed(spark, 6000)
    salting = lookup.Salting.of(rows, ["key"], share=20)
    parts = salting.rows(rows).groupBy("key", "_salt").count()
    assert parts.agg(F.max("count")).first()[0] < 6000 / 20 * 2


def test_broadcast_only_within_budget(spark):
    rows, table = skewed(spark), spark.range(1000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v"))
    size = measured_bytes(table)
    assert size > 1000 * 40
    assert "BroadcastHashJoin" in lookup_join(rows, table, ["key"], budget=size)._jdf.queryExecution().toString()
    beyond = lookup_join(rows, table, ["key"], budget=size - 1)
    assert "_salt" in beyond._jdf.queryExecution().toString()


def test_signature_joins_share_one_exchange(spark):
    rows = skewed(spark).select(F.col("key").alias("sample_name"), F.col("token").cast("string").alias("out5p"), F.col("row").cast("string").alias("in5p"))
    names = ["hot", *[f"k{i}" for i in range(97)]]
    table = spark.createDataFrame([(f"filtered_{n}raw", str(i % 5), i) for i, n in enumerate(names)], "Sample string, Motif string, v int")
    rows = rows.withColumn("sample_name", F.concat("sample_name", F.lit("raw")))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        joined = join_signatures(rows, {"out5p": table, "in5p": table}, budget=-1)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        # One exchange for the rows and one for each table.
        assert plan.count("Exchange hashpartitioning") == 3
        wide = join_signatures(rows, {"out5p": table, "in5p": table})
        assert sorted(map(str, joined.collect())) == sorted(map(str, wide.collect()))
    finally:
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_signature_joins_deal_rows_themselves(spark):
    """By default each join needs the rows by all of its keys: they are not moved by the sample before."""
    rows = spark.range(50).selectExpr("concat('k', id % 7, 'raw') as sample_name", "cast(id % 5 as string) as out5p", "cast(id % 3 as string) as in5p")
    table = spark.range(35).selectExpr("concat('filtered_k', id % 7, 'raw') as Sample", "cast(id div 7 as string) as Motif", "id as v")
    joined = join_signatures(rows, {"out5p": table, "in5p": table}, budget=-1)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan and "_salt" in plan
    wide = join_signatures(rows, {"out5p": table, "in5p": table})
    assert sorted(map(str, joined.collect())) == sorted(map(str, wide.collect()))


def test_duplicate_signatures_multiply_rows(spark):
    table = spark.createDataFrame([("filtered_Araw", "x", 1), ("filtered_Araw", "x", 2), ("filtered_Araw", "y", 3)], "Sample string, Motif string, v int")
    assert [tuple(r) for r in duplicate_signatures(table).collect()] == [("Araw", "x", 2)]
    rows = spark.createDataFrame([("Araw", "x"), ("Araw", "z"), ("Braw", "x")], "sample_name string, out5p string")
    with pytest.warns(UserWarning):
        joined = join_signatures(rows, {"out5p": table})
    assert sorted((r.sample_name, r.out5p, r.v_out or 0) for r in joined.collect()) == [
        ("Araw", "x", 1), ("Araw", "x", 2), ("Araw", "z", 0), ("Braw", "x", 0)]
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        join_signatures(rows, {"out5p": table.where("v > 1")})


def test_frequency_encode_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "a"), (2, "b")], "bag_id int, t string")
    for budget in (lookup.BROADCAST_BYTES, -1):
        found = frequency_encode(rows, ["t"], budget=budget).collect()
        assert sorted((r.bag_id, r.t or "", r.t_freq) for r in found if r.t) == [(1, "a", 2), (1, "a", 2), (2, "a", 1), (2, "b", 1)]
        assert [r.t_freq for r in found if r.t is None] == [None]


def test_scaling(spark):
    rows = spark.createDataFrame([(1, 2.0, 5.0), (1, 4.0, 5.0), (1, None, 5.0), (2, -1.0, 0.0), (2, 3.0, 1.0)], "bag_id int, a double, b double")
    for budget in (lookup.BROADCAST_BYTES, -1):
        scaled = minmax_scale(rows, ["a", "b"], budget=budget).collect()
        assert sorted((r.bag_id, -9 if r.a is None else r.a, r.b) for r in scaled) == [(1, -9, 0), (1, 0, 0), (1, 1, 0), (2, 0, 0), (2, 1, 1)]
    with pytest.raises(Exception, match="NaN in column a"):
        feature_ranges(rows.union(spark.createDataFrame([(1, float("nan"), 0.0)], rows.schema)), ["a"]).collect()


def test_bags(spark):
    rows = skewed(spark).where("key is not null").select(F.col("key").alias("bag_id"), F.col("row").alias("instance_id"), F.array(F.col("row").cast("double")).alias("features"))
    bags = spark.createDataFrame([("hot", 1), ("k1", 0), ("gone", 0)], "bag_id string, label int")
    assert [r.bag_id for r in bag_ops.empty_bags(bags, rows).collect()] == ["gone"]
    with pytest.raises(ValueError, match="gone"):
        bag_ops.require_instances(bags, rows)
    bag_ops.require_instances(bags.where("bag_id <> 'gone'"), rows)
    blocks = bag_ops.assemble_bags(rows, bags, chunk_rows=50)
    assert blocks.agg(F.max(F.size("instance_ids"))).first()[0] < 120
    ids = blocks.select("bag_id", F.explode("instance_ids").alias("i")).collect()
    assert sorted((r.bag_id, r.i) for r in ids) == sorted((r.bag_id, r.instance_id) for r in rows.collect())
    united = bag_ops.union_bags(bags, bags.drop("label").withColumn("extra", F.lit(1)))
    assert united.count() == 6 and united.columns == ["bag_id", "label", "extra"]


def test_global_rank(spark):
    rows = skewed(spark).repartition(7)
    ranked = global_rank(rows, [F.col("token").desc(), F.col("row")])
    expected = sorted(rows.collect(), key=lambda r: (-r.token, r.row))
    assert [r.row for r in sorted(ranked.collect(), key=lambda r: r["rank"])] == [r.row for r in expected]
    assert sorted(r["rank"] for r in ranked.collect()) == list(range(1, 2001))
