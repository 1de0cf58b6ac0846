import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import forward, gated_forward, instances, random_bags

from bagwise.operators import pooling
from bagwise.operators.model import AttentionModel, GatedAttentionModel

SIZES = {"a": 1, "b": 7, "c": 400, "d": 23}


@pytest.fixture(scope="module")
def bags():
    return random_bags(SIZES, 3)


@pytest.fixture(scope="module")
def model():
    return AttentionModel.random(3, 5, seed=3)


@pytest.mark.parametrize("partitions", [1, 4, 17])
@pytest.mark.parametrize("fold_rows", [pooling.FOLD_ROWS, 2])
def test_scores(spark, bags, model, partitions, fold_rows, monkeypatch):
    monkeypatch.setattr(pooling, "FOLD_ROWS", fold_rows)
    rows = instances(spark, bags).repartition(partitions)
    scores = {r.bag_id: r for r in pooling.score_bags(rows, model).collect()}
    pooled = {r.bag_id: r.pooled for r in pooling.attention_pool(rows, model).collect()}
    assert set(scores) == set(SIZES)
    for bag, x in bags.items():
        p, _, m = forward(model, x)
        assert scores[bag].p == pytest.approx(p, abs=1e-12)
        assert scores[bag].pred == int(p >= 0.5)
        np.testing.assert_allclose(pooled[bag], m, atol=1e-12)


def test_attention(spark, bags, model):
    scores, weights = pooling.score_with_attention(instances(spark, bags).repartition(5), model)
    found = {(r.bag_id, r.instance_id): r.attention for r in weights.collect()}
    for bag, x in bags.items():
        np.testing.assert_allclose([found[bag, i] for i in range(len(x))], forward(model, x)[1], atol=1e-12)
    totals = weights.groupBy("bag_id").agg(F.sum("attention").alias("t")).collect()
    assert all(r.t == pytest.approx(1.0) for r in totals)
    shuffled = pooling.attention_weights(instances(spark, bags), model, scores, budget=-1)
    assert {(r.bag_id, r.instance_id): r.attention for r in shuffled.collect()} == pytest.approx(found)


def test_large_logits_stay_finite(spark, bags, model):
    steep = AttentionModel(**{**model.arrays(), "att_w": model.att_w * 900, "att_b": np.array([700.0])})
    scores = pooling.score_bags(instances(spark, bags).repartition(6), steep).collect()
    for r in scores:
        assert r.p == pytest.approx(forward(steep, bags[r.bag_id])[0], abs=1e-9)
    vectors = pooling.attention_pool(instances(spark, bags).repartition(6), steep).collect()
    for r in vectors:
        np.testing.assert_allclose(r.pooled, forward(steep, bags[r.bag_id])[2], atol=1e-9)


def test_copies_change_nothing(spark, bags, model):
    rows = instances(spark, bags)
    once = {r.bag_id: r.p for r in pooling.score_bags(rows, model).collect()}
    twice = {r.bag_id: r.p for r in pooling.score_bags(rows.union(rows), model).collect()}
    assert once == pytest.approx(twice)


def test_gated(spark, bags):
    model = GatedAttentionModel.random(3, 4, seed=9)
    rows = instances(spark, bags).repartition(5)
    scores = {r.bag_id: r.p for r in pooling.score_bags(rows, model).collect()}
    weights = {(r.bag_id, r.instance_id): r.attention for r in pooling.attention_weights(rows, model).collect()}
    for bag, x in bags.items():
        p, a, _ = gated_forward(model, x)
        assert scores[bag] == pytest.approx(p, abs=1e-12)
        np.testing.assert_allclose([weights[bag, i] for i in range(len(x))], a, atol=1e-12)


def test_bad_features_are_refused(spark, model):
    rows = spark.createDataFrame([("a", 1, [1.0, None, 2.0])], "bag_id string, instance_id long, features array<double>")
    with pytest.raises(Exception, match="without nulls"):
        pooling.score_bags(rows, model).collect()


def test_error_and_likelihood(spark):
    scores = spark.createDataFrame([("a", 1, 0.9, 1), ("b", 0, 0.8, 1), ("c", 0, 0.1, 0), ("d", 1, 0.5, 1)], "bag_id string, label int, p double, pred int")
    assert pooling.classification_error(scores).first().error == pytest.approx(0.25)
    found = {r.bag_id: r.nll for r in pooling.bag_nll(scores).collect()}
    assert found == pytest.approx({"a": -np.log(0.9), "b": -np.log(0.2), "c": -np.log(0.9), "d": -np.log(0.5)})


def steep_gated(model):
    """Logits of very different size by unit, far beyond what exponentials hold."""
    return GatedAttentionModel(**{**model.arrays(), "att_w": model.att_w * np.array([[1.0], [900.0], [2500.0], [1.0]]), "att_b": np.array([0.1, 700.0, -700.0, 0.0])})


@pytest.mark.parametrize("partitions", [1, 6])
def test_gated_of_large_logits(spark, bags, partitions):
    model = steep_gated(GatedAttentionModel.random(3, 4, seed=9))
    rows = instances(spark, bags).repartition(partitions)
    pooled = {r.bag_id: r.pooled for r in pooling.gated_attention_pool(rows, model).collect()}
    weights = {(r.bag_id, r.instance_id): r.attention for r in pooling.attention_weights(rows, model).collect()}
    for bag, x in bags.items():
        _, a, m = gated_forward(model, x)
        np.testing.assert_allclose(pooled[bag], m, atol=1e-9)
        np.testing.assert_allclose([weights[bag, i] for i in range(len(x))], a, atol=1e-9)


@pytest.mark.parametrize("bound", [0.0, 701.0])
def test_records_merge_across_ranges(spark, bound):
    """The same sums whether records fall into one range of logits or into several."""
    rows = [("a", t, 2.0, v) for t, v in ((-5.0, 1.0), (0.0, 2.0), (299.0, 3.0), (299.5, 4.0))]
    rows += [("b", -290.0, 3.0, 7.0), (None, 1.0, 1.0, 5.0), (None, 2.0, 1.0, 6.0)]
    if bound:
        rows += [("c", t, 1.0, v) for t, v in ((700.0, 1.0), (699.0, 2.0), (-700.0, 3.0))]
    records = spark.createDataFrame(rows, "bag_id string, top double, mass double, mean double")
    wide = records.withColumn("mean", F.array("mean", -F.col("mean")))
    got = {r.bag_id: r for r in pooling.merged_records(records, ["bag_id"], bound).collect()}
    vectors = {r.bag_id: r for r in pooling.merged_records(wide, ["bag_id"], bound).collect()}
    for bag in {r[0] for r in rows}:
        top, mass, mean = (np.array(v) for v in zip(*[r[1:] for r in rows if r[0] == bag]))
        w = mass * np.exp(top - top.max())
        assert (got[bag].top, got[bag].mass, got[bag]["mean"]) == pytest.approx((top.max(), w.sum(), w @ mean / w.sum()))
        assert vectors[bag].mass == pytest.approx(w.sum())
        np.testing.assert_allclose(vectors[bag]["mean"], [w @ mean / w.sum(), -(w @ mean) / w.sum()])


@pytest.mark.parametrize("scorer", [AttentionModel, GatedAttentionModel])
@pytest.mark.parametrize("steep", [1, 4000])
def test_merging_combines_before_the_shuffle(spark, bags, scorer, steep):
    """Under the lowest exchange stands a partial aggregate; there is no window, and no row per unit."""
    model = scorer.random(3, 4, seed=9)
    model = scorer(**{**model.arrays(), "att_w": model.att_w * steep})
    plan = pooling.score_bags(instances(spark, bags), model)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan
    below = plan[plan.rindex("Exchange hashpartitioning") :].split("\n", 2)[1]
    assert "Aggregate" in below and "partial_" in below
