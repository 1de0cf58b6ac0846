import hashlib

import numpy as np
import pytest
from helpers import auc as plain_auc
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bagwise.operators import folds, metrics, reports
from bagwise.operators.sampling import exact_sample


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, p double").repartition(5)


def plain_roc(labels, scores, drop):
    """Points of the curve from a sorted sweep, without those between two equal steps."""
    steps = []
    for t in sorted(set(scores), reverse=True):
        at = [y for y, p in zip(labels, scores) if p == t]
        steps.append((t, sum(at), len(at) - sum(at)))
    tp = fp = 0
    points = [(float("inf"), 0, 0)]
    for i, (t, pos, neg) in enumerate(steps):
        tp, fp = tp + pos, fp + neg
        inner = 0 < i < len(steps) - 1
        if not (drop and inner and steps[i + 1][1:] == (pos, neg)):
            points.append((t, tp, fp))
    return [(t, fp_ / fp if fp else None, tp_ / tp if tp else None) for t, tp_, fp_ in points]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 12).map(lambda v: v / 12)), min_size=2, max_size=60))
def test_auc_and_roc(spark, rows):
    labels, scores = zip(*rows)
    found = metrics.auc(frame(spark, rows)).first().auc
    if len(set(labels)) == 1:
        assert found is None
    else:
        assert found == pytest.approx(plain_auc(labels, scores))
    for drop in (True, False):
        curve = metrics.roc_curve(frame(spark, rows), drop_collinear=drop).collect()
        points = sorted(((r.threshold, r.fpr, r.tpr) for r in curve), key=lambda r: -r[0])
        assert points == plain_roc(labels, scores, drop)


def test_collinear_points_are_dropped(spark):
    rows = [(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)]
    assert metrics.roc_curve(frame(spark, rows)).count() < metrics.roc_curve(frame(spark, rows), drop_collinear=False).count()


def test_grouped_auc(spark):
    rng = np.random.default_rng(5)
    rows = [(int(g), int(y), float(p)) for g, y, p in zip(rng.integers(0, 4, 300), rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40)]
    rows += [(9, 1, 0.3), (9, 1, 0.4)]
    found = {r.g: r.auc for r in metrics.auc(spark.createDataFrame(rows, "g int, label int, p double").repartition(6), ["g"]).collect()}
    assert found.pop(9) is None
    for g, value in found.items():
        some = [(y, p) for h, y, p in rows if h == g]
        assert value == pytest.approx(plain_auc(*zip(*some)))


def test_auc_depends_on_order_only(spark):
    rng = np.random.default_rng(6)
    rows = [(int(y), float(p)) for y, p in zip(rng.integers(0, 2, 200), rng.random(200))]
    plain = metrics.auc(frame(spark, rows)).first().auc
    bent = metrics.auc(frame(spark, [(y, p**3) for y, p in rows])).first().auc
    assert plain == pytest.approx(bent)


def test_confusion_is_always_whole(spark):
    scores = spark.createDataFrame([(1, 1), (1, 0), (1, 1)], "label int, pred int")
    cells = {(r.label, r.pred): r.n for r in metrics.confusion_matrix(scores).collect()}
    assert cells == {(0, 0): 0, (0, 1): 0, (1, 0): 1, (1, 1): 2}
    shares = {(r.label, r.pred): r.share for r in metrics.confusion_matrix(scores, normalize=True).collect()}
    assert shares[0, 0] is None and shares[1, 1] == pytest.approx(2 / 3)


def test_series(spark):
    rows = spark.createDataFrame([("a", i, i / 10) for i in range(50)] + [("b", 1, 1.0)], "bag_id string, instance_id long, attention double")
    found = sorted(tuple(r) for r in reports.bag_attention_series(rows.repartition(6), "a").collect())
    assert found == [(i, i, i / 10) for i in range(50)]
    assert reports.bag_attention_series(rows, "absent").count() == 0


def test_histogram(spark):
    rng = np.random.default_rng(2)
    values = {"a": rng.random(500), "b": np.full(5, 0.25)}
    rows = [(bag, i, float(v)) for bag, x in values.items() for i, v in enumerate(x)]
    attention = spark.createDataFrame(rows, "bag_id string, instance_id long, attention double")
    bags = spark.createDataFrame([("a", 0), ("b", 1)], "bag_id string, label int")
    found = reports.attention_histogram(attention, bags).collect()
    for label, bag in ((0, "a"), (1, "b")):
        mine = sorted((r for r in found if r.label == label), key=lambda r: r.bin)
        counts, edges = np.histogram(values[bag], bins=50)
        assert [r.n for r in mine] == counts.tolist()
        np.testing.assert_allclose([r.lo_edge for r in mine], edges[:-1])
        np.testing.assert_allclose([r.hi_edge for r in mine], edges[1:])


@pytest.mark.parametrize("n,k", [(10, 10), (23, 5), (150, 10), (7, 2)])
def test_folds(spark, n, k):
    bags = spark.range(n).select(F.col("id").alias("bag_id"))
    found = [r.fold for r in folds.kfold_assign(bags.repartition(3), k, 1).collect()]
    sizes = [found.count(f) for f in range(k)]
    assert sizes == [n // k + (f < n % k) for f in range(k)]


def test_too_few_bags(spark):
    with pytest.raises(ValueError):
        folds.kfold_assign(spark.range(3).select(F.col("id").alias("bag_id")), 4)


def test_summary(spark):
    aucs = spark.createDataFrame([(1, 0.5), (0, 0.7), (2, None)], "fold int, auc double")
    row = folds.cv_summary(aucs).first()
    assert row.aucs == [0.7, 0.5, None]
    assert (row.mean_auc, row.std_auc, row.n_valid_folds, row.n_folds) == pytest.approx((0.6, 0.1, 2, 3))


def test_reports_by_keys_with_null(spark):
    """A null fold is a fold; each group's reports are those of its rows alone."""
    rng = np.random.default_rng(4)
    rows = [(f, e, int(rng.integers(2)), float(rng.integers(1, 9)) / 10) for f in (None, 0, 1) for e in (1, 2) for _ in range(30)]
    rows += [(7, 1, 1, 0.5), (7, 1, 1, 0.7)]  # one class only
    scores = spark.createDataFrame(rows, "fold int, epoch int, label int, p double").withColumn("pred", (F.col("p") >= 0.5).cast("int"))
    reports = metrics.keyed_reports(scores, ["fold", "epoch"])
    found = {(r.fold, r.epoch): r.auc for r in reports.auc.collect()}
    assert len(found) == 7 and found[7, 1] is None
    cells = {(r.fold, r.epoch, r.label, r.pred): r.n for r in reports.confusion.collect()}
    assert len(cells) == 28
    points = {}
    for r in reports.roc.collect():
        points.setdefault((r.fold, r.epoch), []).append((r.threshold, r.fpr, r.tpr))
    for f, e in found:
        own = [(y, p) for g, h, y, p in rows if (g, h) == (f, e)]
        if (f, e) != (7, 1):
            assert found[f, e] == pytest.approx(plain_auc([y for y, _ in own], [p for _, p in own]))
        for y in (0, 1):
            for q in (0, 1):
                assert cells[f, e, y, q] == sum(a == y and (p >= 0.5) == bool(q) for a, p in own)
        one = spark.createDataFrame(own, "label int, p double")
        alone = [(r.threshold, r.fpr, r.tpr) for r in metrics.roc_curve(one).collect()]
        assert sorted(points[f, e], key=str) == sorted(alone, key=str)
    assert {(r.fold, r.epoch) for r in metrics.auc(scores, ["fold", "epoch"]).collect()} == set(found)
    kept = metrics.keyed_reports(scores, ["fold"], drop_collinear=False).roc
    assert kept.where("fold is null").count() == 1 + len({p for f, _, _, p in rows if f is None})


@pytest.mark.parametrize("partitions", [1, 9])
@pytest.mark.parametrize("budget", [64 << 20, -1])
def test_exact_sample(spark, partitions, budget):
    """Each group gives its share to the row, the same rows under any partitioning; null groups too."""
    sizes = {None: 13, "a": 1, "b": 2, "c": 5000, "d": 40}
    rows = [(g, f"{g}{i}") for g, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "bag string, key string").repartition(partitions)
    for fraction in (0.0, 0.01, 0.4, 1.0):
        got = {tuple(r) for r in exact_sample(frame, "key", fraction, 7, ["bag"], budget=budget).collect()}
        expected = set()
        for g, n in sizes.items():
            ranked = sorted((hashlib.md5(f"7|{k}".encode()).hexdigest(), k) for h, k in rows if h == g)
            expected |= {(g, k) for _, k in ranked[: int(n * fraction + 0.5)]}
        assert got == expected
    assert exact_sample(frame, "key", 0.5, 7).count() == round(len(rows) / 2)
    assert exact_sample(frame.where("false"), "key", 0.5, 7).count() == 0
