from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from helpers import auc as plain_auc
from helpers import forward, gated_forward, instances, random_bags
from pyspark.sql import functions as F

from bagwise.catalogue import fixtures
from bagwise.operators import kernels
from bagwise.operators.model import AttentionModel, GatedAttentionModel
from bagwise.plans import training
from bagwise.plans.crossval import cross_validate
from bagwise.plans.evaluation import evaluate
from bagwise.sources import read_bags, write_bags
from bagwise.plans.training import NO_FOLD, Adam, TrainSettings, train_attention, training_history, training_roc

LABELS = {f"bag{i}": i % 2 for i in range(6)}


@pytest.fixture(scope="module")
def bags():
    made = random_bags({b: 3 + 11 * i for i, b in enumerate(LABELS)}, 3, seed=1)
    return {b: x + LABELS[b] for b, x in made.items()}


@pytest.fixture(scope="module")
def model():
    return AttentionModel.random(3, 4, seed=5)


def labels_frame(spark):
    return spark.createDataFrame(list(LABELS.items()), "bag_id string, label int")


def loss_of(values, model, bags, kind="bce"):
    total = 0.0
    for bag, x in bags.items():
        p = forward(model.with_flat(values), x)[0]
        q = p if LABELS[bag] else 1 - p
        total += -np.log(q) if kind == "bce" else -0.25 * (1 - q) ** 2 * np.log(q)
    return total / len(bags)


def numeric_gradient(model, bags, kind):
    at, step = model.flat(), 1e-6
    eye = np.eye(at.size) * step
    return np.array([(loss_of(at + e, model, bags, kind) - loss_of(at - e, model, bags, kind)) / (2 * step) for e in eye])


@pytest.mark.parametrize("kind", ["bce", "focal"])
def test_gradients(spark, bags, model, kind, tmp_path):
    rows = training.labelled_rows(instances(spark, bags), labels_frame(spark)).repartition(5).cache()
    settings = TrainSettings(loss=kind)
    expected = numeric_gradient(model, bags, kind)
    two = training._two_pass_step(rows, {NO_FOLD: model}, settings, str(tmp_path / kind))[NO_FOLD]
    np.testing.assert_allclose(two, expected, atol=1e-8)
    one, scores = training._one_pass_step(rows, {NO_FOLD: model}, settings)
    np.testing.assert_allclose(one[NO_FOLD], expected, atol=1e-8)
    assert {r.bag_id: r.p for r in scores} == pytest.approx({b: forward(model, x)[0] for b, x in bags.items()})
    beyond = training._two_pass_step(rows, {NO_FOLD: model}, replace(settings, budget=-1), str(tmp_path / f"{kind}2"))
    np.testing.assert_allclose(beyond[NO_FOLD], expected, atol=1e-8)


def plain_training(model, bags, order, settings):
    """The same steps one bag at a time."""
    adam, values, seen = Adam(settings.lr, settings.weight_decay), model.flat(), []
    for batch in order:
        some = {b: bags[b] for b in batch}
        seen += [(b, forward(model.with_flat(values), bags[b])[0]) for b in batch]
        values = adam.step(values, numeric_gradient(model.with_flat(values), some, settings.loss))
    return values, seen


@pytest.mark.parametrize("size", [1, 4])
@pytest.mark.parametrize("one_pass", [16, 0])
def test_batches(spark, bags, model, size, one_pass, monkeypatch):
    monkeypatch.setattr(training, "ONE_PASS_RECORDS", one_pass)
    settings = TrainSettings(epochs=1, lr=0.02, batch_bags=size, weight_decay=1e-3)
    trained = train_attention(instances(spark, bags), labels_frame(spark), settings, model)
    ranked = training.shuffled_rank(labels_frame(spark), settings.seed, 1).collect()
    order = [r.bag_id for r in sorted(ranked, key=lambda r: r["rank"])]
    batches = [order[i : i + size] for i in range(0, len(order), size)]
    values, seen = plain_training(model, bags, batches, settings)
    np.testing.assert_allclose(trained.model.flat(), values, atol=1e-5)
    scores = trained.scores.collect()
    assert {r.bag_id: r.p for r in scores} == pytest.approx(dict(seen), abs=1e-5)
    history = training_history(trained.scores).first()
    assert history.auc == pytest.approx(plain_auc([LABELS[b] for b, _ in seen], [p for _, p in seen]))
    assert history.loss == pytest.approx(sum(r.loss for r in scores))


@pytest.mark.parametrize("size, buckets, listed", [(1, 3, 1000), (2, 3, 1000), (5, 3, 1000), (4, 1024, 3)])
def test_batches_are_slices_of_the_order_at_every_size(spark, bags, model, size, buckets, listed, monkeypatch):
    monkeypatch.setattr(training, "MOST_BUCKETS", buckets)
    monkeypatch.setattr(training, "LISTED_BAGS", listed)
    settings = TrainSettings(epochs=1, lr=0.02, batch_bags=size)
    ranked = training.shuffled_rank(labels_frame(spark), settings.seed, 1).collect()
    order = [r.bag_id for r in sorted(ranked, key=lambda r: r["rank"])]
    batches = [order[i : i + size] for i in range(0, len(order), size)]
    values, seen = plain_training(model, bags, batches, settings)
    trained = train_attention(instances(spark, bags), labels_frame(spark), settings, model)
    np.testing.assert_allclose(trained.model.flat(), values, atol=1e-5)
    assert {r.bag_id: r.p for r in trained.scores.collect()} == pytest.approx(dict(seen), abs=1e-5)


@pytest.mark.parametrize("options", [{"batch_bags": 3}, {"n_batches": 2, "gated": True}, {"n_batches": 2, "stored_buckets": 3}])
def test_batches_of_many_bags_are_one_scan(spark, bags, tmp_path, monkeypatch, options):
    """They train as batches that are picked out of the stored rows do; the rows are written once an epoch."""
    settings = TrainSettings(epochs=3, lr=0.02, hidden=4, **options)
    rows = instances(spark, bags)
    if settings.stored_buckets:
        labelled = rows.join(labels_frame(spark), "bag_id").withColumn("split", F.lit("train"))
        write_bags(labelled, str(tmp_path / "bags"), buckets=3)
        rows = read_bags(spark, str(tmp_path / "bags"), "train")
    monkeypatch.setattr(training, "ONE_PASS_RECORDS", 0)
    picked = train_attention(rows, labels_frame(spark), settings)
    monkeypatch.setattr(training, "PRUNED_BAGS", 1)
    monkeypatch.setattr(training, "PICKED_BAGS", 2, raising=False)
    scans, removed, step, gone = [], [], training._two_pass_step, training.discard
    monkeypatch.setattr(training, "_two_pass_step", lambda some, *a: scans.append(some._jdf.queryExecution().optimizedPlan().collectLeaves().size()) or step(some, *a))
    monkeypatch.setattr(training, "discard", lambda spark, path: removed.append(path) or gone(spark, path))
    found = train_attention(rows, labels_frame(spark), settings)
    np.testing.assert_allclose(found.model.flat(), picked.model.flat(), atol=1e-9)
    score = lambda t: {(r.epoch, r.bag_id): r.p for r in t.scores.collect()}
    assert score(found) == pytest.approx(score(picked)) and found.scores.count() == 18
    assert scans == [1] * 6 and len(set(removed)) == 3


@pytest.mark.parametrize("features, message", [([[1.0], [1.0, 2.0, 3.0]], "equal width"), ([[1.0, 2.0], [1.0, float("nan")]], "NaN")])
def test_uneven_and_nan_features_are_refused(features, message):
    with pytest.raises(ValueError, match=message):
        kernels.feature_matrix(pa.array(features))


def test_evaluation_counts_every_bag_once(spark, bags, model):
    labels = labels_frame(spark)
    with pytest.raises(ValueError, match="gone"):
        evaluate(instances(spark, bags), labels.union(spark.createDataFrame([("gone", 1)], labels.schema)), model)
    with pytest.raises(ValueError, match="bag3"):
        evaluate(instances(spark, bags), labels.union(labels.where("bag_id = 'bag3'")), model)


def test_stored_bags_are_read_in_place(spark, bags, model, tmp_path):
    settings = TrainSettings(epochs=2, lr=0.02)
    plain = train_attention(instances(spark, bags), labels_frame(spark), settings, model)
    path = str(tmp_path / "bags")
    labelled = instances(spark, bags).join(labels_frame(spark), "bag_id").withColumn("split", F.lit("train"))
    write_bags(labelled, path, buckets=3)
    stored = read_bags(spark, path, "train")
    in_place = train_attention(stored, labels_frame(spark), replace(settings, stored_buckets=3), model)
    np.testing.assert_allclose(plain.model.flat(), in_place.model.flat(), atol=1e-9)
    assert plain.scores.count() == in_place.scores.count() == 12
    rows = training.labelled_rows(stored, labels_frame(spark))
    step = next(training._batches(rows, labels_frame(spark), 3, 1, settings))
    plan = step._jdf.queryExecution().executedPlan().toString()
    assert "(bag_bucket#" in plan.split("PartitionFilters")[1] and "EqualTo(bag_id," in plan


@pytest.mark.parametrize("size", [None, 1])
def test_single_precision(spark, bags, model, size):
    settings = TrainSettings(epochs=2, lr=0.02, batch_bags=size)
    double = train_attention(instances(spark, bags), labels_frame(spark), settings, model)
    single = train_attention(instances(spark, bags), labels_frame(spark), replace(settings, single=True), model)
    for name, a in double.model.arrays().items():
        if name != "att_b":  # shifts all logits alike: its gradient is rounding only
            np.testing.assert_allclose(single.model.arrays()[name], a, atol=1e-3)
    p = {(r.bag_id, r.epoch): r.p for r in double.scores.collect()}
    assert {(r.bag_id, r.epoch): r.p for r in single.scores.collect()} == pytest.approx(p, abs=1e-4)


def test_learning(spark, small):
    rows, labels = fixtures.event_instances(spark, small), fixtures.event_bags(spark, small)
    settings = TrainSettings(epochs=12, lr=0.05, hidden=8, batch_bags=None)
    trained = train_attention(rows, labels, settings)
    history = sorted(training_history(trained.scores).collect(), key=lambda r: r.epoch)
    assert history[-1].loss < history[0].loss
    assert training_roc(trained.scores).where("threshold = 'Infinity'").count() == 1
    result = evaluate(rows, labels, trained.model)
    assert result.confusion.count() == 4 and result.scores.count() == 15
    assert result.attention.count() == rows.count()


def test_separable_bags_are_learnt(spark, bags):
    settings = TrainSettings(epochs=15, lr=0.05, hidden=8, batch_bags=None)
    trained = train_attention(instances(spark, bags), labels_frame(spark), settings)
    assert evaluate(instances(spark, bags), labels_frame(spark), trained.model).auc.first().auc > 0.8


@pytest.mark.parametrize("size", [None, 2])
def test_cross_validation(spark, bags, model, size):
    settings = TrainSettings(epochs=2, lr=0.02, batch_bags=size, hidden=4)
    models = {f: AttentionModel.random(3, 4, seed=f) for f in range(3)}
    result = cross_validate(instances(spark, bags), labels_frame(spark), settings, k=3, models=models)
    folds = {r.bag_id: r.fold for r in result.scores.collect()}
    assert sorted(folds) == sorted(LABELS)
    for f in models:
        # Each fold's model equals one trained by itself on the other folds' bags, in one batch.
        rest = {b: x for b, x in bags.items() if folds[b] != f}
        if size is None:
            values, _ = plain_training(models[f], rest, [list(rest)] * 2, settings)
            np.testing.assert_allclose(result.trained.models[f].flat(), values, atol=1e-5)
    for r in result.scores.collect():
        assert r.p == pytest.approx(forward(result.trained.models[r.fold], bags[r.bag_id])[0])
    summary = result.summary.first()
    assert summary.n_folds == 3 and len(summary.aucs) == 3


@pytest.mark.parametrize("size", [None, 2])
def test_empty_bags_are_refused(spark, bags, size):
    labels = labels_frame(spark).union(spark.createDataFrame([("gone", 1)], "bag_id string, label int"))
    with pytest.raises(ValueError, match="gone"):
        train_attention(instances(spark, bags), labels, TrainSettings(epochs=1, hidden=2, batch_bags=size))


def test_repeated_bags_are_refused(spark, bags):
    labels = labels_frame(spark).union(labels_frame(spark).where("bag_id = 'bag3'"))
    with pytest.raises(ValueError, match="bag3"):
        train_attention(instances(spark, bags), labels, TrainSettings(epochs=1, hidden=2))


def test_settings_are_checked(spark, bags):
    with pytest.raises(ValueError):
        train_attention(instances(spark, bags), labels_frame(spark), TrainSettings(loss="hinge", hidden=2))
    with pytest.raises(ValueError):
        train_attention(instances(spark, bags), labels_frame(spark), TrainSettings(epochs=0, hidden=2))
    with pytest.raises(Exception, match="takes 2 features"):
        train_attention(instances(spark, bags), labels_frame(spark), TrainSettings(), AttentionModel.random(2, 2))


def gated_loss(values, model, bags, kind="bce"):
    total = 0.0
    for bag, x in bags.items():
        p = gated_forward(model.with_flat(values), x)[0]
        q = p if LABELS[bag] else 1 - p
        total += -np.log(q) if kind == "bce" else -0.25 * (1 - q) ** 2 * np.log(q)
    return total / len(bags)


@pytest.mark.parametrize("kind", ["bce", "focal"])
@pytest.mark.parametrize("steep", [1, 4000])
def test_gated_gradients(spark, bags, kind, steep, tmp_path):
    """Against finite differences, also where logits need several ranges."""
    drawn = GatedAttentionModel.random(3, 4, seed=5)
    model = drawn if steep == 1 else GatedAttentionModel(**{**drawn.arrays(), "att_b": drawn.att_b + np.array([0, 900.0, -900.0, 0])})
    rows = training.labelled_rows(instances(spark, bags), labels_frame(spark)).repartition(5).cache()
    at, step = model.flat(), 1e-5
    eye = np.eye(at.size) * step
    expected = np.array([(gated_loss(at + e, model, bags, kind) - gated_loss(at - e, model, bags, kind)) / (2 * step) for e in eye])
    for n, budget in enumerate((64 << 20, -1)):
        found = training._two_pass_step(rows, {NO_FOLD: model}, TrainSettings(loss=kind, budget=budget), str(tmp_path / f"{kind}{n}"))
        np.testing.assert_allclose(found[NO_FOLD], expected, atol=1e-7)


def test_gated_training_over_batches_and_folds(spark, bags):
    rows, labels = instances(spark, bags), labels_frame(spark)
    settings = TrainSettings(epochs=2, hidden=4, lr=0.05, batch_bags=4, gated=True)
    trained = train_attention(rows, labels, settings)
    assert isinstance(trained.model, GatedAttentionModel) and trained.scores.count() == 12
    losses = {r.epoch: r.loss for r in training_history(trained.scores).collect()}
    assert losses[2] < losses[1]
    result = cross_validate(rows, labels, replace(settings, batch_bags=None), k=3)
    held_out = {r.bag_id: (r.fold, r.p) for r in result.scores.collect()}
    for bag, x in bags.items():
        fold, p = held_out[bag]
        assert p == pytest.approx(gated_forward(result.trained.models[fold], x)[0])
    with pytest.raises(ValueError, match="together"):
        training.is_gated({0: trained.model, 1: AttentionModel.random(3, 4)})


@pytest.mark.parametrize("options", [{"batch_bags": 1}, {"batch_bags": None}, {"n_batches": 4, "gated": True}])
def test_a_stopped_run_goes_on_as_if_unbroken(spark, bags, tmp_path, monkeypatch, options):
    rows, labels = instances(spark, bags), labels_frame(spark)
    settings = TrainSettings(epochs=3, hidden=4, lr=0.02, weight_decay=1e-3, **options)
    whole = train_attention(rows, labels, settings)
    kept = replace(settings, run_folder=str(tmp_path / "runs"))
    taken, after = [], training.Adam.step

    def failing(self, values, gradient):
        taken.append(1)
        if len(taken) == stop:
            raise RuntimeError("executor pool gone")
        return after(self, values, gradient)

    steps = {1: 6, None: 1}.get(settings.batch_bags if settings.n_batches is None else 4, 4)
    stop = 2 * steps + max(1, steps // 2)  # within the third epoch
    monkeypatch.setattr(training.Adam, "step", failing)
    with pytest.raises(RuntimeError):
        train_attention(rows, labels, kept)
    monkeypatch.setattr(training.Adam, "step", after)
    again = train_attention(rows, labels, kept)
    np.testing.assert_allclose(again.model.flat(), whole.model.flat(), rtol=1e-9, atol=1e-12)
    score = lambda t: {(r.epoch, r.bag_id): r.p for r in t.scores.collect()}
    assert score(again) == pytest.approx(score(whole)) and again.scores.count() == 18
    # A finished run is read back; a longer one goes on from its end; another one is refused.
    assert score(train_attention(rows, labels, kept)) == score(again)
    assert train_attention(rows, labels, replace(kept, epochs=4)).scores.count() == 24
    with pytest.raises(ValueError, match="other models or settings"):
        train_attention(rows, labels, replace(kept, lr=0.5))


def scanned_rows(df) -> int:
    """Rows that came out of the file scans of an executed frame."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    plans = [leaves.apply(i) for i in range(leaves.size())]
    return sum(p.metrics().get("numOutputRows").get().value() for p in plans)


def test_batches_read_their_bags_in_place(spark, tmp_path, monkeypatch):
    """Ten epochs of random batches write no rows, and a batch reads the pages of its bags only."""
    n, each = 20, 30_000
    rows = spark.range(n * each).select(
        (F.col("id") % n).alias("bag_id"), F.array(F.rand(1), F.rand(2)).alias("features"), F.lit(1).alias("label"), F.lit(NO_FOLD).alias("fold")
    )
    stored = training._bucketed(rows, str(tmp_path / "rows"), 2)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        bags = spark.range(n).select(F.col("id").alias("bag_id"), (F.col("id") % 2).cast("int").alias("label")).cache()
        monkeypatch.setattr(training, "PRUNED_BAGS", 3)
        written = []
        monkeypatch.setattr(training, "write_bucketed", lambda *a, **k: written.append(a))
        for epoch in range(1, 11):
            seen = []
            for batch in training._batches(stored, bags, 2, epoch, TrainSettings(n_batches=5)):
                found = batch.select("bag_id")
                ids = [r.bag_id for r in found.collect()]
                seen += ids
                if epoch == 1:
                    assert len(ids) == 4 * each and scanned_rows(found) < 3 * len(ids)
                else:
                    break
            assert epoch > 1 or sorted(seen) == sorted(i for i in range(n) for _ in range(each))
        assert not written
        plan = batch._jdf.queryExecution().executedPlan().toString()
        assert "Or(" in plan[plan.index("PushedFilters") :]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
