import math

import pytest
from pyspark.sql import functions as F

from bagwise.functions import (
    bce_loss,
    bce_slope,
    binarise_label,
    clean_numeric,
    extract_sample_id,
    focal_loss,
    focal_slope,
    label_key,
    nll,
    normalise_bin,
    sample_from_path,
    threshold,
)


def values(spark, cells, kind, expr):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cells], f"c {kind}").select(expr(F.col("c"))).collect()]


def test_text_columns(spark):
    assert values(spark, ["160-169", "1-2-3", "x", None], "string", normalise_bin) == ["160_169", "1_2_3", "x", None]
    names = ["a_filtered_S1raw_b_raw", "filtered_raw", "no match", None]
    assert values(spark, names, "string", extract_sample_id) == ["S1raw", "raw", "", None]
    paths = ["file:///d/S1raw_all_x.bed", "S2raw.bed", "/d/S3raw_y.bed/part-00000-ab.csv", "/d_e/S4"]
    assert values(spark, paths, "string", sample_from_path) == ["S1raw", "S2raw.bed", "S3raw", "S4"]
    assert values(spark, ["rawS1raw", "S2"], "string", label_key) == ["S1", "S2"]


def test_clean_numeric(spark):
    cells = ["0.12", " 3 ", "", "   ", None, "n/a", "1e3", "-2"]
    assert values(spark, cells, "string", clean_numeric) == [0.12, 3.0, 0.0, 0.0, 0.0, 0.0, 1000.0, -2.0]


def test_labels(spark):
    assert values(spark, ["Healthy", "healthy", "Tumour", "", None], "string", binarise_label) == [0, 1, 1, 1, 1]
    assert values(spark, [0.5, 0.499999, 1.0], "double", threshold) == [1, 0, 1]


def both(spark, logits, f, *options):
    rows = spark.createDataFrame([(z, y) for z in logits for y in (0, 1)], "z double, y int")
    return {(r.z, r.y): r.v for r in rows.select("z", "y", f(F.col("z"), F.col("y"), *options).alias("v")).collect()}


@pytest.mark.parametrize(
    "loss,slope,options",
    [
        (bce_loss, bce_slope, ()),
        (focal_loss, focal_slope, (0.25, 2.0, "constant")),
        (focal_loss, focal_slope, (0.25, 1.5, "balanced")),
    ],
)
def test_slopes_are_derivatives(spark, loss, slope, options):
    step = 1e-6
    logits = [-3.0, -0.4, 0.0, 1.7, 6.0]
    up = both(spark, [z + step for z in logits], loss, *options)
    down = both(spark, [z - step for z in logits], loss, *options)
    for (z, y), v in both(spark, logits, slope, *options).items():
        assert v == pytest.approx((up[z + step, y] - down[z - step, y]) / (2 * step), abs=1e-7)


def test_loss_edges(spark):
    found = both(spark, [-1000.0, 1000.0], bce_loss)
    assert found == {(-1000.0, 0): 0.0, (-1000.0, 1): 100.0, (1000.0, 0): 100.0, (1000.0, 1): 0.0}
    clamped = spark.range(1).select(nll(F.lit(0.0), F.lit(1)), nll(F.lit(1.0), F.lit(1))).first()
    assert clamped[0] == pytest.approx(-math.log(1e-5))
    assert clamped[1] == pytest.approx(-math.log(1 - 1e-5))
    plain = both(spark, [0.7], bce_loss)[0.7, 1]
    p = 1 / (1 + math.exp(-0.7))
    assert both(spark, [0.7], focal_loss)[0.7, 1] == pytest.approx(0.25 * (1 - p) ** 2 * plain)
