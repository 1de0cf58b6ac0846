"""Plain restatements of the scorers, one bag at a time, to check the distributed ones against."""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

INSTANCES = T.StructType(
    [
        T.StructField("bag_id", T.StringType()),
        T.StructField("instance_id", T.LongType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
    ]
)


def random_bags(sizes: dict[str, int], dim: int, seed: int = 0, scale: float = 1.0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {bag: rng.normal(size=(n, dim)) * scale for bag, n in sizes.items()}


def instances(spark, bags: dict[str, np.ndarray]):
    rows = [(bag, i, [float(v) for v in row]) for bag, x in bags.items() for i, row in enumerate(x)]
    return spark.createDataFrame(rows, INSTANCES)


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=0))
    return e / e.sum(axis=0)


def forward(model, x: np.ndarray):
    """Probability, attention and pooled embedding of one bag."""
    h = np.maximum(x @ model.embed_w.T + model.embed_b, 0)
    s = np.tanh(h @ model.att_v.T + model.att_c) @ model.att_w + model.att_b[0]
    a = softmax(s)
    pooled = a @ h
    return 1 / (1 + np.exp(-(pooled @ model.cls_w + model.cls_b[0]))), a, pooled


def gated_forward(model, x: np.ndarray):
    h = np.maximum(x @ model.embed_w.T + model.embed_b, 0)
    gate = 1 / (1 + np.exp(-(h @ model.gate_u.T + model.gate_c)))
    a = softmax((np.tanh(h @ model.att_v.T + model.att_c) * gate) @ model.att_w.T + model.att_b)
    pooled = (a * h).sum(axis=0)
    return 1 / (1 + np.exp(-(pooled @ model.cls_w + model.cls_b[0]))), a, pooled


def auc(labels, scores) -> float:
    pairs = [(p > q) + 0.5 * (p == q) for p, y in zip(scores, labels) if y for q, z in zip(scores, labels) if not z]
    return float(np.mean(pairs))
