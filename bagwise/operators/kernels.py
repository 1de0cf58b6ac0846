"""Array arithmetic of one Arrow batch. Spark decides which rows meet here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_ROWS = 1024


def feature_matrix(column: pa.Array) -> np.ndarray:
    """List column to a dense (rows, D) matrix; uneven rows, nulls and NaN are errors."""
    rows = len(column)
    flat = column.flatten()
    if column.null_count or flat.null_count or (rows and np.ptp(np.diff(column.offsets.to_numpy()))):
        raise ValueError("features must be arrays of equal width without nulls")
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if np.isnan(values).any():
        raise ValueError("features must not be NaN")
    return values.reshape(rows, len(flat) // rows if rows else 0)


def slices(rows: int):
    """Row ranges whose activations stay in a core's cache."""
    return (slice(at, at + SLICE_ROWS) for at in range(0, rows, SLICE_ROWS))


def embed(model, x: np.ndarray) -> np.ndarray:
    if x.shape[1] != model.dim:
        raise ValueError(f"the model takes {model.dim} features, not {x.shape[1]}")
    hidden = x.astype(model.embed_w.dtype, copy=False) @ model.embed_w.T
    hidden += model.embed_b
    return np.maximum(hidden, 0.0, out=hidden)


def attention(model, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner activation and attention logit of each row."""
    t = hidden @ model.att_v.T
    t += model.att_c
    np.tanh(t, out=t)
    return t, t @ model.att_w + model.att_b[0]


def unit_logits(model, hidden: np.ndarray) -> np.ndarray:
    """Classifier output of each row; the bag's logit is its mean under attention."""
    return hidden @ model.cls_w + model.cls_b[0]


def row_scores(model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attention logit and classifier output of each row."""
    s, unit = np.empty(len(x)), np.empty(len(x))
    for at in slices(len(x)):
        hidden = embed(model, x[at])
        s[at], unit[at] = attention(model, hidden)[1], unit_logits(model, hidden)
    return s, unit


def gated_branches(model, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner activation and gate of each row."""
    gate = hidden @ model.gate_u.T
    gate += model.gate_c
    np.negative(gate, out=gate)
    np.exp(gate, out=gate)
    gate += 1.0
    np.reciprocal(gate, out=gate)
    t = hidden @ model.att_v.T
    t += model.att_c
    return np.tanh(t, out=t), gate


def gated_attention(model, hidden: np.ndarray) -> np.ndarray:
    """Attention logits per row and hidden unit."""
    logits = np.empty_like(hidden)
    for at in slices(len(hidden)):
        t, gate = gated_branches(model, hidden[at])
        t *= gate
        logits[at] = t @ model.att_w.T + model.att_b
    return logits


def gated_gradient(model, x, ends, pooled, slope) -> np.ndarray:
    """Like :func:`pooled_gradient` for a softmax per hidden unit.

    Of each row's bag: ``ends``, the logarithm of every unit's summed exponentials, the pooled
    embedding, and the loss slope.
    """
    kind, total = model.embed_w.dtype, 0.0
    for at in slices(len(x)):
        hidden = embed(model, x[at])
        t, gate = gated_branches(model, hidden)
        inner = t * gate
        share = np.exp(inner @ model.att_w.T + model.att_b - ends[at])
        share = (share * slope[at][:, None]).astype(kind, copy=False)
        direct = share * model.cls_w
        d_logit = (direct * (hidden - pooled[at])).astype(kind, copy=False)
        d_inner = d_logit @ model.att_w
        d_gate = d_inner * inner * (1.0 - gate)
        d_t = d_inner * gate * (1.0 - t * t)
        d_hidden = (direct + d_t @ model.att_v + d_gate @ model.gate_u) * (hidden > 0.0)
        total = total + np.concatenate(
            [
                (d_hidden.T @ x[at].astype(kind, copy=False)).ravel(),
                d_hidden.sum(axis=0),
                (d_t.T @ hidden).ravel(),
                d_t.sum(axis=0),
                (d_logit.T @ inner).ravel(),
                d_logit.sum(axis=0),
                (share * hidden).sum(axis=0),
                [share[:, 0].sum()],
                (d_gate.T @ hidden).ravel(),
                d_gate.sum(axis=0),
            ],
            dtype=np.float64,
        )
    return total


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts equal codes together, the start of each run, and the code of each run."""
    order = np.argsort(codes, kind="stable")
    ordered = codes[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return order, starts, ordered[starts]


def softmax_partials(codes, logits, masses, values):
    """Fold rows with equal codes into (code, top, mass, mean).

    Each row stands for a softmax mass relative to its own logit, with the mean of ``values`` under
    it. The result is of the same kind, so it can be folded again.
    """
    order, starts, keys = grouped(codes)
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(codes)]))
    logits, masses, values = logits[order], masses[order], values[order]
    top = np.maximum.reduceat(logits, starts, axis=0)
    weight = masses * np.exp(logits - top[run])
    mass = np.add.reduceat(weight, starts, axis=0)
    if values.ndim > weight.ndim:
        weight, total = weight[:, None], mass[:, None]
    else:
        total = mass
    mean = np.add.reduceat(weight * values, starts, axis=0) / total
    return keys, top, mass, mean


def backprop(model, x, hidden, t, share, d_logit) -> np.ndarray:
    """Flat parameter gradient, given each row's part in the bag's logit and slope of its attention logit."""
    kind = model.embed_w.dtype
    share, d_logit = share.astype(kind, copy=False), d_logit.astype(kind, copy=False)
    d_inner = t * t
    np.subtract(1.0, d_inner, out=d_inner)
    d_inner *= model.att_w
    d_inner *= d_logit[:, None]
    d_hidden = d_inner @ model.att_v
    d_hidden += share[:, None] * model.cls_w
    d_hidden *= hidden > 0.0
    return np.concatenate(
        [
            (d_hidden.T @ x.astype(kind, copy=False)).ravel(),
            d_hidden.sum(axis=0),
            (d_inner.T @ hidden).ravel(),
            d_inner.sum(axis=0),
            d_logit @ t,
            [d_logit.sum()],
            share @ hidden,
            [share.sum()],
        ],
        dtype=np.float64,
    )


def pooled_gradient(model, x, top, mass, logit, slope) -> np.ndarray:
    """Gradient of the rows' summed bag losses, given each row's bag: its softmax sums, logit and loss slope."""
    total = 0.0
    for at in slices(len(x)):
        hidden = embed(model, x[at])
        t, s = attention(model, hidden)
        share = slope[at] * np.exp(s - top[at]) / mass[at]
        total = total + backprop(model, x[at], hidden, t, share, share * (unit_logits(model, hidden) - logit[at]))
    return total


def logit_bound(model) -> float:
    """No attention logit is larger: the inner activation stays within ±1, gated or not."""
    return float(np.max(np.abs(model.att_w).sum(axis=-1) + np.abs(model.att_b)))


def bag_moments(model, x) -> np.ndarray:
    """Sums over one bag's rows from which its logit and the logit's gradient follow.

    Attention mass, classifier output under it, and two gradients. All are relative to
    :func:`logit_bound`, so sums of different tasks add up as they are.
    """
    total = 0.0
    for at in slices(len(x)):
        hidden = embed(model, x[at])
        t, s = attention(model, hidden)
        e = np.exp(s.astype(np.float64) - logit_bound(model))
        unit = unit_logits(model, hidden)
        full = backprop(model, x[at], hidden, t, e, e * unit)
        focus = backprop(model, x[at], hidden, t, np.zeros_like(e), e)
        total = total + np.concatenate([[e.sum(), e @ unit], full, focus])
    return total


def logit_gradient(moments: np.ndarray) -> np.ndarray:
    """Gradient of a bag's logit from the bag's added-up moments."""
    logit = moments[1] / moments[0]
    full, focus = np.split(moments[2:] / moments[0], 2)
    return full - logit * focus
