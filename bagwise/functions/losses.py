"""Losses of one bag and their slopes with respect to the bag's logit, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the losses.
BCE_LOG_FLOOR = -100.0
NLL_CLAMP = 1e-5
FOCAL_ALPHA = 0.25
FOCAL_GAMMA = 2.0


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def nll(p: Column, label: Column) -> Column:
    """Negative log-likelihood with the probability clamped away from 0 and 1."""
    q = F.greatest(F.least(p, F.lit(1.0 - NLL_CLAMP)), F.lit(NLL_CLAMP))
    return F.when(label == 1, -F.ln(q)).otherwise(-F.ln(F.lit(1.0) - q))


def _log_sigmoid(logit: Column) -> Column:
    """ln of the sigmoid without overflow at either end."""
    return F.least(logit, F.lit(0.0)) - F.log1p(F.exp(-F.abs(logit)))


def _signed(logit: Column, label: Column) -> Column:
    """The logit of the bag's true class."""
    return F.when(label == 1, logit).otherwise(-logit)


def bce_loss(logit: Column, label: Column) -> Column:
    """Binary cross-entropy; its logarithms stop at -100."""
    return -F.greatest(_log_sigmoid(_signed(logit, label)), F.lit(BCE_LOG_FLOOR))


def bce_slope(logit: Column, label: Column) -> Column:
    return sigmoid(logit) - label.cast("double")


def _focal_alpha(label: Column, alpha: float, alpha_mode: str) -> Column:
    if alpha_mode == "constant":
        return F.lit(alpha)
    if alpha_mode == "balanced":
        return F.when(label == 1, F.lit(alpha)).otherwise(F.lit(1.0 - alpha))
    raise ValueError(f"alpha_mode must be 'constant' or 'balanced', not {alpha_mode!r}")


def focal_loss(
    logit: Column,
    label: Column,
    alpha: float = FOCAL_ALPHA,
    gamma: float = FOCAL_GAMMA,
    alpha_mode: str = "constant",
) -> Column:
    """Focal loss: cross-entropy weighted by how far the true class is from certain."""
    z = _signed(logit, label)
    return _focal_alpha(label, alpha, alpha_mode) * F.pow(sigmoid(-z), F.lit(gamma)) * bce_loss(logit, label)


def focal_slope(
    logit: Column,
    label: Column,
    alpha: float = FOCAL_ALPHA,
    gamma: float = FOCAL_GAMMA,
    alpha_mode: str = "constant",
) -> Column:
    z = _signed(logit, label)
    miss = sigmoid(-z)
    towards = F.lit(gamma) * sigmoid(z) * _log_sigmoid(z) - miss
    sign = F.when(label == 1, F.lit(1.0)).otherwise(F.lit(-1.0))
    return _focal_alpha(label, alpha, alpha_mode) * sign * F.pow(miss, F.lit(gamma)) * towards
