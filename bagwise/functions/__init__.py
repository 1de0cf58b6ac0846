from bagwise.functions.columns import (
    binarise_label,
    clean_numeric,
    extract_sample_id,
    fragment_length,
    label_key,
    md5_fraction,
    normalise_bin,
    sample_from_path,
    threshold,
)
from bagwise.functions.losses import bce_loss, bce_slope, focal_loss, focal_slope, nll, sigmoid

__all__ = [
    "bce_loss",
    "bce_slope",
    "binarise_label",
    "clean_numeric",
    "extract_sample_id",
    "focal_loss",
    "focal_slope",
    "fragment_length",
    "label_key",
    "md5_fraction",
    "nll",
    "normalise_bin",
    "sample_from_path",
    "sigmoid",
    "threshold",
]
