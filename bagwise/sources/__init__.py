from bagwise.sources.delimited import (
    read_fragment_cells,
    read_fragments,
    read_labels,
    read_manifest,
    read_signatures,
    with_row_ids,
)
from bagwise.sources.store import load_model, read_bag, read_bags, save_model, store_buckets, sweep_bags, write_bags, write_run

__all__ = [
    "load_model",
    "read_bag",
    "read_bags",
    "read_fragment_cells",
    "read_fragments",
    "read_labels",
    "read_manifest",
    "read_signatures",
    "save_model",
    "store_buckets",
    "sweep_bags",
    "with_row_ids",
    "write_bags",
    "write_run",
]
