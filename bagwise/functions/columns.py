"""Scalar column expressions used while preparing instances. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They define which rows get which label or sample.
SAMPLE_ID_PATTERN = r"filtered_(.*?raw)"
SAMPLE_SUFFIX = "raw"
NEGATIVE_TISSUE = "Healthy"
WHITESPACE = " \t\r\n\f\v"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_bin(c: Column | str) -> Column:
    """Length-bin text with every ``-`` written as ``_``, as the signature tables spell it."""
    return F.replace(_col(c), F.lit("-"), F.lit("_"))


def extract_sample_id(c: Column | str) -> Column:
    """Sample id inside a signature table's ``Sample`` text; ``''`` where there is none."""
    return F.regexp_extract(_col(c), SAMPLE_ID_PATTERN, 1)


def sample_from_path(path: Column | str, *, part_folders: bool = True) -> Column:
    """Base name of a path up to its first ``_``.

    A sample may also be a folder of Spark part files; then the folder name counts. Without
    ``part_folders`` a file named like a part file is a sample of its own.
    """
    whole = F.regexp_replace(_col(path), r"/part-[^/]*$", "") if part_folders else _col(path)
    return F.split_part(F.element_at(F.split(whole, "/"), -1), F.lit("_"), F.lit(1))


def plain_path(uri: Column | str) -> Column:
    """A scan's file path as it was given: scans report it with escapes, in which ``+`` stands for itself."""
    plain = F.url_decode(F.replace(_col(uri), F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(_col(uri), F.lit("%")), plain).otherwise(_col(uri))


def label_key(sample: Column | str) -> Column:
    """Key into the label table: the sample name without any ``raw``."""
    return F.replace(_col(sample), F.lit(SAMPLE_SUFFIX), F.lit(""))


def binarise_label(tissue: Column | str) -> Column:
    """0 for exactly ``Healthy``, 1 for anything else, a missing value included."""
    return F.when(_col(tissue) == NEGATIVE_TISSUE, 0).otherwise(1)


def _cell(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c).cast("string")), F.lit(""))


def _finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != float("inf"))


def clean_numeric(c: Column | str) -> Column:
    """Text cell to double; null, blank and malformed cells become 0, and so do NaN and infinities."""
    value = _cell(c).try_cast("double")
    return F.when(_finite(value), value).otherwise(0.0)


def clean_position(c: Column | str) -> Column:
    """Text cell to a whole number; null where it holds none."""
    return _cell(c).try_cast("long")


# What can be wrong with a cell that holds text.
FAULTS = ("malformed", "nan", "infinite")


def cell_fault(c: Column | str, *, whole: bool = False) -> Column:
    """Which of :data:`FAULTS` a text cell has; null for a readable, blank or missing one.

    A ``whole`` cell must hold an integer; another one may hold any finite number.
    """
    text = _cell(c)
    if whole:
        return F.when(text.isNotNull() & text.try_cast("long").isNull(), "malformed")
    value = text.try_cast("double")
    return (
        F.when(text.isNotNull() & value.isNull(), "malformed")
        .when(F.isnan(value), "nan")
        .when(F.abs(value) == float("inf"), "infinite")
    )


def is_malformed(c: Column | str) -> Column:
    """True where a cell holds text that :func:`clean_numeric` had to replace."""
    return cell_fault(c).isNotNull()


def fragment_length(start: Column | str, end: Column | str) -> Column:
    return _col(end) - _col(start)


def threshold(probability: Column | str, at: float = 0.5) -> Column:
    """Predicted label: 1 from the threshold upwards."""
    return (_col(probability) >= F.lit(at)).cast("int")


def md5_of(*parts: Column) -> Column:
    """Digest of the parts written as text and joined by ``|``."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def md5_fraction(seed: int, key: Column | str) -> Column:
    """Uniform number in [0, 1) that depends only on the seed and the key's text."""
    head = F.substring(md5_of(F.lit(seed), _col(key)), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**8))
