"""Left joins to signature, frequency and label tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bagwise.functions.columns import extract_sample_id
from bagwise.operators.prepare import suffix_columns
from bagwise.plans.lookup import BROADCAST_BYTES, lookup_join, measured_bytes, row_bytes, salted_lookups
from bagwise.plans.scratch import settle

# Which fragment column each signature table explains, in feature order.
SIGNATURE_SUFFIXES = {"out5p": "_out", "in5p": "_in", "length_bin": "_len"}


def signature_columns(table: DataFrame) -> list[str]:
    """Likelihood columns of a signature table: all but its keys."""
    return [c for c in table.columns if c not in ("Sample", "Motif", "ID")]


def duplicate_signatures(table: DataFrame) -> DataFrame:
    """Keys that occur more than once; each one multiplies the instances it matches."""
    sample = extract_sample_id("Sample").alias("sample_name")
    return table.groupBy(sample, "Motif").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def join_signatures(
    rows: DataFrame,
    tables: dict[str, DataFrame],
    *,
    sample: str = "sample_name",
    suffixes: dict[str, str] = SIGNATURE_SUFFIXES,
    budget: int = BROADCAST_BYTES,
    warn_duplicates: bool = True,
    copy: str | None = None,
    by_sample: DataFrame | None = None,
) -> DataFrame:
    """Left-join one signature table per token column on (token, sample).

    ``tables`` maps a token column to its table (``Sample``, ``Motif``, likelihoods). Likelihood
    columns get the token's suffix. Repeated keys multiply rows, with a warning. ``copy`` names a column
    that tells the rows apart which came from one: null for an only one, else a hash of which rows of the
    tables it met. ``by_sample`` is a further table, with one row for each sample, joined along.

    Tables beyond the budget come first: hot samples are counted in the rows as they were given.
    """
    keyed, copies = {}, []
    for token, table in tables.items():
        names = signature_columns(table)
        wide = suffix_columns(table.select(*[F.col(f"`{c}`") for c in names], "Motif", "Sample"), suffixes[token])
        keyed[token] = wide.select(
            extract_sample_id(f"Sample{suffixes[token]}").alias(sample),
            F.col(f"Motif{suffixes[token]}").alias(token),
            *[F.col(f"`{c}{suffixes[token]}`") for c in names],
        )
    small, large = [], []
    for token, size, most in _table_facts(keyed, sample):
        if copy and most > 1:
            # Equal rows of a key get different numbers; which one gets which does not matter.
            copies.append(f"_nth{suffixes[token]}")
            order = Window.partitionBy(sample, token).orderBy(*[F.col(f"`{c}`") for c in keyed[token].columns])
            keyed[token] = keyed[token].withColumn(copies[-1], F.row_number().over(order))
        if warn_duplicates and most > 1:
            warnings.warn(f"signature table for {token} repeats keys: matching rows multiply", stacklevel=2)
        (small if size <= budget else large).append((keyed[token], [token, sample], size))
    if by_sample is not None:
        size = measured_bytes(by_sample)
        (small if size <= budget else large).append((by_sample, [sample], size))
    out = rows
    if large:
        # Every table is keyed by the sample too: the rows move by sample.
        out = salted_lookups(out, [(table, on) for table, on, _ in large], [sample])
    for table, on, size in small:
        out = lookup_join(out, table, on, "left", budget=budget, table_bytes=size)
    order = [f"{c}{suffixes[t]}" for t, table in tables.items() for c in signature_columns(table)]
    order += [c for c in (by_sample.columns if by_sample is not None else []) if c != sample]
    told = []
    if copy:
        nth = [F.coalesce(F.col(c), F.lit(1)) for c in copies]
        only = F.greatest(F.lit(1), F.lit(1), *nth) == 1
        told = [F.when(~only, F.xxhash64(*nth)).alias(copy) if nth else F.lit(None).cast("long").alias(copy)]
    return out.select(*[F.col(f"`{c}`") for c in [*rows.columns, *order]], *told)


def _table_facts(keyed: dict[str, DataFrame], sample: str) -> list[tuple[str, int, int]]:
    """Size and largest key count of every table, all in one job, in the tables' order."""
    facts = []
    for nth, (token, table) in enumerate(keyed.items()):
        per_key = table.groupBy(sample, token).agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(table)).alias("size"))
        whole = per_key.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
        facts.append(whole.select(F.lit(nth).alias("nth"), F.lit(token).alias("token"), "size", "most"))
    return [(r.token, r["size"], r.most) for r in sorted(reduce(DataFrame.union, facts).collect())]


def token_frequencies(rows: DataFrame, tokens: Sequence[str], bag: str = "bag_id") -> DataFrame:
    """Rows per (bag, token) for several token columns, from one scan with map-side counting."""
    pairs = F.array(*[F.struct(F.lit(t).alias("kind"), F.col(t).cast("string").alias("token")) for t in tokens])
    return rows.select(bag, F.inline(pairs)).groupBy(bag, "kind", "token").agg(F.count(F.lit(1)).alias("freq"))


def frequency_encode(
    rows: DataFrame, tokens: Sequence[str], bag: str = "bag_id", *, budget: int = BROADCAST_BYTES
) -> DataFrame:
    """Add ``<token>_freq``, the number of rows of the bag with the same token.

    A null token has no frequency: its cell stays null until :func:`clean_columns` makes it 0. The rows
    are read twice: a job counts when called.
    """
    counts = settle(token_frequencies(rows, tokens, bag))
    size = measured_bytes(counts)  # of all tokens together: no less than any one of them
    out = rows
    for token in tokens:
        one = counts.where((F.col("kind") == token) & F.col("token").isNotNull())
        keyed = one.select(bag, F.col("token").cast(rows.schema[token].dataType).alias(token), F.col("freq").alias(f"{token}_freq"))
        out = lookup_join(out, keyed, [bag, token], "left", budget=budget, table_bytes=size)
    return out


def last_labels(labels: DataFrame) -> DataFrame:
    """One label per key; of a repeated key the last row (by ``row_no``) counts."""
    return labels.groupBy("label_key").agg(F.max_by("label", "row_no").alias("label"))


def attach_labels(
    bags: DataFrame, labels: DataFrame, *, key: str = "label_key", on_missing: str = "default", default: int = 1
) -> DataFrame:
    """Left-join labels; a bag without one gets ``default`` and says so in ``label_source``."""
    known = last_labels(labels).withColumnRenamed("label_key", key)
    joined = lookup_join(bags, known, [key], "left")
    found = F.col("label").isNotNull()
    if on_missing == "error":
        message = F.concat(F.lit("no label for "), F.coalesce(F.col(key).cast("string"), F.lit("a null key")))
        label = F.when(found, F.col("label")).otherwise(F.raise_error(message).cast("int"))
    elif on_missing == "default":
        label = F.coalesce(F.col("label"), F.lit(default))
    else:
        raise ValueError("on_missing must be 'default' or 'error'")
    return joined.withColumns({"label": label, "label_source": F.when(found, "table").otherwise("default")})
