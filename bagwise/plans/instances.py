"""From scanned fragments to instances: the signature path and the frequency path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bagwise.functions.columns import fragment_length, label_key, normalise_bin
from bagwise.operators.joins import SIGNATURE_SUFFIXES, join_signatures, signature_columns
from bagwise.operators.prepare import assemble_features, clean_columns
from bagwise.operators.scaling import feature_ranges, packed_ends, scale_packed
from bagwise.plans.lookup import BROADCAST_BYTES, lookup_join, measured_bytes
from bagwise.plans.ordered import join_by
from bagwise.plans.scratch import settle
from bagwise.sources.delimited import extra_columns, number_columns


def signature_features(fragments: DataFrame, tables: dict[str, DataFrame]) -> list[str]:
    """Feature names in order: the file's own numbers, then each table's likelihoods."""
    likelihoods = [f"{c}{SIGNATURE_SUFFIXES[t]}" for t, table in tables.items() for c in signature_columns(table)]
    return [*number_columns(fragments), *likelihoods]


def signature_instances(
    fragments: DataFrame,
    tables: dict[str, DataFrame],
    *,
    scale: bool = False,
    fragment_ids: bool = False,
    budget: int = BROADCAST_BYTES,
) -> DataFrame:
    """Instances with signature likelihoods as features; min-max scaled per bag on request.

    ``tables`` maps ``out5p``, ``in5p`` and ``length_bin`` to their signature tables, in this order.
    An instance has its fragment's id, so that attention joins back to fragments. Where a repeated
    signature key makes several instances of one fragment, the first has it and the others an id of their
    own; ``fragment_ids`` adds the fragment's to each. Scaling reads the rows twice, but joins them to the
    tables once: ranges come from the tokens that each bag holds (:func:`signature_ranges`).
    """
    features = signature_features(fragments, tables)
    rows = fragments.withColumn("length_bin", normalise_bin("length_bin"))
    # Likelihoods are parsed once per table row, not once per fragment; unmatched ones are 0 as well.
    typed = {token: clean_columns(table, signature_columns(table)) for token, table in tables.items()}
    ends = None
    if scale:
        ranges = signature_ranges(rows.withColumnRenamed("sample_name", "bag_id"), typed, number_columns(fragments), budget=budget)
        ends = settle(packed_ends(ranges, features).withColumnRenamed("bag_id", "sample_name"))
    joined = join_signatures(rows, typed, budget=budget, copy="_copy", by_sample=ends)
    own = F.when(F.col("_copy").isNull(), F.col("instance_id")).otherwise(F.xxhash64("instance_id", "_copy"))
    named = {"bag_id": F.col("sample_name"), "instance_id": own, "fragment_id": F.col("instance_id")}
    keys = ["bag_id", "instance_id", *(["fragment_id"] if fragment_ids else [])]
    held = [*features, *(["_low", "_span"] if scale else [])]
    cleaned = clean_columns(joined.select(*[named[k].alias(k) for k in keys], *[F.col(f"`{c}`") for c in held]), features)
    if scale:
        cleaned = scale_packed(cleaned, features)
    return assemble_features(cleaned, features, keys)


def signature_ranges(rows: DataFrame, tables: dict[str, DataFrame], own: list[str], *, budget: int = BROADCAST_BYTES) -> DataFrame:
    """``bag_id, <feature>_min, <feature>_max`` of every feature, from one scan that counts tokens.

    A bag's likelihoods are those of the tokens it holds, 0 for a token without one; the ends of the
    file's own numbers are kept per token and merged.
    """
    tokens = list(tables)
    numbers = clean_columns(rows.select("bag_id", *tokens, *[F.col(f"`{c}`") for c in own]), own)
    pairs = F.array(*[F.struct(F.lit(t).alias("_kind"), F.col(t).alias("_token")) for t in tokens])
    ends = [f(F.col(f"`{c}`")).alias(f"{c}_{n}") for c in own for n, f in (("min", F.min), ("max", F.max))]
    held = numbers.select("bag_id", *[F.col(f"`{c}`") for c in own], F.inline(pairs))
    counts = settle(held.groupBy("bag_id", "_kind", "_token").agg(F.count(F.lit(1)).alias("_n"), *ends))
    merged = [f(F.col(f"`{c}_{n}`")).alias(f"{c}_{n}") for c in own for n, f in (("min", F.min), ("max", F.max))]
    out = counts.groupBy("bag_id").agg(F.count(F.lit(1)).alias("_n"), *merged).drop("_n")
    for t in tokens:
        of = counts.where(F.col("_kind") == t).select(F.col("bag_id").alias("sample_name"), F.col("_token").alias(t))
        met = join_signatures(of, {t: tables[t]}, budget=budget, warn_duplicates=False)
        names = [f"{c}{SIGNATURE_SUFFIXES[t]}" for c in signature_columns(tables[t])]
        likelihoods = clean_columns(met, names).withColumnRenamed("sample_name", "bag_id")
        out = join_by(out, feature_ranges(likelihoods, names), ["bag_id"])
    return out


# The features of the frequency path that are scaled, behind the file's own numbers.
FREQUENCY_TOKENS = ("out5p", "in5p")
FREQUENCY_SCALED = ("fragment_length", "out5p_freq", "in5p_freq")


def frequency_features(fragments: DataFrame) -> list[str]:
    """Feature names in order: GC content, columns past the tenth, then length and frequencies."""
    return ["gc_content", *extra_columns(fragments), *FREQUENCY_SCALED]


def _token_counts(rows: DataFrame) -> DataFrame:
    """Rows per bag, token column and token, with the ends of their fragment lengths, from one scan."""
    pairs = F.array(*[F.struct(F.lit(t).alias("kind"), F.col(t).alias("token")) for t in FREQUENCY_TOKENS])
    length = F.col("fragment_length")
    return rows.select("bag_id", "fragment_length", F.inline(pairs)).groupBy("bag_id", "kind", "token").agg(
        F.count(F.lit(1)).alias("freq"), F.min(length).alias("low"), F.max(length).alias("high")
    )


def _scaled(value: Column, low: Column, high: Column) -> Column:
    """To [0, 1]; a value that is the same all over its bag becomes 0."""
    return F.when(low != high, (value - low) / (high - low)).otherwise(value * 0.0)


def frequency_instances(fragments: DataFrame, *, budget: int = BROADCAST_BYTES) -> DataFrame:
    """Instances with fragment length and token frequencies, scaled per bag, as features.

    The rows are read twice: once to count tokens, and once to look the counts up. All ranges come from
    the counts: a bag's frequencies are those of its tokens, and lengths keep their ends per token. Ranges
    are taken over the cells that are there; only then do missing ones become 0.
    """
    features = frequency_features(fragments)
    rows = fragments.select(
        F.col("sample_name").alias("bag_id"),
        "instance_id",
        *[F.col(f"`{c}`") for c in features[: -len(FREQUENCY_SCALED)]],
        fragment_length("frag_start", "frag_end").cast("double").alias("fragment_length"),
        *FREQUENCY_TOKENS,
    )
    counts = settle(_token_counts(rows))
    known = F.col("token").isNotNull()
    ends = [f(F.when(known & (F.col("kind") == t), F.col("freq"))).alias(f"_{t}_{n}") for t in FREQUENCY_TOKENS for n, f in (("low", F.min), ("high", F.max))]
    ranges = settle(counts.groupBy("bag_id").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), *ends))
    size = measured_bytes(counts)  # of both token columns: no less than either
    out = rows
    for t in FREQUENCY_TOKENS:
        one = counts.where(known & (F.col("kind") == t)).join(ranges, "bag_id")
        scaled = _scaled(F.col("freq").cast("double"), F.col(f"_{t}_low"), F.col(f"_{t}_high")).alias(f"{t}_freq")
        keyed = one.select("bag_id", F.col("token").alias(t), scaled)
        out = lookup_join(out, keyed, ["bag_id", t], "left", budget=budget, table_bytes=size)
    out = lookup_join(out, ranges.select("bag_id", "_low", "_high"), ["bag_id"], "left", budget=budget)
    out = out.withColumn("fragment_length", _scaled(F.col("fragment_length"), F.col("_low"), F.col("_high")))
    return assemble_features(clean_columns(out, features), features)


def bags_of(manifest: DataFrame) -> DataFrame:
    """``bag_id, split, label_key`` of a manifest's samples; several files of one sample are one bag."""
    named = manifest.select(F.col("sample_name").alias("bag_id"), "split", label_key("sample_name").alias("label_key"))
    return named.distinct()
