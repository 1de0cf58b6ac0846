"""The benchmark tables seen as bags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.operators.model import AttentionModel, GatedAttentionModel
from bagwise.plans.scratch import scratch_path, settle
from bagwise.sources.parts import write_parts

# Parameters of the scorers that the SQL restates.
EVENT_MODEL = AttentionModel.of(
    embed_w=[[0.8, -0.5], [-0.3, 0.9]],
    embed_b=[0.1, -0.2],
    att_v=[[0.6, -0.4], [0.5, 0.7]],
    att_c=[0.05, -0.1],
    att_w=[1.2, -0.8],
    att_b=[0.3],
    cls_w=[1.5, -1.1],
    cls_b=[-0.4],
)
EVENT_GATED_MODEL = GatedAttentionModel.of(
    **{
        **EVENT_MODEL.arrays(),
        "att_w": [[1.2, -0.8], [0.4, 0.9]],
        "att_b": [0.3, -0.2],
        "gate_u": [[0.3, 0.5], [-0.6, 0.2]],
        "gate_c": [0.1, 0.0],
    }
)
EMBEDDING_DIM = 64
EMBEDDING_MODEL = AttentionModel.of(
    **{
        **EVENT_MODEL.arrays(),
        "embed_w": [[((7 * d + 3 * j) % 11 - 5) / 20 for d in range(EMBEDDING_DIM)] for j in range(2)],
    }
)
#: Over the eight features of the signature path.
LINE_MODEL = AttentionModel.of(
    **{**EVENT_MODEL.arrays(), "embed_w": [[((5 * d + 3 * j) % 7 - 3) / 10 for d in range(8)] for j in range(2)]}
)
#: Columns of a fragment row that a signature table explains.
TOKENS = ("out5p", "in5p", "length_bin")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_features() -> Column:
    k = F.get_json_object("props", "$.k").cast("double")
    return F.array(F.col("value") / 100, k / 100)


def event_instances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("user_id").alias("bag_id"), F.col("event_id").alias("instance_id"), event_features().alias("features")
    )


def event_bags(spark: SparkSession, folder: str) -> DataFrame:
    """A bag is positive if it holds a purchase above 150: at least one positive instance."""
    positive = (F.col("event_type") == "purchase") & (F.col("value") > 150)
    return table(spark, folder, "events").groupBy(F.col("user_id").alias("bag_id")).agg(
        F.max(positive.cast("int")).alias("label")
    )


def nation_instances(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as instances; nations are bags, 25 of them at every size of the tables."""
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("bag_id"),
        F.col("c_custkey").alias("instance_id"),
        F.array(F.col("c_acctbal") / 10000, F.col("c_custkey") % 100 / 100).alias("features"),
    )


def nation_bags(spark: SparkSession, folder: str) -> DataFrame:
    ends = F.max("c_acctbal") + F.min("c_acctbal")
    return table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("bag_id")).agg((ends > 9000).cast("int").alias("label"))


def embedding_instances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.concat_ws("-", F.lit("group"), "label").alias("bag_id"),
        F.col("vec_id").alias("instance_id"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def length_bin(value: Column) -> Column:
    low = (F.floor(value / 10) * 10).cast("int")
    return F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"))


def sample_of_supplier() -> Column:
    return F.concat(F.lit("S"), F.col("l_suppkey"), F.lit("raw"))


def line_fragments(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """Order lines in the shape of fragment rows; the supplier is the sample.

    ``wide`` rows have all ten columns and an eleventh, and cells here and there that cannot be read.
    """
    rows = table(spark, folder, "lineitem").select(
        sample_of_supplier().alias("sample_name"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("chromosome"),
        F.unix_date(F.lit("1992-01-01").cast("date")).cast("long").alias("frag_start"),
        F.unix_date(F.col("l_shipdate").cast("date")).cast("long").alias("frag_end"),
        length_bin(F.col("l_quantity")).alias("length_bin"),
        F.col("l_returnflag").alias("out5p"),
        F.col("l_linestatus").alias("in5p"),
        F.col("l_discount").cast("string").alias("gc_content"),
        F.col("l_tax").cast("string").alias("gc_weight"),
        *([F.col(c) for c in ("l_orderkey", "l_linenumber", "l_quantity")] if wide else []),
    )
    if not wide:
        return rows
    seventh = F.col("l_orderkey") % 7
    spoilt = {
        "frag_end": F.when(seventh == 0, "1e3").when(seventh == 1, "").otherwise(F.col("frag_end").cast("string")),
        "gc_content": F.when(seventh == 2, "NaN").when(seventh == 3, " ").otherwise(F.col("gc_content")),
        "gc_weight": F.when(seventh == 4, "-Infinity").when(seventh == 5, "x").otherwise(F.concat(F.lit(" "), "gc_weight")),
    }
    full = {"is_shifted": F.lit("0"), "cnv_weight": F.col("l_linenumber").cast("string"), "further": F.col("l_quantity").cast("string")}
    return rows.withColumns({**spoilt, **full}).drop("l_orderkey", "l_linenumber", "l_quantity")


def line_signatures(fragments: DataFrame, token: str) -> DataFrame:
    """Log-likelihood of each token in each sample, for the tokens of at least average share.

    Rarer tokens are left out, so the join has misses. Shaped like a signature file: text columns.
    """
    motif = F.replace(F.col(token), F.lit("-"), F.lit("_")).alias("Motif")
    return _signatures(fragments.groupBy("sample_name", motif).agg(F.count(F.lit(1)).alias("n")))


def _signatures(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("sample_name").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    llh = F.ln((F.col("n") + 1) / (F.col("total") + F.col("kinds")))
    return (
        counts.join(totals, "sample_name")
        .where(F.col("n") * F.col("kinds") >= F.col("total"))
        .select(
            F.concat(F.lit("cohort_filtered_"), F.col("sample_name"), F.lit("_v7")).alias("Sample"),
            "Motif",
            llh.cast("string").alias("llh"),
            F.ln(F.col("n") / F.col("total")).cast("string").alias("plain"),
        )
    )


def signatures_by_token(fragments: DataFrame) -> dict[str, DataFrame]:
    """:func:`line_signatures` of every token column, from one scan that counts them all."""
    pairs = F.array(*[F.struct(F.lit(t).alias("kind"), F.replace(F.col(t), F.lit("-"), F.lit("_")).alias("Motif")) for t in TOKENS])
    held = fragments.select("sample_name", F.inline(pairs))
    counts = settle(held.groupBy("sample_name", "kind", "Motif").agg(F.count(F.lit(1)).alias("n")))
    return {t: _signatures(counts.where(F.col("kind") == t).drop("kind")) for t in TOKENS}


def line_signature_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    fragments = line_fragments(spark, folder)
    return {t: settle(line_signatures(fragments, t)) for t in TOKENS}


def supplier_labels(spark: SparkSession, folder: str) -> DataFrame:
    """A label file's columns for the suppliers; poorer ones are absent, so some lookups miss."""
    tissue = F.when(F.col("s_acctbal") >= 5000, "Tumour").otherwise("Healthy")
    return table(spark, folder, "supplier").where(F.col("s_acctbal") >= 1000).select(
        F.concat(F.lit("S"), F.col("s_suppkey")).alias("V1"), tissue.alias("Tissue")
    )


# Written rows live under ``file=<name>`` folders; the name is what a manifest would list.
FILE_SUFFIX = "_fragments.bed"


def sample_of_folder(path: Column) -> Column:
    return F.regexp_extract(path, r"file=([^/_]*)", 1)


def write_line_files(spark: SparkSession, folder: str, wide: bool = False, signatures: bool = True) -> dict[str, str]:
    """The order lines as the engine's text inputs, written to the scratch folder.

    Queries that read no signature tables go without ``signatures``.
    """
    root = scratch_path(spark, "line-files")
    fragments = line_fragments(spark, folder, wide)
    paths = {"fragments": f"{root}/fragments", "labels": f"{root}/labels", "manifest": f"{root}/manifest"}
    file = F.concat(F.col("sample_name"), F.lit(FILE_SUFFIX))
    cells = F.struct(*[F.col(c) for c in fragments.columns if c != "sample_name"])
    write_parts(fragments.select(file.alias("file"), F.to_csv(cells, {"sep": "\t"}).alias("line")), paths["fragments"])
    supplier_labels(spark, folder).write.option("header", True).option("sep", "\t").csv(paths["labels"])
    listed = table(spark, folder, "lineitem").select("l_suppkey").distinct()
    line = F.concat(F.lit(f"  {paths['fragments']}/file="), sample_of_supplier(), F.lit(f"{FILE_SUFFIX} "))
    listed.select(line.alias("value")).write.text(paths["manifest"])
    if signatures:
        for token, counted in signatures_by_token(fragments).items():
            paths[token] = f"{root}/signatures-{token}"
            counted.write.option("header", True).csv(paths[token])
    return paths
