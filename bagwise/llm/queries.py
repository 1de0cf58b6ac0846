"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bagwise.llm import (
    archives,
    centroids,
    chat_format,
    exact_dedup,
    line_dedup,
    mixing,
    near_dedup,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    source_audit,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_pii": pii.op4_pii,
    "op5_mixing": mixing.op5_mixing,
    "op6_warc": archives.op6_warc,
    "op7_chat_format": chat_format.op7_chat_format,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_packing": packing.op9_packing,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_centroids": centroids.op12_centroids,
    "op13_source_audit": source_audit.op13_source_audit,
}


def oracles() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_url_filter": url_filter.oracle(),
        "op3_quality_rules": quality_rules.oracle(),
        "op5_mixing": mixing.ORACLE,
        "op6_warc": archives.ORACLE,
        "op7_chat_format": chat_format.ORACLE,
        "op11_line_dedup": line_dedup.ORACLE,
        "op12_centroids": centroids.oracle(),
        "op13_source_audit": source_audit.oracle(),
    }
