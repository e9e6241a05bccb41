"""Queries on the findings snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.snapshot_diff import as_set, snapshot_changes
from sievework.session import read


def finding_content() -> list:
    """The compared columns of a finding; -0.0 equals 0.0."""
    return [
        F.col("severity"),
        F.col("confidence") + F.lit(0.0),
        F.col("layer"),
        F.col("title"),
        F.col("description"),
        as_set(F.col("evidence")),
        F.col("suggestion"),
        F.col("resolved_at"),
        F.when(F.col("llm_false_positive").isNotNull(), F.struct((F.col("llm_false_positive.confidence") + F.lit(0.0)).alias("confidence"), F.col("llm_false_positive.reason").alias("reason"))),
    ]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(read(spark, sf_dir, "findings"), "workspace", "snapshot_no", "fingerprint", finding_content(), "delivered_at", pairs=range(2, 7))


def p6_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes per workspace, snapshot and kind."""
    return p6_found(spark, sf_dir).groupBy("workspace", "snapshot_no", "change_kind").agg(F.count("*").alias("n"))


_P6_SQL = """
WITH r AS (
  SELECT workspace, snapshot_no, fingerprint, severity, confidence, layer, title, description, suggestion, resolved_at,
         llm_false_positive, list_sort(list_distinct(list_transform(evidence, lambda x: to_json(x)::VARCHAR))) AS ev, evidence IS NULL AS ev_null,
         row_number() OVER (PARTITION BY workspace, snapshot_no, fingerprint ORDER BY delivered_at DESC NULLS LAST) AS rn
  FROM findings WHERE snapshot_no BETWEEN 1 AND 6),
l AS (SELECT * FROM r WHERE rn = 1),
d AS (
  SELECT coalesce(a.workspace, b.workspace) AS workspace, coalesce(a.snapshot_no, b.snapshot_no + 1) AS snapshot_no,
         coalesce(a.fingerprint, b.fingerprint) AS fingerprint,
         CASE WHEN b.fingerprint IS NULL THEN 'added' WHEN a.fingerprint IS NULL THEN 'removed'
              WHEN (a.severity, a.confidence, a.layer, a.title, a.description, a.suggestion, a.resolved_at, a.llm_false_positive, a.ev, a.ev_null)
                   IS DISTINCT FROM (b.severity, b.confidence, b.layer, b.title, b.description, b.suggestion, b.resolved_at, b.llm_false_positive, b.ev, b.ev_null)
              THEN 'changed' END AS change_kind
  FROM l a FULL JOIN l b ON a.workspace = b.workspace AND a.fingerprint = b.fingerprint AND a.snapshot_no = b.snapshot_no + 1)
"""

QUERIES = {"p6_found": p6_found, "p6_change_counts": p6_change_counts}
ORACLE = {
    "p6_found": _P6_SQL + "SELECT workspace, snapshot_no::INTEGER AS snapshot_no, fingerprint, change_kind FROM d WHERE change_kind IS NOT NULL AND snapshot_no BETWEEN 2 AND 6",
    "p6_change_counts": _P6_SQL + "SELECT workspace, snapshot_no::INTEGER AS snapshot_no, change_kind, count(*) AS n FROM d WHERE change_kind IS NOT NULL AND snapshot_no BETWEEN 2 AND 6 GROUP BY ALL",
}
