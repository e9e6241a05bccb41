"""Nearest-rank latency statistics and scan series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latency_stats(rows: DataFrame, by: str, latency: str) -> DataFrame:
    """Calls, total, rounded mean and nearest-rank p50 and p95, by ``by`` and overall (null, is_total).

    Null, NaN and negative latencies are not measured and left out.
    """
    d = rows.filter(F.col(latency).isNotNull() & ~F.isnan(latency) & (F.col(latency) >= 0))
    d = d.groupingSets([[by], []], by)
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {latency})")
    return d.agg(
        F.grouping_id().alias("is_total"), F.count("*").alias("calls"), F.round(F.sum(latency), 3).alias("total_ms"), F.round(F.avg(latency), 0).alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms")
    )


def outcome_counts(verdicts: DataFrame, by: str, hit: str) -> DataFrame:
    """Verdicts with and without the outcome per ``by``; a null outcome counts as neither."""
    return verdicts.groupBy(by).agg(F.count_if(hit).alias("races"), F.count_if(~F.col(hit)).alias("safe"))


def window_summary(scans: DataFrame, by: str) -> DataFrame:
    """Per ``by``: scans, newest minus oldest high count, mean duration (unfinished as 0), mean p50 and p95 of scans with calls."""
    order = Window.partitionBy(by).orderBy("started_at", "scan_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = scans.withColumn("_first", F.first("high").over(order)).withColumn("_last", F.last("high").over(order))
    called = F.col("llm_calls") > 0
    return s.groupBy(by).agg(
        F.count("*").alias("scans"), (F.max("_last") - F.max("_first")).alias("high_change"), F.round(F.avg(F.coalesce("duration_ms", F.lit(0))), 3).alias("avg_duration_ms"),
        F.round(F.avg(F.when(called, F.col("llm_p50_ms"))), 3).alias("avg_p50_ms"), F.round(F.avg(F.when(called, F.col("llm_p95_ms"))), 3).alias("avg_p95_ms"),
    )
