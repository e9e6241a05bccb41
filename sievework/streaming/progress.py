"""Scan progress as a stream: state per scan and running statistics of verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "scan_id string, seq long, state string, detector_id string, phase string, latency_ms double, race boolean, at timestamp"
_C = F.col


def read_events(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """Event files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).json(folder)


def fold(events: DataFrame) -> DataFrame:
    """(scan_id, state, active_detector, done, verdicts, races, last_seq), the same for a stream and a table.

    The last event by sequence number holds, whatever the order of arrival; a repeated event counts once
    in the sets, and in the counters too where the caller has dropped repetitions of (scan_id, seq).
    """
    done = F.collect_set(F.when(_C("phase") == "done", _C("detector_id")))
    verdict = _C("latency_ms").isNotNull()
    return events.groupBy("scan_id").agg(
        F.max_by("state", F.when(_C("state").isNotNull(), _C("seq"))).alias("state"),
        F.max_by("detector_id", F.when(_C("phase") == "start", _C("seq"))).alias("active_detector"),
        F.array_sort(done).alias("done"),
        F.count_if(verdict).alias("verdicts"),
        F.count_if(verdict & _C("race")).alias("races"),
        F.max("seq").alias("last_seq"),
    )


def running_stats(verdicts: DataFrame) -> DataFrame:
    """Calls, total and approximate percentiles of the latency by detector; exact ones come at a scan's end."""
    d = verdicts.filter(_C("latency_ms").isNotNull() & ~F.isnan("latency_ms") & (_C("latency_ms") >= 0))
    return d.groupBy("detector_id").agg(F.count("*").alias("calls"), F.sum("latency_ms").alias("total_ms"), F.percentile_approx("latency_ms", 0.5, 1000).alias("p50_ms"), F.percentile_approx("latency_ms", 0.95, 1000).alias("p95_ms"))


def run_fold(spark: SparkSession, folder: str, table: str, checkpoint: str) -> None:
    """Folds all events that are there into a table that late readers can replay, then stops."""
    events = read_events(spark, folder).dropDuplicates(["scan_id", "seq"])

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(table)

    fold(events).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def eta_ms(verdicts: DataFrame, left: int, default_ms: float = 1500.0) -> DataFrame:
    """Time left: calls to come times the mean latency so far."""
    return verdicts.agg((F.lit(left) * F.coalesce(F.avg(F.when(~F.isnan("latency_ms") & (_C("latency_ms") >= 0), _C("latency_ms"))), F.lit(default_ms))).alias("eta_ms"))
