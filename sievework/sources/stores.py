"""Scan history, fingerprint sets and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework import schemas
from sievework.operators.clustering import first_per

_C = F.col


def load_history(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON file per scan, unreadable ones skipped, missing fields null, newest first."""
    d = spark.read.schema(schemas.SCANS).option("mode", "DROPMALFORMED").option("multiLine", True).json(f"{folder}/*.json")
    return d.filter("scan_id IS NOT NULL").orderBy(_C("started_at").desc_nulls_last(), "scan_id")


def persist_scan(scan: DataFrame, folder: str) -> None:
    """Scans as JSON, a folder per scan id; a scan written again replaces itself."""
    scan.withColumn("_id", _C("scan_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_id").json(folder)


def read_set(spark: SparkSession, path: str) -> DataFrame:
    """A stored fingerprint set; a missing one is empty. Between a write's two renames the new set is read."""
    for place in (path, path + ".new"):
        if _exists(spark, place + "/_SUCCESS"):
            return spark.read.schema("fingerprint string").parquet(place).filter("fingerprint IS NOT NULL").distinct()
    return spark.createDataFrame([], "fingerprint string")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def write_set(fps: DataFrame, path: str) -> None:
    """Sorted and distinct; written beside the old set and then renamed, so at every moment a whole set is read.

    ``fps`` may derive from the set at ``path`` itself, whose files stay until the new ones are written.
    """
    spark = fps.sparkSession
    fps.select("fingerprint").distinct().sort("fingerprint").write.mode("overwrite").parquet(path + ".tmp")
    for old, new in ((path + ".new", path + ".tmp"), (path, path + ".new")):
        p, fs = _fs(spark, old)
        fs.delete(p, True)
        _rename(spark, new, old)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    p, fs = _fs(spark, source)
    if not fs.rename(p, _fs(spark, target)[0]):
        raise OSError(f"could not rename {source} to {target}")


def move(spark: SparkSession, fps: DataFrame, to: str, away_from: str) -> None:
    """Adds to one set and removes from another: what is marked false positive isn't kept open, and vice versa."""
    add = fps.select("fingerprint").distinct().persist()
    write_set(read_set(spark, to).union(add), to)
    write_set(read_set(spark, away_from).join(add, "fingerprint", "left_anti"), away_from)
    add.unpersist()


def remove(spark: SparkSession, fps: DataFrame, path: str) -> None:
    write_set(read_set(spark, path).join(fps.select("fingerprint").distinct(), "fingerprint", "left_anti"), path)


# --- reports ------------------------------------------------------------------------------------------
def report_counts(findings: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """total, shown, hidden, and the shown ones by severity."""
    shown = _C("confidence") >= min_confidence
    sev = [F.count_if(shown & (_C("severity") == s)).alias(s) for s in ("high", "medium", "low")]
    return findings.agg(F.count("*").alias("total"), F.count_if(shown).alias("shown"), F.count_if(~shown).alias("hidden"), *sev)


def json_report(findings: DataFrame, folder: str, min_confidence: float = 0.0) -> None:
    """Shown and hidden findings as JSON, partitioned by visibility."""
    findings.withColumn("visible", _C("confidence") >= min_confidence).write.mode("overwrite").partitionBy("visible").json(folder)


def markdown_report(findings: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """(detector_id, position, markdown) blocks, worst severity then confidence first within a detector."""
    rank = F.when(_C("severity") == "high", 0).when(_C("severity") == "medium", 1).otherwise(2)
    sites = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("- `"), e["file"], F.lit(":"), e["line_range"]["start_line"].cast("string"), F.lit("`"))), "\n")
    block = F.concat_ws("\n\n", F.concat(F.lit("### "), "title"), F.concat(F.lit("*"), "severity", F.lit("*, confidence "), F.format_number("confidence", 2)), "description", sites, "suggestion")
    d = findings.filter(_C("confidence") >= min_confidence)
    from pyspark.sql.window import Window

    w = Window.partitionBy("detector_id").orderBy(rank, _C("confidence").desc(), "fingerprint")
    return d.select("detector_id", F.row_number().over(w).alias("position"), block.alias("markdown"))


def fix_prompt(marked: DataFrame) -> DataFrame:
    """One text that lists the marked findings: severity mix, files, numbered blocks.

    For the findings that a person marked, a list of human size by contract.
    """
    rank = F.when(_C("severity") == "high", 0).when(_C("severity") == "medium", 1).otherwise(2)
    d = first_per(marked, ["fingerprint"], ["title"])
    row = F.struct(rank.alias("r"), "fingerprint", "title", "severity", F.coalesce("suggestion", F.lit("")).alias("suggestion"), F.transform("evidence", lambda e: e["file"]).alias("files"))
    g = d.agg(F.array_sort(F.collect_list(row)).alias("rows"), *[F.count_if(_C("severity") == s).alias(s) for s in ("high", "medium", "low")])
    files = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda r: r["files"])))), "\n")
    blocks = F.array_join(F.transform("rows", lambda r, i: F.concat((i + 1).cast("string"), F.lit(". ["), r["severity"], F.lit("] "), r["title"], F.lit("\n   "), r["suggestion"])), "\n")
    head = F.concat(F.lit("Fix these findings: "), _C("high").cast("string"), F.lit(" high, "), _C("medium").cast("string"), F.lit(" medium, "), _C("low").cast("string"), F.lit(" low."))
    return g.select(F.concat_ws("\n\n", head, files, blocks).alias("prompt"))
