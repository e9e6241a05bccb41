"""Session helpers: table loading, lineage cuts in the shared folder, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast; larger sides take a shuffled join.
BROADCAST_BYTES = 32 << 20


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it.

    Workers on other machines need it installed or sent with ``--py-files``.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parent.parent)
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), here)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A driver table; ``sf_dir`` holds one Parquet file or folder per table."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where the session sets it.

    Only where it is unset on one machine (a local master, as in tests) a temporary folder is made and
    kept for later calls; on a cluster an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = getattr(shared_dir, "own", None)
        if not found:
            own = tempfile.mkdtemp(prefix="sievework-")
            atexit.register(shutil.rmtree, own, True)
            shared_dir.own = found = f"file://{own}"
    return found.rstrip("/")


class Scratch:
    """Written tables that cut the lineage of an iterative job.

    ``cut`` writes a DataFrame to the shared folder and reads it back, so a lost executor
    costs a re-read and not the loop. ``drop`` removes tables that no later step needs.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame, files: int | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        (df if files is None else df.coalesce(files)).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for df in dfs:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint when its counted rows fit ``limit`` bytes, else unchanged."""
    return F.broadcast(df) if rows * row_bytes <= limit else df
