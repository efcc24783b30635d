"""Session plumbing: the shared folder, lineage cuts, size-checked broadcasts, worker import path."""

from __future__ import annotations

import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)
#: A side is broadcast only if it was counted and has at most so many rows.
BROADCAST_ROWS = 20_000
_CLEAR = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def prepare(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package and gives the session a checkpoint folder if it names none."""
    sc = spark.sparkContext
    have = sc.environment.get("PYTHONPATH", "")
    if ROOT not in have.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{have}" if have else ROOT
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset (local runs and tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return spark.sparkContext.getCheckpointDir()


class Workspace:
    """Tables written to the shared folder to cut lineage: they survive lost executors, and a replaced one is deleted.

    With clear, the shuffle files of a write are deleted when it ends, not when the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession, label: str, clear: bool = False):
        self.spark, self.clear = prepare(spark), clear
        self.base = f"{shared_dir(spark).rstrip('/')}/weftline-{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def write(self, df: DataFrame, **counts) -> tuple[DataFrame, dict]:
        """Writes df and reads it back; counts are aggregate columns taken while writing, without a second pass."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        got: dict = {}
        before = self.spark.conf.get(_CLEAR, None)
        if self.clear:
            self.spark.conf.set(_CLEAR, "true")
        try:
            if counts:
                seen = Observation()
                df.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
                got = seen.get
            else:
                df.write.parquet(path)
        finally:
            if self.clear:
                self.spark.conf.unset(_CLEAR) if before is None else self.spark.conf.set(_CLEAR, before)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._weftline_path = path
        return back, got

    def together(self, dfs: list[DataFrame]) -> DataFrame:
        """Tables written here with one schema, as one scan."""
        return self.spark.read.schema(dfs[0].schema).parquet(*[df._weftline_path for df in dfs])

    def drop(self, *dfs: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark._jvm
        for df in dfs:
            p = jvm.org.apache.hadoop.fs.Path(df._weftline_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within the limit, else as it is (shuffled join)."""
    return F.broadcast(df) if rows <= limit else df
