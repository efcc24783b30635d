"""Content-addressed caches of completions and embeddings as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.runtime import Workspace

COMPLETIONS = "key string, content string, finish_reason string, usage string, t double, key2 string"
EMBEDDINGS = "key string, embedding array<float>, key2 string"


class Cache:
    """Rows by key under a folder, partitioned by the key's first two digits; `value` is the column that must hold something."""

    def __init__(self, spark: SparkSession, path: str, schema: str = COMPLETIONS, value: str = "content"):
        self.spark, self.path, self.schema, self.value = spark, path, schema, value

    def _filled(self):
        return text.strip(self.value) != "" if self.schema == COMPLETIONS else F.size(self.value) > 0

    def read(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def put(self, rows: DataFrame) -> None:
        """Adds rows whose value is neither null nor blank, one file for each pair of first digits that occurs."""
        filled = rows.where(self._filled()).withColumn("key2", F.substring("key", 1, 2))
        filled.repartition("key2").write.mode("append").partitionBy("key2").parquet(self.path)

    def split(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits, misses) of requests with a key: hits have the cached columns, of a key cached more than once the greatest row; a blank value is a miss.

        Only folders of first digits that requests have are read, at most 256, and the join is made once for both.
        """
        columns = [c.split()[0] for c in self.schema.split(", ") if not c.startswith("key")]
        folders = [r[0] for r in requests.select(F.substring("key", 1, 2)).distinct().collect()]
        found = lookup(self.read().where(F.col("key2").isin(folders)).where(self._filled()), columns).withColumn("found", F.lit(True))
        both, _ = Workspace(self.spark, "cache").write(requests.join(found, "key", "left"))
        return both.where("found").drop("found"), both.where("found is null").drop("found", *columns)


def lookup(cached: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each key, the greatest by the last of the columns, then the others."""
    return cached.groupBy("key").agg(F.max(F.struct(*reversed(columns))).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in columns])
