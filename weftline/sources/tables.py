"""Scans and sinks: files of several formats, JSON lines, JSON documents, versioned tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import rows as lineage_rows
from weftline.settings import Config, same_dataset


def scan(spark: SparkSession, path: str, kind: str | None = None, schema=None, **options) -> DataFrame:
    """A data set by path; kind (parquet, json, csv, orc, text) follows the ending unless given. JSON lines may be null in any field."""
    kind = kind or {"jsonl": "json", "json": "json", "csv": "csv", "orc": "orc", "txt": "text"}.get(path.rstrip("/").rsplit(".", 1)[-1], "parquet")
    if kind == "csv":
        options = {"header": True, "multiLine": True, "escape": '"'} | options
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write_jsonl(df: DataFrame, path: str, files: int | None = None) -> None:
    """Rows as JSON lines, in place of what is there; null fields are left out, letters are not escaped. files=1 gives one part file, for small results only."""
    (df.coalesce(files) if files else df).write.mode("overwrite").json(path)


def write_document(payload: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(payload, indent=2, ensure_ascii=False, default=str), encoding="utf-8")


class VersionedTable:
    """A table as a folder of versions and a pointer to the current one, so that it can be read while its successor is written.

    A version is complete before the pointer turns to it; readers of the old one are not disturbed.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int | None:
        fs, p = self._fs("current.txt")
        if not fs.exists(p):
            return None
        return int(self.spark.read.text(f"{self.path}/current.txt").first()[0])

    def read(self) -> DataFrame:
        v = self.version()
        if v is None:
            raise ValueError(f"{self.path} has no version yet")
        return self.spark.read.parquet(f"{self.path}/v{v}")

    def replace(self, df: DataFrame, partition_by: str | None = None) -> int:
        v = (self.version() or 0) + 1
        w = df.write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(f"{self.path}/v{v}")
        fs, p = self._fs("current.txt")
        out = fs.create(p, True)
        out.write(bytearray(str(v).encode()))
        out.close()
        return v

    def append(self, df: DataFrame) -> int:
        """The current rows and df's, over the union of columns in alphabetical order, nothing dropped."""
        return self.replace(lineage_rows.aligned_union(self.read(), df) if self.version() is not None else df)


def publish(table: VersionedTable, rows: DataFrame, cfg: Config, dataset: str | None = None) -> int:
    """A run's rows: appended without its source rows if the output is the input and cfg says so, else all in place of what is there. No rows are an error."""
    target = dataset or cfg.output.dataset
    if not target:
        raise ValueError("no output data set")
    append = same_dataset(target, cfg.input.dataset) and cfg.output.append_if_same_dataset
    if append:
        rows = lineage_rows.publishable(rows)
    if rows.isEmpty():
        raise ValueError("no rows to publish")
    if not append:
        return table.replace(rows)
    for name, of in ((cfg.input.question_field, "question"), (cfg.input.answer_field, "answer")):
        if name != of:
            rows = rows.withColumn(name, F.col(of))
    return table.append(rows)
