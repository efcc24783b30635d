"""Queries on texts of lineage_rows: cut values (problem 2) and broken pairs (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import completeness, pairs
from weftline.runtime import prepare

FIELDS = {"question": None, "answer": "question", "source_answer": "source_question"}


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/lineage_rows.parquet")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of three columns that end before their text does."""
    return completeness.settle(completeness.judged(_lineage(spark, d), FIELDS)).where("cut").select("id", "field").distinct()


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Share of cut values of each data set and column."""
    return completeness.rates(completeness.settle(completeness.judged(_lineage(spark, d), FIELDS))).withColumnRenamed("source", "dataset").withColumn("share", F.round("share", 6))


def p2_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which data sets cut their columns."""
    return completeness.spikes(completeness.judged(_lineage(spark, d), FIELDS)).withColumnRenamed("source", "dataset")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Unusable pairs with the type of defect."""
    return pairs.defects(_lineage(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_rates, p2_spikes, p4_found)}
SQL: dict[str, str] = {}
