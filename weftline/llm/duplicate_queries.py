"""Queries on repeated questions of lineage_rows: problems 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import history, neardup
from weftline.runtime import prepare


def _lineage(spark: SparkSession, d: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/lineage_rows.parquet")


def _checked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    made = F.coalesce(F.col("role").isin("generated", "rejected"), F.lit(False))
    return history.newcomers(_lineage(spark, d).select("id", "iteration", made.alias("newcomer"), "accepted", "question"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Newcomers whose question repeats one accepted in an earlier iteration."""
    return _checked(spark, d)[0]


def p5_shards(spark: SparkSession, d: str) -> DataFrame:
    """The shards that p5_found searches: rows, width of the beam, recall of the graph alone against exhaustive search."""
    return _checked(spark, d)[1]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _lineage(spark, d)
    own = rows.where(F.col("role").isin("generated", "rejected")).select(F.col("id").alias("key"), F.col("question").alias("text"))
    return own.unionByName(rows.where("source_question is not null").select(F.col("source_id").alias("key"), F.col("source_question").alias("text")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of keys with similar texts."""
    c = neardup.classes(_texts(spark, d))
    return neardup.key_pairs(c, neardup.similar_sets(c))


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per key and word set with its class, its group and the number of similar classes; numbers name, they don't rank."""
    c = neardup.classes(_texts(spark, d))
    return neardup.groups(c, neardup.similar_sets(c))


QUERIES = {f.__name__: f for f in (p5_found, p5_shards, p6_found, p6_groups)}

_WORDS = "list_distinct(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+'))"

SQL = {
    "p5_found": f"""
WITH sets AS MATERIALIZED (
  SELECT id, iteration, coalesce(role IN ('generated', 'rejected'), false) AS newcomer, coalesce(accepted, false) AS accepted, {_WORDS.format('question')} AS w
  FROM lineage_rows WHERE id IS NOT NULL AND iteration IS NOT NULL AND question IS NOT NULL),
one AS MATERIALIZED (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT * FROM sets WHERE len(w) > 0)),
words AS MATERIALIZED (SELECT k, iteration, newcomer, accepted, len(w) AS n, unnest(w) AS x FROM one),
pairs AS (SELECT a.k AS a, a.n AS na, b.n AS nb, count(*) AS c FROM words a JOIN words b ON a.x = b.x AND a.newcomer AND b.accepted AND b.iteration < a.iteration GROUP BY a.k, b.k, a.n, b.n)
SELECT DISTINCT o.id FROM pairs p JOIN one o ON o.k = p.a WHERE 10 * c >= 7 * (na + nb - c)""",
    "p6_found": f"""
WITH texts AS (
  SELECT id AS k, question AS t FROM lineage_rows WHERE role IN ('generated', 'rejected')
  UNION SELECT source_id, source_question FROM lineage_rows WHERE source_question IS NOT NULL),
one AS MATERIALIZED (SELECT k, {_WORDS.format('t')} AS w, row_number() OVER () AS r FROM texts WHERE k IS NOT NULL AND t IS NOT NULL),
words AS MATERIALIZED (SELECT k, r, len(w) AS n, unnest(w) AS x FROM one),
pairs AS (SELECT a.k AS ka, b.k AS kb, a.n AS na, b.n AS nb, count(*) AS c FROM words a JOIN words b ON a.x = b.x AND a.k < b.k GROUP BY a.r, b.r, a.k, b.k, a.n, b.n)
SELECT DISTINCT ka AS id_a, kb AS id_b FROM pairs WHERE 10 * c >= 7 * (na + nb - c)""",
}
