"""Queries over documents: token ids (problem 7), mixtures (problem 8) and spam pages (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import mixing, spampages, tokenizer
from weftline.runtime import prepare


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/documents.parquet")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return tokenizer.encode(_documents(spark, d), keep=["doc_id"])


def p7_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts that come back from the ids, of every document; null texts come back empty."""
    return tokenizer.decode(p7_ids(spark, d)).select("doc_id", "text")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used in the mixture."""
    return mixing.mix(_documents(spark, d), prepare(spark).read.parquet(f"{d}/mix_targets.parquet"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every listed source."""
    return mixing.mix(_documents(spark, d), spark.read.parquet(f"{d}/mix_targets.parquet"))[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of keywords, links, menus or product tags."""
    return spampages.flag(spampages.scores(_documents(spark, d))).select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all pages of two words or more, with the reason of those flagged."""
    scored = spampages.scores(_documents(spark, d))
    return scored.join(spampages.flag(scored), "doc_id", "left").select("doc_id", *[F.round(c, 6).alias(c) for c in ("prose", "links", "mean_npmi", "repeats", "stuffed")], "reason")


QUERIES = {f.__name__: f for f in (p7_ids, p7_decoded, p8_mix, p8_shares, p9_found, p9_scores)}

SQL = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
