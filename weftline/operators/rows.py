"""Rows of the lineage table: source rows, generated and rejected rows, aligned unions, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.functions.ids import stable_id


def source_rows(parents: DataFrame, dataset: str, split: str, record: str | None = None) -> DataFrame:
    """Source rows of parents (source_id, source_iteration, question_text, answer_text, memory); record names a column with the whole row as JSON."""
    made = {
        "id": stable_id("seed", dataset, split, F.col("source_id")), "lineage_id": stable_id("lineage", dataset, split, F.col("source_id")), "seed_id": F.col("source_id"), "parent_id": F.lit(""),
        "source_iteration": F.col("source_iteration"), "iteration": F.col("source_iteration"), "role": F.lit("source"), "question": F.col("question_text"), "answer": F.col("answer_text"), "solution": F.lit(""),
        "accepted": F.lit(True), "failure_kind": F.lit(""), "memory": F.col("memory"), "memory_json": F.to_json(F.struct(F.col("memory").alias("source_memory"))), "scores_json": F.lit("{}"),
        "artifacts_json": F.concat(F.lit('{"source_record":'), F.col(record), F.lit("}")) if record else F.lit("{}"), "created_at": F.unix_timestamp(),
    }
    return parents.select(*[c.alias(k) for k, c in made.items()])


def made_rows(chosen: DataFrame, dataset: str, split: str, copies: dict[str, str] | None = None) -> DataFrame:
    """Generated and rejected rows of selected candidates joined with their parents.

    chosen: source_id, source_iteration, next_iteration, question_text, answer_text, parent_memory, and the columns of a selected
    candidate with role, accepted, new_memory and artifacts_json. copies: further column names -> which of question, answer,
    iteration and memory they repeat; a name that this table already has is not repeated.
    """
    lineage = stable_id("lineage", dataset, split, F.col("source_id"))
    summary = F.struct(F.col("parent_memory"), F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("status"), "transformation", "why_new", "risk", "judge_notes", "scores")
    made = {
        "id": stable_id(F.col("role"), lineage, F.col("next_iteration"), F.col("question"), F.col("answer")), "lineage_id": lineage, "seed_id": F.col("source_id"), "parent_id": stable_id("seed", dataset, split, F.col("source_id")),
        "source_iteration": F.col("source_iteration"), "iteration": F.col("next_iteration"), "role": F.col("role"), "question": F.col("question"), "answer": F.col("answer"), "solution": F.col("solution"),
        "accepted": F.col("accepted"), "failure_kind": F.col("failure_kind"), "memory": F.col("new_memory"), "memory_json": F.to_json(summary), "scores_json": F.to_json("scores"), "artifacts_json": F.col("artifacts_json"), "created_at": F.unix_timestamp(),
        "source_question": F.col("question_text"), "source_answer": F.col("answer_text"), "source_id": F.col("source_id"),
    }
    out = chosen.select(*[c.alias(k) for k, c in made.items()])
    for name, of in (copies or {}).items():
        if name not in out.columns:
            out = out.withColumn(name, F.col(of))
        elif name != of:
            raise ValueError(f"column {name} already means something else")
    return out


def aligned_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """All rows of both, none dropped, over the union of their columns in alphabetical order; nested cells become JSON text, missing ones null."""
    both = text.nested_to_json(a).unionByName(text.nested_to_json(b), allowMissingColumns=True)
    return both.select(*[f"`{c}`" for c in sorted(both.columns)])


def publishable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("role").isin("generated", "rejected"))


def summary(rows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row of counters of a run's rows."""
    role = lambda r: F.count_if(F.col("role") == r)
    return rows.agg(role("source").alias("source_rows"), role("generated").alias("generated_rows"), F.count_if((F.col("role") == "generated") & F.col("accepted")).alias("accepted_steps"), role("rejected").alias("rejected_steps"), F.count("*").alias("total_rows"))
