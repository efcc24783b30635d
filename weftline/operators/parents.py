"""The parent rows of the next generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import text

#: Spellings of `accepted` that mean no.
NOT_ACCEPTED = ("false", "0", "no", "rejected")


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; there are {df.columns}")


def eligible(df: DataFrame) -> Column:
    """Whether a row may be a parent: not of role rejected, and `accepted` true, absent, null or a text that doesn't mean no."""
    ok = F.lit(True)
    if "role" in df.columns:
        ok = F.coalesce(F.lower(text.strip(F.col("role").cast("string"))), F.lit("")) != "rejected"
    if "accepted" in df.columns:
        a = F.col("accepted")
        if isinstance(df.schema["accepted"].dataType, T.BooleanType):
            return ok & F.coalesce(a, F.lit(True))
        return ok & ~F.coalesce(F.lower(text.strip(a.cast("string"))).isin(*NOT_ACCEPTED), F.lit(False))
    return ok


def memory(df: DataFrame, field: str = "memory") -> Column:
    """First of the named column, memory and memory_json that is not null, as text; '' stops the search. '' if there is none."""
    names = [n for n in dict.fromkeys((field, "memory", "memory_json")) if n in df.columns]
    as_text = lambda n: F.to_json(n) if isinstance(df.schema[n].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(n).cast("string")
    return F.coalesce(*[text.strip(as_text(n)) for n in names], F.lit(""))


def source_id(df: DataFrame, ordinal: Column | None = None) -> Column:
    """First of id, row_id and problem_id that is neither null, '' nor 0, else the row's ordinal; as text."""
    tests = [F.when(~F.coalesce(F.col(n).cast("string").isin("", *(["0"] if isinstance(df.schema[n].dataType, T.NumericType) else [])), F.lit(True)), F.col(n).cast("string")) for n in ("id", "row_id", "problem_id") if n in df.columns]
    return F.coalesce(*tests, (F.lit(None) if ordinal is None else ordinal).cast("string"))


def candidates(df: DataFrame, question: str = "question", answer: str = "answer", iteration: str = "iteration") -> DataFrame:
    """df with eligible rows of the latest eligible iteration that have a question and an answer, and the columns
    question_text, answer_text, source_iteration and next_iteration.

    The latest iteration is taken over all eligible rows, whatever their texts; without an iteration column all rows are
    raw seeds of iteration 0; with one in which nothing can be read no row is a parent. Columns of those four names in df give way.
    """
    require_columns(df, [question, answer])
    q, a = (text.field_text(F.col(c), df.schema[c].dataType) for c in (question, answer))
    ok = eligible(df)
    if iteration not in df.columns:
        out = df.where(ok).withColumn("source_iteration", F.lit(0))
    else:
        it = text.parse_iteration(F.col(iteration), df.schema[iteration].dataType)
        latest = df.where(ok).agg(F.max(it).alias("__latest"))  # one row
        out = df.where(ok).withColumn("__it", it).join(F.broadcast(latest), F.col("__it") == F.col("__latest")).withColumn("source_iteration", F.col("__latest")).drop("__it", "__latest")
    return out.withColumns({"question_text": q, "answer_text": a, "next_iteration": F.col("source_iteration") + 1}).where("question_text <> '' and answer_text <> ''")


def sample(df: DataFrame, n: int, seed: int = 0, key: str = "source_id") -> DataFrame:
    """n rows in an order that seed and key alone decide, with seed_index from 0; a negative n leaves the last -n out.

    Ordered by SHA-256 of seed and key, so it needs no count and no permutation of positions: a top-n of each partition, then of all.
    """
    from pyspark.sql import Window

    h = F.sha2(F.concat_ws(":", F.lit(str(seed)), key), 256)
    if n < 0:
        n = max(0, df.count() + n)
    top = df.withColumn("__h", h).orderBy("__h", key).limit(n)
    # The window runs over the sample, n rows, which the caller has bounded.
    return top.withColumn("seed_index", F.row_number().over(Window.orderBy("__h", key)) - 1).drop("__h")
