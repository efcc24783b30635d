"""Memory of rows and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators.selection import SCORES

#: The wording of memory texts and lessons, so that rows published before and after read alike.
PREVIOUS = "Previous dataset memory:\n"
LATEST = "Latest synthesis memory:\n- Parent iteration: "
STATUS = "\n- New status: "
USED = "\n- Transformation used: "
CHANGED = "\n- Why it changed the problem: "
NOTES = "\n- Judge notes: "
LISTED = "\n- Scores: "
AVOID = "Failed directions to avoid next time:\n- "
TOOK = "Accepted parent "
LEFT = "Rejected at parent "


def row_memory(prior: Column, iteration: Column, accepted: Column, transformation: Column, why_new: Column, notes: Column, scores: Column, failed: Column) -> Column:
    """Memory text of a new row: the prior memory, the latest synthesis, and up to three failed directions."""
    some = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), F.lit(other))
    listed = F.concat_ws(", ", *[F.when(F.map_contains_key(scores, F.lit(k)), F.concat(F.lit(f"{k}="), text.two_decimals(F.try_element_at(scores, F.lit(k))))) for k in SCORES])
    before = F.when(text.strip(prior) != "", F.concat(F.lit(PREVIOUS), text.strip(prior)))
    latest = F.concat(F.lit(LATEST), iteration.cast("string"), F.lit(STATUS), F.when(accepted, "accepted").otherwise("rejected"), F.lit(USED), some(transformation, "unspecified"), F.lit(CHANGED), some(why_new, "unspecified"), F.lit(NOTES), some(notes, "none"), F.lit(LISTED), some(listed, "{}"))
    avoid = F.when(F.size(failed) > 0, F.concat(F.lit(AVOID), F.array_join(failed, "\n- ")))
    return F.concat_ws("\n\n", before, latest, avoid)


def lesson(role: Column, source_id: Column, iteration: Column, transformation: Column, kind: Column, notes: Column, scores: Column) -> Column:
    """What a run learns from one parent; generated rows count as accepted here even if they did not pass."""
    s = lambda k: text.two_decimals(F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)))
    yes = F.concat(F.lit(TOOK), source_id, F.lit(" for iteration "), iteration.cast("string"), F.lit(": "), F.substring(transformation, 1, 220), F.lit(" (depth="), s("depth"), F.lit(", novelty="), s("novelty"), F.lit(")."))
    no = F.concat(F.lit(LEFT), source_id, F.lit(" for iteration "), iteration.cast("string"), F.lit(": "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("weak_candidate")), F.lit("; "), F.substring(notes, 1, 240))
    return F.when(role == "generated", yes).otherwise(no)


def dense(df: DataFrame, part: str, order: str, to: str, width: int = 10_000) -> DataFrame:
    """df with `to`, the place from 0 of each row within part by the whole number `order`, which must not repeat within part.

    Rows are numbered within stretches of `width` order numbers, after the counts of the stretches before: a large part is spread
    over many tasks.
    """
    cut = df.withColumn("__b", F.floor(F.col(order) / width))
    sums = cut.groupBy(part, "__b").agg(F.count("*").alias("__n"))
    sums = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    n = F.row_number().over(Window.partitionBy(part, "__b").orderBy(order)) - 1
    return cut.join(sums, [part, "__b"]).withColumn(to, F.col("__before") + n).drop("__b", "__before")


def run_memory(lessons: DataFrame, n: int = 8, width: int = 10_000) -> DataFrame:
    """lessons (run, seq, lesson) with `memory`: the lessons of the n rows before, oldest first; n = 0 means all of them.

    Rows without a lesson (errors) have a memory but are in none. The trailing frame never spans a whole run: rows are put into
    stretches of their places, each with the last n lessons of the stretch before.
    """
    told = lessons.where("lesson is not null and run is not null")
    if not n:
        w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        return lessons.withColumn("memory", F.collect_list("lesson").over(w))  # all of a run, as asked for
    placed = dense(told, "run", "seq", "__at", width).withColumn("__bin", F.floor(F.col("__at") / width))
    own = placed.withColumn("__own", F.lit(True))
    lent = placed.where(F.col("__at") % width >= max(0, width - n)).withColumn("__bin", F.col("__bin") + 1).withColumn("__own", F.lit(False))
    w = Window.partitionBy("run", "__bin").orderBy("__at").rowsBetween(-n, -1)
    out = own.unionByName(lent).withColumn("memory", F.collect_list("lesson").over(w)).where("__own")
    return out.select(*lessons.columns, "memory")
