"""Judging, ranking and selecting candidates of each parent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.settings import Lineage

SCORES = ("novelty", "depth", "seed_alignment", "non_stitched", "solution_economy")


def judge(candidates: DataFrame, blocks: DataFrame, responses: DataFrame | None = None) -> DataFrame:
    """candidates (key, ord, ...) with correct, scores (map, empty where not judged), decision, failure_kind and judge_notes.

    The i-th candidate belongs to the i-th judgement block, whatever their labels. A candidate without a block keeps no scores and
    is rejected as judge_missing; if its key has no block at all, as judge_unparseable, or judge_empty where responses
    (key, response) has no text. Surplus blocks are not used. A blank decision follows correct.
    """
    b = blocks.select("key", "ord", *[text.score(c).alias(f"s_{c}") for c in SCORES], text.flag("correct").alias("j_correct"), F.lower(text.strip(F.coalesce("decision", F.lit("")))).alias("j_decision"), F.lower(text.strip(F.coalesce("failure_kind", F.lit("")))).alias("j_kind"), text.strip(F.coalesce("notes", F.lit(""))).alias("j_notes"), F.lit(True).alias("judged"))
    out = candidates.join(b, ["key", "ord"], "left").join(blocks.groupBy("key").agg(F.count("*").alias("n_blocks")), "key", "left")
    if responses is not None:
        out = out.join(responses.select("key", (text.strip(F.coalesce("response", F.lit(""))) != "").alias("said")), "key", "left")
    else:
        out = out.withColumn("said", F.lit(True))
    judged = F.coalesce("judged", F.lit(False))
    empty = F.create_map().cast("map<string,double>")
    scores = F.create_map(*[x for c in SCORES for x in (F.lit(c), F.col(f"s_{c}"))])
    missing = F.when(F.col("n_blocks").isNotNull(), "judge_missing").when(F.coalesce("said", F.lit(False)), "judge_unparseable").otherwise("judge_empty")
    decision = F.when(~judged, "reject").when(F.col("j_decision") != "", F.col("j_decision")).when(F.col("j_correct"), "accept").otherwise("reject")
    return out.select(*candidates.columns, F.coalesce("j_correct", F.lit(False)).alias("correct"), F.when(judged, scores).otherwise(empty).alias("scores"), decision.alias("decision"), F.when(judged, F.col("j_kind")).otherwise(missing).alias("failure_kind"), F.coalesce("j_notes", F.lit("no judgement block for this candidate")).alias("judge_notes"))


def _score(name: str) -> Column:
    return F.coalesce(F.try_element_at("scores", F.lit(name)), F.lit(0.0))


def passes(limits: Lineage = Lineage()) -> Column:
    """Quality gate over correct, scores and decision; a missing score is 0, seed alignment has no limit, and only the exact decision 'reject' fails."""
    ok = F.coalesce("correct", F.lit(False)) if limits.min_correctness >= 1 else F.lit(True)
    for name, least in (("novelty", limits.min_novelty), ("depth", limits.min_depth), ("non_stitched", limits.min_non_stitched), ("solution_economy", limits.min_solution_economy)):
        ok = ok & (_score(name) >= least)
    return ok & (F.coalesce("decision", F.lit("")) != "reject")


def composite() -> Column:
    """Weighted score by which candidates are ranked."""
    s = _score
    return 0.28 * s("depth") + 0.24 * s("novelty") + 0.18 * s("seed_alignment") + 0.16 * s("non_stitched") + 0.14 * s("solution_economy") + F.when(F.coalesce("correct", F.lit(False)), 0.10).otherwise(-0.30)


def select(judged: DataFrame, limits: Lineage = Lineage()) -> DataFrame:
    """The best candidate of every key: among those that pass, else among all; ties go to the earlier one.

    Adds accepted (it passes) and role: 'generated' if one passes or limits.continue_on_rejected, else 'rejected'. One maximum
    of structs per key, added up before the shuffle; no group is sorted.
    """
    row = F.struct(*judged.columns)
    best = judged.groupBy("key").agg(F.max_by(F.struct(row.alias("r"), passes(limits).alias("ok")), F.struct(passes(limits), composite(), -F.col("ord"))).alias("b"))
    chosen = best.select("b.r.*", F.col("b.ok").alias("accepted"))
    return chosen.withColumn("role", F.when(F.col("accepted") | F.lit(limits.continue_on_rejected), "generated").otherwise("rejected"))


def failed_directions(candidates: Column | str = "candidates", n: int = 3) -> Column:
    """'kind: transformation' of the first n candidates of an array that are not correct or rejected; without a transformation the question's first 160 characters."""
    bad = F.filter(candidates, lambda c: ~F.coalesce(c["correct"], F.lit(False)) | F.coalesce(c["decision"] == "reject", F.lit(False)))
    some = lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b)
    return F.slice(F.transform(bad, lambda c: F.concat(some(c["failure_kind"], F.lit("rejected")), F.lit(": "), some(c["transformation"], F.substring(F.coalesce(c["question"], F.lit("")), 1, 160)))), 1, n)
