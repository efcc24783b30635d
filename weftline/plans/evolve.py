"""One generation: parents, generate, refine, judge, select, rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import memory, parents, responses, rows, selection
from weftline.operators.completions import Completer, stage
from weftline.runtime import Workspace
from weftline.settings import Config


@dataclass
class Result:
    rows: DataFrame
    summary: dict
    events: DataFrame
    lessons: list[str] = field(default_factory=list)


def select_parents(df: DataFrame, cfg: Config, num_seeds: int | None = None, seed: int | None = None) -> DataFrame:
    """Sampled parents: seed_index, source_id, source_iteration, next_iteration, question_text, answer_text, memory, record."""
    i = cfg.input
    found = parents.candidates(df, i.question_field, i.answer_field, i.iteration_field)
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    given = found.select(parents.source_id(found, F.xxhash64("question_text", "answer_text")).alias("source_id"), "source_iteration", "next_iteration", "question_text", "answer_text", parents.memory(found, i.memory_field).alias("memory_text"), record.alias("record"))
    given = given.withColumnRenamed("memory_text", "memory")
    return parents.sample(given, i.max_seeds if num_seeds is None else num_seeds, i.seed if seed is None else seed)


def generation_prompt(cfg: Config, lessons: list[str]) -> F.Column:
    line = cfg.lineage
    shown = text.bullet_block("Lessons of this run", F.array(*[F.lit(x) for x in lessons]).cast("array<string>"))
    return F.concat(F.lit(f"Make {line.candidates_per_iteration} new problems out of the one below, each by one change of its mathematics. Number them as candidates and give each the headings Transformation, Problem, Answer, Solution, Why It Is New and Failure Risk.\n\nGeneration: "), F.col("next_iteration").cast("string"), F.lit("\n\nGiven problem\n"), text.trim_middle("question_text", line.max_question_chars), F.lit("\n\nGiven answer\n"), text.trim_middle("answer_text", line.max_answer_chars), F.lit("\n\nNotes kept with it\n"), F.coalesce(F.nullif(text.trim_middle("memory", line.max_answer_chars), F.lit("")), F.lit("no notes are kept with this problem")), F.lit("\n\n"), shown)


def follow_up_prompt(cfg: Config, what: str) -> F.Column:
    return F.concat(F.lit(f"{what}\n\nGiven problem\n"), text.trim_middle("question_text", cfg.lineage.max_question_chars), F.lit("\n\nProposals\n"), responses.format_candidates("candidates"))


REFINE = "Correct and shorten each proposal without changing its idea. Answer with as many blocks, numbered REFINED 1 and on, under the same headings."
JUDGE = "Judge each proposal in a block of its own, numbered JUDGEMENT 1 and on: Correct, Novelty, Depth, Seed Alignment, Non-Stitched, Solution Economy (0 to 1), Decision, Failure Kind, Notes."


def evolve(df: DataFrame, cfg: Config, completer: Completer, num_seeds: int | None = None, seed: int | None = None, wave: int | None = None) -> Result:
    """Rows of one new generation from the latest one in df.

    Parents go in waves of `wave` (all at once by default): a wave's prompts show the last lessons of the waves before; 1 is the strict sequence.
    Each model stage is written before it is used, so no call repeats. A parent whose generation fails or has no candidate gives an
    error event and no new row. With cfg.runtime.dry_run only source rows come out.
    """
    spark = df.sparkSession
    ws = Workspace(spark, "evolve")
    i = cfg.input
    chosen, n = ws.write(select_parents(df, cfg, num_seeds, seed), n=F.count("*"), it=F.max("source_iteration"))
    out = rows.source_rows(chosen, i.dataset, i.split, "record")
    kinds = [chosen.select(F.lit("seed_started").alias("kind"), F.col("source_id").alias("seed_id"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("status"))]
    lessons: list[str] = []
    calls = 0
    answered = {"calls": F.count("response")}
    total = n["n"] or 0
    step = total if not wave else wave
    for start in range(0, 0 if cfg.runtime.dry_run else total, max(1, step)):
        part = chosen.where((F.col("seed_index") >= start) & (F.col("seed_index") < start + step)).withColumn("key", F.col("seed_index").cast("string"))
        keep = cfg.lineage.max_memory_items
        shown = lessons[-keep:] if keep else lessons
        made, n1 = ws.write(stage(part.select("key", generation_prompt(cfg, shown).alias("prompt")), "generate", completer), **answered)
        first, _ = ws.write(responses.candidate_table(made, "key", "response"))
        packed = lambda c: c.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "label", "question", "answer", "solution", "transformation", "why_new", "risk"))).alias("candidates"))  # noqa: E731  a response's few candidates
        asked = part.join(packed(first), "key").select("key", follow_up_prompt(cfg, REFINE).alias("prompt"))
        refined, n2 = ws.write(stage(asked, "refine", completer), **answered)
        both, _ = ws.write(responses.substitute(first, responses.candidate_table(refined, "key", "response", "refined")))
        asked = part.join(packed(both), "key").select("key", follow_up_prompt(cfg, JUDGE).alias("prompt"))
        judged_text, n3 = ws.write(stage(asked, "judge", completer), **answered)
        calls += sum(x["calls"] or 0 for x in (n1, n2, n3))
        judged, _ = ws.write(selection.judge(both, responses.block_table(judged_text, "key", "response", "judgement"), judged_text))
        best = selection.select(judged, cfg.lineage)
        fields = F.struct("label", "transformation", "question", "answer", "solution", "why_new", "risk", "scores", "correct", "decision", "failure_kind", "judge_notes")
        listed = judged.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", fields.alias("c"))), lambda a, b: a["ord"] - b["ord"]).alias("l")).select("key", F.col("l.c").alias("all"))
        raw = made.select("key", F.col("response").alias("raw_generation_response")).join(refined.select("key", F.col("response").alias("raw_refinement_response")), "key", "left").join(judged_text.select("key", F.col("response").alias("raw_judgement_response")), "key", "left")
        whole = best.join(part.select("key", "source_id", "source_iteration", "next_iteration", "question_text", "answer_text", F.col("memory").alias("parent_memory")), "key").join(listed, "key").join(raw, "key")
        failed = selection.failed_directions(F.col("all"))
        artifacts = F.to_json(F.struct("source_iteration", F.col("next_iteration").alias("iteration"), "raw_generation_response", "raw_refinement_response", "raw_judgement_response", F.col("all").alias("candidates"), "parent_memory", F.array(*[F.lit(x) for x in shown]).cast("array<string>").alias("global_memory_used")))
        c = F.col
        whole = whole.withColumns({"artifacts_json": artifacts, "new_memory": memory.row_memory(c("parent_memory"), c("source_iteration"), c("accepted"), c("transformation"), c("why_new"), c("judge_notes"), c("scores"), failed), "lesson": memory.lesson(c("role"), c("source_id"), c("next_iteration"), c("transformation"), c("failure_kind"), c("judge_notes"), c("scores"))})
        whole, _ = ws.write(whole)
        copies = {i.question_field: "question", i.answer_field: "answer", i.iteration_field: "iteration", i.memory_field: "memory"}
        out = out.unionByName(rows.made_rows(whole, i.dataset, i.split, copies), allowMissingColumns=True)
        lessons += [r["lesson"] for r in whole.orderBy(F.col("key").cast("int")).select("lesson").collect()]  # max_seeds at most
        ended = part.select("key", "source_id").join(whole.select("key", "role"), "key", "left").join(made.select("key", "error"), "key", "left")
        kinds.append(ended.select(F.when(F.col("role").isNull(), "seed_error").otherwise("seed_done").alias("kind"), F.col("source_id").alias("seed_id"), F.when(F.col("role").isNull(), F.coalesce("error", F.lit("no parseable candidates"))).alias("error"), F.when(F.col("role") == "generated", "done").otherwise(F.col("role")).alias("status")))
    result, _ = ws.write(out)
    events = kinds[0]
    for more in kinds[1:]:
        events = events.unionByName(more)
    events, _ = ws.write(events)
    counted = rows.summary(result).first().asDict()
    errors = [f"{r['seed_id']}: {r['error']}" for r in events.where("kind = 'seed_error'").collect()]
    keep = cfg.lineage.max_memory_items
    latest = n["it"] if n["it"] is not None else 0
    summary = {"input_dataset": i.dataset, "input_split": i.split, "output_dataset": cfg.output.dataset, "seeds": total, "source_iteration": latest, "current_iteration": latest + 1, **counted, "model_calls": calls, "errors": errors, "global_memory": lessons[-keep:] if keep else lessons}
    return Result(result, summary, events, lessons)

