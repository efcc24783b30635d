"""State of runs from their events, as batch aggregates and as a stream.

events: event_id, run_id, seq, ts, seed_id, iteration, kind, stage, candidate_count, status, error. State is what the event of
the greatest seq says, so late and repeated events change nothing and no order of arrival is needed: the same aggregates serve
as a streaming fold. Events without a seed, or of a seed that never started, count for no seed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: kinds of events that a seed's state depends on.
SEED_KINDS = ("seed_started", "stage_started", "stage_done", "iteration_accepted", "iteration_rejected", "seed_done", "seed_error")


def once(events: DataFrame) -> DataFrame:
    """Events sent twice (same run_id and seq) once: a copy that names its seed, then the one of the smallest event_id."""
    cols = [c for c in events.columns if c not in ("run_id", "seq")]
    first = events.groupBy("run_id", "seq").agg(F.min_by(F.struct(*cols), F.struct(F.col("seed_id").isNull(), "event_id")).alias("e"))
    return first.select("run_id", "seq", *[F.col(f"e.{c}").alias(c) for c in cols]).select(*events.columns)


def _status() -> Column:
    k = F.col("kind")
    return F.when(k.isin("seed_started", "stage_started"), "running").when(k == "seed_done", F.coalesce(F.nullif("status", F.lit("")), F.lit("done"))).when(k == "seed_error", "error")


def _stage() -> Column:
    k = F.col("kind")
    return F.when(k == "seed_started", "queued").when(k == "stage_started", F.col("stage")).when(k == "stage_done", F.concat(F.col("stage"), F.lit("_done"))).when(k == "iteration_accepted", "accepted").when(k == "iteration_rejected", "rejected").when(k == "seed_done", "done").when(k == "seed_error", "error")


def seed_states(events: DataFrame) -> DataFrame:
    """(run_id, seed_id, status, stage, last_iteration, error, n_started, last_seq); also for a streaming DataFrame, in complete or update mode.

    One aggregation with partial sums; a hot run or seed meets one row per task in the shuffle.
    """
    seq = F.col("seq")
    at = lambda value, when: F.max_by(value, F.when(when, seq))
    status, stage = _status(), _stage()
    made = F.col("kind").isin("iteration_accepted", "iteration_rejected")
    seeds = events.where(F.col("seed_id").isNotNull() & F.col("kind").isin(*SEED_KINDS)).groupBy("run_id", "seed_id").agg(at(status, status.isNotNull()).alias("status"), at(stage, stage.isNotNull()).alias("stage"), at(F.col("iteration"), made).alias("last_iteration"), at(F.col("error"), F.col("kind") == "seed_error").alias("error"), F.max(F.when(F.col("kind") == "seed_started", 1)).alias("started"), F.max("seq").alias("last_seq"))
    return seeds.where("started = 1").drop("started")


def steps(events: DataFrame) -> DataFrame:
    """(run_id, seed_id, iteration, stage, seq, status, candidate_count, started_at, finished_at): one row per stage_started of a seed's last start.

    A stage_done belongs to the latest step of its iteration and stage that began before it; a later one overrides an earlier. A seed that
    starts again loses its steps. Needs events once each.
    """
    e = events.where(F.col("seed_id").isNotNull() & F.col("kind").isin("seed_started", "stage_started", "stage_done"))
    start = e.where("kind = 'seed_started'").groupBy("run_id", "seed_id").agg(F.max("seq").alias("__start"))
    e = e.join(start, ["run_id", "seed_id"]).where("seq > __start")
    w = Window.partitionBy("run_id", "seed_id", "iteration", "stage").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    e = e.withColumn("__n", F.count(F.when(F.col("kind") == "stage_started", 1)).over(w)).where("__n > 0")
    done, began = F.col("kind") == "stage_done", F.col("kind") == "stage_started"
    out = e.groupBy("run_id", "seed_id", "iteration", "stage", "__n").agg(F.max(F.when(began, F.col("seq"))).alias("seq"), F.max(F.when(done, 1)).alias("d"), F.coalesce(F.max_by("candidate_count", F.when(done & F.col("candidate_count").isNotNull(), F.col("seq"))), F.max(F.when(began, F.col("candidate_count")))).alias("candidate_count"), F.max(F.when(began, F.col("ts"))).alias("started_at"), F.max_by("ts", F.when(done, F.col("seq"))).alias("finished_at"))
    return out.withColumn("status", F.when(F.col("d") == 1, "done").otherwise("running")).drop("__n", "d")


def latest(events: DataFrame, n: int = 1000) -> DataFrame:
    """The last n events of each run by seq. Spark keeps the first n of each task before it shuffles, so a hot run sends few."""
    w = Window.partitionBy("run_id").orderBy(F.col("seq").desc())
    return events.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def progress(events: DataFrame) -> DataFrame:
    """(run_id, seeds, finished, errors, rows, accepted): seeds started, those finished (done, dry_run, rejected or error), rows made."""
    states = seed_states(events).groupBy("run_id").agg(F.count("*").alias("seeds"), F.count_if(F.col("status").isin("done", "dry_run", "rejected", "error")).alias("finished"), F.count_if(F.col("status") == "error").alias("errors"))
    made = events.where("seed_id is not null").groupBy("run_id").agg(F.count_if(F.col("kind").isin("iteration_accepted", "iteration_rejected")).alias("rows"), F.count_if(F.col("kind") == "iteration_accepted").alias("accepted"))
    return made.join(states, "run_id", "left").fillna(0, ["seeds", "finished", "errors"])


def listing(events: DataFrame) -> DataFrame:
    """(run_id, created_at, events, place): runs by their first event, newest first, those without a time last."""
    made = events.groupBy("run_id").agg(F.min("ts").alias("created_at"), F.count("*").alias("events"))
    order = Window.orderBy(F.col("created_at").desc_nulls_last(), "run_id")  # one row a run
    return made.withColumn("place", F.row_number().over(order))


def upload_state(events: DataFrame) -> DataFrame:
    """(run_id, upload): idle, running, done or error, by the last event that tells; a failed run fails an upload under way."""
    k, seq = F.col("kind"), F.col("seq")
    told = F.when(k == "upload_started", "running").when(k == "upload_done", "done")
    out = events.groupBy("run_id").agg(F.max_by(told, F.when(told.isNotNull(), seq)).alias("u"), F.max(F.when(k == "run_failed", seq)).alias("f"))
    return out.select("run_id", F.when((F.col("u") == "running") & F.col("f").isNotNull(), "error").otherwise(F.coalesce("u", F.lit("idle"))).alias("upload"))


def stream_states(spark: SparkSession, path: str, out: str, checkpoint: str, per_trigger: int | None = None) -> DataFrame:
    """Seed states of the events files at path, folded by a stream that takes what is there and ends; states are written to out.

    Each micro-batch updates the states that its events touch (update mode) and appends them with the batch number, so a restart
    repeats a batch under its number; the result reads the latest row of each seed.
    """
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", at.getName()), str(at.getParent())
    states = seed_states(reader.parquet(path))

    def put(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    states.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(out)
    cols = [c for c in kept.columns if c not in ("run_id", "seed_id", "batch")]
    return kept.groupBy("run_id", "seed_id").agg(F.max_by(F.struct(*cols), "batch").alias("s")).select("run_id", "seed_id", "s.*")


def scratch(base: str) -> tuple[str, str]:
    """(output, checkpoint) folders of one streaming run under the shared folder."""
    at = f"{base.rstrip('/')}/weftline-stream-{uuid.uuid4().hex[:12]}"
    return f"{at}/states", f"{at}/checkpoint"
