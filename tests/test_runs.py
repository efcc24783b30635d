"""Run states: batch, stream and a fold event by event."""

import random

from weftline.streaming import runs

SCHEMA = "event_id long, run_id string, seq long, ts timestamp, seed_id string, iteration int, kind string, stage string, candidate_count int, status string, error string"


def events(n, seed):
    import datetime as dt

    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(["seed_started", "stage_started", "stage_started", "stage_done", "stage_done", "iteration_accepted", "iteration_rejected", "seed_done", "seed_error", "run_started"])
        staged = kind.startswith("stage")
        out.append((i, rng.choice("rs"), i, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i), rng.choice(["a", "b", None]), rng.choice([1, 2, None]), kind, rng.choice(["generate", "judge"]) if staged else None, rng.choice([None, 3]) if staged else None, rng.choice([None, "rejected"]) if kind == "seed_done" else None, "e" if kind == "seed_error" else None))
    return out


def fold(rows):
    seeds = {}
    for _, run, seq, ts, seed, it, kind, stage, count, status, error in sorted(rows, key=lambda r: r[2]):
        if seed is None:
            continue
        key = (run, seed)
        if kind == "seed_started":
            seeds[key] = {"status": "running", "stage": "queued", "steps": []}
        elif s := seeds.get(key):
            if kind == "stage_started":
                s["status"], s["stage"] = "running", stage
                s["steps"].append([it, stage, seq, "running", count])
            elif kind == "stage_done":
                s["stage"] = f"{stage}_done"
                for step in reversed(s["steps"]):
                    if step[:2] == [it, stage]:
                        step[3] = "done"
                        step[4] = step[4] if count is None else count
                        break
            elif kind.startswith("iteration"):
                s["stage"] = kind[10:]
            elif kind == "seed_done":
                s["status"], s["stage"] = status or "done", "done"
            elif kind == "seed_error":
                s["status"] = s["stage"] = "error"
    return seeds


def test_states_and_steps_against_the_fold(spark):
    for seed in range(3):
        rows = events(250, seed)
        df = spark.createDataFrame(rows, SCHEMA)
        want = fold(rows)
        got = {(r.run_id, r.seed_id): (r.status, r.stage) for r in runs.seed_states(df).collect()}
        assert got == {k: (s["status"], s["stage"]) for k, s in want.items()}
        steps = sorted((r.run_id, r.seed_id, r.seq, r.status, r.candidate_count) for r in runs.steps(df).collect())
        assert steps == sorted((*k, s[2], s[3], s[4]) for k, v in want.items() for s in v["steps"])


def test_stream_equals_batch(spark, tmp_path):
    rows = events(200, 9)
    late = rows[:]
    random.Random(1).shuffle(late)
    spark.createDataFrame(late + [(1000 + i, *r[1:]) for i, r in enumerate(late[:40])], SCHEMA).repartition(6).write.parquet(str(tmp_path / "e"))
    got = runs.stream_states(spark, str(tmp_path / "e"), str(tmp_path / "o"), str(tmp_path / "c"), per_trigger=2)
    key = lambda r: (r.run_id, r.seed_id, r.status, r.stage, r.last_seq)
    assert sorted(map(key, got.collect())) == sorted(map(key, runs.seed_states(spark.createDataFrame(rows, SCHEMA)).collect()))
    spark.createDataFrame([(5000, "r", 5000, None, "a", 1, "seed_started", None, None, None, None)], SCHEMA).write.mode("append").parquet(str(tmp_path / "e"))
    more = runs.stream_states(spark, str(tmp_path / "e"), str(tmp_path / "o"), str(tmp_path / "c"))  # goes on where it stopped
    assert [(r.status, r.stage) for r in more.where("run_id = 'r' and seed_id = 'a'").collect()] == [("running", "queued")]


def test_once_retention_progress_upload(spark):
    rows = events(60, 4)
    df = spark.createDataFrame(rows + [(900 + i, *r[1:4], None, *r[5:]) for i, r in enumerate(rows[:20])], SCHEMA)
    assert runs.once(df).count() == 60 and runs.once(df).where("seed_id is null").count() == sum(r[4] is None for r in rows)
    kept = runs.latest(runs.once(df), 5).collect()
    assert {r.seq for r in kept if r.run_id == "r"} == set(sorted(r[2] for r in rows if r[1] == "r")[-5:])
    assert {r.run_id for r in runs.progress(runs.once(df)).collect()} == {"r", "s"}
    up = spark.createDataFrame([(1, "a", 1, None, None, None, "upload_started", None, None, None, None), (2, "a", 2, None, None, None, "run_failed", None, None, None, None), (3, "b", 1, None, None, None, "upload_done", None, None, None, None), (4, "c", 1, None, None, None, "run_done", None, None, None, None)], SCHEMA)
    assert {r.run_id: r.upload for r in runs.upload_state(up).collect()} == {"a": "error", "b": "done", "c": "idle"}
    assert runs.seed_states(df.limit(0)).count() == runs.steps(df.limit(0)).count() == 0
