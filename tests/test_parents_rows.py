"""Parents, rows, unions, memory, tables, caches, a whole generation."""

import pytest
from pyspark.sql import functions as F

from weftline.operators import memory, parents, rows
from weftline.operators.completions import StubCompleter, call, complete_cached, embed_cached
from weftline.plans.evolve import evolve
from weftline.settings import Config, Models, load_config, same_dataset, write_config
from weftline.sources import cache, tables


def texts(df):
    return sorted(r.question_text for r in df.collect())


def test_latest_generation(spark):
    df = spark.createDataFrame([("a", "x", "1", "generated", True), ("b", "x", "2", "generated", True), ("c", "x", "3", "Rejected ", True), ("d", "x", "3", None, False), ("e", " ", "2", None, None), (None, "x", "2", None, None)], "question string, answer string, iteration string, role string, accepted boolean")
    got = parents.candidates(df)
    assert texts(got) == ["b"] and got.first().next_iteration == 3
    assert parents.candidates(df.withColumn("iteration", F.lit("none"))).count() == 0  # a column without any number: no parents
    assert texts(parents.candidates(df.drop("iteration"))) == ["a", "b"] and parents.candidates(df.drop("iteration")).first().source_iteration == 0
    newest = spark.createDataFrame([("a", "x", 1), ("", "x", 2)], "question string, answer string, iteration int")
    assert parents.candidates(newest).count() == 0  # the newest generation counts even if its texts are blank
    clash = newest.withColumn("source_iteration", F.lit(9)).withColumn("question_text", F.lit("z"))
    assert parents.candidates(clash.where("iteration = 1")).first().source_iteration == 1
    with pytest.raises(ValueError, match="question"):
        parents.candidates(df.drop("question"))


def test_loose_acceptance(spark):
    df = spark.createDataFrame([(x,) for x in ("False", "0", "0.0", " no", "rejected", "yes", None, "")], "accepted string")
    assert [r.e for r in df.select(parents.eligible(df).alias("e")).collect()] == [False, False, True, False, False, True, True, True]


def test_sample(spark):
    df = spark.createDataFrame([(str(i), f"t{i}") for i in range(50)], "source_id string, t string")
    first = [(r.source_id, r.seed_index) for r in parents.sample(df, 10, 3).orderBy("seed_index").collect()]
    again = [(r.source_id, r.seed_index) for r in parents.sample(df.repartition(7), 10, 3).orderBy("seed_index").collect()]
    assert first == again and [i for _, i in first] == list(range(10)) and first != [(r.source_id, r.seed_index) for r in parents.sample(df, 10, 4).orderBy("seed_index").collect()]
    assert parents.sample(df, 0).count() == 0 and parents.sample(df, -48).count() == 2 and parents.sample(df, 99).count() == 50


def test_source_id_and_memory(spark):
    df = spark.createDataFrame([(0, "", "p", None, '{"a":1}'), (5, "r", "p", "", "j")], "id int, row_id string, problem_id string, memory string, memory_json string")
    assert [r.s for r in df.select(parents.source_id(df).alias("s")).collect()] == ["p", "5"]
    assert [r.m for r in df.select(parents.memory(df, "notes").alias("m")).collect()] == ['{"a":1}', ""]


def test_run_memory_against_lists(spark):
    got = []
    given = [("r", i * 3, None if i % 5 == 2 else f"l{i}") for i in range(60)] + [("s", 1, "x"), (None, 1, "y")]
    df = spark.createDataFrame(given, "run string, seq long, lesson string")
    for n in (1, 4):
        told = [x for _, _, x in given[:60] if x]
        want = {x: told[max(0, k - n) : k] for k, x in enumerate(told)}
        got = {r.lesson: r.memory for r in memory.run_memory(df, n, width=7).where("run = 'r'").collect()}
        assert got == want
    assert memory.run_memory(df.limit(0)).count() == 0


def test_aligned_union_keeps_everything(spark):
    a = spark.createDataFrame([(1, ["x"])], "b int, a array<string>")
    b = spark.createDataFrame([("q", 1), ("q", 1)], "c string, b int")
    u = rows.aligned_union(a, b)
    assert u.columns == ["a", "b", "c"] and u.count() == 3 and u.where("c is null").first().a == '["x"]'


def test_versioned_publishing(spark, tmp_path):
    cfg = Config.of({"input": {"dataset": "D"}, "output": {"dataset": " d "}})
    t = tables.VersionedTable(spark, str(tmp_path / "t"))
    r = spark.createDataFrame([("source", "q", "a"), ("generated", "q2", "a2")], "role string, question string, answer string")
    t.replace(r.limit(1).select(F.lit("base").alias("question")))
    tables.publish(t, r, cfg)
    assert sorted(x.question for x in t.read().collect()) == ["base", "q2"] and t.version() == 2
    cfg.output.dataset = "other"
    tables.publish(t, r, cfg)  # another data set gets all rows, source rows too
    assert sorted(x.question for x in t.read().collect()) == ["q", "q2"]
    with pytest.raises(ValueError, match="no rows"):
        tables.publish(t, r.limit(0), cfg)
    tables.write_jsonl(r, str(tmp_path / "j"), files=1)
    assert tables.scan(spark, str(tmp_path / "j"), "json").count() == 2


def test_cache(spark, tmp_path):
    c = cache.Cache(spark, str(tmp_path / "c"))
    req = spark.createDataFrame([("aa1",), ("bb2",), ("cc3",)], "key string")
    assert c.split(req)[1].count() == 3
    c.put(spark.createDataFrame([("aa1", "old", "", "", 1.0), ("aa1", "new", "", "", 2.0), ("bb2", "  ", "", "", 1.0)], "key string, content string, finish_reason string, usage string, t double"))
    hits, misses = c.split(req)
    assert [r.content for r in hits.collect()] == ["new"] and sorted(r.key for r in misses.collect()) == ["bb2", "cc3"]


def test_calls_retry():
    waits, tries = [], []

    def flaky(stage, prompt):
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("busy")
        return "ok"

    assert call(flaky, "s", "p", waits.append) == ("ok", None, 3) and waits == [1.0, 2.0]

    def refused(stage, prompt):
        raise RuntimeError("Invalid API key")

    assert call(refused, "s", "p", waits.append) == (None, "Invalid API key", 1)


def test_cached_calls_and_vectors(spark, tmp_path):
    def shout(stage, prompt):
        if prompt == "bad":
            raise RuntimeError("unauthorized")
        return "" if prompt == "mute" else prompt.upper()

    store = cache.Cache(spark, str(tmp_path / "c"))
    req = spark.createDataFrame([("aa1", "x"), ("aa1", "x"), ("bb2", "bad"), ("cc3", "mute")], "key string, prompt string")
    assert {r.key: r.content for r in complete_cached(req, "s", shout, store).collect()} == {"aa1": "X", "bb2": None, "cc3": ""}
    assert [r.key for r in store.split(req)[0].select("key").distinct().collect()] == ["aa1"]  # blanks and failures are not kept
    again = complete_cached(req, "s", lambda stage, prompt: "other", store)
    assert {r.key: r.content for r in again.collect()} == {"aa1": "X", "bb2": "other", "cc3": "other"}
    vectors = cache.Cache(spark, str(tmp_path / "v"), cache.EMBEDDINGS, "embedding")
    texts = spark.createDataFrame([("a",), ("a",), ("bcd",), (None,)], "text string")
    first = embed_cached(texts, "m", lambda ts: [[float(len(t))] for t in ts], vectors)
    assert sorted(r.embedding for r in first.collect()) == [[1.0], [3.0]]
    assert sorted(r.embedding for r in embed_cached(texts, "m", lambda ts: [[9.0]] * len(ts), vectors).collect()) == [[1.0], [3.0]]


def test_generation(spark):
    class Failing(StubCompleter):
        def __call__(self, stage, prompt):
            if "broken" in prompt and stage == "generate":
                return "nothing of use"
            return super().__call__(stage, prompt)

    df = spark.createDataFrame([(f"i{k}", "broken" if k == 2 else f"What is {k}?", str(k), 0) for k in range(6)], "id string, question string, answer string, iteration int")
    cfg = Config.of({"input": {"dataset": "d"}})
    whole = evolve(df, cfg, Failing())
    waves = evolve(df, cfg, Failing(), wave=2)
    for r in (whole, waves):
        s = r.summary
        assert (s["source_rows"], s["generated_rows"] + s["rejected_steps"], len(s["errors"]), s["current_iteration"]) == (6, 5, 1, 1)
        made = r.rows.where("role <> 'source'").collect()
        sources = {x.id for x in r.rows.where("role = 'source'").collect()}
        assert all(x.parent_id in sources and x.iteration == 1 and x.source_question for x in made)
    assert len(waves.summary["global_memory"]) == 5
    cfg.runtime.dry_run = True
    dry = evolve(df, cfg, Failing())
    assert dry.summary["total_rows"] == dry.summary["source_rows"] == 6


def test_settings(tmp_path):
    cfg = Config.of({"input": {"dataset": "d", "config_name": " "}, "models": {"default": "m", "generators": ["g"], "what": 1}, "more": 2})
    assert (cfg.models.generator, cfg.models.refiner, cfg.models.judge, cfg.output.dataset, cfg.input.config_name) == ("g", "g", "m", "d", None)
    write_config(tmp_path / "c.yaml", cfg)
    assert load_config(tmp_path / "c.yaml").as_dict() == cfg.as_dict()
    for bad in ({"lineage": {"candidates_per_iteration": 9}}, {"lineage": {"min_depth": 2}}, {"input": {"dataset": "d", "max_seeds": 0}}):
        with pytest.raises(ValueError):
            Config.of({"input": {"dataset": "d"}} | bad)
    assert Models().judge == "stub" and same_dataset("A ", "a") and not same_dataset("", "")
