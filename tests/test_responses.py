"""Response parsing and selection: one row for each trap."""

from pyspark.sql import functions as F

from weftline.operators import responses as r
from weftline.operators import selection
from weftline.settings import Lineage


def labels(s, kind="candidate"):
    return [x for x, _ in r.blocks(s, kind)]


def test_header_styles():
    assert labels("== CANDIDATE 1 ==\nx\n## option no. 2\ny\n**Proposal #3**\nz\nProblem 4:\nw") == ["1", "2", "3", "4"]
    assert labels("1. Correct: yes\n2) Correct: no", "judgement") == ["1", "2"] and labels("1. Correct: yes", "judgement") == []
    assert labels("Judgement", "judgement") == ["ment"] and labels("Candidates:") == ["s"]  # an alias and a label without space
    assert labels("Problem\n42") == ["42"]  # a header may span a line end
    assert labels(None) == labels("") == []


def test_fields_fold():
    got = r.fields("lead\nProblem: a\nb\n**Answer** - 5\nAnswer: 6\nlost\nSolution\nlines\nhere\nParent problem: x\nNotes: no")
    assert got == {"problem": "a\nb", "answer": "5", "solution": "lines\nhere"}
    assert r.heading("1. Correct: yes") == ("correct", "yes") and r.heading("Verdict — accept") == ("decision", "accept") and r.heading("plain") == (None, "")
    assert r.heading("Accepted: no") == ("decision", "no") and r.heading("x" * 70) == (None, "")


def table(spark, texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "key string, response string")


def test_candidates(spark):
    one = "Problem: q\nAnswer: a"
    df = table(spark, [one, f"Candidate 1\n{one}\nCandidate 2\nProblem: only\nCandidate 3\n{one}3", "", None, "nothing"])
    got = sorted((x.key, x.ord, x.label, x.question, x.answer) for x in r.candidate_table(df, "key", "response").collect())
    assert got == [("0", 0, "1", "q", "a"), ("1", 0, "1", "q", "a"), ("1", 1, "3", "q", "a3")]
    assert r.candidate_table(df.limit(0), "key", "response").count() == 0


def test_substitution_needs_equal_counts(spark):
    c = lambda *ks: spark.createDataFrame([(k, i) for i, k in enumerate(ks)], "key string, ord int")
    got = r.substitute(c("a", "a", "b", "c").withColumn("s", F.lit("first")), c("a", "a", "b", "b").withColumn("s", F.lit("new")))
    assert sorted((x.key, x.s) for x in got.collect()) == [("a", "new"), ("a", "new"), ("b", "first"), ("c", "first")]


def test_judging_by_place(spark):
    c = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0)], "key string, ord int")
    texts = spark.createDataFrame([("a", "Judgement 7\nCorrect: yes\nDepth: .5\nDecision:\nJudge Notes: n\nJudgement 9\nCorrect: no\nDecision: Rejected"), ("b", "hm"), ("c", " ")], "key string, response string")
    got = {(x.key, x.ord): x for x in selection.judge(c, r.block_table(texts, "key", "response", "judgement"), texts).collect()}
    assert (got["a", 0].decision, got["a", 0].scores["depth"], got["a", 0].judge_notes) == ("accept", 1.0, "n")
    assert got["a", 1].decision == "rejected" and not got["a", 1].correct
    assert got["b", 0].failure_kind == "judge_unparseable" and got["b", 0].scores == {} and got["c", 0].failure_kind == "judge_empty"


def judged(spark, rows):
    return spark.createDataFrame(rows, "key string, ord int, correct boolean, scores map<string,double>, decision string")


GOOD = {"novelty": 0.5, "depth": 0.5, "seed_alignment": 0.0, "non_stitched": 0.7, "solution_economy": 0.5}


def test_gate(spark):
    rows = [("a", 0, True, GOOD, "accept"), ("a", 1, True, GOOD, "reject."), ("a", 2, True, GOOD, "reject"), ("a", 3, False, GOOD, "accept"), ("a", 4, True, {}, "accept"), ("a", 5, None, GOOD, None)]
    got = [x.p for x in judged(spark, rows).orderBy("ord").select(selection.passes().alias("p")).collect()]
    assert got == [True, True, False, False, False, False]
    assert judged(spark, rows[3:4]).select(selection.passes(Lineage(min_correctness=0.9)).alias("p")).first().p


def test_best_of_each_key(spark):
    low = GOOD | {"depth": 0.46}
    rows = [("a", 0, True, low, "accept"), ("a", 1, True, GOOD, "accept"), ("a", 2, True, GOOD, "accept"), ("b", 0, False, GOOD, "accept"), ("b", 1, False, {}, "reject")]
    got = {x.key: (x.ord, x.accepted, x.role) for x in selection.select(judged(spark, rows)).collect()}
    assert got == {"a": (1, True, "generated"), "b": (0, False, "rejected")}
    again = {x.key: x.role for x in selection.select(judged(spark, rows), Lineage(continue_on_rejected=True)).collect()}
    assert again["b"] == "generated" and selection.select(judged(spark, [])).count() == 0


def test_failed_directions(spark):
    df = spark.createDataFrame([([(False, "x", "k", "t", "q"), (True, "accept", "", "t", "q"), (True, "reject", "", "", "q" * 200), (None, None, None, None, None), (False, "", "", "u", "")],)], "c array<struct<correct:boolean,decision:string,failure_kind:string,transformation:string,question:string>>")
    assert df.select(selection.failed_directions("c").alias("x")).first().x == ["k: t", "rejected: " + "q" * 160, "rejected: "]
