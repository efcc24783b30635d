"""Queries for the engine's own operators over the given tables, each with independent SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import ids, salvage, text
from weftline.operators import memory, parents, responses, rows, selection
from weftline.plans import evolve
from weftline.operators.completions import StubCompleter
from weftline.runtime import Workspace, prepare, shared_dir
from weftline.settings import Config, Lineage
from weftline.sources import cache, tables
from weftline.streaming import runs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/{name}.parquet")


_W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


_NO = "('false', '0', 'no', 'rejected')"
_PARENTS = f"""
ok AS (SELECT * FROM lineage_rows WHERE coalesce(lower({_strip('role')}), '') <> 'rejected' AND coalesce(accepted, true)),
par AS (SELECT id, iteration AS source_iteration, iteration + 1 AS next_iteration, coalesce({_strip('question')}, '') AS question_text, coalesce({_strip('answer')}, '') AS answer_text
  FROM ok WHERE iteration = (SELECT max(iteration) FROM ok)),
parents AS (SELECT * FROM par WHERE question_text <> '' AND answer_text <> '')"""


@query(f"WITH {_PARENTS} SELECT id, source_iteration, next_iteration, question_text, answer_text FROM parents")
def parents_latest_generation(spark, d):
    """Eligible rows of the latest generation."""
    return parents.candidates(_read(spark, d, "lineage_rows")).select("id", "source_iteration", "next_iteration", "question_text", "answer_text")


@query(f"WITH {_PARENTS} SELECT id, question_text, CAST(row_number() OVER (ORDER BY sha256(concat_ws(':', '7', id)), id) - 1 AS INT) AS seed_index FROM parents ORDER BY seed_index LIMIT 100")
def parents_seeded_sample(spark, d):
    """A reproducible sample of 100 parents with their places."""
    found = parents.candidates(_read(spark, d, "lineage_rows"))
    return parents.sample(found.select(parents.source_id(found).alias("id"), "question_text"), 100, 7, "id")


@query(f"""SELECT row_id, problem_id, 0 AS source_iteration, 1 AS next_iteration, {_strip('question')} AS question_text FROM seed_records
WHERE coalesce(lower({_strip('accepted')}) NOT IN {_NO}, true) AND coalesce({_strip('question')}, '') <> '' AND coalesce({_strip('answer')}, '') <> ''""")
def parents_no_iteration_column(spark, d):
    """Raw seeds: without an iteration column every eligible row is a parent of generation 1."""
    return parents.candidates(_read(spark, d, "seed_records").drop("iteration")).select("row_id", "problem_id", "source_iteration", "next_iteration", "question_text")


@query(f"SELECT row_id, problem_id, accepted, coalesce(lower({_strip('accepted')}) NOT IN {_NO}, true) AS eligible FROM seed_records")
def parent_eligibility_matrix(spark, d):
    """Loose spellings of accepted."""
    s = _read(spark, d, "seed_records")
    return s.select("row_id", "problem_id", "accepted", parents.eligible(s).alias("eligible"))


@query(r"SELECT row_id, problem_id, TRY_CAST(nullif(regexp_extract(iteration, '-?\d+'), '') AS INT) AS iteration FROM seed_records")
def iteration_parse(spark, d):
    """Iterations out of loose cells."""
    s = _read(spark, d, "seed_records")
    return s.select("row_id", "problem_id", text.parse_iteration(F.col("iteration"), s.schema["iteration"].dataType).alias("iteration"))


@query(f"SELECT id, coalesce({_strip('memory')}, {_strip('memory_json')}, '') AS memory FROM lineage_rows")
def memory_coalesce(spark, d):
    """Memory of a row: text, else JSON."""
    s = _read(spark, d, "lineage_rows")
    return s.select("id", parents.memory(s, "memory").alias("memory"))


@query("SELECT coalesce(nullif(row_id, ''), nullif(problem_id, ''), dataset) AS source_id, count(*) AS n FROM seed_records GROUP BY 1")
def source_id_fallback(spark, d):
    """Keys of raw seeds, the data set standing in for the ordinal."""
    s = _read(spark, d, "seed_records")
    return s.groupBy(parents.source_id(s, F.col("dataset")).alias("source_id")).agg(F.count("*").alias("n"))


@query(f"""SELECT doc_id, CASE WHEN length(t) <= 500 THEN t ELSE regexp_replace(substring(t, 1, 380), '{_W}+$', '') || chr(10) || '...[trimmed]...' || chr(10) || regexp_replace(right(t, 100), '^{_W}+', '') END AS text
FROM (SELECT doc_id, coalesce({_strip('text')}, '') AS t FROM documents)""")
def trim_middle(spark, d):
    """Long texts without their middle."""
    return _read(spark, d, "documents").select("doc_id", text.trim_middle("text", 500).alias("text"))


def _first_key(j: str) -> str:
    return "CASE " + " ".join(f"WHEN json_exists({j}, '$.{k}') THEN coalesce({_strip(f'''json_extract_string({j}, '$.{k}')''')}, '')" for k in ("solution", "answer", "text", "content", "markdown")) + " END"


@query(f"""WITH s AS (SELECT row_number() OVER () AS n, row_id, problem_id, question, CASE WHEN json_valid(question) THEN json_type(question) END AS kind FROM seed_records),
items AS (SELECT s.n, string_agg(t, chr(10) || chr(10) ORDER BY i) AS joined FROM s, LATERAL (
  SELECT CAST(e.key AS INT) AS i, CASE WHEN json_type(e.value) = 'OBJECT' THEN {_first_key('e.value')} ELSE {_strip("json_extract_string(e.value, '$')")} END AS t FROM json_each(s.question) e) x
  WHERE kind = 'ARRAY' AND t <> '' GROUP BY s.n)
SELECT row_id, problem_id, CASE kind WHEN 'OBJECT' THEN {_first_key('question')} WHEN 'ARRAY' THEN coalesce({_strip('joined')}, '') ELSE coalesce({_strip('question')}, '') END AS question
FROM s LEFT JOIN items USING (n)""")
def field_text_json(spark, d):
    """Questions given as text, object or list."""
    return _read(spark, d, "seed_records").select("row_id", "problem_id", text.json_field_text("question").alias("question"))


@query("""SELECT doc_id, trim(regexp_replace(lower(source), '[^a-z0-9]+', ' ', 'g')) AS source_label, CASE trim(regexp_replace(lower(doc_kind), '[^a-z0-9]+', ' ', 'g')) WHEN 'problem' THEN 'problem' WHEN 'solution' THEN 'solution' END AS heading FROM documents""")
def label_normalise(spark, d):
    """Labels in one spelling, and the headings among them."""
    return _read(spark, d, "documents").select("doc_id", text.normal_label("source").alias("source_label"), text.canonical_heading("doc_kind").alias("heading"))


@query(r"SELECT doc_id, greatest(0.0, least(1.0, coalesce(TRY_CAST(nullif(regexp_extract(text, '-?\d+(?:\.\d+)?'), '') AS DOUBLE), 0.0))) AS score FROM documents")
def score_extract_clamp(spark, d):
    """First number of each text as a score."""
    return _read(spark, d, "documents").select("doc_id", text.score("text").alias("score"))


@query(f"SELECT row_id, problem_id, starts_with(t, 'yes') OR starts_with(t, 'true') OR starts_with(t, '1') OR starts_with(t, 'correct') AS flag FROM (SELECT *, lower({_strip('''coalesce(accepted, '')''')}) AS t FROM seed_records)")
def flag_parse(spark, d):
    """Yes or no out of loose cells."""
    return _read(spark, d, "seed_records").select("row_id", "problem_id", text.flag("accepted").alias("flag"))


def _responses(spark, d, field: str) -> DataFrame:
    v = F.try_variant_get(F.try_parse_json("artifacts_json"), f"$.{field}", "string")
    return _read(spark, d, "lineage_rows").select("id", v.alias("response")).where("response is not null").distinct()


#: What the SQL expects of headings and header words, kept apart from the tables under test.
_EXPECTED_HEADINGS = """
transformation: transformation, mutation, change, what changed
problem: problem, question, new problem, proposed problem, generated problem
answer: answer, final answer, result
solution: solution, proof, full solution
why it is new: why it is new, why new, why this is new, why sharper
failure risk: failure risk, risk, risks
correct: correct, correctness, mathematical correctness
novelty: novelty, novelty score
depth: depth, depth score, quality
seed alignment: seed alignment, alignment
non stitched: non stitched, nonstitched, not stitched
solution economy: solution economy, economy
decision: decision, verdict, accepted
failure kind: failure kind, failure reason, rejection reason
notes: notes, reason, judge notes, explanation
meta: parent problem, parent answer, parent lineage problem, dataset memory, dataset memory stored on the parent row, memory from earlier rows in this run, target iteration, candidates, candidates to refine
"""
_EXPECTED_WORDS = {"candidate": "candidate|option|proposal|problem", "refined": "refined|candidate|option|proposal|problem", "judgement": "judgement|judgment|judge|review|evaluation|candidate"}
_HEADS = "heads(alias, name) AS (VALUES " + ", ".join(f"('{a.strip()}', '{line.split(':')[0]}')" for line in _EXPECTED_HEADINGS.strip().splitlines() for a in line.split(":")[1].split(",")) + ")"


def _parse_sql(p: str, field: str, kind: str) -> str:
    """CTEs p_blocks (id, ord, label, block) and p_fields (id, ord, key, value): marks are taken off whole lines, names looked up in a table."""
    named = rf"(?i)^(?:{_EXPECTED_WORDS[kind]})\s*(?:#|no\.?|number)?\s*([a-z0-9_.-]+)\s*[:.)]?$"
    first = "least(" + ", ".join(f"coalesce(nullif(strpos(bare, '{x}'), 0), 999)" for x in (":", " -", " –", " —")) + ")"
    return rf"""
{p}_resp AS (SELECT DISTINCT id, json_extract_string(artifacts_json, '$.{field}') AS response FROM lineage_rows WHERE json_valid(artifacts_json) AND json_type(artifacts_json, '$.{field}') = 'VARCHAR'),
{p}_split AS (SELECT id, i AS pos, string_split(response, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(response, chr(10))) + 1)) AS i FROM {p}_resp)),
{p}_lines AS (SELECT *, count(label) OVER (PARTITION BY id ORDER BY pos) AS b FROM (SELECT *, nullif(regexp_extract(trim(line, ' =#*' || chr(9)), '{named}', 1), '') AS label FROM {p}_split)),
{p}_blocks AS (SELECT id, CAST(b - 1 AS INT) AS ord, max(label) AS label, {_strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (label IS NULL), '')")} AS block FROM {p}_lines WHERE b > 0 GROUP BY id, b),
{p}_bare AS (SELECT id, b, pos, line, trim(regexp_replace(replace(replace(line, '**', ''), '__', ''), '^\s*([-*+]|[0-9]+[.)])\s+', '')) AS bare FROM {p}_lines WHERE b > 0 AND label IS NULL),
{p}_parts AS (SELECT id, b, pos, line, 1 AS turn, left(bare, {first} - 1) AS name, trim(ltrim(substr(bare, {first}), ' :-–—')) AS rest FROM {p}_bare WHERE {first} BETWEEN 2 AND 61 UNION ALL SELECT id, b, pos, line, 2, rtrim(bare, ':'), '' FROM {p}_bare WHERE length(bare) <= 61),
{p}_found AS (SELECT id, b, pos, min_by(h.name, turn) AS key, min_by(rest, turn) AS rest FROM {p}_parts x JOIN heads h ON h.alias = trim(regexp_replace(lower(x.name), '[^a-z0-9]+', ' ', 'g')) GROUP BY id, b, pos),
{p}_seen AS (SELECT b.id, b.b, b.pos, b.line, f.key, f.rest, max(CASE WHEN f.key IS NOT NULL THEN b.pos END) OVER w AS head, max(CASE WHEN f.key = 'meta' THEN 1 ELSE 0 END) OVER w AS over FROM {p}_bare b LEFT JOIN {p}_found f USING (id, b, pos) WINDOW w AS (PARTITION BY b.id, b.b ORDER BY b.pos)),
{p}_values AS (SELECT id, b, head, max(key) AS key, {_strip("string_agg(CASE WHEN pos = head THEN rest ELSE line END, chr(10) ORDER BY pos)")} AS value FROM {p}_seen WHERE over = 0 AND head IS NOT NULL GROUP BY id, b, head),
{p}_fields AS (SELECT id, CAST(b - 1 AS INT) AS ord, key, min_by(value, head) AS value FROM {p}_values GROUP BY id, b, key)"""


@query(f"WITH {_HEADS}, {_parse_sql('g', 'raw_generation_response', 'candidate')} SELECT id, ord, label, block FROM g_blocks")
def block_split(spark, d):
    """Numbered blocks of the generation responses."""
    return responses.block_table(_responses(spark, d, "raw_generation_response"), "id", "response").select(F.col("key").alias("id"), "ord", "label", "block")


@query(f"WITH {_HEADS}, {_parse_sql('g', 'raw_generation_response', 'candidate')} SELECT id, ord, key AS field, value FROM g_fields")
def field_parse(spark, d):
    """Fields of those blocks, one row each."""
    b = responses.block_table(_responses(spark, d, "raw_generation_response"), "id", "response")
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f.replace(" ", "_")).alias("value")) for f in responses.FIELDS])).alias("f")
    return b.select(F.col("key").alias("id"), "ord", long).select("id", "ord", "f.field", "f.value").where("value is not null")


_CAND = """
{p}_all AS (SELECT id, ord, max(CASE WHEN key = 'problem' THEN value END) AS question, max(CASE WHEN key = 'answer' THEN value END) AS answer, coalesce(max(CASE WHEN key = 'transformation' THEN value END), '') AS transformation FROM {p}_fields GROUP BY id, ord),
{p}_cand AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS INT) AS ord, question, answer, transformation FROM {p}_all WHERE question <> '' AND answer <> '')"""


@query(f"WITH {_HEADS}, {_parse_sql('g', 'raw_generation_response', 'candidate')}, {_CAND.format(p='g')} SELECT id, ord, question, answer, transformation FROM g_cand")
def candidates_complete(spark, d):
    """Candidates with a problem and an answer."""
    return responses.candidate_table(_responses(spark, d, "raw_generation_response"), "id", "response").select(F.col("key").alias("id"), "ord", "question", "answer", "transformation")


#: Lines that would read as headings, with which a round trip can't be whole.
_HEADING = "(?im)^[ \\t*_-]*(?:" + "|".join(sorted((a.strip() for x in _EXPECTED_HEADINGS.strip().splitlines()[:-1] for a in x.split(":")[1].split(",")), key=len, reverse=True)) + ")[*_]*[ \\t]*(?::|[ \\t][-–—]|$)"


@query(f"""WITH {_HEADS}, {_parse_sql('g', 'raw_generation_response', 'candidate')}, {_CAND.format(p='g')} SELECT id, ord, question, answer, transformation FROM g_cand
WHERE id NOT IN (SELECT id FROM g_cand WHERE regexp_matches(question, '{_HEADING}') OR regexp_matches(answer, '{_HEADING}') OR regexp_matches(transformation, '{_HEADING}'))""")
def format_parse_roundtrip(spark, d):
    """Candidates written as text and read again are the same, where no line of theirs reads as a heading."""
    c = responses.candidate_table(_responses(spark, d, "raw_generation_response"), "id", "response")
    bad = c.where(F.col("question").rlike(_HEADING) | F.col("answer").rlike(_HEADING) | F.col("transformation").rlike(_HEADING)).select("key")
    c = c.join(bad, "key", "left_anti")
    packed = c.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "transformation", "question", "answer", "solution", "why_new", "risk"))).alias("candidates"))
    again = responses.candidate_table(packed.select("key", responses.format_candidates("candidates").alias("response")), "key", "response")
    return again.select(F.col("key").alias("id"), "ord", "question", "answer", "transformation")


@query(f"""WITH {_HEADS}, {_parse_sql('g', 'raw_generation_response', 'candidate')}, {_CAND.format(p='g')}, {_parse_sql('j', 'raw_judgement_response', 'judgement')},
jb AS (SELECT b.id, b.ord, coalesce(max(CASE WHEN f.key = 'correct' THEN f.value END), '') AS c, coalesce(max(CASE WHEN f.key = 'novelty' THEN f.value END), '') AS n, lower(coalesce(max(CASE WHEN f.key = 'decision' THEN f.value END), '')) AS dec,
  coalesce(max(CASE WHEN f.key = 'notes' THEN f.value END), '') AS notes FROM j_blocks b LEFT JOIN j_fields f ON f.id = b.id AND f.ord = b.ord GROUP BY b.id, b.ord),
nb AS (SELECT id, count(*) AS k FROM j_blocks GROUP BY id),
x AS (SELECT c.id, c.ord, jb.id IS NOT NULL AS judged, coalesce(regexp_matches(lower(jb.c), '^(yes|true|1|correct)'), false) AS correct, jb.n, jb.dec, jb.notes, nb.k FROM g_cand c LEFT JOIN jb ON jb.id = c.id AND jb.ord = c.ord LEFT JOIN nb ON nb.id = c.id)
SELECT id, ord, correct, CASE WHEN judged THEN greatest(0.0, least(1.0, coalesce(TRY_CAST(nullif(regexp_extract(n, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE), 0.0))) END AS novelty,
  CASE WHEN NOT judged THEN 'reject' WHEN dec <> '' THEN dec WHEN correct THEN 'accept' ELSE 'reject' END AS decision,
  CASE WHEN judged THEN notes ELSE 'no judgement block for this candidate' END AS judge_notes, CASE WHEN NOT judged THEN CASE WHEN k IS NOT NULL THEN 'judge_missing' ELSE 'judge_unparseable' END END AS missing FROM x""".replace("\\\\", "\\"))
def judgement_positional_join(spark, d):
    """The i-th judgement for the i-th candidate."""
    c = responses.candidate_table(_responses(spark, d, "raw_generation_response"), "id", "response")
    j = responses.block_table(_responses(spark, d, "raw_judgement_response"), "id", "response", "judgement")
    judged = selection.judge(c, j)
    return judged.select(F.col("key").alias("id"), "ord", "correct", F.try_element_at("scores", F.lit("novelty")).alias("novelty"), "decision", "judge_notes", F.when(F.col("failure_kind").startswith("judge_"), F.col("failure_kind")).alias("missing"))


@query(f"""WITH {_HEADS}, {_parse_sql('g', 'raw_generation_response', 'candidate')}, {_CAND.format(p='g')}, {_parse_sql('r', 'raw_refinement_response', 'refined')}, {_CAND.format(p='r')},
same AS (SELECT id FROM (SELECT id, count(*) AS n FROM g_cand GROUP BY id) JOIN (SELECT id, count(*) AS m FROM r_cand GROUP BY id) USING (id) WHERE n = m)
SELECT id, ord, question, answer FROM r_cand WHERE id IN (SELECT id FROM same) UNION ALL SELECT id, ord, question, answer FROM g_cand WHERE id NOT IN (SELECT id FROM same)""")
def refine_substitution(spark, d):
    """Refined candidates where there are as many as first ones."""
    first = responses.candidate_table(_responses(spark, d, "raw_generation_response"), "id", "response")
    refined = responses.candidate_table(_responses(spark, d, "raw_refinement_response"), "id", "response", "refined")
    return responses.substitute(first, refined).select(F.col("key").alias("id"), "ord", "question", "answer")


def _judged(spark, d) -> DataFrame:
    """Judged candidates out of artifacts_json: key, ord, correct, scores, decision, failure_kind, transformation, question."""
    r = _read(spark, d, "lineage_rows").select("id", "artifacts_json").distinct()
    v = r.select("id", F.posexplode(F.try_variant_get(F.try_parse_json("artifacts_json"), "$.candidates", "array<variant>")).alias("ord", "v"))
    got = lambda path, kind: F.try_variant_get("v", f"$.{path}", kind)
    scores = F.map_filter(F.create_map(*[x for s in selection.SCORES for x in (F.lit(s), got(f"scores.{s}", "double"))]), lambda k, x: x.isNotNull())
    v = v.where(F.schema_of_variant("v").startswith("OBJECT"))
    return v.select(F.col("id").alias("key"), "ord", F.coalesce(got("correct", "boolean"), F.lit(False)).alias("correct"), scores.alias("scores"), F.coalesce(got("decision", "string"), F.lit("")).alias("decision"), got("failure_kind", "string").alias("failure_kind"), F.coalesce(got("transformation", "string"), F.lit("")).alias("transformation"), F.coalesce(got("question", "string"), F.lit("")).alias("question"), F.coalesce(got("judge_notes", "string"), F.lit("")).alias("judge_notes"), F.coalesce(got("why_new", "string"), F.lit("")).alias("why_new"))


def _num(k: str) -> str:
    return f"coalesce(TRY_CAST(json_extract_string(v, '$.scores.{k}') AS DOUBLE), 0.0) AS {k}"


_JUDGED = f"""
arr AS (SELECT DISTINCT id, artifacts_json AS j FROM lineage_rows WHERE json_valid(artifacts_json) AND json_type(artifacts_json, '$.candidates') = 'ARRAY'),
el AS (SELECT id, CAST(key AS INT) AS ord, value AS v FROM (SELECT arr.id, e.key, e.value FROM arr, json_each(arr.j, '$.candidates') e) WHERE json_type(value) = 'OBJECT'),
judged AS (SELECT id, ord, {", ".join(_num(k) for k in ("novelty", "depth", "seed_alignment", "non_stitched", "solution_economy"))}, coalesce(json_extract_string(v, '$.correct') = 'true', false) AS correct, coalesce(json_extract_string(v, '$.decision'), '') AS decision,
  coalesce(json_extract_string(v, '$.failure_kind'), '') AS failure_kind, coalesce(json_extract_string(v, '$.transformation'), '') AS transformation, coalesce(json_extract_string(v, '$.question'), '') AS question,
  coalesce(json_extract_string(v, '$.judge_notes'), '') AS judge_notes, coalesce(json_extract_string(v, '$.why_new'), '') AS why_new FROM el),
ranked AS (SELECT *, correct AND novelty >= 0.45 AND depth >= 0.45 AND non_stitched >= 0.70 AND solution_economy >= 0.50 AND decision <> 'reject' AS passes,
  0.28 * depth + 0.24 * novelty + 0.18 * seed_alignment + 0.16 * non_stitched + 0.14 * solution_economy + CASE WHEN correct THEN 0.10 ELSE -0.30 END AS score FROM judged)"""
#: The literals above are decimals in DuckDB; this makes them doubles, as in Spark.
_JUDGED = _JUDGED.replace("0.28 *", "0.28::DOUBLE *").replace("0.24 *", "0.24::DOUBLE *").replace("0.18 *", "0.18::DOUBLE *").replace("0.16 *", "0.16::DOUBLE *").replace("0.14 *", "0.14::DOUBLE *").replace("THEN 0.10 ELSE -0.30", "THEN 0.10::DOUBLE ELSE -0.30::DOUBLE")


@query(f"WITH {_JUDGED} SELECT id, ord, passes FROM ranked")
def quality_gate(spark, d):
    """Candidates against the limits of the gate."""
    return _judged(spark, d).select(F.col("key").alias("id"), "ord", selection.passes().alias("passes"))


@query(f"WITH {_JUDGED} SELECT id, ord, round(score, 6) AS score FROM ranked")
def composite_score(spark, d):
    """Weighted scores."""
    return _judged(spark, d).select(F.col("key").alias("id"), "ord", F.round(selection.composite(), 6).alias("score"))


@query(f"WITH {_JUDGED} SELECT id, ord, transformation FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS r FROM ranked WHERE passes) WHERE r = 1")
def select_best_per_parent(spark, d):
    """The best passing candidate of each row."""
    return selection.select(_judged(spark, d)).where("accepted").select(F.col("key").alias("id"), "ord", "transformation")


@query(f"WITH {_JUDGED} SELECT id, ord, passes AS accepted, 'generated' AS role FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY passes DESC, score DESC, ord) AS r FROM ranked) WHERE r = 1")
def select_with_fallback(spark, d):
    """The best candidate of each row, passing or not."""
    return selection.select(_judged(spark, d), Lineage(continue_on_rejected=True)).select(F.col("key").alias("id"), "ord", "accepted", "role")


_FAILED = "coalesce(nullif(failure_kind, ''), 'rejected') || ': ' || coalesce(nullif(transformation, ''), substring(question, 1, 160))"


@query(f"""WITH {_JUDGED}, bad AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS n FROM judged WHERE NOT correct OR decision = 'reject')
SELECT id, string_agg({_FAILED}, ' | ' ORDER BY ord) AS failed FROM bad WHERE n <= 3 GROUP BY id""")
def failed_directions_top3(spark, d):
    """Up to three failed directions of each row."""
    packed = _judged(spark, d).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", "correct", "decision", "failure_kind", "transformation", "question"))).alias("c"))
    return packed.select(F.col("key").alias("id"), F.array_join(selection.failed_directions("c"), " | ").alias("failed")).where("failed <> ''")


def _mem(k: str) -> str:
    return f"'{k}=' || printf('%.2f', {k})"


@query(f"""WITH {_JUDGED}, full_ AS (SELECT j.*, i.iteration, i.prior FROM judged j JOIN (SELECT DISTINCT id, iteration, coalesce(source_question, '') AS prior FROM lineage_rows) i ON i.id = j.id WHERE j.ord = 0 AND iteration IS NOT NULL AND NOT EXISTS (SELECT 1 FROM el WHERE el.id = j.id AND el.ord = 0 AND (json_type(v, '$.scores') IS NULL OR json_type(v, '$.scores.novelty') IS NULL OR json_type(v, '$.scores.depth') IS NULL OR json_type(v, '$.scores.seed_alignment') IS NULL OR json_type(v, '$.scores.non_stitched') IS NULL OR json_type(v, '$.scores.solution_economy') IS NULL)))
SELECT id, CASE WHEN {_strip('prior')} <> '' THEN 'Previous dataset memory:' || chr(10) || {_strip('prior')} || chr(10) || chr(10) ELSE '' END || 'Latest synthesis memory:' || chr(10) || '- Parent iteration: ' || iteration || chr(10) || '- New status: ' || CASE WHEN correct THEN 'accepted' ELSE 'rejected' END || chr(10) ||
 '- Transformation used: ' || coalesce(nullif(transformation, ''), 'unspecified') || chr(10) || '- Why it changed the problem: ' || coalesce(nullif(why_new, ''), 'unspecified') || chr(10) || '- Judge notes: ' || coalesce(nullif(judge_notes, ''), 'none') || chr(10) || '- Scores: ' || {" || ', ' || ".join(_mem(k) for k in selection.SCORES)} AS memory FROM full_""")
def row_memory_text(spark, d):
    """Memory texts of first candidates with all scores."""
    row = _read(spark, d, "lineage_rows").select(F.col("id").alias("key"), "iteration", F.coalesce("source_question", F.lit("")).alias("prior")).distinct()
    c = _judged(spark, d).where((F.col("ord") == 0) & (F.size("scores") == 5)).join(row, "key").where("iteration is not null")
    made = memory.row_memory(F.col("prior"), F.col("iteration"), F.col("correct"), F.col("transformation"), F.col("why_new"), F.col("judge_notes"), F.col("scores"), F.array().cast("array<string>"))
    return c.select(F.col("key").alias("id"), made.alias("memory"))


_ONCE = "once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY seed_id IS NULL, event_id) AS rn FROM run_events) WHERE rn = 1)"


@query(f"""WITH {_ONCE}, l AS (SELECT run_id, seq, kind || ' ' || coalesce(seed_id, '?') AS lesson FROM once WHERE kind IN ('iteration_accepted', 'iteration_rejected'))
SELECT run_id, seq, coalesce(array_to_string(list(lesson) OVER (PARTITION BY run_id ORDER BY seq ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), ' | '), '') AS memory FROM l""")
def run_memory_tail(spark, d):
    """The last eight lessons before each lesson of a run."""
    e = runs.once(_read(spark, d, "run_events")).where(F.col("kind").isin("iteration_accepted", "iteration_rejected"))
    l = e.select(F.col("run_id").alias("run"), "seq", F.concat_ws(" ", "kind", F.coalesce("seed_id", F.lit("?"))).alias("lesson"))
    return memory.run_memory(l).select(F.col("run").alias("run_id"), "seq", F.array_join("memory", " | ").alias("memory"))


@query("SELECT count(*) FILTER (role = 'source') AS source_rows, count(*) FILTER (role = 'generated') AS generated_rows, count(*) FILTER (role = 'generated' AND accepted) AS accepted_steps, count(*) FILTER (role = 'rejected') AS rejected_steps, count(*) AS total_rows FROM lineage_rows")
def run_summary(spark, d):
    """Counters over rows."""
    return rows.summary(_read(spark, d, "lineage_rows"))


@query("SELECT id, left(sha256(concat_ws(chr(31), 'generated', coalesce(lineage_id, ''), coalesce(CAST(iteration AS VARCHAR), ''), coalesce(question, ''))), 16) AS new_id FROM lineage_rows")
def stable_ids(spark, d):
    """Content-addressed ids."""
    return _read(spark, d, "lineage_rows").select("id", ids.stable_id("generated", F.col("lineage_id"), F.col("iteration"), F.col("question")).alias("new_id"))


@query("""SELECT answer, dataset, id, iteration, question, role, row_id FROM (SELECT id, role, dataset, question, answer, CAST(iteration AS VARCHAR) AS iteration FROM lineage_rows WHERE role IN ('generated', 'rejected')
UNION ALL BY NAME SELECT row_id, dataset, question, answer, iteration FROM seed_records)""")
def append_aligned_union(spark, d):
    """Rows of unlike tables over all their columns."""
    new = rows.publishable(_read(spark, d, "lineage_rows")).select("id", "role", "dataset", "question", "answer", F.col("iteration").cast("string").alias("iteration"))
    return rows.aligned_union(_read(spark, d, "seed_records").select("row_id", "dataset", "question", "answer", "iteration"), new)


@query("SELECT n_regionkey, CAST(to_json(list(n_nationkey ORDER BY n_nationkey)) AS VARCHAR) AS nations FROM nation GROUP BY n_regionkey")
def nested_to_json(spark, d):
    """List columns as JSON text."""
    n = _read(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("nations"))
    return text.nested_to_json(n)


@query("""WITH req AS (SELECT doc_id, sha256(concat_ws(chr(31), 'm', '', text, '0', '100')) AS key FROM documents WHERE text IS NOT NULL),
cached AS (SELECT sha256(concat_ws(chr(31), 'm', '', text, '0', '100')) AS key, max(topic) AS content FROM documents WHERE text IS NOT NULL AND source IN ('kintavo-drills', 'tallow-qa') AND topic IS NOT NULL AND trim(topic) <> '' GROUP BY 1)
SELECT doc_id, c.key IS NOT NULL AS hit, c.content FROM req LEFT JOIN cached c USING (key)""")
def cache_hits_and_misses(spark, d):
    """Requests found in a completion cache, and those not."""
    docs = _read(spark, d, "documents").where("text is not null")
    keyed = docs.select("doc_id", "source", "topic", ids.cache_key("m", "", F.col("text"), "0", "100").alias("key"))
    c = cache.Cache(spark, f"{Workspace(spark, 'cache').base}/completions")
    c.put(keyed.where(F.col("source").isin("kintavo-drills", "tallow-qa")).select("key", F.col("topic").alias("content"), F.lit("stop").alias("finish_reason"), F.lit("").alias("usage"), F.lit(0.0).alias("t")))
    hits, misses = c.split(keyed.select("doc_id", "key"))
    return hits.select("doc_id", F.lit(True).alias("hit"), "content").unionByName(misses.select("doc_id", F.lit(False).alias("hit"), F.lit(None).cast("string").alias("content")))


_MODELS = ("openai/gpt-5.5", "gpt-4.1-mini", "openrouter/o3-mini", "o1", "anthology-large", "gpt-5-nano", "ollama/qwen", "GPT-5.4-pro")


@query(f"""SELECT model, requested, CASE WHEN r THEN greatest(8192, requested * 4) ELSE requested END AS budget, r AS reasoning, NOT (contains(m, 'gpt-5.5') OR contains(m, 'gpt-5.4')) AS temperature
FROM (SELECT *, contains(m, 'gpt-5') OR contains(m, '/o') OR starts_with(m, 'o') AS r FROM (SELECT model, lower(model) AS m, requested FROM (VALUES {", ".join(f"('{m}')" for m in _MODELS)}) t(model), (VALUES (100), (2048), (5000)) q(requested)))""")
def token_budget_rules(spark, d):
    """Rules by model name."""
    pairs = prepare(spark).createDataFrame([(m, n) for m in _MODELS for n in (100, 2048, 5000)], "model string, requested int")
    return pairs.select("model", "requested", text.token_budget("model", "requested").alias("budget"), text.reasoning_model("model").alias("reasoning"), text.takes_temperature("model").alias("temperature"))


@query(f"""SELECT model, requested, NOT (contains(m, 'gpt-5.5') OR contains(m, 'gpt-5.4')) AS heated, CASE WHEN r THEN greatest(8192, requested * 4) END AS max_completion_tokens, CASE WHEN NOT r THEN requested END AS max_tokens, requested = 100 AS cached
FROM (SELECT *, contains(m, 'gpt-5') OR contains(m, '/o') OR starts_with(m, 'o') AS r FROM (SELECT model, lower(model) AS m, requested FROM (VALUES {", ".join(f"('{m}')" for m in _MODELS)}) t(model), (VALUES (100), (2048), (5000)) q(requested)))""")
def request_parameters(spark, d):
    """Call parameters by model name."""
    pairs = prepare(spark).createDataFrame([(m, n) for m in _MODELS for n in (100, 2048, 5000)], "model string, requested int")
    r = pairs.withColumns({"r": text.request("model", F.lit(0.4), "requested", F.lit(False)), "cached": text.cache_eligible(F.lit(None).cast("boolean"), F.when(F.col("requested") == 100, 0.0).otherwise(0.7))})
    return r.select("model", "requested", F.col("r.temperature").isNotNull().alias("heated"), "r.max_completion_tokens", "r.max_tokens", "cached")


@query("SELECT run_id, count(*) AS events, CAST(row_number() OVER (ORDER BY min(ts) DESC NULLS LAST, run_id) AS INT) AS place FROM run_events GROUP BY run_id")
def run_listing(spark, d):
    """Runs, newest first."""
    return runs.listing(_read(spark, d, "run_events")).select("run_id", "events", "place")


@query(f"SELECT id, coalesce(nullif({_strip('solution')}, ''), nullif({_strip('answer')}, ''), nullif({_strip('question')}, ''), '') AS text FROM lineage_rows")
def response_text_coalesce(spark, d):
    """The first text that says something."""
    return _read(spark, d, "lineage_rows").select("id", text.first_text(F.col("solution"), F.col("answer"), F.col("question")).alias("text"))


@query()
def json_salvage(spark, d):
    """JSON out of each of the three JSON fields, whole or in part."""
    r = _read(spark, d, "lineage_rows")
    each = [F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("artifacts_json", "scores_json", "memory_json")]
    r = r.select("id", F.explode(F.array(*each)).alias("t")).select(F.struct("id", "t.field").alias("at"), "t.text").where("text is not null").distinct()
    return salvage.salvage_column(r, "at", "text").select("at.id", "at.field", "json")


@query("""SELECT event_id, NOT ((contains(m, 'missing') AND contains(m, 'api key')) OR contains(m, 'authentication') OR contains(m, 'unauthorized') OR contains(m, 'invalid api key') OR contains(m, 'incorrect api key')
 OR (contains(m, 'api key') AND (contains(m, 'invalid') OR contains(m, 'not provided') OR contains(m, 'required') OR contains(m, 'must be set')))) AS retryable FROM (SELECT event_id, lower(error) AS m FROM run_events WHERE error IS NOT NULL)""")
def retry_classifier(spark, d):
    """Errors that a second attempt may mend."""
    return _read(spark, d, "run_events").where("error is not null").select("event_id", text.retryable("error").alias("retryable"))


_STATES = f"""WITH {_ONCE}, e AS (SELECT *, CASE WHEN kind IN ('seed_started', 'stage_started') THEN 'running' WHEN kind = 'seed_done' THEN coalesce(nullif(status, ''), 'done') WHEN kind = 'seed_error' THEN 'error' END AS st,
 CASE kind WHEN 'seed_started' THEN 'queued' WHEN 'stage_started' THEN stage WHEN 'stage_done' THEN stage || '_done' WHEN 'iteration_accepted' THEN 'accepted' WHEN 'iteration_rejected' THEN 'rejected' WHEN 'seed_done' THEN 'done' WHEN 'seed_error' THEN 'error' END AS sg FROM once WHERE seed_id IS NOT NULL)
SELECT run_id, seed_id, arg_max(st, seq) FILTER (st IS NOT NULL) AS status, arg_max(sg, seq) FILTER (sg IS NOT NULL) AS stage, arg_max(iteration, seq) FILTER (kind IN ('iteration_accepted', 'iteration_rejected')) AS last_iteration, max(seq) AS last_seq
FROM e GROUP BY run_id, seed_id HAVING bool_or(kind = 'seed_started')"""


@query(_STATES)
def run_state_seed_status(spark, d):
    """Status and stage of every seed."""
    return runs.seed_states(runs.once(_read(spark, d, "run_events"))).drop("error")


@query(_STATES)
def run_state_streaming(spark, d):
    """The same states by a stream over the events as they are, sent twice or late."""
    prepare(spark)
    out, checkpoint = runs.scratch(shared_dir(spark))
    return runs.stream_states(spark, f"{d}/run_events.parquet", out, checkpoint).drop("error")


@query(f"""WITH {_ONCE}, e AS (SELECT *, max(CASE WHEN kind = 'seed_started' THEN seq END) OVER (PARTITION BY run_id, seed_id) AS s FROM once WHERE seed_id IS NOT NULL),
f AS (SELECT * FROM e WHERE seq > s), st AS (SELECT *, lead(seq) OVER (PARTITION BY run_id, seed_id, iteration, stage ORDER BY seq) AS nxt FROM f WHERE kind = 'stage_started')
SELECT st.run_id, st.seed_id, st.iteration, st.stage, st.seq, CASE WHEN count(d.seq) > 0 THEN 'done' ELSE 'running' END AS status, coalesce(arg_max(d.candidate_count, d.seq), any_value(st.candidate_count)) AS candidate_count
FROM st LEFT JOIN f d ON d.kind = 'stage_done' AND d.run_id = st.run_id AND d.seed_id = st.seed_id AND d.iteration IS NOT DISTINCT FROM st.iteration AND d.stage = st.stage AND d.seq > st.seq AND (st.nxt IS NULL OR d.seq < st.nxt)
GROUP BY st.run_id, st.seed_id, st.iteration, st.stage, st.seq""")
def step_pairing_asof(spark, d):
    """Steps of stages, each start with the ends that follow it."""
    return runs.steps(runs.once(_read(spark, d, "run_events"))).select("run_id", "seed_id", "iteration", "stage", "seq", "status", "candidate_count")


@query(f"WITH {_ONCE} SELECT run_id, seq, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS r FROM once) WHERE r <= 1000")
def event_retention(spark, d):
    """The last thousand events of each run."""
    return runs.latest(runs.once(_read(spark, d, "run_events"))).select("run_id", "seq", "event_id", "kind")


@query(f"""WITH s AS ({_STATES}), m AS (SELECT run_id, count(*) FILTER (kind IN ('iteration_accepted', 'iteration_rejected')) AS rows, count(*) FILTER (kind = 'iteration_accepted') AS accepted FROM (SELECT DISTINCT run_id, seq, kind FROM run_events WHERE seed_id IS NOT NULL) GROUP BY run_id)
SELECT m.run_id, coalesce(x.seeds, 0) AS seeds, coalesce(x.finished, 0) AS finished, coalesce(x.errors, 0) AS errors, m.rows, m.accepted FROM m LEFT JOIN (SELECT run_id, count(*) AS seeds, count(*) FILTER (status IN ('done', 'dry_run', 'rejected', 'error')) AS finished, count(*) FILTER (status = 'error') AS errors FROM s GROUP BY run_id) x USING (run_id)""")
def run_progress_counters(spark, d):
    """Seeds and rows of each run so far."""
    return runs.progress(runs.once(_read(spark, d, "run_events")))


@query("SELECT id, role, iteration FROM lineage_rows WHERE role IN ('generated', 'rejected') UNION ALL SELECT id, role, iteration FROM lineage_rows WHERE role = 'source'")
def publish_replace(spark, d):
    """A versioned table, replaced and appended to while it is read."""
    r = _read(spark, d, "lineage_rows").select("id", "role", "iteration")
    t = tables.VersionedTable(spark, f"{Workspace(spark, 'table').base}/rows")
    t.replace(r.where("role = 'source'"))
    t.append(rows.publishable(r))
    return t.read()


@query("""WITH have AS (SELECT sha256('m:' || vec_id) AS key, len(embedding) AS n FROM embeddings WHERE label < 5), req AS (SELECT vec_id, sha256('m:' || vec_id) AS key FROM embeddings)
SELECT vec_id, h.n AS dims FROM req LEFT JOIN have h USING (key)""")
def embedding_cache_lookup(spark, d):
    """Vectors found in an embedding cache."""
    e = _read(spark, d, "embeddings").withColumn("key", ids.embedding_key("m", F.col("vec_id")))
    c = cache.Cache(spark, f"{Workspace(spark, 'cache').base}/embeddings", cache.EMBEDDINGS, "embedding")
    c.put(e.where("label < 5").select("key", "embedding"))
    hits, misses = c.split(e.select("vec_id", "key"))
    return hits.select("vec_id", F.size("embedding").cast("long").alias("dims")).unionByName(misses.select("vec_id", F.lit(None).cast("long").alias("dims")))


@query()
def evolve_generation(spark, d):
    """A generation made by a stub model from the latest one: source rows and new rows."""
    cfg = Config.of({"input": {"dataset": "lineage", "max_seeds": 50}})
    made = evolve.evolve(_read(spark, d, "lineage_rows"), cfg, StubCompleter())
    return made.rows.select("id", "parent_id", "role", "iteration", "accepted", "question", "answer")
