"""Queries over lineage_rows: hierarchies (problem 1) and flat tables from nested JSON (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import hierarchy, nested
from weftline.runtime import Workspace, prepare

FIELDS = ["artifacts_json", "scores_json", "memory_json"]


def lineage(spark: SparkSession, d: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{d}/lineage_rows.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Root of every row whose parent row exists."""
    return hierarchy.label(hierarchy.resolve_links(lineage(spark, d))).where("parent is not null").select("id", "root_id")


def p1_tree(spark: SparkSession, d: str) -> DataFrame:
    """Path, depth, root and number of descendants of every row; rows on circles are told by on_circle and have no size."""
    labels = hierarchy.label(hierarchy.resolve_links(lineage(spark, d)))
    return labels.join(hierarchy.paths(labels), "id").select("id", "path", "depth", "root_id", "on_circle", (F.col("size") - 1).alias("n_descendants"))


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Every row off the circles with its chain and its numbers: its descendants are the rows of the same tree numbered from first + 1 to last."""
    labels = hierarchy.label(hierarchy.resolve_links(lineage(spark, d))).where("not on_circle")
    return labels.select("id", F.col("top").alias("tree"), "head", "pos", "first", (F.col("first") + F.col("size") - 1).alias("last"))


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every row with each of its descendants and their distance, off the circles."""
    return hierarchy.descendants(hierarchy.label(hierarchy.resolve_links(lineage(spark, d))))


def p1_circle_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every row on a circle with all that hang below it, over the other rows of the circle too; the rest of p1_descendants."""
    return hierarchy.ring_descendants(hierarchy.label(hierarchy.resolve_links(lineage(spark, d))))


def p1_circles(spark: SparkSession, d: str) -> DataFrame:
    """Circle and number of descendants of every row on a circle, which p1_tree leaves null."""
    return hierarchy.ring_sizes(hierarchy.label(hierarchy.resolve_links(lineage(spark, d))))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every object that is an element of an array in the three JSON fields."""
    return nested.shred(lineage(spark, d), FIELDS, elements_only=True, keep=["id", "path"])


def p3_nodes(spark: SparkSession, d: str) -> DataFrame:
    """All nodes with Dewey labels and the label of the parent."""
    nodes = nested.shred(lineage(spark, d), FIELDS)
    return nodes.select("id", "field", "dewey", nested.parent_of("dewey").alias("parent_dewey"), "path", "schema_path", "kind", "value")


def p3_schema_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables that the objects fall into, by schema path, with rows and documents."""
    return nested.objects(lineage(spark, d), FIELDS).groupBy("schema_path").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("n_ids"))


def p3_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of these tables, with types and how many rows have them."""
    return nested.columns_of(nested.objects(lineage(spark, d), FIELDS))


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each table have a row of the parent's table, by the schema paths of both."""
    rows, _ = Workspace(spark, "tables").write(nested.objects(lineage(spark, d), FIELDS).select("id", "field", "schema_path", "dewey", "parent_dewey"))
    up = rows.select("id", "field", F.col("dewey").alias("parent_dewey"), F.col("schema_path").alias("parent_path")).distinct()
    return rows.distinct().join(up, ["id", "field", "parent_dewey"]).groupBy("parent_path", "schema_path").agg(F.count("*").alias("n"))


def p3_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The table of candidates, by row and place."""
    rows = nested.objects(lineage(spark, d), FIELDS).where("schema_path = 'artifacts_json.candidates[*]'")
    wanted = ("question", "answer", "decision", "correct", "failure_kind")
    return nested.flat_tables(rows, [{"schema_path": "artifacts_json.candidates[*]", "name": k, "type": "boolean" if k == "correct" else "string"} for k in wanted]).get("artifacts_json.candidates[*]", rows).select("id", "ord", *wanted)


QUERIES = {f.__name__: f for f in (p1_found, p1_tree, p1_intervals, p1_descendants, p1_circle_descendants, p1_circles, p3_found, p3_nodes, p3_schema_tables, p3_columns, p3_links, p3_candidates)}

_LINKS = """
rows_ AS (
  SELECT id, min(coalesce(nullif(lower(trim(parent_id)), ''), nullif(lower(trim(seed_id)), ''))) AS up
  FROM lineage_rows WHERE id IS NOT NULL GROUP BY id),
links AS (SELECT r.id, p.id AS parent FROM rows_ r LEFT JOIN rows_ p ON p.id = r.up),
ways AS (
  SELECT id, id AS cur, 0 AS n, [id] AS seen, false AS back FROM links
  UNION ALL
  SELECT w.id, l.parent, w.n + 1, list_append(w.seen, l.parent), list_contains(w.seen, l.parent)
  FROM ways w JOIN links l ON l.id = w.cur WHERE l.parent IS NOT NULL AND NOT w.back),
ends AS (SELECT id, max_by(cur, n) AS top, max(n) AS n, bool_or(back) AS back, max_by(seen, n) AS seen FROM ways GROUP BY id),
roots AS (
  SELECT id, n, back, seen, CASE WHEN back THEN list_min(seen[list_position(seen, top):]) ELSE top END AS root_id,
    list_position(seen, top) AS enters FROM ends)
"""

_JSON = "f AS (" + " UNION ALL ".join(f"SELECT DISTINCT id, '{f}' AS field, {f} AS t FROM lineage_rows WHERE id IS NOT NULL AND {f} IS NOT NULL" for f in FIELDS) + """),
g AS (SELECT id, field, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END END AS t FROM f),
h AS (SELECT * FROM g WHERE t IS NOT NULL AND json_valid(t)),
x AS (SELECT h.id, h.field, e.fullkey, e.type, e.value FROM h, json_tree(h.t) e)"""

SQL = {
    "p1_found": f"WITH RECURSIVE {_LINKS} SELECT r.id, r.root_id FROM roots r JOIN links l ON l.id = r.id WHERE l.parent IS NOT NULL",
    "p1_tree": f"""WITH RECURSIVE {_LINKS},
below AS (SELECT a AS id, count(*) AS k FROM (SELECT id, unnest(seen[2:CASE WHEN back THEN enters - 1 ELSE len(seen) END]) AS a FROM roots) GROUP BY a)
SELECT r.id,
  CASE WHEN r.back AND r.enters = 1 THEN r.id WHEN r.back THEN array_to_string(list_reverse(r.seen[1:r.enters - 1]), '/') ELSE array_to_string(list_reverse(r.seen), '/') END AS path,
  CAST(CASE WHEN r.back THEN r.enters - 1 ELSE r.n END AS BIGINT) AS depth, r.root_id, r.back AND r.enters = 1 AS on_circle,
  CASE WHEN r.back AND r.enters = 1 THEN NULL ELSE coalesce(b.k, 0) END AS n_descendants
FROM roots r LEFT JOIN below b ON b.id = r.id""",
    "p3_candidates": f"""WITH {_JSON} SELECT id, regexp_extract(fullkey, '([0-9]+)\\]$', 1)::INT AS ord, json_extract_string(value, '$.question') AS question, json_extract_string(value, '$.answer') AS answer, json_extract_string(value, '$.decision') AS decision, TRY_CAST(json_extract_string(value, '$.correct') AS BOOLEAN) AS correct, json_extract_string(value, '$.failure_kind') AS failure_kind FROM x WHERE field = 'artifacts_json' AND type = 'OBJECT' AND regexp_full_match(fullkey, '\\$\\.candidates\\[[0-9]+\\]')""",
    "p3_schema_tables": f"WITH {_JSON} SELECT regexp_replace(field || substr(fullkey, 2), '\\[[0-9]+\\]', '[*]', 'g') AS schema_path, count(*) AS n_rows, count(DISTINCT id) AS n_ids FROM x WHERE type = 'OBJECT' GROUP BY 1",
    "p3_found": "WITH f AS (" + " UNION ALL ".join(f"SELECT DISTINCT id, '{f}' AS field, {f} AS t FROM lineage_rows WHERE id IS NOT NULL AND {f} IS NOT NULL" for f in FIELDS) + """),
g AS (SELECT id, field, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END END AS t FROM f),
h AS (SELECT * FROM g WHERE t IS NOT NULL AND json_valid(t)),
x AS (SELECT h.id, h.field, e.fullkey, e.type, e.value FROM h, json_tree(h.t) e)
SELECT DISTINCT id, field || substr(fullkey, 2) AS path FROM x WHERE type = 'OBJECT' AND fullkey LIKE '%]'""",
    "p1_descendants": f"""WITH RECURSIVE {_LINKS},
up AS (SELECT id, seen[2:CASE WHEN back THEN enters - 1 ELSE len(seen) END] AS ups FROM roots WHERE NOT (back AND enters = 1))
SELECT u.ups[k.i] AS id, u.id AS descendant_id, CAST(k.i AS BIGINT) AS distance FROM up u, LATERAL (SELECT unnest(range(1, len(u.ups) + 1)) AS i) k""",
    "p1_circle_descendants": f"""WITH RECURSIVE {_LINKS},
ring AS (SELECT id FROM roots WHERE back AND enters = 1),
down AS (
  SELECT id AS top, id, 0 AS n FROM ring
  UNION
  SELECT d.top, l.id, d.n + 1 FROM down d JOIN links l ON l.parent = d.id WHERE l.id <> d.top)
SELECT d.top AS id, d.id AS descendant_id, CAST(d.n AS BIGINT) AS distance, d.id IN (SELECT id FROM ring) AS on_circle FROM down d WHERE d.n > 0""",
    "p1_circles": f"""WITH RECURSIVE {_LINKS}
SELECT r.id, r.root_id AS circle, (SELECT count(*) FROM roots o WHERE o.back AND o.enters = 1 AND o.root_id = r.root_id) AS n_on_circle,
  (SELECT count(*) FROM roots o WHERE o.back AND o.root_id = r.root_id) - 1 AS n_descendants
FROM roots r WHERE r.back AND r.enters = 1""",
}
