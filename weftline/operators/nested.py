"""Nested JSON text to flat, linked tables by Dewey labels.

Every node of a document gets the ordinals on its way down as label ("0.2.1"); the label without its last part is the
parent's. Nodes are grouped by schema path (the path with [*] for positions) into tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "id string, field string, dewey string, path string, schema_path string, kind string, in_array boolean, value string"


def _refuse(text: str):
    raise ValueError(text)


_TOKEN = re.compile(r'\s*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')


def _parse_deep(text: str):
    """json.loads without recursion, for texts nested more deeply than its stack allows."""
    at, end, stack, done = 0, len(text.rstrip(" \t\n\r")), [], []
    key, want = None, "value"

    def put(x):
        nonlocal want
        if not stack:
            done.append(x)
            want = "end"
        elif isinstance(stack[-1][0], list):
            stack[-1][0].append(x)
            want = "comma"
        else:
            stack[-1][0][stack[-1][1]] = x
            want = "comma"

    while at < end:
        m = _TOKEN.match(text, at, end)
        if not m:
            raise ValueError("not JSON")
        at = m.end()
        mark, string, number, word = m.groups()
        top = stack[-1] if stack else None
        if mark in ("[", "{") and want in ("value", "first") and not (top and isinstance(top[0], dict) and want == "first"):
            stack.append([[] if mark == "[" else {}, None])
            want = "first"
        elif mark in ("]", "}") and top and want in ("first", "comma") and isinstance(top[0], list) == (mark == "]"):
            put(stack.pop()[0])
        elif mark == "," and want == "comma" and top:
            want = "value" if isinstance(top[0], list) else "key"
        elif mark == ":" and want == "colon":
            want = "value"
        elif string is not None and top and isinstance(top[0], dict) and want in ("first", "key"):
            top[1], want = json.loads(string), "colon"
        elif mark is None and (want == "value" or want == "first" and isinstance(top[0], list)):
            put(json.loads(string or number or word))
        else:
            raise ValueError("not JSON")
    if want != "end":
        raise ValueError("not JSON")
    return done[0]


def load(text: str | None):
    """(True, value) of a JSON text, (False, None) if it is none. NaN and Infinity are no JSON. A string holding JSON is read once more."""
    for once_more in (True, False):
        try:
            try:
                value = json.loads(text, parse_constant=_refuse)
            except RecursionError:
                value = _parse_deep(text)
        except (ValueError, TypeError):
            return False, None
        if not (once_more and isinstance(value, str)):
            return True, value
        text = value
    return True, value


def walk(field: str, value, elements_only: bool = False) -> Iterator[tuple]:
    """(dewey, path, schema_path, kind, in_array, value) of each node, parents before children; with elements_only just the objects in arrays, at any depth.

    value is the JSON text of a scalar, else null. Ordinals of object members follow the order of the text.
    """
    stack = [("0", field, field, False, value)]
    while stack:
        dewey, path, schema, inside, x = stack.pop()
        kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
        if not elements_only:
            yield dewey, path, schema, kind, inside, None if kind in ("object", "array") else json.dumps(x, ensure_ascii=False)
        elif inside and kind == "object":
            yield dewey, path, schema, kind, inside, None
        if kind == "object":
            below = [(f"{dewey}.{i}", f"{path}.{k}", f"{schema}.{k}", False, v) for i, (k, v) in enumerate(x.items()) if not elements_only or isinstance(v, (dict, list))]
        elif kind == "array":
            below = [(f"{dewey}.{i}", f"{path}[{i}]", f"{schema}[*]", True, v) for i, v in enumerate(x) if not elements_only or isinstance(v, (dict, list))]
        else:
            continue
        stack.extend(reversed(below))


_ARROW = {"string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "map<string,string>": pa.map_(pa.string(), pa.string())}


def _each(texts: DataFrame, rows_of, schema: str, most: int = 20_000) -> DataFrame:
    """What rows_of(id, field, value) gives for each JSON text of (id, field, text), in batches of about `most` rows."""
    names, kinds = zip(*[(x.split(" ")[0], _ARROW[x.split(" ")[1]]) for x in schema.split(", ")])

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(names), kinds)], names=names)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i, field, text in zip(*(c.to_pylist() for c in batch.columns)):
                ok, value = load(text)
                if ok:
                    out.extend(rows_of(i, field, value))
                if len(out) >= most:
                    yield batch_of(out)
                    out = []
            yield batch_of(out)

    return texts.mapInArrow(run, schema)


def shred(df: DataFrame, fields: list[str], id_col: str = "id", elements_only: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per node of the JSON texts in fields (NODE_SCHEMA), or per object in an array with elements_only.

    A null, blank or broken text gives no rows, a null id neither. A repeated id with equal texts counts once; where its texts
    differ, the nodes of each come out, with elements_only those alike once. Extra columns are not read, nothing is gathered. Texts
    are brought together before they are parsed, since their nodes are many times as large; with elements_only the few labels
    are, after it. keep names the columns to return.
    """
    if not elements_only:
        text = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("t")
        texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), text).select("id", "t.*").where("text is not null").distinct()
        return _each(texts, lambda i, field, value: ((i, field, *node) for node in walk(field, value)), NODE_SCHEMA).select(*(keep or [x.split()[0] for x in NODE_SCHEMA.split(", ")]))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out: list[tuple] = []
            for k, field in enumerate(fields, 1):
                for i, text in zip(ids, batch.column(k)):
                    ok, value = load(text.as_py()) if text.is_valid else (False, None)
                    if ok:
                        out.extend((i, field, *node) for node in walk(field, value, elements_only))
                    if len(out) >= 20_000:
                        yield rows(out)
                        out = []
            yield rows(out)

    names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
    kinds = [pa.bool_() if x.endswith("boolean") else pa.string() for x in NODE_SCHEMA.split(", ")]

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * len(names), kinds)], names=names)

    source = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(f).cast("string") for f in fields]).where("id is not null")
    return source.mapInArrow(run, NODE_SCHEMA).select(*(keep or names)).distinct()


def parent_of(dewey: Column | str) -> Column:
    """The parent's label: the label cut before its last ordinal; null at the top."""
    d = F.col(dewey) if isinstance(dewey, str) else dewey
    return F.nullif(F.regexp_replace(d, r"\.?\d+$", ""), F.lit(""))


def object_table(nodes: DataFrame, schema_path: str, columns: list[str]) -> DataFrame:
    """The table of the objects at schema_path: id, dewey, parent_dewey (the enclosing object or array), ord, and the named scalar members as JSON text."""
    own = nodes.where((F.col("schema_path") == schema_path) & (F.col("kind") == "object")).select("id", "field", "dewey")
    cells = nodes.where(F.col("schema_path").isin([f"{schema_path}.{c}" for c in columns])).select("id", "field", parent_of("dewey").alias("dewey"), F.col("schema_path").alias("at"), "value")
    wide = cells.groupBy("id", "field", "dewey").agg(*[F.max(F.when(F.col("at") == f"{schema_path}.{c}", F.col("value"))).alias(c) for c in columns])
    return own.join(wide, ["id", "field", "dewey"], "left").select("id", "dewey", parent_of("dewey").alias("parent_dewey"), F.regexp_extract("dewey", r"(\d+)$", 1).cast("int").alias("ord"), *columns)


OBJECT_SCHEMA = "id string, field string, schema_path string, dewey string, parent_dewey string, ord int, members map<string,string>, kinds map<string,string>"


def _objects(i: str, field: str, value):
    """Each object with the label of the object around it, its place among its siblings and its scalar members as JSON text."""
    owner: dict[str, str] = {}
    found: dict[str, tuple] = {}
    for dewey, _, schema, kind, inside, text in walk(field, value):
        up, _, place = dewey.rpartition(".")
        around = up if up in found else owner.get(up)  # an array belongs to the object that holds it
        if kind == "object":
            found[dewey] = (i, field, schema, dewey, around, int(place or 0), {}, {})
        elif kind == "array":
            owner[dewey] = around
        elif up in found:
            name = schema.removeprefix(found[up][2] + ".")
            found[up][6][name], found[up][7][name] = text, kind
    return [(*x[:6], list(x[6].items()), list(x[7].items())) for x in found.values()]


def objects(df: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """One row per object (OBJECT_SCHEMA): id, field and parent_dewey are the key of the row of the object around it, null at the top.

    members holds the scalar members as JSON text, kinds their JSON types. Repeats and broken texts as in shred.
    """
    text = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])).alias("t")
    texts = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), text).select("id", "t.*").where("text is not null").distinct()
    return _each(texts, _objects, OBJECT_SCHEMA, 5_000)


def columns_of(rows: DataFrame) -> DataFrame:
    """(schema_path, name, type, n) of the columns of all tables: boolean, double or string, as all values of a member allow, and how many rows have it."""
    cells = rows.select("schema_path", F.explode("kinds").alias("name", "kind")).groupBy("schema_path", "name").agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in ("boolean", "number", "null")])
    only = lambda k: (F.col(k) > 0) & (F.col(k) + F.col("null") == F.col("n"))
    return cells.select("schema_path", "name", F.when(only("boolean"), "boolean").when(only("number"), "double").otherwise("string").alias("type"), "n")


def flat_tables(rows: DataFrame, columns: list | None = None) -> dict[str, DataFrame]:
    """schema path -> its table: id, field, dewey, parent_dewey, ord and a typed column for each scalar member that occurs.

    A table joins its parent's on id, field and parent_dewey = dewey. A member named as one of these five gets an underscore
    behind its name. columns are the rows of columns_of(rows), as many as the documents' schema has members.
    """
    keys = ["id", "field", "dewey", "parent_dewey", "ord"]
    of: dict[str, list] = {r[0]: [] for r in rows.select("schema_path").distinct().collect()}
    for r in columns if columns is not None else columns_of(rows).collect():
        of[r["schema_path"]].append((r["name"], r["type"]))
    out = {}
    for path, members in of.items():
        taken = {k.lower() for k in keys}
        cells = []
        for name, kind in sorted(members):
            text = F.try_element_at("members", F.lit(name))
            value = F.try_variant_get(F.try_parse_json(text), "$", "string") if kind == "string" else F.nullif(text, F.lit("null")).try_cast(kind)
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
            cells.append(value.alias(name))
        out[path] = rows.where(F.col("schema_path") == path).select(*keys, *cells)
    return out
