"""Nested JSON against a recursive walk."""

import json

from weftline.operators import nested as n

DOC = {"a": [{"b": 1, "c": [[{"d": None}, 2], "x"]}, {"b": True, "k.ey": {}}], "e": {"f": [1, "é"]}, "g": []}


def recursive(field, x, path=None, inside=False):
    path = field if path is None else path
    yield path, inside and isinstance(x, dict)
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from recursive(field, v, f"{path}[{k}]" if isinstance(x, list) else f"{path}.{k}", isinstance(x, list))


def test_nodes_and_elements(spark):
    df = spark.createDataFrame([("1", json.dumps(DOC), None), ("2", json.dumps(json.dumps([{}, {"a": 1}])), "[{}]")], "id string, j string, k string")
    nodes = n.shred(df, ["j", "k"]).collect()
    assert sorted(r.path for r in nodes if r.id == "1") == sorted(p for p, _ in recursive("j", DOC))
    some = n.shred(df, ["j", "k"], elements_only=True, keep=["id", "path"]).collect()
    assert sorted(r.path for r in some if r.id == "1") == sorted(p for p, e in recursive("j", DOC) if e)
    assert sorted(r.path for r in some if r.id == "2") == ["j[0]", "j[1]", "k[0]"]


def test_parents_by_truncation_exist(spark):
    df = spark.createDataFrame([("1", json.dumps(DOC))], "id string, j string")
    nodes = n.shred(df, ["j"]).withColumn("up", n.parent_of("dewey")).collect()
    labels = {r.dewey: r for r in nodes}
    assert all((r.up is None) == (r.dewey == "0") and (r.up is None or r.path.startswith(labels[r.up].path)) for r in nodes)


def test_object_table(spark):
    df = spark.createDataFrame([("1", json.dumps({"a": [{"x": 1, "y": "p"}, {"x": 2}, 3]}))], "id string, j string")
    got = n.object_table(n.shred(df, ["j"]), "j.a[*]", ["x", "y"]).orderBy("ord").collect()
    assert [(r.ord, r.dewey, r.parent_dewey, r.x, r.y) for r in got] == [(0, "0.0.0", "0.0", "1", '"p"'), (1, "0.0.1", "0.0", "2", None)]


def test_bad_texts_give_nothing():
    for bad in (None, "", "  ", "{", "[1,]", "NaN", "[NaN]", "[Infinity]", "{'a': 1}", "[1] x", '"["'):
        assert not n.load(bad)[0], bad
    assert n.load('"[1]"') == (True, [1]) and n.load('"\\"[1]\\""') == (True, "[1]")


def test_very_deep_text():
    depth = 200_000
    text = "[" * depth + '{"a": [1, {"b": "]"}]}' + "]" * depth
    ok, value = n.load(text)
    assert ok
    for _ in range(depth):
        value = value[0]
    assert value == {"a": [1, {"b": "]"}]}
    assert not n.load("[" * depth + "]" * (depth - 1))[0] and not n.load("[" * depth + "]" * depth + "]")[0]


def test_parse_deep_agrees_with_json():
    import random

    rng = random.Random(3)
    whole = json.dumps(DOC)
    for _ in range(3000):
        i = rng.randrange(len(whole))
        text = whole[:i] + rng.choice(["", "]", "}", ",", ":", '"', "1", " ", "{", "["]) + whole[i + rng.randrange(3) :]
        try:
            want = (True, json.loads(text))
        except ValueError:
            want = (False, None)
        try:
            got = (True, n._parse_deep(text))
        except ValueError:
            got = (False, None)
        assert got == want, text


def test_repeats_nulls_empty_and_clashes(spark):
    rows = [("1", '[{"a": 1}]', "x"), ("1", '[{"a": 1}]', "y"), (None, "[{}]", "z"), ("2", None, "w"), ("3", "broken", "v")]
    df = spark.createDataFrame(rows, "id string, j string, path string")
    assert [(r.id, r.path) for r in n.shred(df, ["j"], elements_only=True).collect()] == [("1", "j[0]")]
    assert n.shred(df.limit(0), ["j"]).count() == 0


def test_flat_tables_join_on_their_keys(spark):
    text = '{"name": "top", "id": 7, "list": [{"v": 1, "ok": true}, [{"v": 2.5, "ok": null}], {"sub": {"deep": "x", "v": null}, "v": 3}]}'
    df = spark.createDataFrame([("a", text, 1), ("a", text, 2), ("b", "broken", 3), (None, text, 4), ("c", "[]", 5), ("d", None, 6)], "id string, j string, dewey int")
    rows = n.objects(df, ["j"])
    kinds = {(r.schema_path, r.name): (r.type, r.n) for r in n.columns_of(rows).collect()}
    assert kinds == {("j", "name"): ("string", 1), ("j", "id"): ("double", 1), ("j.list[*]", "v"): ("double", 2), ("j.list[*]", "ok"): ("boolean", 1), ("j.list[*][*]", "v"): ("double", 1), ("j.list[*][*]", "ok"): ("string", 1), ("j.list[*].sub", "deep"): ("string", 1), ("j.list[*].sub", "v"): ("string", 1)}
    tables = n.flat_tables(rows)
    top, items, subs = tables["j"], tables["j.list[*]"], tables["j.list[*].sub"]
    assert [(r.name, r.id_, r.parent_dewey) for r in top.collect()] == [("top", 7.0, None)]
    assert sorted((r.v, r.ok, r.ord) for r in items.collect() if r.ok) == [(1.0, True, 0)] and tables["j.list[*][*]"].first().parent_dewey == top.first().dewey
    above = top.select("id", "field", top.dewey.alias("parent_dewey"), "name")
    assert items.join(above, ["id", "field", "parent_dewey"]).count() == 2
    assert subs.select("id", "field", "parent_dewey", "deep").join(items.select("id", "field", items.dewey.alias("parent_dewey"), "v"), ["id", "field", "parent_dewey"]).select("deep", "v").collect() == [("x", 3.0)]
    assert n.flat_tables(n.objects(df.limit(0), ["j"])) == {}
