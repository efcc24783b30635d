"""Hierarchies against walking the links one by one."""

import random

import pytest

from weftline.operators import hierarchy as h

ROWS = "id string, parent_id string, seed_id string"


def walk(links):
    """id -> (root, depth, on_circle, path) by following links."""
    out = {}
    for v in links:
        seen = [v]
        while (p := links[seen[-1]]) is not None and p not in seen:
            seen.append(p)
        if p is None:
            out[v] = (seen[-1], len(seen) - 1, False, "/".join(reversed(seen)))
        else:
            ring = seen[seen.index(p) :]
            if v in ring:
                out[v] = (min(ring), 0, True, v)
            else:
                way = seen[: seen.index(p)]
                out[v] = (min(ring), len(way), False, "/".join(reversed(way)))
    return out


def check(spark, links):
    df = spark.createDataFrame(list(links.items()), "id string, parent string")
    labels = h.label(df)
    labels.cache()
    want = walk(links)
    got = {r.id: r for r in labels.collect()}
    assert set(got) == set(want)
    for v, (root, depth, circle, _) in want.items():
        assert (got[v].root_id, got[v].depth, got[v].on_circle) == (root, depth, circle), v
    assert {r.id: r.path for r in h.paths(labels).collect()} == {v: w[3] for v, w in want.items()}
    pairs = {(a, v, i) for v, w in want.items() if not w[2] for i, a in enumerate(reversed(w[3].split("/"))) if i}
    found = [(r.id, r.descendant_id, r.distance) for r in h.descendants(labels, width=7).collect()]
    assert len(found) == len(set(found)) and set(found) == pairs
    numbers = {}
    for r in got.values():
        if not r.on_circle:
            numbers.setdefault(r.top, []).append(r.first)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())


@pytest.mark.parametrize("seed", range(4))
def test_random_forests_with_circles(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(150)]
    check(spark, {v: rng.choice(ids) if rng.random() < 0.35 else (ids[rng.randrange(i)] if i and rng.random() < 0.9 else None) for i, v in enumerate(ids)})


def test_chain_star_and_circles(spark):
    links = {f"c{i:03d}": f"c{i - 1:03d}" if i else None for i in range(130)}
    links |= {f"s{i:03d}": "s000" if i else None for i in range(300)}
    links |= {"self": "self", "a": "b", "b": "c", "c": "a", "below": "a", "belower": "below", "alone": None}
    check(spark, links)


def test_dirty_links(spark):
    rows = [("p", None, None), ("a", " P ", "x"), ("a", " P ", "x"), ("b", "", "p"), ("c", "  ", "P"), ("d", "gone", "p"), ("e", None, ""), (None, "p", "p"), ("f", "f", None)]
    got = {r.id: r.parent for r in h.resolve_links(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {"p": None, "a": "p", "b": "p", "c": "p", "d": None, "e": None, "f": "f"}


def test_repeated_id_with_two_parents_takes_the_smaller(spark):
    rows = [("p", None, None), ("q", None, None), ("a", "q", None), ("a", "p", None)]
    assert {r.id: r.parent for r in h.resolve_links(spark.createDataFrame(rows, ROWS)).collect()}["a"] == "p"


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], ROWS)
    labels = h.label(h.resolve_links(empty))
    assert labels.count() == 0 and h.paths(labels).count() == 0 and h.descendants(labels).count() == 0
    wide = spark.createDataFrame([("a", None, None, "x", 1, "y")], ROWS + ", parent string, ptr int, size string")
    assert [r.root_id for r in h.label(h.resolve_links(wide)).collect()] == ["a"]


def test_wanted_descendants_only(spark):
    labels = h.label(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string"))
    only = spark.createDataFrame([("b",), ("b",), ("zz",)], "id string")
    assert [(r.id, r.descendant_id) for r in h.descendants(labels, only).collect()] == [("b", "c")]


def test_rows_on_circles_have_what_hangs_below(spark):
    rng = random.Random(9)
    ids = [f"n{i:02d}" for i in range(60)]
    links = {v: rng.choice(ids) if rng.random() < 0.6 else None for v in ids}
    links |= {"self": "self", "a": "b", "b": "c", "c": "d", "d": "a", "below": "a", "belower": "below", "more": "belower", "alone": None}
    labels = h.label(spark.createDataFrame(list(links.items()), "id string, parent string"))
    on = {v for v, w in walk(links).items() if w[2]}
    want = set()
    for v in links:
        at, seen = links[v], {v}
        for n in range(1, len(links)):
            if at is None or at in seen:
                break
            seen.add(at)
            if at in on:
                want.add((at, v, n, v in on))
            at = links[at]
    got = [tuple(r) for r in h.ring_descendants(labels).collect()]
    assert len(got) == len(set(got)) and set(got) == want and ("b", "more", 4, False) in want
    sizes = {r.id: r.n_descendants for r in h.ring_sizes(labels).collect()}
    assert sizes == {v: sum(x[0] == v for x in want) for v in on} and sizes["self"] == 0
