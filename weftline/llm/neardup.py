"""Near-duplicate texts by SuperMinHash, banding, verification and union-find grouping."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import minhash
from weftline.runtime import Workspace, small

SKETCH_BITS = 256
_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]


@dataclass(frozen=True)
class Banding:
    """Bands of the signature. Of two sets of similarity s, a pair shares no band with chance (1 - s^rows)^count: 1.2e-4 at
    s = 0.7 with the defaults, 6e-7 at 0.75. agree is the least number of equal bits of the 256-bit sketches (4.8 standard
    deviations below the mean at 0.7); of pairs of similarity 0.2 one in a million has as many, so what is left is written as it is."""

    rows: int = 6
    count: int = 72
    agree: int = 190
    #: A bucket of more than 16 times so many members is parted, its parts being paired by tasks of their own.
    large: int = 2000
    #: Bands are joined in so many rounds, the shuffled rows of one being gone when the next begins.
    rounds: int = 4


@dataclass
class Classes:
    """members: (key, cid), one row per key and word set; sets: (cid, n, hashes), one row per distinct word set."""

    ws: Workspace
    members: DataFrame
    sets: DataFrame


def classes(texts: DataFrame, key: str = "key", text: str = "text") -> Classes:
    """Collapses texts with equal word sets. Null keys and texts without words are left out; repeated rows count once."""
    ws = Workspace(texts.sparkSession, "neardup", clear=True)
    w = texts.select(F.col(key).alias("key"), minhash.words(text).alias("w")).where("key is not null and size(w) > 0")
    base, _ = ws.write(w.select("key", minhash.set_key(F.col("w")).alias("cls"), minhash.word_hashes(F.col("w")).alias("hashes")))
    # Numbers given at writing stay as written; equal sets are brought together by partial aggregation, however many copies there are.
    sets, _ = ws.write(base.groupBy("cls").agg(F.first("hashes").alias("hashes")).select(F.monotonically_increasing_id().alias("cid"), "cls", F.size("hashes").alias("n"), "hashes"))
    members, _ = ws.write(base.select("key", "cls").distinct().join(sets.select("cls", "cid"), "cls").select("key", "cid"))
    ws.drop(base)
    return Classes(ws, members, sets.drop("cls"))


def signed(sets: DataFrame, b: Banding, *own: str) -> DataFrame:
    """(cid, n, bands, s0, s1, s2, s3, own columns) of sets (cid, n, hashes, own columns)."""
    def run(batches):
        for batch in batches:
            flat, offsets = minhash.flat_lists(batch.column(2))
            step = 512
            for i in range(0, batch.num_rows, step):
                part = offsets[i : i + step + 1]
                sig = minhash.signatures(flat[part[0] : part[-1]], part - part[0], b.rows * b.count)
                keys, sk = minhash.bands(sig, b.rows, b.count), minhash.sketch(sig, SKETCH_BITS).view(np.int64)
                got = batch.slice(i, step)
                bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, b.count, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1), bands, *(pa.array(x.copy()) for x in sk.T), *got.columns[3:]], names=["cid", "n", "bands", *_SKETCH, *own])

    kinds = dict(sets.dtypes)
    return sets.select("cid", "n", "hashes", *own).mapInArrow(run, ", ".join(["cid long, n int, bands array<long>", *(f"{c} long" for c in _SKETCH), *(f"{c} {kinds[c]}" for c in own)]))


def _ratio(a: str, b: str, num: int, den: int):
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def candidates(ws: Workspace, sets: DataFrame, num: int, den: int, b: Banding, meet, *own: str) -> DataFrame:
    """(a, b): cids of sets (as `signed` gives them, with own columns) that share a band, whose sketches are near and for which meet holds.

    meet is a condition on columns a_cid, a_own..., b_cid, b_own... Both sides of the join are one shuffle if it reads the same
    columns of a and b. Members of a bucket are compared where they meet and only pairs with near sketches are kept, so what is
    written grows with the pairs that are similar. A bucket that is too large for one task, as told from a sample, is parted: that
    moves rows, but changes no pair.
    """
    split = 16 * b.large
    share = min(1.0, 32 / split)
    some = sets.where(F.pmod(F.xxhash64("cid"), F.lit(2**20)) < int(share * 2**20)).select(F.explode("bands").alias("k"))
    parts = F.ceil(F.col("met") / (share * split)).cast("int").alias("parts")
    hot, got = ws.write(some.groupBy("k").agg(F.count("*").alias("met")).where(F.col("met") > share * split).select("k", parts), n=F.count("*"))
    n, rounds, step = got["n"] or 0, [], -(-b.count // b.rounds)

    def paired(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        x, y = (t.select(*on, *(F.col(c).alias(p + c) for c in ("cid", "n", *_SKETCH, *own))) for t, p in ((x, "a_"), (y, "b_")))
        differ = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in _SKETCH), F.lit(0))
        return x.join(y, on).where(meet & _ratio("a_n", "b_n", num, den) & (differ <= SKETCH_BITS - b.agree)).select(F.col("a_cid").alias("a"), F.col("b_cid").alias("b"))

    for lo in range(0, b.count, step):
        per = sets.select("cid", "n", *_SKETCH, *own, F.explode(F.slice("bands", lo + 1, step)).alias("k"))
        usual = per.join(small(hot, n), "k", "left_anti") if n else per
        found = paired(usual, usual, ["k"])
        if n:
            crowd = per.join(small(hot, n), "k")
            one, all_ = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
            found = found.unionByName(paired(crowd.withColumn("part", one), crowd.withColumn("part", all_), ["k", "part"]))
        rounds.append(ws.write(found.distinct())[0])
    found, _ = ws.write(ws.together(rounds).distinct())
    ws.drop(hot, *rounds)
    return found


def similar_sets(c: Classes, num: int = 7, den: int = 10, b: Banding = Banding()) -> DataFrame:
    """(a, b) with a < b: pairs of classes whose word sets have a Jaccard similarity of num/den or more, each checked on the whole sets."""
    marked, _ = c.ws.write(signed(c.sets, b))
    found = candidates(c.ws, marked, num, den, b, F.col("a_cid") < F.col("b_cid"))
    c.ws.drop(marked)
    left = c.sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = c.sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    common = F.size(F.array_intersect("ha", "hb"))
    pairs = found.join(left, "a").join(right, "b").withColumn("common", common).where(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num)
    return c.ws.write(pairs.select("a", "b"))[0]


def key_pairs(c: Classes, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of different keys with similar texts, those with equal word sets included."""
    m = c.members
    a, b = m.select(F.col("key").alias("k1"), F.col("cid").alias("a")), m.select(F.col("key").alias("k2"), F.col("cid").alias("b"))
    near = pairs.join(a, "a").join(b, "b").where("k1 <> k2").select(F.least("k1", "k2").alias("id_a"), F.greatest("k1", "k2").alias("id_b"))
    same = a.join(b, a["a"] == b["b"]).where("k1 < k2").select(F.col("k1").alias("id_a"), F.col("k2").alias("id_b"))
    return near.unionByName(same).distinct()


def _forest(batches):
    """Of the edges of one partition, those that a union-find needs."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                up[max(x, y)] = min(x, y)
    if up:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is linked with, however far.

    Union-find within partitions leaves stars; stars are then joined across partitions by alternately linking every node's
    larger, then smaller neighbours to its least one, until nothing changes.
    """
    e, got = ws.write(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(_forest, "u long, v long"), n=F.count("*"), s=F.sum(F.col("v").cast("decimal(38,0)")))
    least = lambda t: t.groupBy("u").agg(F.min("v").alias("m"))  # noqa: E731  with partial minima: a node with many edges is held by no task
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = both.where("v > u").join(least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down = big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
        star = down.join(least(down), "u")
        star = star.select("u", F.col("m").alias("v")).unionByName(star.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new, now = ws.write(star, n=F.count("*"), s=F.sum(F.col("v").cast("decimal(38,0)")))
        ws.drop(e)
        e = new
        if now == got:
            break
        got = now
    tops = e.select(F.col("v").alias("node")).distinct().join(e.select(F.col("u").alias("node")), "node", "left_anti")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(tops.select("node", F.col("node").alias("root")))


def groups(c: Classes, pairs: DataFrame) -> DataFrame:
    """(key, class_id, group_id, n_links): one row per key and word set; class_id is its word set, group_id the linked classes, n_links how many other classes are similar to its class."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("n_links"))
    roots = components(pairs, c.ws)
    out = c.members.join(roots, c.members["cid"] == roots["node"], "left").drop("node").join(ends, F.col("cid") == ends["node"], "left")
    return out.select("key", F.col("cid").alias("class_id"), F.coalesce("root", "cid").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
