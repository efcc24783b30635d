"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from weftline.llm import tokenizer
from weftline.runtime import Workspace

#: Tokens of a block, and tokens of a shard about.
BLOCK, SHARD = 256, 2_000_000


def apportion(weights, seats: int, caps) -> np.ndarray:
    """Seats by highest quotients weight / (2 n + 1), none beyond its cap; ties go to the larger weight, then the earlier place.

    A divisor found by bisection gives all but the last few seats at once, so the number of seats does not matter. Seats that no
    uncapped weight can take stay empty.
    """
    w, cap = np.maximum(np.nan_to_num(np.asarray(weights, float)), 0), np.maximum(np.asarray(caps, np.int64), 0)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return np.zeros(len(w), np.int64)
    take = lambda d: np.minimum(cap, np.floor(np.minimum(w / d, 4e18) + 0.5).astype(np.int64))
    low, high = 0.0, 2 * w.max() + 1e-300  # take(high) is nothing
    for _ in range(200):
        mid = (low + high) / 2
        if mid <= 0 or mid in (low, high):
            break
        low, high = (mid, high) if take(mid).sum() > seats else (low, mid)
    n = take(high * (1 + 1e-9))  # equal quotients that rounding would part are left to the queue
    queue = [(-w[i] / (2 * n[i] + 1), -w[i], i) for i in range(len(w)) if n[i] < cap[i]]
    heapq.heapify(queue)
    for _ in range(seats - int(n.sum())):
        _, _, i = heapq.heappop(queue)
        n[i] += 1
        if n[i] < cap[i]:
            heapq.heappush(queue, (-w[i] / (2 * n[i] + 1), -w[i], i))
    return n


def _targets(targets: DataFrame) -> DataFrame:
    """One row per named source: the largest share and cap given; null and negative shares are 0, a null cap is 1."""
    return targets.where("source is not null").groupBy("source").agg(F.greatest(F.coalesce(F.max("target_share"), F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce(F.max("max_repeats"), F.lit(1)), F.lit(0)).alias("max_repeats"))


def mix(docs: DataFrame, targets: DataFrame, seed: int = 0, block: int = BLOCK, shard: int = SHARD, folder: str = tokenizer.FOLDER, vocabulary: str = tokenizer.VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares).

    docs: doc_id, source, text; each row is a document. targets: source, target_share, max_repeats. The size aimed at is the token count of
    all documents of listed sources. Blocks of `block` tokens go to the sources by highest quotients; a source takes no more
    blocks than max_repeats uses of its documents fill, and what it can't take goes on to the others in their proportion.
    A source's blocks go to its shards (parts of about `shard` tokens, by a hash of doc_id) in the same way, and within a shard
    documents are taken in a seeded order: all of them once for each whole round of the quota, then the first ones, up to
    half a document more or less. mixture: doc_id, source, n_tokens, copies (at least 1). shares: one row per listed source.
    Documents without tokens or of other sources are in no mixture.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mix")
    wanted = _targets(targets)
    listed = wanted.collect()  # a configuration table
    names = spark.createDataFrame([(r["source"],) for r in listed], "source string")
    sized, _ = ws.write(tokenizer.count(docs.join(F.broadcast(names) if len(listed) <= 10_000 else names, "source"), ["doc_id", "source"], folder=folder, vocabulary=vocabulary).where("n_tokens > 0"))
    have = {r["source"]: (r["n"], r["docs"]) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()}  # at most a row for each listed source
    total = sum(n for n, _ in have.values())
    order = sorted(listed, key=lambda r: r["source"])
    caps = [r["max_repeats"] * have.get(r["source"], (0, 0))[0] // block for r in order]
    quota = apportion([r["target_share"] for r in order], total // block, caps)
    plan = spark.createDataFrame([(r["source"], float(r["target_share"]), int(r["max_repeats"]), have.get(r["source"], (0, 0))[1], have.get(r["source"], (0, 0))[0], int(q) * block, max(1, -(-have.get(r["source"], (0, 0))[0] // shard))) for r, q in zip(order, quota)], "source string, target_share double, max_repeats int, n_docs long, tokens long, quota_tokens long, shards long")
    small = F.broadcast(plan.select("source", "max_repeats", "quota_tokens", "shards")) if len(listed) <= 10_000 else plan.select("source", "max_repeats", "quota_tokens", "shards")
    placed = sized.join(small, "source").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("shards")))

    def share_out(key, table):
        t = table.combine_chunks()
        tokens, repeats, blocks = t["tokens"].to_numpy(), int(t["max_repeats"][0].as_py()), int(t["quota_tokens"][0].as_py()) // block
        by = np.argsort(t["shard"].to_numpy(), kind="stable")
        n = np.zeros(len(by), np.int64)
        n[by] = apportion(tokens[by], blocks, repeats * tokens[by] // block)
        return pa.table({"source": t["source"], "shard": t["shard"], "quota": n * block})

    # A row for each shard, far fewer than documents: a source of 10^12 tokens has half a million.
    shards = placed.groupBy("source", "shard", "max_repeats", "quota_tokens").agg(F.sum("n_tokens").alias("tokens"))
    quotas = shards.groupBy("source").applyInArrow(share_out, "source string, shard long, quota long")
    turn = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    line = placed.select("doc_id", "source", "shard", "n_tokens").withColumn("upto", F.sum("n_tokens").over(turn)).withColumn("size", F.sum("n_tokens").over(Window.partitionBy("source", "shard")))
    line = line.join(quotas, ["source", "shard"])
    more = (F.col("upto") * 2 - F.col("n_tokens") <= (F.col("quota") % F.col("size")) * 2).cast("long")
    mixture = line.withColumn("copies", F.floor(F.col("quota") / F.col("size")) + more).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")
    mixture, _ = ws.write(mixture)
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_docs"), F.max("copies").alias("most_copies"))
    shares = plan.drop("shards").join(got, "source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_copies"])
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # listed sources only
    return mixture, shares.withColumn("actual_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
