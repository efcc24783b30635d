"""Model calls as a materialised stage: requests in, responses out, errors as columns."""

from __future__ import annotations

import hashlib
import time
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.ids import embedding_key
from weftline.functions.text import FINAL_ERRORS
from weftline.runtime import Workspace
from weftline.sources.cache import Cache

RESULT = "key string, response string, error string, attempts int"
#: Most attempts of a call, shortest and longest wait in seconds.
ATTEMPTS, SHORTEST, LONGEST = 4, 1.0, 30.0


class Completer(Protocol):
    """Anything that can be pickled and answers a prompt; raising means the call failed."""

    def __call__(self, stage: str, prompt: str) -> str: ...


class Vectoriser(Protocol):
    """Anything that can be pickled and turns texts into vectors."""

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class StubCompleter:
    """Answers from the prompt's hash alone, in the response format of each stage; for tests and dry measurements."""

    def __init__(self, candidates: int = 3):
        self.candidates = candidates

    def __call__(self, stage: str, prompt: str) -> str:
        h = hashlib.sha256(prompt.encode()).hexdigest()
        part = lambda i: int(h[i * 4 : i * 4 + 4], 16)
        if stage == "judge":
            one = lambda i: f"=== JUDGEMENT {i + 1} ===\nCorrect: {'yes' if part(i) % 4 else 'no'}\nNovelty: {part(i + 1) % 101 / 100}\nDepth: {part(i + 2) % 101 / 100}\nSeed Alignment: {part(i + 3) % 101 / 100}\nNon-Stitched: {part(i + 4) % 101 / 100}\nSolution Economy: {part(i + 5) % 101 / 100}\nDecision:\nFailure Kind: none\nNotes: stub"
        else:
            word = "REFINED" if stage == "refine" else "CANDIDATE"
            one = lambda i: f"=== {word} {i + 1} ===\nTransformation: t{part(i) % 9}\nProblem: What is {part(i)} + {part(i + 1)}?\nAnswer: {part(i) + part(i + 1)}\nSolution: Add.\nWhy It Is New: other numbers\nFailure Risk: none"
        return "\n\n".join(one(i) for i in range(self.candidates))


def call(completer: Completer, stage: str, prompt: str, pause=time.sleep) -> tuple[str | None, str | None, int]:
    """(response, error, attempts) with waits that double from SHORTEST to LONGEST; errors that stay are not tried again."""
    for n in range(1, ATTEMPTS + 1):
        try:
            return completer(stage, prompt), None, n
        except Exception as e:
            said = str(e).lower()
            if n == ATTEMPTS or any(all(p in said for p in parts) for parts in FINAL_ERRORS):
                return None, str(e), n
            pause(min(LONGEST, SHORTEST * 2 ** (n - 1)))
    raise AssertionError


def stage(requests: DataFrame, name: str, completer: Completer, parallel: int | None = None) -> DataFrame:
    """RESULT rows for requests (key, prompt); parallel bounds the calls under way. Write the result before reading it twice, or calls repeat."""
    def run(batches):
        for batch in batches:
            got = [call(completer, name, p) if p is not None else (None, "no prompt", 0) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int32())], names=["key", "response", "error", "attempts"])

    source = requests.select(F.col("key").cast("string"), F.col("prompt").cast("string"))
    return (source.repartition(parallel) if parallel else source).mapInArrow(run, RESULT)


def complete_cached(requests: DataFrame, name: str, completer: Completer, store: Cache, parallel: int | None = None) -> DataFrame:
    """(key, content) of requests (key, prompt), key being the hash of the whole request: from the store where it has them, else by calls, whose answers are kept if they say anything.

    What is found is fixed before anything is added; the answers are read back from the store, so no call is made twice.
    """
    hits, misses = store.split(requests.dropDuplicates(["key"]))
    found = hits.select("key", "content")
    ws = Workspace(requests.sparkSession, "calls")
    kept, _ = ws.write(found)
    made, _ = ws.write(stage(misses, name, completer, parallel))
    store.put(made.where("response is not null").select("key", F.col("response").alias("content"), F.lit("stop").alias("finish_reason"), F.lit("").alias("usage"), F.lit(time.time()).alias("t")))
    return kept.unionByName(made.select("key", F.col("response").alias("content")))


def embed_cached(texts: DataFrame, model: str, vectoriser: Vectoriser, store: Cache, batch: int = 256) -> DataFrame:
    """(key, embedding) of texts (column text), each text once, from the store where it has them, else by the vectoriser in batches; null texts have none."""
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectoriser(part.column(1).to_pylist()), pa.list_(pa.float32()))], names=["key", "embedding"])

    keyed = texts.where("text is not null").select(embedding_key(model, F.col("text")).alias("key"), "text").dropDuplicates(["key"])
    hits, misses = store.split(keyed)
    ws = Workspace(texts.sparkSession, "vectors")
    kept, _ = ws.write(hits.select("key", "embedding"))
    made, _ = ws.write(misses.select("key", "text").mapInArrow(run, "key string, embedding array<float>"))
    store.put(made)
    return kept.unionByName(made)
