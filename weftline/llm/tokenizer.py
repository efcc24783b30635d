"""Byte-level BPE with the merge ranks of a public tokenizer, and its decoder."""

from __future__ import annotations

import base64
import heapq
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the split into pieces that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker keeps; when full, the memory is emptied.
KEPT = 200_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token -> rank from a vocabulary file: base64 token, space, rank on each line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class _Pieces(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        ids = self.encode(piece.encode())
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """encode(text) and decode(ids) for a rank table; without special tokens, whose strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.pieces = _Pieces(self.merge)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one piece: the pair of lowest rank merges first, of equal ones the leftmost.

        Symbols form a doubly linked list; the queue holds (rank, left, end of the right symbol). An entry whose symbols have
        changed since is stale and skipped, so a piece of n bytes takes n log n steps.
        """
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return (whole,)
        n = len(piece)
        end = list(range(1, n + 1))  # of the symbol that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        queue = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue
            end[i], end[j] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(queue, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(queue, (r, h, stop))
        ids, i = [], 0
        while i < n:
            ids.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


_MADE: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary file."""
    key = hash(shared.value)
    if key not in _MADE:
        _MADE[key] = Encoder(read_ranks(shared.value))
    return _MADE[key]


def _share(df: DataFrame, folder: str, vocabulary: str):
    """The file of the vocabulary (under 1 MB), read by the driver alone."""
    return df.sparkSession.sparkContext.broadcast(Path(folder, vocabulary).read_bytes())


def encode(df: DataFrame, text: str = "text", to: str = "ids", folder: str = FOLDER, vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """The columns of df (or those in keep) and `to`, the token ids of the whole text; empty and null texts have an empty list.

    Each row is encoded where it is read; an existing column named `to` is replaced. A text that decoding gives back unchanged is any text.
    """
    shared = _share(df, folder, vocabulary)
    cols = [c for c in (df.columns if keep is None else keep) if c != to]

    def run(batches):
        e = _encoder(shared)
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # slices of bounded text, as ids take more room
                size, stop = 0, at
                while stop < batch.num_rows and (size < 4_000_000 or stop == at):
                    size += len(batch.column(0)[stop].as_py() or "")
                    stop += 1
                part = batch.slice(at, stop - at)
                ids = [e.encode(t) if t else [] for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(ids, pa.list_(pa.int32()))], names=[*cols, to])
                at = stop

    source = df.select(F.col(text).cast("string").alias("__text"), *[F.col(c) for c in cols])
    schema = df.select(*cols).schema.add(to, T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ids: str = "ids", to: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with `to`, the text of the ids: their vocabulary strings joined, read as UTF-8. Null ids give null, an unknown id an error."""
    shared = _share(df, folder, vocabulary)
    cols = [c for c in df.columns if c != to]

    def run(batches):
        e = _encoder(shared)
        for batch in batches:
            texts = [None if x is None else e.decode(x) for x in batch.column(len(cols)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(cols)], pa.array(texts, pa.string())], names=[*cols, to])

    return df.select(*cols, F.col(ids).alias("__ids")).mapInArrow(run, df.select(*cols).schema.add(to, "string"))


def count(df: DataFrame, keep: list[str], text: str = "text", to: str = "n_tokens", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns in keep and `to`, the number of tokens; 0 for empty and null texts."""
    shared = _share(df, folder, vocabulary)

    def run(batches):
        e = _encoder(shared)
        for batch in batches:
            n = [len(e.encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*keep, to])

    source = df.select(F.col(text).cast("string").alias("__text"), *[F.col(c) for c in keep])
    return source.mapInArrow(run, df.select(*keep).schema.add(to, "long"))
