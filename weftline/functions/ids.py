"""Content-addressed ids. Parts are joined by U+001F; DuckDB's sha256(concat_ws(chr(31), ...)) gives the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _texts(parts) -> list[Column]:
    return [F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts]


def stable_id(*parts, size: int = 16) -> Column:
    """First `size` hex digits of the SHA-256 of the parts; null parts count as ''."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *_texts(parts)), 256), 1, size)


def cache_key(model, system, user, temperature, max_tokens) -> Column:
    """Key of a completion request."""
    return F.sha2(F.concat_ws("\x1f", *_texts((model, system, user, temperature, max_tokens))), 256)


def embedding_key(model, text) -> Column:
    return F.sha2(F.concat_ws(":", *_texts((model, text))), 256)
