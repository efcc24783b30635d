"""JSON out of texts that hold more than JSON."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FENCE = re.compile(r"^\s*```[a-zA-Z0-9_-]*\s*\n?|\n?\s*```\s*$")


def balanced(s: str, mark: str) -> str | None:
    """The first stretch from mark ('{' or '[') to the brace that closes it, strings skipped; None if it never closes."""
    close = {"{": "}", "[": "]"}[mark]
    start = s.find(mark)
    depth, inside, i = 0, False, start
    while 0 <= i < len(s):
        ch = s[i]
        if inside:
            i += ch == "\\"
            inside = ch != '"'
        elif ch == '"':
            inside = True
        elif ch == mark:
            depth += 1
        elif ch == close:
            depth -= 1
            if not depth:
                return s[start : i + 1]
        i += 1
    return None


def salvage(s: str | None) -> str | None:
    """The JSON of a text without code fences: all of it if it parses, else its first balanced object, else list; None if there is none."""
    if s is None:
        return None
    bare = _FENCE.sub("", s).strip()
    for part in (bare, balanced(bare, "{"), balanced(bare, "[")):
        if part:
            try:
                json.loads(part)
                return part
            except (ValueError, RecursionError):
                pass
    return None


def salvage_column(df: DataFrame, key: str, column: str, to: str = "json") -> DataFrame:
    """(key, to): what can be salvaged of column. Texts that are JSON stay in the JVM; only the others are scanned in Python."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([salvage(s) for s in b.column(1).to_pylist()], pa.string())], names=[key, to])

    base = df.select(key, F.col(column).cast("string").alias(to))
    fine = F.coalesce(F.try_parse_json(to).isNotNull(), F.lit(False))
    broken = base.where(~fine)
    return base.where(fine).unionByName(broken.mapInArrow(run, broken.schema))
