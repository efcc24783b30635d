"""Holds a Spark query against its SQL in DuckDB."""

import math
import os
from collections import Counter

import duckdb

DATA = "/root/testdata"


def norm(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


def differences(spark, queries, sql, name, sf="sf0.001"):
    d = f"{DATA}/{sf}"
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f[:-8]} as select * from '{d}/{f}'")
    df = queries[name](spark, d)
    cols = sorted(df.columns)
    ours = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    got = con.execute(sql[name])
    at = [x[0] for x in got.description]
    assert sorted(at) == cols
    theirs = Counter(tuple(norm(r[at.index(c)]) for c in cols) for r in got.fetchall())
    return list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
