"""Run registered queries on Spark and their SQL on DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    return str(v)


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, name, fn, sql, sf):
    """Message describing the first difference, or None."""
    df = fn(spark, sf)
    cols = sorted(df.columns)
    left = Counter(tuple(norm(v) for v in row) for row in df.select(*cols).collect())
    if sql is None:
        return None if left else "no rows"
    rel = con.execute(sql)
    dcols = [d[0] for d in rel.description]
    if sorted(dcols) != cols:
        return f"columns {cols} != {sorted(dcols)}"
    at = [dcols.index(c) for c in cols]
    right = Counter(tuple(norm(row[i]) for i in at) for row in rel.fetchall())
    if left == right:
        return None if left else "no rows"
    a, b = list((left - right).items())[:3], list((right - left).items())[:3]
    return f"rows {sum(left.values())} vs {sum(right.values())}; cols {cols}\n   spark {a}\n   duck  {b}"


def main(sf, patterns):
    import __spark_entry__ as entry
    from tests.session import session

    spark, con = session(), duck(sf)
    oracle, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if patterns and not any(name.startswith(p) for p in patterns):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        tag = "ok  " if problem is None else "FAIL"
        print(f"{tag} {name} {time.time() - start:.1f}s{'' if name in oracle else ' (rows only)'}", flush=True)
        if problem:
            print("   ", problem, flush=True)
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
