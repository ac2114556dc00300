"""Compare registered queries with their SQL twins in DuckDB.

    python tools/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import importlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def main() -> int:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--modules", default="")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    import duckdb
    from pyspark.sql import SparkSession

    from barweave.plans import registry

    if a.modules:
        for m in a.modules.split(","):
            importlib.import_module(f"barweave.plans.{m}")
        qs = registry.QUERIES
    else:
        qs = registry.load_all()
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{a.sf}/{t}.parquet'")
    bad = 0
    for name, q in qs.items():
        if a.names and name not in a.names:
            continue
        if a.modules and q.build.__module__.rsplit(".", 1)[-1] not in a.modules.split(","):
            continue
        t0 = time.time()
        try:
            df = q(spark, a.sf)
            names = sorted(df.columns)
            got = [tuple(norm(v) for v in r) for r in df.select(*names).collect()]
            dt = time.time() - t0
            if q.sql is None:
                print(f"rows {name}: {len(got)} rows, {dt:.1f}s", flush=True)
                continue
            t1 = time.time()
            rel = con.sql(q.sql)
            cols = {n: str(ty) for n, ty in zip(rel.columns, rel.types)}
            if sorted(cols) != names:
                raise AssertionError(f"columns {names} vs {sorted(cols)}")
            want = [tuple(norm(v) for v in r) for r in rel.select(*[f'"{n}"' for n in names]).fetchall()]
            key = lambda r: tuple((x is None, str(x)) for x in r)
            got.sort(key=key), want.sort(key=key)
            types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            kinds = {"double": "DOUBLE", "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN"}
            odd = [f"{n}:{types[n]}/{cols[n]}" for n in names if kinds.get(types[n], "?") != cols[n]]
            ok = got == want
            if ok:
                print(f"ok   {name}: {len(got)} rows, {dt:.1f}s spark, {time.time() - t1:.1f}s duckdb {' '.join(odd)}", flush=True)
            else:
                bad += 1
                diff = sum(g != w for g, w in zip(got, want))
                print(f"FAIL {name}: {len(got)} vs {len(want)} rows, {diff} differ {' '.join(odd)}", flush=True)
                only_g = sorted(set(got) - set(want), key=key)[:3]
                only_w = sorted(set(want) - set(got), key=key)[:3]
                print("   cols  ", names, "\n   spark ", only_g, "\n   duckdb", only_w, flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
