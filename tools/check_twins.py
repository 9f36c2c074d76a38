"""Run registered queries and their SQL twins side by side.

usage: python tools/check_twins.py [--sf DIR] [name ...]
"""

import argparse
import importlib
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tickloom.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), kind="stable", na_position="last").reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"columns {sorted(a.columns)} / {sorted(b.columns)}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    a, b = normal(a), normal(b)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {int((~same).sum())} differ, first {a.loc[i].to_dict()} / {b.loc[i].to_dict()}"
        if str(a[c].dtype) != str(b[c].dtype):
            return f"{c}: dtype {a[c].dtype} / {b[c].dtype}"
    return ""


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.01")
    p.add_argument("--modules", default="")
    p.add_argument("names", nargs="*")
    args = p.parse_args()
    if args.modules:
        for m in args.modules.split(","):
            importlib.import_module(f"tickloom.plans.{m}")
        from tickloom.plans.catalog import QUERIES, TWINS
    else:
        from tickloom.plans import load_all

        QUERIES, TWINS = load_all()
    spark = build_session("twins", cores=8, shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name in args.names or sorted(QUERIES):
        try:
            t0 = time.time()
            got = QUERIES[name](spark, args.sf).toPandas()
            t1 = time.time()
            if name not in TWINS:
                print(f"rows {name:32s} {len(got):8d} {t1 - t0:6.1f}s", flush=True)
                continue
            want = con.execute(TWINS[name]).df()
            t2 = time.time()
            diff = differences(got, want)
            bad += bool(diff)
            print(f"{'BAD ' if diff else 'ok  '} {name:32s} {len(got):8d} {t1 - t0:6.1f}s {t2 - t1:6.1f}s {diff[:600]}", flush=True)
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL {name:32s} {type(e).__name__}: {str(e)[:700]}", flush=True)
    print(f"{bad} bad")
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
