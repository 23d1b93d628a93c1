"""Compare registered queries with their reference SQL: python tests/oracle_check.py SF [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA:
            return "~"
        if isinstance(v, float):
            return repr(float(v)) if v != int(v) or abs(v) > 1e15 else str(int(v))
        if hasattr(v, "item"):
            return cell(v.item())
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False, name=None))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """'' where equal, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a == b:
        return ""
    sa, sb = set(a), set(b)
    return f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:2]}; only sql {sorted(sb - sa)[:2]}"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from careerloom.runtime import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), connect(sf_dir)
    qs, oracles = queries(), oracle_sql()
    bad = 0
    for name in names or qs:
        t0 = time.time()
        try:
            got = qs[name](spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} spark: {str(e)[:600]}", flush=True)
            continue
        t1 = time.time()
        if name not in oracles:
            print(f"rows {name} {len(got)} {t1 - t0:.1f}s", flush=True)
            continue
        try:
            want = con.execute(oracles[name]).df()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name} sql: {str(e)[:600]}", flush=True)
            continue
        diff = compare(got, want)
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok  '} {name} {len(got)} {t1 - t0:.1f}s sql {time.time() - t1:.1f}s {diff[:900]}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main())
