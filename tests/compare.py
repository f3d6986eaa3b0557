"""Compare registered queries with their SQL on one data folder.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads = 8")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normalise(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reindex(sorted(frame.columns), axis=1)
    out = pd.DataFrame(index=frame.index)
    for column in frame.columns:
        s = frame[column]
        if pd.api.types.is_bool_dtype(s.dtype) or str(s.dtype) == "boolean":
            out[column] = s.astype(object).map(lambda v: None if pd.isna(v) else str(bool(v)))
        elif pd.api.types.is_numeric_dtype(s.dtype):
            out[column] = s.astype(float).map(lambda v: None if pd.isna(v) else repr(round(v, 9) + 0.0))
        elif pd.api.types.is_datetime64_any_dtype(s.dtype):
            out[column] = s.map(lambda v: None if pd.isna(v) else str(pd.Timestamp(v)))
        else:
            out[column] = s.astype(object).map(_plain)
    return out.fillna("␀").sort_values(list(out.columns)).reset_index(drop=True)


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool,)):
        return str(v)
    if isinstance(v, (int, float)):
        return repr(round(float(v), 9) + 0.0)
    return str(v)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} != {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} != {len(sql_frame)}"
    a, b = normalise(spark_frame), normalise(sql_frame)
    bad = (a != b).any(axis=1)
    if bad.any():
        at = bad[bad].index[:3]
        return f"{int(bad.sum())} rows differ\nspark\n{a.loc[at].to_string()}\nsql\n{b.loc[at].to_string()}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from scanloom.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    built, sql = queries(), oracle_sql()
    names = [n for n in built if not wanted or any(w == n or (w.endswith("*") and n.startswith(w[:-1])) for w in wanted)]
    failed = []
    for name in names:
        start = time.time()
        try:
            got = built[name](spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name} {len(got)} rows {took:.1f}s", flush=True)
                continue
            start = time.time()
            problem = differences(got, con.execute(sql[name]).df())
            print(f"{'ok   ' if problem is None else 'DIFF '} {name} {len(got)} rows {took:.1f}s "
                  f"sql {time.time() - start:.1f}s", flush=True)
            if problem:
                print(problem[:1800])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {error}"
            print(f"FAIL  {name} {problem[:1500]}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names)} queries, {len(failed)} failing: {failed}")
    spark.stop()
    os._exit(1 if failed else 0)


if __name__ == "__main__":
    main()
