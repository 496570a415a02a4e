"""Row-exact comparison of a Spark result with the SQL result."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(df, con, sql: str) -> dict:
    """What differs: columns, column types, rows on one side only."""
    names = sorted(df.columns)
    cur = con.execute(sql)
    oracle_names = [d[0] for d in cur.description]
    if sorted(oracle_names) != names:
        return {"columns": (names, sorted(oracle_names))}
    at = [oracle_names.index(n) for n in names]
    want = Counter(tuple(r[i] for i in at) for r in cur.fetchall())
    got = Counter(tuple(r[n] for n in names) for r in df.collect())
    out = {}
    if got != want:
        out["only_spark"] = list((got - want).items())[:3]
        out["only_sql"] = list((want - got).items())[:3]
        out["counts"] = (sum(got.values()), sum(want.values()))
    return out


SPARK_TO_SQL = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
}


def type_differences(df, con, sql: str) -> dict:
    oracle = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return {
        n: (t, oracle[n]) for n, t in df.dtypes if SPARK_TO_SQL.get(t, t) != oracle[n]
    }
