"""Runs a registered query and its SQL over the same tables and compares them as multisets."""

from __future__ import annotations

import glob
import os
import sys
from collections import Counter
from pathlib import Path

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def normal(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(map(normal, value))
    if isinstance(value, dict):
        return tuple(sorted((k, normal(v)) for k, v in value.items()))
    return value


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(normal(r[i]) for i in order) for r in data)


def duck(sql: str, sf: str = SF):
    con = duckdb.connect(config={"threads": 4})
    for path in glob.glob(f"{sf}/*.parquet"):
        name = Path(path).stem
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{source}')")
    result = con.execute(sql)
    return rows([d[0] for d in result.description], result.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def difference(df, sql: str, sf: str = SF) -> str:
    (names, ours), (theirs_names, theirs) = spark_rows(df), duck(sql, sf)
    if names != theirs_names:
        return f"columns {names} and {theirs_names}"
    if ours != theirs:
        return f"rows {sum(ours.values())} and {sum(theirs.values())}; only ours {list((ours - theirs).items())[:4]}; only SQL {list((theirs - ours).items())[:4]}"
    return ""


if __name__ == "__main__":  # python tests/compare.py SF_DIR QUERY...
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from tests.conftest import session

    spark, sf, names = session(), sys.argv[1], sys.argv[2:]
    sql, queries = entry.oracle_sql(), entry.queries()
    for name in names or [n for n in queries if n.startswith("k")]:
        began = time.time()
        try:
            if name in sql:
                said = difference(queries[name](spark, sf), sql[name], sf) or "equal"
            else:
                said = f"rows only: {queries[name](spark, sf).count()}"
        except Exception as error:  # noqa: BLE001
            said = f"ERROR {str(error)[:1500]}"
        print(f"{name}: {time.time() - began:.1f} s {said}", flush=True)
