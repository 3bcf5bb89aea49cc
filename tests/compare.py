"""Run catalogued queries in Spark and in DuckDB and compare all rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = """region nation customer supplier part orders lineitem events documents embeddings pages
benchmark labels conversations""".split()
DATA = os.environ.get("KINMATCH_DATA", "/root/testdata/sf0.01")


def duck(sf_dir: str = DATA):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def kind(type_name: str) -> str:
    t = type_name.lower()
    if any(x in t for x in ("bigint", "int", "long", "hugeint")) and "[]" not in t and "array" not in t:
        return "integer"
    if t in ("double", "float") or t.startswith("decimal"):
        return "double" if not t.startswith("decimal") else "decimal"
    return {"varchar": "string", "string": "string", "boolean": "boolean"}.get(t, t)


def compare(spark, con, name, query, sql, sf_dir: str = DATA) -> str:
    """'' when equal, else what differs."""
    got = query(spark, sf_dir)
    rows = got.collect()
    if sql is None:
        return "" if rows else "no rows"
    wanted = con.execute(sql)
    columns = [d[0] for d in wanted.description]
    kinds = {d[0]: kind(str(d[1])) for d in wanted.description}
    if sorted(columns) != sorted(got.columns):
        return f"columns {sorted(got.columns)} != {sorted(columns)}"
    mine = {c: kind(t) for c, t in got.dtypes}
    if mine != kinds:
        return f"types {[(c, mine[c], kinds[c]) for c in mine if mine[c] != kinds[c]]}"
    a, b = _rows(got.columns, rows), _rows(columns, wanted.fetchall())
    if not a:
        return "no rows"
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"first difference {str(x)[:300]} != {str(y)[:300]}"
    return ""


def main(argv):
    import __spark_entry__ as registry
    from kinmatch.session import local_session

    sf_dir = DATA
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    oracles = registry.oracle_sql()
    failed = []
    for name, query in registry.queries().items():
        if argv and name not in argv:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "FAIL " + problem if problem else ("ok" if name in oracles else "ok (rows only)")
        print(f"{name:28} {time.time() - start:6.2f}s {mark}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed or "none")


if __name__ == "__main__":
    main(sys.argv[1:])
