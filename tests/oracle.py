"""Run catalogue queries next to their check SQL and compare schema and rows."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(name: str) -> str:
    n = name.lower()
    if n.startswith(("bigint", "int", "long", "smallint", "hugeint", "tinyint", "ubigint")):
        return "int" if not n.startswith("hugeint") else "hugeint"
    if n.startswith(("double", "float")):
        return "double"
    if n.startswith(("varchar", "string")):
        return "string"
    if n.startswith("timestamp"):
        return "timestamp"
    return n.split("(")[0]


def cell(v):
    if v is None:
        return "\0null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return str(v)


def compare(spark, con, name: str, run, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    rows = [tuple(cell(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(rows)} rows {took:.1f}s"
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: kind(str(d[1])) for d in rel.description}
    want_cols = sorted(names)
    if cols != want_cols:
        return False, f"columns {cols} != {want_cols}"
    at = [names.index(c) for c in want_cols]
    want = [tuple(cell(r[i]) for i in at) for r in rel.fetchall()]
    mine = {f.name: kind(f.dataType.simpleString()) for f in df.schema.fields}
    bad = {c: (mine[c], types[c]) for c in cols if mine[c] != types[c]}
    if bad:
        return False, f"types (spark, sql) {bad}"
    if sorted(rows) != sorted(want):
        a, b = set(rows), set(want)
        return False, (
            f"rows {len(rows)} vs {len(want)}; cols {cols}\n  spark only {sorted(a - b)[:4]}\n"
            f"  sql only   {sorted(b - a)[:4]}"
        )
    return True, f"{len(rows)} rows {took:.1f}s"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from matchloom.session import local_session

    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or any(n.startswith(a) for a in argv)]
    failed = 0
    for name in names:
        try:
            ok, text = compare(spark, con, name, queries[name], sql.get(name), sf)
        except Exception as exc:  # noqa: BLE001
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        failed += not ok
        print(("ok  " if ok else "FAIL"), name, text, flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
