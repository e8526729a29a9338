"""Run registered queries next to their DuckDB oracles: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duckdb_views(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def oracle_rows(con, statement: str):
    cursor = con.execute(statement)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = Counter(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
    return sorted(names), rows


def spark_rows(df):
    names = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())
    return names, rows


def main(argv: list[str]) -> int:
    from checks.queries import QUERIES
    from sentilake.session import local_session

    sf = argv[0] if argv and Path(argv[0]).is_dir() else "/root/testdata/sf0.01"
    names = [a for a in argv if a in QUERIES] or list(QUERIES)
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_views(sf)
    failed = []
    for name in names:
        q = QUERIES[name]
        start = time.time()
        try:
            got_names, got = spark_rows(q.run(spark, sf))
            took = time.time() - start
            if q.oracle is None:
                print(f"rows  {name}: {sum(got.values())} rows, {took:.1f}s", flush=True)
                continue
            start = time.time()
            want_names, want = oracle_rows(con, q.oracle)
            ok = got_names == want_names and got == want
            print(
                f"{'ok   ' if ok else 'DIFF '} {name}: {sum(got.values())} / {sum(want.values())} rows, "
                f"{took:.1f}s, oracle {time.time() - start:.1f}s",
                flush=True,
            )
            if not ok:
                failed.append(name)
                print("   columns", got_names, want_names)
                print("   only spark ", list((got - want).items())[:3])
                print("   only oracle", list((want - got).items())[:3], flush=True)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"FAIL  {name}: {str(error)[:600]}", flush=True)
    print("failed:", failed)
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
