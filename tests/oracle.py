"""Compare catalog queries with their SQL on DuckDB: python -m tests.oracle [names]."""

import datetime
import math
import sys
import time
from importlib import import_module

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, query):
    """None if equal, else a description."""
    got = rows_of(df.columns, df.collect())
    cur = con.execute(query)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if got == want:
        return None
    wrong = sum(a != b for a, b in zip(got, want))
    first = next(((a, b) for a, b in zip(got, want) if a != b), ("", ""))
    return f"rows {len(got)} vs {len(want)}, {wrong} differ, first {first[0]} vs {first[1]}"


def main(names, sf_dir):
    from servelog import catalog
    from tests.local_session import local_session
    spark, con = local_session(), connect(sf_dir)
    queries, oracle = catalog.queries(), catalog.oracle_sql()
    picked = []
    for name in names or queries:
        if name in catalog.FAMILIES:
            picked += import_module(f"servelog.catalog.{name}").QUERIES
        else:
            picked.append(name)
    for name in picked:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                verdict = difference(df, con, oracle[name]) or "ok"
            else:
                verdict = f"no sql, {df.count()} rows"
        except Exception as error:  # keep going: this is a report
            verdict = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = next((a for a in args if a.startswith("/")), "/root/testdata/sf0.01")
    main([a for a in args if not a.startswith("/")], sf)
