"""Compare the corpus queries with their SQL on DuckDB: python -m tests.llm.oracle [names]."""

import sys
import time

from servelog.llm import queries
from tests.local_session import local_session
from tests.oracle import connect, difference


def main(args):
    sf_dir = next((a for a in args if a.startswith("/")), "/root/testdata/sf0.01")
    spark, con = local_session(), connect(sf_dir)
    for name in [a for a in args if not a.startswith("/")] or queries.SQL:
        start = time.time()
        verdict = difference(queries.QUERIES[name](spark, sf_dir), con, queries.SQL[name]) or "ok"
        print(f"{name:28s} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
