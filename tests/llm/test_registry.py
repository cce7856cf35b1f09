import re

import __spark_entry__
from servelog.llm import queries


def test_all_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n) or n == "pipeline"]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14))
    assert "pipeline" in names and set(queries.SQL) <= set(__spark_entry__.oracle_sql())
