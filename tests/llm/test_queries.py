import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from oracle_check import digest, duck  # noqa: E402
from tablelens.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    df = queries.QUERIES[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    got = duck(folder).execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    want = got.fetchall()
    assert sorted(df.columns) == sorted(names) and len(rows) == len(want)
    assert digest(df.columns, rows) == digest(names, want)


def test_every_operator_is_registered_once():
    import __spark_entry__ as e
    numbers = sorted(int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in e.queries()
