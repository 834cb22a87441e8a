import os
import re

import duckdb
import pytest

import __spark_entry__
from strataflow.llm import queries


def test_ten_queries_and_the_pipeline_are_registered():
    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_native_operators_run_no_python():
    """Their modules import neither pandas nor Arrow, and define no functions for Python workers."""
    from strataflow.llm import mixing, secrets, sharding

    for module in (mixing, secrets, sharding):
        source = open(module.__file__).read()
        assert not re.search(r"pandas|pyarrow|mapIn|applyIn|\.rdd\b|\budf\b", source), module.__name__


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(result.fetchall(), key=str)
