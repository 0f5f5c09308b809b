import duckdb
import pytest
from cohortlab.plans import registry

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("customer", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, con, name):
    a, b = registry.QUERIES[name](spark, DIR).toPandas(), con.execute(registry.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(str).replace("None", "nan").values.tolist()))
    assert rows(a) == rows(b)
