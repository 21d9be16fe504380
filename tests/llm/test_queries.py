import duckdb
import pytest

from lexmill.llm import queries
from tests.conftest import DATA, rows

TINY = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not TINY.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in TINY.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(TINY))
    r = c.execute(queries.ORACLES[name])
    order = [[d[0] for d in r.description].index(x) for x in df.columns]
    assert rows(df) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)


@pytest.mark.parametrize("name", ["p2_found", "p5_found", "p9_mix", "p9_shares", "p10_found"])
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, str(TINY))
    assert df.count() == df.distinct().count() > 0
