import duckdb
import pytest

from lexmill.plans import storage
from tests.conftest import DATA, rows

TINY = DATA / "sf0.001"
pytestmark = pytest.mark.skipif(not TINY.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(storage.QUERIES))
def test_round_trips(spark, name):
    df = storage.QUERIES[name](spark, str(TINY))
    if name not in storage.ORACLES:
        assert df.count() > 0
        return
    c = duckdb.connect()
    for p in TINY.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    r = c.execute(storage.ORACLES[name])
    order = [[d[0] for d in r.description].index(x) for x in df.columns]
    assert rows(df) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
