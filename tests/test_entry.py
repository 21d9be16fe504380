import duckdb
import pytest

import __spark_entry__ as e
from tests.conftest import DATA, rows

TINY = DATA / "sf0.001"


def test_names_and_contract():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and "unigrams" in q and "p4_found" in q


@pytest.mark.skipif(not TINY.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["unigrams", "vocabulary", "encoded_bigrams", "flat_catalog_fast", "id_distances", "p4_found", "chunked_wordcounts"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in TINY.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = e.queries()[name](spark, str(TINY))
    r = c.execute(e.oracle_sql()[name])
    order = [[d[0] for d in r.description].index(x) for x in df.columns]
    assert rows(df) == sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)


@pytest.mark.skipif(not TINY.exists(), reason="no test tables here")
def test_flagship(spark):
    assert e.entry(spark).count() > 0
