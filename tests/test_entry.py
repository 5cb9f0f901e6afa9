import os

import pytest

import __spark_entry__ as entry
from arborgrid import registry

DATA = "/root/testdata/sf0.001"


def test_registries_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["label", "bin", "n", "share"] and df.count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(n for n in registry.ORACLES if n not in {"watershed_cost", "superior_reconstruction"}))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    got, want = registry.QUERIES[name](spark, DATA), con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)

    def plain(v):
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        if hasattr(v, "item"):
            v = v.item()
        return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*names).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
