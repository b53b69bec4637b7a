"""Every query beside its SQL, at the smallest size."""

import duckdb
import pytest

from textwarden.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Some of each group; the whole list takes minutes.
SOME = [n for n in registry.ORACLES if n.split("_")[0] in {"b3", "b5", "c1", "d1", "d3", "e1", "e11", "f2", "f11", "g3", "g12", "h7", "i6", "j9", "k3", "k6", "m2", "m3"}]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or v != v else float(f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf, duck, name):
    a = registry.QUERIES[name](spark, sf)
    cols = sorted(a.columns)
    b = duck.sql(registry.ORACLES[name])
    assert sorted(b.columns) == cols
    got = sorted((tuple(plain(r[c]) for c in cols) for r in a.collect()), key=str)
    want = sorted((tuple(plain(v) for v in r) for r in b.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), key=str)
    assert got == want


def test_names():
    import __spark_entry__ as entry

    assert registry.FLAGSHIP in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
