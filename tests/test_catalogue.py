"""Every query of the core against its SQL in DuckDB, over the smallest of the driver's tables."""

from pathlib import Path

import pytest

from siltstone.plans import catalogue, reports  # noqa: F401

DATA = Path("/root/testdata/sf0.001")
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in DATA.iterdir():
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "tzinfo"):
        return v.replace(tzinfo=None)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in catalogue.SQL:
        r = duck.execute(catalogue.SQL[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(row[names.index(c)]) for c in cols) for row in r.fetchall()), key=repr)
