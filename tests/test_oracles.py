"""Every query of the table operators against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from durata.plans import queries as plans

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
VALUES = "".join(open(os.path.join(os.path.dirname(__file__), f)).read() for f in ("test_hazard_values.py", "test_resample.py"))
TABLES = "region nation customer supplier part orders lineitem events".split()


def views(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def db():
    return views(SF)


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "as_integer_ratio"):
        return round(float(v), 7) + 0.0
    return str(v)


def as_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, db, name):
    if name not in plans.oracle_sql():
        assert f'"{name}"' in VALUES, "a query without SQL needs a test of its values"
        pytest.skip("its values are tested elsewhere")
    df = plans.queries()[name](spark, SF)
    rows = df.collect()
    result = db.execute(plans.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    if not rows:  # the smallest tables hold no such row: both sides agree, and the next larger ones must show some
        assert result.fetchall() == []
        larger = SF.replace("sf0.001", "sf0.01")
        df = plans.queries()[name](spark, larger)
        rows, result = df.collect(), views(larger).execute(plans.oracle_sql()[name])
    assert rows, "a query that returns nothing proves nothing"
    assert as_rows(df.columns, rows) == as_rows(names, result.fetchall())
