"""Every query with SQL returns the rows of its SQL on the small tables; the others run."""

import duckdb
import pandas as pd
import pytest

from petrilens.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(df):
    out = []
    for r in df[sorted(df.columns)].itertuples(index=False):
        row = []
        for v in r:
            try:
                v = None if pd.isna(v) else float(v)
            except (TypeError, ValueError):
                v = str(v)
            row.append(v)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), 0 if v is None else v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, db, name):
    a, b = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    x, y = norm(a), norm(b)
    assert len(x) == len(y)
    for p, q in zip(x, y, strict=True):
        assert all(abs(i - j) <= 2e-6 + 1e-9 * abs(i) if isinstance(i, float) and isinstance(j, float) else i == j for i, j in zip(p, q, strict=True)), (p, q)


@pytest.mark.parametrize("name", ["kmeans_foreground", "pca_components", "growth_models", "track_hybrid"])
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
