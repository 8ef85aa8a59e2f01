"""Every query of the engine's own operators against its SQL, on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

OWN = {k: f for plan in entry.PLANS for k, f in plan.QUERIES.items()}
SQL = {k: s for plan in entry.PLANS for k, s in plan.SQL.items()}


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or v != v:
        return "-"
    if hasattr(v, "item") and not isinstance(v, str):
        v = v.item() if getattr(v, "size", 1) == 1 else v.tolist()
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


@pytest.mark.parametrize("name", sorted(OWN))
def test_query(spark, con, sf, name):
    got = OWN[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = con.sql(SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    text = lambda df: sorted("|".join(map(plain, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None))
    assert text(got) == text(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_match():
    assert set(SQL) <= set(OWN)
    assert set(entry.oracle_sql()) <= set(entry.queries())
