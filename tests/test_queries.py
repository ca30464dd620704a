"""Each query against its DuckDB counterpart on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from sablespan.plans import base
from sablespan.plans import more as _registered  # noqa: F401
from sablespan.plans import wider as _wider  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    plain = []
    for row in frame.itertuples(index=False):
        values = []
        for v in row:
            if isinstance(v, pd.Timestamp):
                v = v.tz_localize(None)
            values.append(None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) else v)
        plain.append(tuple(values))
    return sorted(plain, key=lambda r: tuple(str(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r))


@pytest.mark.parametrize("name", sorted(base.ORACLE))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = base.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.sql(base.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows_of(got), rows_of(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or (isinstance(p, float) and math.isclose(p, q, rel_tol=1e-12)) for p, q in zip(x, y)), (x, y)


def test_entry_finds_and_masks(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    assert rows and all("█" in r["redacted"] and r["n_entities"] > 0 for r in rows)
