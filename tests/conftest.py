"""A local session and the driver's tables in DuckDB, shared by all tests."""

from __future__ import annotations

import math
import os
import sys
import tempfile
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from lanternlake.session import local_session

    return local_session(partitions=4, **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-"), "spark.driver.memory": "6g"})


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return DATA


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def plain(x):
    """A value in a form in which Spark's and DuckDB's can be compared."""
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (int, bool)):
        return round(float(x), 9)
    if hasattr(x, "tzinfo"):
        return x.replace(tzinfo=None)
    return x


def bag(rows, columns) -> list:
    """The rows in an order of their own, columns in the order of their names."""
    by = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in by) for r in rows), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(df, sql: str) -> int:
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(columns)
        expected = bag(found.fetchall(), columns)
        assert bag([r.asDict(recursive=True).values() and tuple(r.asDict(recursive=True).values()) for r in df.collect()], df.columns) == expected
        return len(expected)

    return check
