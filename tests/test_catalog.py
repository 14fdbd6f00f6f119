"""Every query against its check SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver
from tidewatch.catalog.queries import REGISTRY

# covered by test_streaming and test_io
SLOW = {"stream_events", "stream_events_by_messages", "mlp_scores", "mlp_hold_out"}
CHECKED = sorted(n for n in set(REGISTRY) - SLOW)


@pytest.fixture(scope="module")
def db(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(a, b, abs_tol=2e-6, rel_tol=1e-9)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda row: [v if isinstance(v, float) else str(v) for v in row])


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, db, folder, name):
    frame = driver.queries()[name](spark, folder)
    got = [tuple(r) for r in frame.select(*sorted(frame.columns)).collect()]
    if name not in driver.oracle_sql():
        assert got
        return
    result = db.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    at = [columns.index(c) for c in sorted(columns)]
    want = [tuple(row[i] for i in at) for row in result.fetchall()]
    assert len(got) == len(want)
    for x, y in zip(ordered(got), ordered(want)):
        assert all(same(a, b) for a, b in zip(x, y)), (x, y)


def test_every_oracle_belongs_to_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
