"""Every query with an oracle against DuckDB on the small tables."""

import glob
import math
import os

import duckdb
import pytest

from levylens.plans import loads  # noqa: F401  registers its queries
from levylens.plans.queries import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    return "-" if x is None else f"{x:.4f}" if isinstance(x, float) and not math.isnan(x) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    rows = sorted([plain(r[c]) for c in cols] for r in got.collect())
    assert rows
    if name in ORACLES:
        want = con.execute(ORACLES[name])
        names = [x[0] for x in want.description]
        assert sorted(names) == cols
        assert rows == sorted([plain(r[names.index(c)]) for c in cols] for r in want.fetchall())
