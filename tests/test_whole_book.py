"""Queries over the whole book, against their SQL with its bounds taken out (the SQL itself keeps them)."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from citeloom import catalog

SF = "/root/testdata/sf0.01"
#: All pairs of instruments are too many for SQL there.
SMALL = {"nearest_year_options": "/root/testdata/sf0.001"}
BOUNDS = {
    "extract_provisions": [" WHERE okey < 5000"],
    "order_keys": [" WHERE okey < 4000"],
    "prefix_descendants": ["okey < 2000 AND "],
    "route_range": [" WHERE b.okey % 5 = 0"],
    "nearest_year_options": [" QUALIFY row_number() OVER (PARTITION BY status, year ORDER BY number) <= 3", " WHERE q.number % 500 = 0"],
}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", BOUNDS)
def test_whole_book(spark, name):
    db, sf = duckdb.connect(), SMALL.get(name, SF)
    for f in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    sql = catalog.oracle_sql()[name]
    for bound in BOUNDS[name]:
        assert bound in sql
        sql = sql.replace(bound, "")
    want = db.execute(sql)
    names = [c[0] for c in want.description]
    rows = catalog.queries()[name](spark, sf).select(*names).collect()
    assert Counter(map(tuple, rows)) == Counter(want.fetchall())
