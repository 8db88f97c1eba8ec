import duckdb
import pytest

import __spark_entry__
from xylem import catalog

SF = "/root/testdata/sf0.001"
#: A query of each kind; the driver compares all of them.
SOME = ["xpath_returned_items", "axis_following_sibling", "predicate_boolean", "compare_any_pair", "serialize", "navigate_paths", "dtd_validate", "parse_status_pages"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLES[name]})").fetchall()
    assert rows == sorted(want, key=str)
