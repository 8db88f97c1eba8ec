"""The plans that a cluster runs: adaptive execution and generated code, which the other tests leave out for speed."""

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SOME = ["xpath_returned_items", "predicate_boolean", "compare_any_pair", "union", "axis_following", "function_id", "events_kinds", "events_kinds_stream", "dtd_rules", "serialize_kinds", "canonical_digest", "edit_set_text", "xinclude_element", "table_function", "load_files"]


@pytest.fixture(scope="module")
def cluster(spark):
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1", "spark.sql.shuffle.partitions": "5"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", SOME)
def test_oracle(cluster, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[name](cluster, SF)
    columns = sorted(got.columns)
    rows = sorted(map(tuple, got.select(*columns).collect()), key=str)
    assert rows == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall(), key=str)
