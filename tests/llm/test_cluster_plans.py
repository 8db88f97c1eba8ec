"""Corpus operators under adaptive execution and generated code, against brute force and SQL."""

import duckdb
import pytest

from tests.llm import brute
from xylem.llm import near_dedup, queries, repeats, wavelet

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cluster(spark):
    wanted = {"spark.sql.adaptive.enabled": "true", "spark.sql.codegen.wholeStage": "true", "spark.sql.codegen.factoryMode": "FALLBACK", "spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", [n for n in queries.ORACLES])
def test_oracle(cluster, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](cluster, SF)
    columns = [c for c in sorted(con.execute(f"SELECT * FROM ({queries.ORACLES[name]}) LIMIT 0").df().columns)]
    rows = sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in got.select(*columns).collect()), key=str)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert rows == sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in want), key=str)


def test_repeats_and_near_copies_of_a_hot_group(cluster, monkeypatch):
    """A third of all rows are one text, another third near copies of it."""
    monkeypatch.setattr(near_dedup, "BLOCK_UNITS", 8)
    base = [f"w{i}" for i in range(120)]
    data = [(i, " ".join(base)) for i in range(60)] + [(100 + i, " ".join([*base[:50], f"x{i}", *base[51:]])) for i in range(60)] + [(200 + i, " ".join(f"v{i}n{j}" for j in range(80))) for i in range(60)]
    df = cluster.createDataFrame(data, "doc_id long, text string").repartition(9)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(near_dedup.verdicts(df).select("doc_id", "n_shingles", "component_id")) == sorted(brute.near(data), key=str)
    assert rows(repeats.cut_repeats(df, 100, 40, False, 4).drop("text")) == sorted(brute.repeats(data, 100), key=str)


def test_very_long_texts(cluster):
    """One text longer than a slice, with repeats at both ends (and the blank before the second, which comes again within), among short ones."""
    long = "start of a passage that comes again " * 20 + "".join(f"word{i} " for i in range(250_000)) + "start of a passage that comes again " * 20
    data = [(1, long), (2, "short"), (3, None), (4, "start of a passage that comes again " * 20)]
    df = cluster.createDataFrame(data, "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(near_dedup.verdicts(df).select("doc_id", "n_shingles", "component_id")) == sorted(brute.near(data), key=str)
    got = {r.doc_id: r for r in repeats.verdicts(df).collect()}
    assert got[1].n_bytes == len(long) and got[1].n_removed == 2 * 36 * 20 + 1 and got[1].n_spans == 2 and got[4].n_removed == 720 and got[2].n_removed == 0
    assert sum(r.n_tokens for r in wavelet.round_trip(df).collect()) > 500_000
