"""Every registered query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from urlloom.plans.oracles import ORACLE_SQL
from urlloom.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        if glob.glob(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(None if r[i] is None else str(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert rows
        return
    got = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(rows, df.columns) == plain(got.fetchall(), names)


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["normalize_mixed", "ipv4_normalize", "opaque_urls", "url_credentials", "opaque_edits", "ipv6_hosts", "file_urls"])
def test_one_row_group_is_work_for_all_cores(spark, name):
    assert QUERIES[name](spark, DATA).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
