"""Every query that SQL can express gives the rows of its SQL."""

import math
import os

import duckdb
import pytest

from tideway.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def sorted_rows(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, db, data, name):
    got = catalog.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = db.execute(catalog.SQL[name])
    named = [c[0] for c in want.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    rows = sorted_rows([tuple(plain(r[c]) for c in columns) for r in got.collect()])
    assert rows == sorted_rows([tuple(plain(r[i]) for i in at) for r in want.fetchall()])
    assert rows or name in ("state_read",)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_filters_reach_the_scan(spark, data):
    from tideway.operators import reader
    from tideway.sources import store

    path = f"{spark.conf.get('spark.checkpoint.dir')}/pushed"
    rows = spark.createDataFrame([("t", 0, i, 0, "a", "k") for i in range(20)], "topic string, partition int, ms long, seq long, type string, key string")
    store.append(rows, path, 0)
    read = store.read(spark, path, "t").where("partition = 0 and type = 'a'")
    plan = reader.read_after(read, 0, (7, 3), 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ms,7)" in plan and "EqualTo(type,a)" in plan and "PartitionFilters: [isnotnull(topic" in plan
