"""The core queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from sparkfold import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [q for q in queries.QUERIES if not q.startswith("tccg_")] + [q for q in queries.QUERIES if q.startswith("tccg_")][::8]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SOME)
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(got.columns) == sorted(cols)
    want = sorted(tuple(r) for r in cur.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(q.startswith("tccg_") for q in entry.queries()) == 49


def test_gram_supplier_of_keys_far_apart(spark, sf, tmp_path):
    """D is as large as the suppliers are many, not as their keys are great."""
    for t, cols in (("supplier", {"s_suppkey"}), ("lineitem", {"l_suppkey", "l_partkey"}), ("part", {"p_partkey"})):
        df = spark.read.parquet(f"{sf}/{t}.parquet")
        df.withColumns({c: df[c] * 10_000_019 for c in cols}).write.parquet(str(tmp_path / f"{t}.parquet"))
    c = duckdb.connect()
    for t in ("supplier", "lineitem"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = entry.queries()["gram_supplier"](spark, str(tmp_path))
    want = sorted(c.execute(f"SELECT s, t, value FROM ({entry.oracle_sql()['gram_supplier']})").fetchall())
    assert len(want) > 1 and sorted(tuple(r) for r in got.select("s", "t", "value").collect()) == want
