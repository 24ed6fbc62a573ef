"""Every query that has SQL gives the rows of its SQL, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from frostline import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(normal, v))
    return v


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, db, name):
    if name == "paired_ttest":
        with pytest.raises(Exception, match="seeds"):  # not every nation has every segment here
            plans.QUERIES[name](spark, SF).collect()
        return
    df = plans.QUERIES[name](spark, SF)
    rows, cols = [tuple(r) for r in df.collect()], sorted(df.columns)
    if name not in plans.SQL:
        assert rows
        return
    found = db.sql(plans.SQL[name])
    assert sorted(found.columns) == cols
    pick = lambda names, r: tuple(normal(r[names.index(c)]) for c in cols)
    assert sorted((pick(df.columns, r) for r in rows), key=str) == sorted((pick(found.columns, r) for r in found.fetchall()), key=str)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_streaming(spark):
    from frostline.streaming.incremental import event_stream, first_seen_pairs, running_degrees

    events = spark.read.parquet(f"{SF}/events.parquet")
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        events.selectExpr("ts", "user_id", "user_id % 7 as item_id").write.parquet(f"{d}/in")
        stored = spark.read.parquet(f"{d}/in")
        for name, made in (("degrees", running_degrees), ("pairs", first_seen_pairs)):
            q = made(event_stream(spark, f"{d}/in", stored.schema)).writeStream.outputMode("complete" if name == "degrees" else "append").format("memory").queryName(name).start()
            q.processAllAvailable()
            q.stop()
        assert {tuple(r) for r in spark.table("degrees").collect()} == {tuple(r) for r in stored.groupBy("user_id").count().collect()}
        assert spark.table("pairs").select("user_id", "item_id").distinct().count() == stored.select("user_id", "item_id").distinct().count()
