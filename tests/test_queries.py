"""Every query of the log that has SQL, against DuckDB over the same tables."""

import duckdb
import pytest
from helpers import SF

import __spark_entry__
from lodestrata.plans import queries as q


def plain(rows, names):
    return sorted(repr([r[n] if not isinstance(r[n], float) else round(r[n], 9) for n in sorted(names)]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return con


@pytest.mark.parametrize("name", list(q.ORACLE_SQL))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = plain([r.asDict() for r in df.collect()], df.columns)
    told = duck.sql(q.ORACLE_SQL[name])
    assert sorted(told.columns) == sorted(df.columns)
    assert got == plain([dict(zip(told.columns, r)) for r in told.fetchall()], told.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_level_is_merged(spark):
    """The levels hold every key, the last write of the log among them."""
    got, log = q.merge_every_level(spark, SF), q.event_log(spark, SF)
    assert got.select("key").distinct().count() == log.select("key").distinct().count()


def test_filter_has_every_live_key(spark):
    """The filter grows with the log, leaves no live key out and keeps most deleted ones out."""
    log = q.event_log(spark, SF)
    keys, live = log.select("key").distinct(), q.resolve.live(log).select("key")
    got = q.bloom_probe(spark, SF)
    assert not live.exceptAll(got).count() and got.count() - live.count() < 0.03 * (keys.count() - live.count())
    assert q.bloom_bits(spark, SF).count() > q.bloom_bits(spark, SF.replace("sf0.01", "sf0.001")).count()


def test_versions_by_number_are_limited_in_each_task(spark):
    for df in (q.version_first(spark, SF), q.version_nth(spark, SF)):
        assert "WindowGroupLimit" in df._jdf.queryExecution().executedPlan().toString()
