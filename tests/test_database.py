"""A store over JDBC, in the embedded database that comes with Spark."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pulseframe.plans.index import Index
from pulseframe.sources.tables import RUN, Store

D0 = datetime(2024, 1, 1)
ROWS = "userid string, time timestamp, value double"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, jdbc={"url": f"jdbc:derby:memory:{tmp_path.name};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, split={"plain": "value"}, tasks=3)


def rows(spark, n, user="u", day=0):
    return spark.createDataFrame([(f"{user}{k % 3}", D0 + timedelta(days=day, minutes=k), float(k)) for k in range(n)], ROWS)


def test_reading_is_split(spark, store):
    assert not store.exists("plain")
    store.write(rows(spark, 90), "plain")
    got = store.read("plain")
    assert got.rdd.getNumPartitions() == 3 and sorted(map(tuple, got.collect())) == sorted(map(tuple, rows(spark, 90).collect()))
    assert max(len(x) for x in got.rdd.glom().collect()) < 40
    for k in range(5):
        store.write_run(rows(spark, 4, day=k), "runs", f"r{k}")
    assert store.read("runs").rdd.getNumPartitions() == 3 and store.read("runs").count() == 20
    store.drop("plain")
    assert not store.exists("plain")


def test_runs_are_replaced_in_one_transaction(spark, store, monkeypatch):
    store.write_run(rows(spark, 6), "t", "a", F.to_date("time"))
    store.write_run(rows(spark, 4, "w", 1), "t", "b", F.to_date("time"))
    store.write_run(rows(spark, 2), "t", "a", F.to_date("time"))
    state = lambda: sorted((r[RUN], r.userid, r.value) for r in store.read("t", runs=True).collect())
    before = state()
    assert len(before) == 6 and store.parts("t") == {"a/2024-01-01", "b/2024-01-02"} and not store.exists("t__stage")
    whole = Store._transact

    def broken(self, statements):
        whole(self, [*statements[:-1], ("INSERT INTO nowhere VALUES 1", [])] if len(statements) > 1 else statements)

    monkeypatch.setattr(Store, "_transact", broken)
    with pytest.raises(Exception, match="(?i)nowhere|error"):
        store.write_run(rows(spark, 5, "x"), "t", "a", F.to_date("time"))
    monkeypatch.setattr(Store, "_transact", whole)
    assert state() == before  # the old rows were deleted, and came back
    bad = rows(spark, 5, "x").withColumn("value", F.when(F.col("value") < 4, F.col("value")).otherwise(F.raise_error(F.lit("broken off")).cast("double")))
    with pytest.raises(Exception, match="broken off"):
        store.write_run(bad, "t", "a", F.to_date("time"))
    assert state() == before
    store.write_run(rows(spark, 5, "x"), "t", "a", F.to_date("time"))
    assert len(state()) == 9
    store.drop_run("t", "a")
    assert {r[0] for r in state()} == {"b"}
    store.replace(rows(spark, 3, "y", 1), "w", F.to_date("time"))
    store.replace(rows(spark, 2, "z", 1).unionByName(rows(spark, 1, "z", 2)), "w", F.to_date("time"))
    assert sorted(r.userid for r in store.read("w").collect()) == ["z0", "z0", "z1"]


def test_index_over_jdbc(spark, store):
    for k in range(3):
        store.write_run(rows(spark, 4, f"p{k}", k), "samples", f"r{k}", F.to_date("time"))
    index = Index(store, "samples", {"userid": "userid", "date": "to_date(time)"}, lows={"low": "value"}).refresh()
    assert store.parts(index.name) == store.parts("samples") and index.stale() == (set(), set())
    store.write_run(rows(spark, 2, "q", 5), "samples", "r9", F.to_date("time"))
    assert index.stale() == ({"r9/2024-01-06"}, set())
    assert {r.userid: r.n for r in index.refresh().spans().filter("userid like 'q%'").collect()} == {"q0": 1, "q1": 1}
    some = spark.createDataFrame([("q1",)], "userid string")
    assert index.parts_of(some) == {"r9/2024-01-06"} and index.read(some).count() == 1
    store.drop_run("samples", "r0")
    assert index.refresh().spans().filter("userid like 'p0%'").count() == 0
