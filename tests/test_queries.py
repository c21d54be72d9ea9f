"""Queries on small tables against their SQL, on one thread, so that its sums go in the order of the rows."""

from datetime import datetime, timedelta

import duckdb
import numpy as np

from pulseframe.plans import queries

T0 = datetime(2024, 1, 1)


def put(spark, tmp_path, events, files=4, first=0):
    """events: (user_id, time, type, value) in order; their parquet files are cut and dealt."""
    rows = [(k, time, user, kind, float(value)) for k, (user, time, kind, value) in enumerate(events, first)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def both(spark, sf, name):
    """The rows of a query and of its SQL, in its columns' order, sorted."""
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    db.execute("SET threads = 1")
    db.execute(f"CREATE TABLE events AS SELECT * FROM '{sf}/events.parquet/*.parquet' ORDER BY event_id")
    told = db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in told.description]
    wanted = sorted(map(repr, map(tuple, told.fetchall())))
    return sorted(repr(tuple(r)) for r in queries.queries()[name](spark, sf).select(*columns).collect()), wanted


def test_first_differences_after_0_and_next_to_the_middle(spark, tmp_path):
    gap = timedelta(seconds=1977, microseconds=470_730)  # 32.9578455 minutes, whose double is a little less
    values = [0, 5, 0, 0, 5.12, 5.13, 2.56]
    sf = put(spark, tmp_path, [(1, T0 + k * gap, "view", v) for k, v in enumerate(values)])
    got, wanted = both(spark, sf, "first_differences")
    assert got == wanted and sum("inf" in r for r in got) == 2 and sum("nan" in r for r in got) == 1


def test_labelled_sessions_tell_equal_rows_apart(spark, tmp_path):
    rng = np.random.default_rng(7)
    values = np.repeat(rng.choice([0, 4, 12, 30, 60, 60, 90], 1000), rng.choice([1, 2, 3], 1000))  # rows of one time and value, low and at peaks
    sf = put(spark, tmp_path, [(1, T0 + timedelta(seconds=k), "view", v) for k, v in enumerate(values)])
    # Joins that deal the rows anew into several tasks, as those of large tables do, leave no order of equal ones.
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got, wanted = both(spark, sf, "labelled_sessions")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == wanted and len(got) == len(values)


def test_days_have_thresholds_summed_in_order(spark, tmp_path):
    rng = np.random.default_rng(11)
    events = [(int(u), T0 + timedelta(minutes=20 * k), str(rng.choice(["view", "error"])), round(float(rng.exponential(50)), 2)) for k, u in enumerate(rng.integers(1, 21, 320))]
    sf = put(spark, tmp_path, events)
    values = {}
    for user, _, _, v in events:
        values.setdefault(str(user), []).append(v)
    assert {r.userid: r.thresh14 for r in queries._thresholds(spark, sf).collect()} == {u: sum_in_order(v) / len(v) for u, v in values.items()}
    for name in ("daily_features", "daily_mvpa"):
        got, wanted = both(spark, sf, name)
        assert got == wanted


def sum_in_order(values):
    total = 0.0
    for v in values:  # not sum(), which compensates
        total += v
    return total


def test_treatments_by_steps_take_all_days(spark, tmp_path):
    """Ids of large tables give days decades on."""
    rng = np.random.default_rng(5)
    events = [(1, T0, "view", v) for v in rng.choice([0, 10, 60, 90, 120], 1000)]
    got, wanted = both(spark, put(spark, tmp_path, events, first=12_000_000), "treatments_by_steps")
    assert got == wanted and got


def test_first_differences_of_odd_values(spark, tmp_path):
    """NaN, infinities, zeros of either sign, negative values and missing times come after each other, as doubles have it in SQL."""
    odd = [0.0, -0.0, 5.0, -5.0, float("nan"), float("inf"), float("-inf"), None, 1e-9, 1e305]
    pairs = [v for a in odd for b in odd for v in (a, b)]
    rows = [(k, None if k % 17 == 3 else T0 + timedelta(seconds=7 * (k // 2)), 1, "view", v) for k, v in enumerate(pairs)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got, wanted = both(spark, str(tmp_path), "first_differences")
    assert got == wanted and sum("-0.0" in r for r in got) > 3 and sum("-inf" in r for r in got) > 3
