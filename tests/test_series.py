import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions.calendar import auto_units, jan_week, season
from pulseframe.functions.stats import proportional_difference, variation
from pulseframe.operators import heart, series

T0 = datetime(2024, 1, 1)


def frame(spark, values, seconds=None):
    seconds = seconds if seconds is not None else range(len(values))
    return spark.createDataFrame([("u", T0.date(), T0 + timedelta(seconds=float(s)), None if v is None else float(v), i) for i, (s, v) in enumerate(zip(seconds, values, strict=True))], "userid string, date date, time timestamp, value double, k int")


def kept(df):
    return sorted(r.k for r in df.select("k").collect())


def test_small_exact_cases(spark):
    ones = frame(spark, [1] * 11)
    assert series.run_totals(ones, ["userid"], ["time"], F.col("value") == 1, {"n": 5}).first().n == 11
    assert frame(spark, [1] * 10).agg(variation(F.col("value")).alias("v")).first().v == 0
    assert frame(spark, [3]).agg(variation(F.col("value")).alias("v")).first().v is None
    up = series.upcrossing(F.col("value"), F.lit(120.0), ["userid"], ["time"])
    assert frame(spark, [1, 121] * 3).withColumn("up", up).filter("up").count() == 3
    assert spark.range(1).select(proportional_difference(F.lit(6), F.lit(4)).alias("p")).first().p == 50
    row = spark.sql("select date'2021-01-01' d, date'2021-01-08' e, date'2021-12-01' f").select(jan_week("d").alias("a"), jan_week("e").alias("b"), season(F.col("f")).alias("c"), season(F.col("d")).alias("s")).first()
    assert tuple(row) == (1, 2, 1, 1)
    assert [spark.range(1).select(auto_units(F.lit(float(x))).alias("u")).first().u for x in (59, 60, 7200)] == [59, 1, 2]


def test_runs_and_chains_match_loops(spark):
    rng = np.random.default_rng(1)
    flags = rng.random(300) < 0.6
    positions = np.cumsum(rng.integers(1, 3, 300))
    df = frame(spark, flags.astype(int), positions)
    runs, chains, n, last = [], [], 0, None
    for f, p in zip(flags, positions, strict=True):
        if f:
            n += 1
            chains = chains[:-1] + [chains[-1] + 1] if last is not None and p == last + 1 else chains + [1]
            last = p
        else:
            runs, n = runs + [n], 0
    runs.append(n)
    got = series.run_totals(df, ["userid"], ["time"], F.col("value") == 1, {"a": 0, "b": 4}).first()
    assert (got.a, got.b) == (sum(runs), sum(r for r in runs if r >= 4))
    out = series.with_chains(df.withColumn("p", F.unix_seconds("time")), ["userid"], ["time"], F.col("value") == 1, F.col("p"))
    got = out.agg(series.chain_total(F.col("value") == 1, F.col("chain_length"), 3).alias("c")).first().c
    assert got == sum(c for c in chains if c >= 3)


def test_lookback_edges(spark):
    df = frame(spark, [5, 0, 0], [0, 900, 901])
    got = df.withColumn("any", series.any_within(F.col("value"), ["userid"], F.unix_seconds("time"), 900)).orderBy("time").collect()
    assert [r["any"] for r in got] == [True, True, False]


def test_sessionise_counts_the_previous_end_only(spark):
    rows = [("p", "a", 0, 600), ("p", "b", 10, 20), ("p", "c", 100, 110), ("p", "d", 170, 180)]
    df = spark.createDataFrame([(p, s, T0 + timedelta(minutes=a), T0 + timedelta(minutes=b)) for p, s, a, b in rows], "p string, s string, a timestamp, b timestamp")
    got = {r.s: r.treatment_id for r in series.sessionise(df, ["p"], "a", "b", "s").collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "d"}


def test_nearest_date_takes_the_earlier_of_two(spark):
    probes = spark.sql("select 'u' userid, date'2024-01-05' date union all select 'v', date'2024-01-05'")
    history = spark.sql("select 'u' userid, date'2024-01-03' date, 1 t union all select 'u', date'2024-01-07', 2")
    assert {(r.userid, r.t) for r in series.nearest_date(probes, history, "userid", "date", "date", ["t"]).collect()} == {("u", 1), ("v", None)}


def loop_defaults(v):
    n, seventies = len(v), [i for i, x in enumerate(v) if x == 70]
    gone = set()
    if len(seventies) >= 2:
        m = next((i for i, x in enumerate(v) if x != 70), n)
        gone |= set(range(min(m, len(seventies) - 1)))
        if v[-1] == 70:
            gone.add(n - 1)
            if v[-2] == 70 and len(seventies) >= 3:
                gone.add(n - 2)
    return gone


def loop_repeats(v, longest):
    gone, i, n = set(), 1, len(v)
    while i < n - 1:
        j = i
        while j + 1 < n - 1 and v[j + 1] == v[i]:
            j += 1
        if j - i + 1 > longest:
            gone |= set(range(i, j + 1))
        i = j + 1
    return gone


def loop_jumps(v, t, percent=15, most=5, below=100, seconds=30):
    jumps = [k for k in range(1, len(v)) if abs(v[k] - v[k - 1]) * 100 / v[k - 1] >= percent]
    gone = set()
    for a, b in zip(jumps, jumps[1:], strict=False):
        if b - a <= most and v[a] < below and t[a] - t[a - 1] < seconds:
            gone |= set(range(a, b))
    return gone


def loop_gaps(t, gap=120, most=20):
    n = len(t)
    gaps = [k for k in range(1, n) if t[k] - t[k - 1] >= gap]
    gone = set()
    if gaps:
        marks = sorted({1, *gaps, n - 1})
        for i in range(2, n):
            a, b = max(k for k in marks if k < i and (k in gaps or k == 1)), min(k for k in marks if k >= i and (k in gaps or k == n - 1))
            if b - a <= most:
                gone.add(i - 1)
        if 1 in gaps:
            gone |= {0, 1}
        if n - 1 in gaps:
            gone |= {n - 2, n - 1}
    return gone


@pytest.mark.parametrize("seed", range(6))
def test_cleaning_rules_match_loops(spark, seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(4, 70))
    v = np.where(rng.random(n) < 0.5, 70, rng.choice([69, 70, 71, 90, 120], n))
    t = np.cumsum(rng.choice([5, 20, 40, 130], n, p=[0.6, 0.2, 0.1, 0.1]))
    df = frame(spark, v, t)
    everything = set(range(n))
    assert set(kept(heart.drop_default_edges(df))) == everything - loop_defaults(v)
    assert set(kept(heart.drop_repeats(df, longest=3))) == everything - loop_repeats(v, 3)
    assert set(kept(heart.drop_jump_islands(df))) == everything - loop_jumps(v, t)
    assert set(kept(heart.drop_gap_islands(df, rows_at_most=6))) == everything - loop_gaps(t, most=6)


def test_zero_values_do_not_divide(spark):
    df = frame(spark, [0, 0, 90, 0, 90, 0], [0, 5, 10, 15, 20, 25])
    assert kept(heart.drop_jump_islands(df)) == [0, 1, 5]
    assert spark.range(1).select(proportional_difference(F.lit(6), F.lit(0)).alias("p")).first().p is None


def test_cleaning_short_and_empty_days(spark):
    for values in ([], [70], [70, 70], [50, 60, 50]):
        assert set(kept(heart.clean(frame(spark, values)))) <= set(range(len(values)))


@pytest.mark.parametrize("size", [1, 3, 50, 1000])
def test_chunks_give_what_windows_give(spark, size):
    """Runs of any length, nulls among the flags, series cut anywhere."""
    rng = np.random.default_rng(size)
    rows = [(key, i, i // size, bool(f) if f < 2 else None, float(v) if v < 28 else None) for key, n in (("a", 300), ("b", 1), ("c", 47)) for i, (f, v) in enumerate(zip(np.repeat(rng.integers(0, 3, n), rng.integers(1, 9, n))[:n], rng.integers(0, 30, n), strict=True))]
    df = spark.createDataFrame(rows, "key string, i int, chunk int, f boolean, v double")
    columns = ["key", "i", "run", "run_length"]
    got, want = series.with_long_runs(df, ["key"], "chunk", ["i"], F.col("f")), series.with_runs(df, ["key"], ["i"], F.col("f"))
    assert got.columns == want.columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    least = {"two": 2, "nine": 9}
    assert sorted(map(tuple, series.long_run_totals(df, ["key"], "chunk", ["i"], F.col("f"), least).collect())) == sorted(map(tuple, series.run_totals(df, ["key"], ["i"], F.col("f"), least).collect()))
    up = series.upcrossing(F.col("v"), F.lit(12.0), ["key"], ["i"])
    told = lambda d: sorted((r.key, r.i, r.up) for r in d.collect())
    assert told(series.with_long_upcrossings(df, ["key"], "chunk", ["i"], F.col("v"), F.lit(12.0))) == told(df.withColumn("up", up))
    active = F.col("v") > 25
    near = series.any_within(F.when(active, 1), ["key"], F.col("i"), 4)
    found = sorted((r.key, r.i, r.any_active) for r in series.with_long_lookback(df, ["key"], "chunk", ["i"], active, F.col("i"), 4).collect())
    assert found == sorted((r.key, r.i, r.near) for r in df.withColumn("near", near).collect())


def test_chunks_deal_rows_by_chunk(spark):
    df = spark.range(1000).selectExpr("id % 2 AS key", "id AS i", "id div 100 AS chunk", "id % 7 < 3 AS f")
    plan = series.with_long_runs(df, ["key"], "chunk", ["i"], F.col("f"))._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.split("\n") if "REPARTITION_BY_NUM" in x]
    assert dealt and all("chunk" in x for x in dealt)
    for x in plan.split("\n"):  # what runs along a key alone are sums of chunks
        if "+- Window [" in x and not re.search(r"\[key#\d+L, chunk#\d+L\], \[i#", x):
            assert "chunk" in x.rpartition("[")[2] and "____" in x
