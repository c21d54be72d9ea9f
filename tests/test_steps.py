from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.functions import variation
from pulseframe.operators import daily, enrich, quality
from pulseframe.plans import steps
from pulseframe.sources.schemas import DAILY, HEART, LABELLED_PRESSURE, LINK, TREATMENTS
from pulseframe.sources.tables import Store, day_ledger, read_csv, remaining
from pulseframe.streaming import incremental

D0 = datetime(2024, 1, 1)


def minutes(spark, rows):
    return spark.createDataFrame([("u", D0 + timedelta(minutes=m), s, h) for m, s, h in rows], "userid string, time timestamp, value_steps double, value_hr double")


def thresholds(spark):
    return spark.createDataFrame([("u", date(2024, 1, 1), 100.0, 90.0, 110.0)], "userid string, date date, thresh14 double, thresh14_low double, thresh14_high double")


def test_daily_features_match_a_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for m in range(0, 1440):
        if rng.random() < 0.7:
            rows.append((m, None if rng.random() < 0.1 else float(rng.choice([0, 10, 80, 120])), None if rng.random() < 0.1 else float(rng.integers(60, 130))))
    df = daily.daily_features(minutes(spark, rows), thresholds(spark))
    quality.check_schema(df, DAILY)
    r = df.first()
    step = lambda keep=lambda m: True: sum(s for m, s, _ in rows if s is not None and keep(m))
    assert r.step_count == step() and r.step_count_q2 == step(lambda m: 360 <= m < 720) and r.step_count_q234 == step(lambda m: m >= 360)
    hours = {h: sum(s or 0 for m, s, _ in rows if m // 60 == h) for h in {m // 60 for m, _, _ in rows}}
    assert r.mean_hourly_steps_day == pytest.approx(np.mean(list(hours.values()))) and r.active_hours == sum(v > 500 for v in hours.values()) and r.low_active_hours == sum(0 < v <= 500 for v in hours.values())
    runs, n = [], 0
    for _, s, _ in [*rows, (0, 0, 0)]:
        if (s or 0) >= 70:
            n += 1
        else:
            runs, n = [*runs, n], 0
    assert [r[f"active_mins_steps_{k}"] for k in (0, 2, 5)] == [sum(x for x in runs if x >= k) for k in (0, 2, 5)]
    hr = [h for _, _, h in rows if h is not None]
    assert r.resting_hr_proxy == pytest.approx(np.mean(sorted(hr)[:5])) and r.mins_wear_total == len(hr) and r.cov_hr == pytest.approx(np.std(hr, ddof=1) / np.mean(hr) * 100)
    mvpa = [m for m, _, h in rows if h is not None and h > 100 and any(s for k, s, _ in rows if m - 15 <= k <= m and s)]
    both = [m for m, s, _ in rows if m in set(mvpa) and s is not None and s > 70]

    def chains(ms, least):
        out, run = 0, 1
        for a, b in zip(ms, [*ms[1:], None], strict=True):
            if b is not None and b == a + 1:
                run += 1
            else:
                out += run if run >= max(2, least) else 0
                run = 1
        return out

    assert r.mvpa_15_prev_method == len(mvpa) and r.mvpa_15_prev_method3 == chains(mvpa, 3) and r.mvpa_15_prev_method_ap_8_21 == sum(8 <= m // 60 <= 21 for m in mvpa)
    assert r.active_mins_hr_steps_thresh == len(both) and r.active_mins_hr_steps_thresh2 == chains(both, 2)
    v = [h or 0 for _, _, h in rows]
    assert r.switch_thresh == sum(a < 100 < b for a, b in zip(v, v[1:], strict=False))
    assert r.step_sedentary_thresh_mvpa == pytest.approx(np.mean([s for _, s, h in rows if h is not None and h <= 100 and s is not None]))
    assert r.step_count_norm_q2 == pytest.approx(r.step_count_q2 / r.wear_percent_q2)


def test_combine_and_gates(spark):
    heart = spark.createDataFrame([("u", D0, 60.0), ("u", D0 + timedelta(seconds=30), 80.0), ("u", D0 + timedelta(minutes=5), 90.0)], HEART)
    stepped = spark.createDataFrame([("u", D0, 5.0), ("u", D0, 5.0), ("u", D0 + timedelta(minutes=9), 7.0)], HEART)
    got = {r.time.minute: (r.value_steps, r.value_hr) for r in daily.combine_minutes(stepped, heart).collect()}
    assert got == {0: (5, 70), 5: (None, 90), 9: (7, None)}
    assert {(r.value_steps, r.value_hr) for r in daily.combine_minutes(stepped.limit(0), heart).collect()} == {(0, 70), (0, 90)}
    assert daily.worth_featurising(stepped, heart).count() == 1 and daily.worth_featurising(stepped, heart.withColumn("value", F.lit(0.0))).count() == 0


def link(spark):
    row = ("g", 1.0, 1.0, date(2024, 1, 1), 10, "u", "p", None, None, None, None, None, None)
    return spark.createDataFrame([row], LINK)


@pytest.mark.parametrize("days,withdrawn,phase", [(0, None, "blind"), (61, None, "feedback"), (121, None, "gaming"), (361, None, "gaming ended"), (426, None, "feedback ended"), (60, None, "blind"), (31, 30, "feedback ended"), (29, 30, "blind")])
def test_phases(spark, days, withdrawn, phase):
    people = link(spark).withColumn("date_withdrawn", F.lit(None if withdrawn is None else date(2024, 1, 1) + timedelta(days=withdrawn)).cast("date"))
    df = spark.createDataFrame([("p", date(2024, 1, 1) + timedelta(days=days))], "patient_id string, act_date date")
    assert enrich.with_phase(df, people).first().phase == phase


def test_outliers(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, 2, 3, 2, 3, 2, 3)], "v double")
    out = enrich.flag_outliers(df)
    assert out.count() == 10 and [r.v for r in out.filter("v_is_out").collect()] == [10.0]
    assert enrich.drop_outliers(df, ratio=0.2).count() == 9 and enrich.drop_outliers(df, ratio=0.05).count() == 10
    assert enrich.flag_outliers(spark.createDataFrame([(1.0,)] * 5, "v double")).filter("v_is_out").count() == 5
    with pytest.raises(ValueError):
        enrich.flag_outliers(spark.createDataFrame([("a",)], "s string"))


def test_quartiles_are_exact(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(0, 1, 1001), rng.integers(0, 5, 999), [3.0], [1, 2], np.append(np.zeros(900), rng.normal(0, 1, 100))):
        df = spark.createDataFrame([(float(v), None) for v in values] + [(None, None)], "v double, e double")
        got = enrich.quartiles(df, ["v", "e"])
        assert np.allclose(got["v"], np.percentile(np.asarray(values, float), [25, 75])) and got["e"] == [None, None]


def test_nan_is_missing(spark, tmp_path):
    """In quartiles and flags, minutes, variation, and at the readers."""
    nan = float("nan")
    df = spark.createDataFrame([(float(x),) for x in range(100)] + [(nan,)] * 5 + [(None,)], "v double")
    assert enrich.quartiles(df, ["v"])["v"] == [24.75, 74.25]
    assert enrich.flag_outliers(df).filter("v_is_out").count() == 0 and enrich.flag_outliers(df).filter("v_is_out is null").count() == 6
    assert enrich.drop_outliers(df).count() == 106
    heart = spark.createDataFrame([("u", D0, 60.0), ("u", D0 + timedelta(seconds=30), nan), ("u", D0 + timedelta(minutes=5), nan)], HEART)
    stepped = spark.createDataFrame([("u", D0, nan), ("u", D0 + timedelta(minutes=9), 7.0)], HEART)
    got = {r.time.minute: (r.value_steps, r.value_hr) for r in daily.combine_minutes(stepped, heart).collect()}
    assert got == {0: (None, 60.0), 5: (None, None), 9: (7.0, None)}
    with pytest.raises(ValueError, match="neither"):
        daily.combine_minutes(stepped.limit(0), heart.limit(0))
    assert daily.combine_minutes(stepped.limit(0), heart.limit(0), allow_empty=True).count() == 0
    one = spark.createDataFrame([(3.0,), (5.0,), (nan,)], "v double").agg(variation(F.col("v")).alias("cv")).first().cv
    assert one == pytest.approx(np.std([3, 5], ddof=1) / 4 * 100)
    store = Store(spark, str(tmp_path))
    store.write(df, "t")
    assert store.read("t").filter("v is null").count() == 6 and store.read("t").agg(F.max("v")).first()[0] == 99.0
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("userid,time,value\nu,2024-01-01 00:00:00,NaN\n")
    assert read_csv(spark, path, HEART).first().value is None


def test_reports(spark):
    bad = spark.createDataFrame([("u", D0, 500.0), ("x", D0 - timedelta(days=9), None)], HEART)
    r = quality.samples_report(bad, link(spark), "2024-06-01", "heart").first()
    assert (r.complete, r.finite, r.in_range, r.column_names, r.column_types, r.column_number, r.not_in_future, r.after_recruitment, r.known_ids) == (False, False, False, True, True, True, True, True, False)
    with pytest.raises(ValueError, match="in_range"):
        quality.demand(quality.samples_report(bad, link(spark), "2024-06-01", "heart"))
    with pytest.raises(ValueError):
        quality.check_schema(bad, TREATMENTS)


def raw_sessions(spark, n=3):
    rows = []
    for k in range(n):
        for i in range(400):
            rows.append((f"s{k}", 20.0 if i % 50 in range(10, 20) else 1.0 + 0.001 * (i % 7), D0 + timedelta(hours=3 * k, microseconds=100_000 * i), "p"))
    return spark.createDataFrame(rows, "id string, pressurevalues double, time timestamp, patient_record_id string")


def test_pressure_steps_are_incremental(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(raw_sessions(spark, 2), "raw")
    assert steps.clean_pressure_step(store, "raw", "clean", "clean_ledger", "2024-01-01", "2024-01-08")
    assert not steps.clean_pressure_step(store, "raw", "clean", "clean_ledger", "2024-01-01", "2024-01-08")
    store.write(raw_sessions(spark, 3).filter("id = 's2'"), "raw")
    assert steps.clean_pressure_step(store, "raw", "clean", "clean_ledger", "2024-01-01", "2024-01-08")
    assert store.read("clean").select("session_id").distinct().count() == 3 == store.read("clean_ledger").count()
    assert steps.label_pressure_step(store, "clean", "labelled", "label_ledger", "2024-01-01", "2024-01-08")
    labelled = store.read("labelled")
    quality.check_schema(labelled, LABELLED_PRESSURE)
    assert {r.breath_count for r in labelled.collect()} == {8.0}
    devices = spark.createDataFrame([("p", 2, 4, 5)], "patient_id string, treatments_per_day int, number_of_sets int, breaths_per_set int")
    assert steps.featurise_treatments_step(store, "labelled", "features", "feature_ledger", devices, "2024-01-01", "2024-01-08")
    features = store.read("features")
    quality.check_schema(features, TREATMENTS)
    assert features.count() == 3 and {r.treatment_day_adherence_score for r in features.collect()} == {1.5}
    with pytest.raises(ValueError):
        steps.featurise_treatments_step(store, "labelled", "features", "feature_ledger", devices, "2024-01-01", "2024-01-05")
    with pytest.raises(ValueError):
        store.write(features, "pressure_raw_vals")
    with pytest.raises(ValueError):
        steps.label_pressure(store.read("clean"), spark.createDataFrame([], "session_id string, treatment_id string, session_start timestamp"))
    store.drop("features")
    assert not store.exists("features")


def test_activity_steps_withhold_the_latest_day(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    heart = spark.createDataFrame([("u", D0 + timedelta(days=d, minutes=m), 80.0 + m % 3) for d in range(3) for m in range(40)], HEART)
    stepped = heart.withColumn("value", F.lit(12.0))
    store.write(heart, "hr")
    store.write(stepped, "fs")
    assert steps.clean_days_step(store, "hr", "clean", "hr_ledger", "2024-01-01", "2024-02-01")
    assert {r.date.day for r in store.read("hr_ledger").collect()} == {1, 2}
    assert not steps.clean_days_step(store, "hr", "clean", "hr_ledger", "2024-01-01", "2024-02-01")
    assert steps.featurise_days_step(store, "fs", "clean", "features", "feature_ledger", thresholds(spark), link(spark), "2024-01-01", "2024-02-01")
    features = store.read("features")
    assert {r.date.day for r in features.collect()} == {1, 2} and store.read("feature_ledger").count() == 3
    sex = spark.createDataFrame([(1.0, "f")], "study_email double, gender string")
    out = steps.enrich_days(features, link(spark), sex)
    assert out.count() == 2 and {"mvpa_week_score", "decimal_age", "mvpa_15_prev_method_is_out"} <= set(out.columns)
    assert remaining(day_ledger(heart), store.read("hr_ledger"), ["date", "userid"]).count() == 1


class Breaks(Store):
    """A store whose writes to one table fail, before or after they are done."""

    def write_run(self, df, name, run, label=None):
        where, after = self.jdbc.get("_fails"), self.jdbc.get("_after")
        if name == where and not after:
            raise OSError(name)
        Store(self.spark, self.root).write_run(df, name, run, label)
        if name == where:
            raise OSError(name)


STEPS = {
    "clean_pressure": lambda st, dims: steps.clean_pressure_step(st, "raw", "clean", "clean_ledger", "2024-01-01", "2024-01-08"),
    "label": lambda st, dims: steps.label_pressure_step(st, "clean", "labelled", "label_ledger", "2024-01-01", "2024-01-08"),
    "featurise": lambda st, dims: steps.featurise_treatments_step(st, "labelled", "features", "feature_ledger", dims[0], "2024-01-01", "2024-01-08"),
    "clean_days": lambda st, dims: steps.clean_days_step(st, "hr", "clean_hr", "hr_ledger", "2024-01-01", "2024-02-01"),
    "featurise_days": lambda st, dims: steps.featurise_days_step(st, "fs", "clean_hr", "daily", "daily_ledger", dims[1], dims[2], "2024-01-01", "2024-02-01"),
}
WRITES = {"clean_pressure": ("clean", "clean_ledger"), "label": ("labelled", "label_ledger"), "featurise": ("features_rows", "feature_ledger"), "clean_days": ("clean_hr", "hr_ledger"), "featurise_days": ("daily", "daily_ledger")}


def seeded(spark, root):
    store = Store(spark, root)
    store.write(raw_sessions(spark, 2), "raw")
    heart = spark.createDataFrame([("u", D0 + timedelta(days=d, minutes=m), 80.0 + m % 3) for d in range(3) for m in range(40)], HEART)
    store.write(heart, "hr")
    store.write(heart.withColumn("value", F.lit(12.0)), "fs")
    devices = spark.createDataFrame([("p", 2, 4, 5)], "patient_id string, treatments_per_day int, number_of_sets int, breaths_per_set int")
    return store, (devices, thresholds(spark), link(spark))


def test_steps_after_failures(spark, tmp_path):
    """Each step breaks off once with its data written and no ledger, and once with both; what stands there in the end is what
    one clean run gives."""
    store, dims = seeded(spark, str(tmp_path / "a"))
    other, _ = seeded(spark, str(tmp_path / "b"))
    for name, step in STEPS.items():
        target, ledger = WRITES[name]
        assert step(store, dims)
        for fails, after in ((target, True), (ledger, False)):
            with pytest.raises(OSError):
                step(Breaks(spark, other.root, {"_fails": fails, "_after": after}), dims)
        assert step(other, dims) and not step(other, dims)
        for table in (target, ledger, "features")[: 3 if name == "featurise" else 2]:
            a, b = (sorted(map(str, s.read(table).collect())) for s in (store, other))
            assert a == b and len(a) > 0, table


def test_unfinished_writes_are_no_tables(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    left = tmp_path / "ledger_begun" / "_run=rx" / "_temporary" / "0"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_bytes(b"x")
    assert not store.exists("ledger_begun") and not store.exists("nothing")
    store.write_run(spark.range(0).selectExpr("id AS k"), "ledger_begun", "rx")
    assert store.exists("ledger_begun") and store.read("ledger_begun").columns == ["k"] and store.read("ledger_begun").count() == 0


def test_steps_in_a_catalog(spark, tmp_path):
    store = Store(spark)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    store.write_run(rows, "run_table", "x")
    store.write_run(rows.filter("k = 1"), "run_table", "y")
    store.write_run(rows.filter("k = 2"), "run_table", "x")
    assert sorted(map(tuple, store.read("run_table").collect())) == [(1, "a"), (2, "b")]
    store.drop("run_table")
    assert not store.exists("run_table")


def test_blind_windows_and_csv(spark, tmp_path):
    w = steps.blind_windows(link(spark), featurise=True).first()
    assert (w.window_end - w.window_start).days % 7 == 0 and (w.window_end - w.window_start).days == 63
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("userid,time,value\nu,2024-01-01 00:00:00,3.5\n")
    assert read_csv(spark, path, HEART).first().value == 3.5


def test_streams(spark, tmp_path):
    source, store = str(tmp_path / "in"), Store(spark, str(tmp_path))
    rows = [("u", D0 + timedelta(days=d, minutes=m), 80.0 + m % 5) for d in (0, 1, 4) for m in range(30)]
    spark.createDataFrame(rows, HEART).write.parquet(source)
    stream = spark.readStream.schema(HEART).parquet(source)
    query = incremental.clean_stream(stream, store, "out", str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    days = {r.date.day for r in store.read("out").select("date").distinct().collect()}
    assert 1 in days and 5 not in days
    want = steps.clean_days(spark.createDataFrame([r for r in rows if r[1].day in days], HEART))
    assert sorted(map(tuple, store.read("out").select("userid", "time", "value").collect())) == sorted(map(tuple, want.collect()))


def test_entry_points(spark):
    import __spark_entry__

    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50
    assert __spark_entry__.entry(spark).count() > 0
