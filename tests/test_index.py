"""The index of parts, totals that do not depend on how runs are cut, and checks as a gate."""

import os
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import quality, treatments
from pulseframe.plans import steps
from pulseframe.plans.index import Index
from pulseframe.sources.schemas import HEART, LINK
from pulseframe.sources.tables import PART, RUN, Store

D0 = datetime(2024, 1, 1)
RAW = "id string, pressurevalues double, time timestamp, patient_record_id string"


def raw_rows(sessions, patient="p", n=300):
    """sessions: {name: start}."""
    return [(s, 20.0 if i % 50 in range(10, 20) else 1.0 + 0.001 * (i % 7), t + timedelta(microseconds=100_000 * i), patient) for s, t in sessions.items() for i in range(n)]


def link(spark, *patients):
    return spark.createDataFrame([("g", 1.0, 1.0, date(2024, 1, 1), 10, p, p, None, None, None, None, None, None) for p in patients], LINK)


def devices(spark):
    return spark.createDataFrame([("p", 2, 4, 5), ("q", 1, 1, 1)], "patient_id string, treatments_per_day int, number_of_sets int, breaths_per_set int")


def told(df):
    """Rows without what an iterated solver may give otherwise in other batches."""
    return sorted(tuple(round(v, 2) if isinstance(v, float) else v for v in r) for r in df.select(sorted(df.columns)).collect())


def ruin(root, names):
    """Overwrites files by bytes that nobody can read."""
    for folder, _, files in os.walk(root):
        for name in files:
            if name.endswith(".parquet") and (names is None or name in names):
                with open(os.path.join(folder, name), "wb") as f:
                    f.write(b"nothing")
            if name.startswith(".") and name.endswith(".crc"):
                os.remove(os.path.join(folder, name))


def test_index_reads_only_new_parts(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(spark.createDataFrame(raw_rows({"s0": D0, "s1": D0 + timedelta(hours=5)}), RAW).coalesce(1), "raw")
    index = steps.raw_index(store, "raw").refresh()
    first = store.parts("raw")
    assert store.parts(index.name) == first and index.stale() == (set(), set())
    ruin(tmp_path / "raw", None)  # no later reading of these files would go through
    store.write(spark.createDataFrame(raw_rows({"s2": D0 + timedelta(days=1)}) + raw_rows({"s1": D0 + timedelta(hours=4)}, n=3), RAW).coalesce(1), "raw")
    fresh = store.parts("raw") - first
    assert index.stale() == (fresh, set())
    spans = {r.session_id: (r.first, r["last"], r.n) for r in index.refresh().spans().collect()}
    last = timedelta(seconds=29.9)
    assert spans == {"s0": (D0, D0 + last, 300), "s1": (D0 + timedelta(hours=4), D0 + timedelta(hours=5) + last, 303), "s2": (D0 + timedelta(days=1), D0 + timedelta(days=1) + last, 300)}
    some = index.read(spark.createDataFrame([("s2",)], "session_id string"))
    assert len(some.inputFiles()) == 1 and some.count() == 300 and some.columns == ["id", "pressurevalues", "time", "patient_record_id"]
    assert index.parts_of(spark.createDataFrame([("s1",)], "session_id string")) == first | fresh
    for name in fresh:
        os.remove(tmp_path / "raw" / name)
    assert {r.session_id for r in index.refresh().spans().collect()} == {"s0", "s1"} and store.parts(index.name) == first


def test_second_run_reads_changed_parts_only(spark, tmp_path):
    """Every file that the first runs wrote or read is ruined; the second runs still give what one run over all gives."""
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    one, two = raw_rows({"s0": D0, "s1": D0 + timedelta(hours=5)}), raw_rows({"s2": D0 + timedelta(days=8), "s3": D0 + timedelta(days=8, minutes=20)})

    def run(store):
        assert steps.clean_pressure_step(store, "raw", "clean", "l1", "2024-01-01", "2024-02-05")
        assert steps.label_pressure_step(store, "clean", "labelled", "l2", "2024-01-01", "2024-02-05")
        assert steps.featurise_treatments_step(store, "labelled", "features", "l3", devices(spark), "2024-01-01", "2024-02-05")

    steps.ingest(a, spark.createDataFrame(one, RAW), "raw", "monday")
    steps.ingest(a, spark.createDataFrame(one, RAW), "raw", "monday")  # delivered twice
    run(a)
    for table in ("raw", "clean", "labelled"):
        ruin(tmp_path / "a" / table, None)
    steps.ingest(a, spark.createDataFrame(two, RAW), "raw", "tuesday")
    run(a)
    steps.ingest(b, spark.createDataFrame(one + two, RAW), "raw", "all")
    run(b)
    assert told(a.read("features")) == told(b.read("features")) and a.read("features").count() == 3
    assert a.parts("raw") == {"monday/2024-01-01", "tuesday/2024-01-09"}
    days = {p.split("/")[1] for p in a.parts("clean")}
    assert days == {"2024-01-01", "2024-01-09"} and a.parts("features") == {"none", "2024-w01", "2024-w02"}
    assert {"_run", "_label", "_part"}.isdisjoint(b.read("clean").columns)


def labelled_days(spark, store, seed=3):
    """A labelled table of two patients over some days: short treatments, of which a day has one to four."""
    rng, rows = np.random.default_rng(seed), []
    for p in "pq":
        for d in range(16):
            for k in range(int(rng.integers(1, 5))):
                t, start = f"{p}{d}-{k}", D0 + timedelta(days=d, hours=4 * k)
                breaths = int(rng.integers(0, 4))
                for i in range(60):
                    breath = float(i // 15 + 1) if i // 15 < breaths and i % 15 < 9 else 0.0
                    rows.append((p, t, start + timedelta(microseconds=100_000 * i), float(rng.integers(3, 25)) if breath else 0.5, t, start, False, breath, 0.0 if breath else float(min(i // 15, breaths) + 1), 0.0, float(breaths), float(min(4, breaths) + 1), 0.0))
    schema = "patient_id string, session_id string, time timestamp, pressure_detrend double, treatment_id string, session_start timestamp, prominent_peak boolean, breath_id double, break_id double, set_id double, breath_count double, break_count double, set_count double"
    df = spark.createDataFrame(rows, schema)
    store.write(df, "labelled")
    return df


def featurised(store, spark, ranges, extra=False):
    for start, end in ranges:
        steps.featurise_treatments_step(store, "labelled", "features", "ledger", devices(spark), start, end, extra)
    return told(store.read("features"))


def test_totals_do_not_depend_on_how_runs_are_cut(spark, tmp_path, extra=True):
    """Runs of one week, of two, of all, and of treatments that come in any order."""
    whole = Store(spark, str(tmp_path / "whole"))
    df = labelled_days(spark, whole).persist()
    want = featurised(whole, spark, [("2024-01-01", "2024-01-29")], extra)
    once = treatments.with_adherence(treatments.treatment_features(df, extra), devices(spark), extra)
    assert want == told(once) and len(want) > 20
    weeks = Store(spark, str(tmp_path / "weeks"))
    labelled_days(spark, weeks)
    assert featurised(weeks, spark, [("2024-01-08", "2024-01-15"), ("2024-01-01", "2024-01-08"), ("2024-01-01", "2024-01-29")], extra) == want
    late = Store(spark, str(tmp_path / "late"))
    for k in (2, 0, 1):  # days are done in three runs
        late.write(df.filter(F.pmod(F.hash("treatment_id"), F.lit(3)) == k), "labelled")
        got = featurised(late, spark, [("2024-01-01", "2024-01-29")], extra)
    assert got == want


def test_three_treatments_of_a_day_in_two_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = [("p", f"t{k}", D0 + timedelta(hours=3 * k, microseconds=100_000 * i), 12.0 if i % 20 < 10 else 0.0, f"t{k}", D0 + timedelta(hours=3 * k), False, float(i // 20 + 1) if i % 20 < 10 else 0.0, 0.0 if i % 20 < 10 else float(i // 20 + 2), 0.0, 5.0, 5.0, 0.0) for k in range(3) for i in range(100)]
    df = spark.createDataFrame(rows, "patient_id string, session_id string, time timestamp, pressure_detrend double, treatment_id string, session_start timestamp, prominent_peak boolean, breath_id double, break_id double, set_id double, breath_count double, break_count double, set_count double")
    for some, n in ((df.filter("treatment_id < 't2'"), 2), (df.filter("treatment_id = 't2'"), 3)):
        store.write(some, "labelled")
        featurised(store, spark, [("2024-01-01", "2024-01-08")])
        found = store.read("features").select("treatment_day_adherence_score", "pressures_daily_count").collect()
        assert [tuple(r) for r in found] == [(n / 2, 100.0 * n)] * n


class Breaks(Store):
    """A store that fails once weeks are replaced, before or after."""

    def replace(self, df, name, label):
        if self.jdbc["when"] == "after":
            Store(self.spark, self.root).replace(df, name, label)
        raise OSError(name)


def test_replaced_weeks_after_failures(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "a")), Store(spark, str(tmp_path / "b"))
    for store in (a, b):
        labelled_days(spark, store)
        featurised(store, spark, [("2024-01-01", "2024-01-08")])
    want = featurised(a, spark, [("2024-01-01", "2024-01-29")])
    for when in ("before", "after"):
        broken = Breaks(spark, b.root, {"when": when})
        with pytest.raises(OSError):
            featurised(broken, spark, [("2024-01-01", "2024-01-29")])
    assert featurised(b, spark, [("2024-01-01", "2024-01-29")]) == want


def test_plans_of_treatments(spark, tmp_path):
    """The labelled rows are scanned and shuffled once; adherence deals the treatments once."""
    df = labelled_days(spark, Store(spark, str(tmp_path)))
    plan = treatments.treatment_features(Store(spark, str(tmp_path)).read("labelled"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and plan.count("Exchange hashpartitioning") == 4
    features = treatments.treatment_features(df, extra=True).checkpoint()
    plan = treatments.adherence(features, devices(spark), extra=True)._jdf.queryExecution().executedPlan().toString()
    assert sum("patient_id" in x for x in plan.split("\n") if "Exchange hashpartitioning" in x) <= 2  # the other is of the devices


def test_gate_holds_the_ledger_back(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write(spark.createDataFrame(raw_rows({"s0": D0}), RAW), "raw")
    assert steps.clean_pressure_step(store, "raw", "clean", "ledger", "2024-01-01", "2024-02-05", link(spark, "p"))
    bad = [(s, 400.0 if k == 7 else v, t, p) for k, (s, v, t, p) in enumerate(raw_rows({"s1": D0 + timedelta(days=1)}))]
    store.write(spark.createDataFrame(bad, RAW), "raw")
    for _ in range(2):
        with pytest.raises(ValueError, match="values_in_range"):
            steps.clean_pressure_step(store, "raw", "clean", "ledger", "2024-01-01", "2024-02-05", link(spark, "p"))
        assert [r.id for r in store.read("ledger").collect()] == ["s0"] and store.read("clean").select("session_id").distinct().count() == 1
    assert not steps.clean_pressure_step(store, "raw", "clean", "ledger", "2024-01-01", "2024-01-02", link(spark, "p"))  # other days go on
    with pytest.raises(ValueError, match="known_ids"):
        steps.clean_pressure_step(store, "raw", "clean", "ledger2", "2024-01-01", "2024-01-02", link(spark, "other"))
    with pytest.raises(ValueError, match="missing"):
        store.write(spark.createDataFrame([("s", "x", D0, "p")], "id string, pressurevalues string, time timestamp, patient_record_id string"), "odd")
        steps.clean_pressure_step(store, "odd", "clean3", "ledger3", "2024-01-01", "2024-02-05")


def test_gates_of_samples(spark, tmp_path):
    store, people = Store(spark, str(tmp_path)), link(spark, "u")
    hr = spark.createDataFrame([("u", D0 + timedelta(days=d, minutes=m), 80.0 + m % 3) for d in range(3) for m in range(40)], HEART)
    store.write(hr, "hr")
    assert steps.clean_days_step(store, "hr", "clean", "ledger", "2024-01-01", "2024-02-01", people, "2024-06-01")
    for rows, what in ((hr.withColumn("value", F.lit(300.0)), "in_range"), (hr.withColumn("value", F.lit(None).cast("double")), "complete"), (hr.withColumn("userid", F.lit("w")), "known_ids"), (hr.withColumn("time", F.col("time") - F.expr("interval 50 days")), "after_recruitment")):
        store.write(rows, f"hr_{what}")
        with pytest.raises(ValueError, match=what):
            steps.clean_days_step(store, f"hr_{what}", f"clean_{what}", f"ledger_{what}", "2020-01-01", "2024-02-01", people, "2024-06-01")
        assert not store.exists(f"ledger_{what}")
    with pytest.raises(ValueError, match="not_in_future"):
        steps.clean_days_step(store, "hr", "clean_f", "ledger_f", "2024-01-01", "2024-02-01", people, "2024-01-01")
    store.write(hr.withColumn("value", F.lit(60_000.0)), "fs")
    thresholds = spark.createDataFrame([("u", date(2024, 1, 1), 100.0, 90.0, 110.0)], "userid string, date date, thresh14 double, thresh14_low double, thresh14_high double")
    with pytest.raises(ValueError, match="in_range"):
        steps.featurise_days_step(store, "fs", "clean", "daily", "ledger_d", thresholds, people, "2024-01-01", "2024-02-01", checked=True)
    assert not store.exists("ledger_d")


def test_gate_costs_no_scan(spark, tmp_path):
    hr = spark.createDataFrame([("u", D0, 80.0)], HEART)
    hr.write.parquet(str(tmp_path / "hr"))
    gate = quality.samples_gate("heart")
    rows = gate.watch(spark.read.parquet(str(tmp_path / "hr")).withColumn("date_recruited", F.lit(None).cast("date")))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Exchange" not in plan and "CollectMetrics" in plan


def test_index_in_a_catalog(spark):
    store = Store(spark)
    for k in range(2):
        store.write_run(spark.createDataFrame([(f"u{k}", D0 + timedelta(days=k), float(k)), ("u", D0, 3.0)], HEART), "samples_by_run", f"r{k}", F.to_date("time"))
    index = Index(store, "samples_by_run", {"userid": "userid", "date": "to_date(time)"}, lows={"low": "value"}).refresh()
    assert store.parts("samples_by_run") == {"r0/2024-01-01", "r1/2024-01-01", "r1/2024-01-02"} == store.parts(index.name)
    assert {(r.userid, r.n, r.low) for r in index.spans().collect()} == {("u", 2, 3.0), ("u0", 1, 0.0), ("u1", 1, 1.0)}
    assert index.read(spark.createDataFrame([("u1",)], "userid string")).count() == 1
    plain = Store(spark)
    plain.write(spark.createDataFrame([("u", D0, 3.0)], HEART), "samples_plain")
    whole = Index(plain, "samples_plain", {"userid": "userid"}).refresh()
    assert plain.parts("samples_plain") is None and whole.spans().first().n == 1 and whole.read(spark.createDataFrame([("u",)], "userid string")).count() == 1
    for name in ("samples_by_run", index.name, "samples_plain"):
        store.drop(name)


def test_parts_and_runs(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write_run(spark.createDataFrame([], "k int, d string"), "t", "r0", F.col("d"))
    assert store.parts("t") == {"r0/none"} and store.read("t").columns == ["k", "d"] and store.read("t").count() == 0
    rows = spark.createDataFrame([(1, "a:b"), (2, None), (3, "c/d")], "k int, d string")
    store.write_run(rows, "t", "r1", F.col("d"))
    store.write_run(rows.filter("k < 3"), "t", "r1", F.col("d"))
    assert store.parts("t") == {"r0/none", "r1/none", "r1/a:b"}
    assert {(r.k, r[PART]) for r in store.read_parts("t", {"r1/a:b", "r1/none"}).collect()} == {(1, "r1/a:b"), (2, "r1/none")}
    assert store.read("t", runs=True).filter(F.col(RUN) == "r1").count() == 2
    store.drop_run("t", "r1")
    assert store.parts("t") == {"r0/none"}
    store.replace(rows, "w", F.col("d"))
    store.replace(rows.filter("k = 1").withColumn("k", F.lit(9)), "w", F.col("d"))
    assert sorted(r.k for r in store.read("w").collect()) == [2, 3, 9]
    assert not store.exists("nothing") and store.parts("nothing") == set()


def test_long_runs_of_sessions_have_few_parts(spark, tmp_path):
    """Runs over many days have their parts by week; what comes of them is what comes of all rows at once."""
    store = Store(spark, str(tmp_path))
    rows = raw_rows({f"s{d}": D0 + timedelta(days=d) for d in range(120)}, n=60)
    clean = spark.createDataFrame([(p, s, t, v) for s, v, t, p in rows], "patient_id string, session_id string, time timestamp, pressure_detrend double").persist()
    steps.ingest(store, clean, "clean", "all")
    assert store.parts("clean") == {f"all/2024-w{w:02d}" for w in range(1, 19)}
    steps.label_pressure_step(store, "clean", "labelled", "l2", "2024-01-01", "2024-07-01")
    assert {x.split("/")[1] for x in store.parts("labelled")} == {f"2024-w{w:02d}" for w in range(1, 19)}
    assert told(store.read("labelled")) == told(steps.label_pressure(clean, treatments.session_metadata(clean)))


def test_totals_from_parts_by_week_and_year(spark, tmp_path, monkeypatch):
    whole, late = Store(spark, str(tmp_path / "whole")), Store(spark, str(tmp_path / "late"))
    df = labelled_days(spark, whole).persist()
    want = featurised(whole, spark, [("2024-01-01", "2024-01-29")])
    for most, some in ((2, F.dayofyear("time") > 2), (100, F.dayofyear("time") <= 2)):
        monkeypatch.setattr(steps, "MOST_PARTS", most)
        late.write(df.filter(some), "labelled")
        got = featurised(late, spark, [("2024-01-01", "2024-01-29")])
    assert got == want and len(want) > 20
    assert {x.split("/")[1] for x in late.parts("features_rows")} == {"y2024", "2024-w01"}


def test_run_of_other_labels_in_a_catalog(spark):
    store = Store(spark)
    for n in (3, 120):  # the same delivery, with more days the second time
        steps.ingest(store, spark.createDataFrame([("u", D0 + timedelta(days=d), 1.0) for d in range(n)], HEART), "samples_again", "monday")
    assert store.read("samples_again").count() == 120 and len(store.parts("samples_again")) == 18
    store.drop("samples_again")


def test_long_runs_of_days_have_few_parts(spark, tmp_path):
    """Runs over many days have their parts by week, those over few by day; what comes of them is what comes of all rows at once."""
    store = Store(spark, str(tmp_path))
    thresholds = spark.createDataFrame([("u", date(2024, 1, 1), 80.0, 79.0, 81.0)], "userid string, date date, thresh14 double, thresh14_low double, thresh14_high double")
    rows = spark.createDataFrame([("u", D0 + timedelta(days=k // 12, minutes=k % 12), 78.0 + k % 5) for k in range(120 * 12)], HEART)
    stepped = rows.filter("minute(time) > 3")
    steps.ingest(store, rows, "hr", "all")
    steps.ingest(store, stepped, "fs", "all")
    assert len(store.parts("hr")) == 18
    for start, end in (("2024-01-01", "2024-01-04"), ("2024-01-01", "2025-01-01")):
        steps.clean_days_step(store, "hr", "clean", "l1", start, end)
    steps.featurise_days_step(store, "fs", "clean", "daily", "l2", thresholds, link(spark, "u"), "2024-01-01", "2025-01-01")
    assert {x.split("/")[1] for x in store.parts("clean")} == {"2024-01-01", "2024-01-02", "2024-01-03"} | {f"2024-w{w:02d}" for w in range(1, 18)}
    clean = steps.clean_days(rows.filter("time < '2024-04-29'")).persist()  # the latest day is withheld
    assert told(store.read("clean")) == told(clean)
    want = steps.featurise_days(stepped, clean, thresholds, link(spark, "u"))
    assert told(store.read("daily")) == told(want) and want.count() == 119
