"""The two pipelines as incremental steps over whole populations.

A step brings the index of its input up to date (plans.index: only parts that are new are read), takes the units (sessions,
treatments, days) that its ledger does not have by an anti join, reads them from the parts that hold any, and transforms all
of them in one plan. It first notes the units of its run in `<ledger>_begun`, then writes the data, then the ledger, all
under the run's name; a run that is in the first but not in the ledger was broken off, and the next call does it again, with
the same units and under the same name, so that what it had written is replaced. A step that is run again after a failure
therefore neither loses nor doubles rows.

Columns and types of what comes in and goes out are checked. Given the link table, values, ids and dates of what comes in are
too, by aggregates that are gathered while the rows are written: if one fails, the run is taken back and has no ledger rows.

Data are written in parts by day; a run of many days in parts by week, month or year, so that it has a bounded number of files
and the listing of them does not outweigh the work. What treatments have from their days and weeks is worked out anew, for all treatments of each
week that a run touches, from a table with what they have by themselves; so the result does not depend on how runs are cut.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import daily, enrich, heart, pressure, quality, treatments
from ..sources import schemas
from ..sources.tables import LABEL, RUN, Store, remaining
from .index import Index


def clean_pressure(raw: DataFrame) -> DataFrame:
    """Raw rows (id, pressurevalues, time, patient_record_id) as detrended sessions."""
    rows = pressure.complete_rows(raw.select(F.col("patient_record_id").alias("patient_id"), F.col("id").alias("session_id"), "time", F.col("pressurevalues").cast("double").alias("pressure")))
    rows = pressure.even_times(pressure.drop_resent_blocks(rows.repartition("session_id")))
    return pressure.within_physical(pressure.detrended(rows)).select("patient_id", "session_id", "time", "pressure_detrend")


def label_pressure(clean: DataFrame, metadata: DataFrame, covered: bool = False) -> DataFrame:
    """Detrended rows with treatments, peaks, breaths, breaks, sets and their counts. All sessions must have metadata, which is
    looked up unless they are known to be covered."""
    if not covered and quality.uncovered(clean, metadata).limit(1).count():
        raise ValueError("sessions without metadata")
    rows = clean.join(metadata.select("session_id", "treatment_id", "session_start"), "session_id")
    rows = pressure.with_breaths(pressure.with_peaks(rows, place="place"), place="place")
    return treatments.with_counts(pressure.with_sets(rows, place="place").drop("place"))


def run_step(store: Store, ledger: str, keys: list[str], units: DataFrame, write: Callable[[str, DataFrame], list[str]], gate: quality.Gate | None = None) -> bool:
    """write(run, units) for the units that the ledger lacks, after those of a run that was broken off; returns whether there
    were any. write says which tables the run has rows in: they are taken back if the gate does not let it pass."""
    begun, known = f"{ledger}_begun", store.exists(ledger)
    found = False

    def finish(run: str, todo: DataFrame) -> None:
        written = write(run, todo)
        if gate:
            try:
                gate.demand()
            except ValueError:
                for table in [*written, begun]:
                    store.drop_run(table, run)
                raise
        store.write_run(todo, ledger, run)

    if store.exists(begun):
        notes = store.read(begun, runs=True)
        runs = notes.select(RUN).distinct()
        for row in (runs.join(store.read(ledger, runs=True).select(RUN), RUN, "left_anti") if known else runs).collect():  # one name for each broken run
            finish(row[0], notes.filter(F.col(RUN) == row[0]).select(*keys))
            found = known = True
    todo = remaining(units, store.read(ledger) if known else None, keys)
    if todo.isEmpty():
        return found
    run = f"r{uuid.uuid4().hex}"  # a letter first: no reader takes it for a number
    store.write_run(todo, begun, run)
    finish(run, store.read(begun, runs=True).filter(F.col(RUN) == run).select(*keys))
    return True


def between(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Dates from start on, before end."""
    return df.filter((F.col(column) >= F.lit(start).cast("date")) & (F.col(column) < F.lit(end).cast("date")))


def whole_weeks(start: str, end: str) -> None:
    """Raises unless the range is a positive number of weeks."""
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days
    if days < 7 or days % 7:
        raise ValueError(f"{days} days are not whole weeks")


def blind_windows(link: DataFrame, featurise: bool = False) -> DataFrame:
    """Per patient, the days before feedback: [recruited (one later to featurise), feedback or 60 days on), to featurise
    made up to whole weeks."""
    start = F.date_add("date_recruited", 1) if featurise else F.col("date_recruited")
    out = link.select(F.col("patient_record_id").alias("patient_id"), start.alias("window_start"), F.coalesce("date_feedback_start", F.date_add(start, 60)).alias("window_end"))
    if featurise:
        out = out.withColumn("window_end", F.date_add("window_end", F.pmod(7 - F.datediff("window_end", "window_start"), F.lit(7))))
    return out


def within_windows(df: DataFrame, windows: DataFrame, date_column: str) -> DataFrame:
    out = df.join(windows, "patient_id").filter((F.col(date_column) >= F.col("window_start")) & (F.col(date_column) < F.col("window_end")))
    return out.drop("window_start", "window_end")


def settled_days(days: DataFrame, user: str = "userid") -> DataFrame:
    """A user's days without the latest, which may still grow."""
    latest = days.groupBy(user).agg(F.max("date").alias("__latest"))
    return days.join(latest, user).filter("date < __latest").drop("__latest")


def clean_days(samples: DataFrame) -> DataFrame:
    """Heart-rate samples (userid, time, value) cleaned by day."""
    return heart.clean(samples.withColumn("date", F.to_date("time"))).select("userid", "time", "value")


def days_after_recruitment(days: DataFrame, link: DataFrame) -> DataFrame:
    people = link.select(F.col("hub_id").alias("userid"), "date_recruited")
    return days.join(people, "userid").filter("date >= date_recruited").select("userid", "date")


def featurise_days(steps: DataFrame, clean: DataFrame, thresholds: DataFrame, link: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Daily features of the days after recruitment that are worth it; `days` (userid, date) if these are known already."""
    if days is None:
        days = days_after_recruitment(daily.worth_featurising(steps, clean), link)
    return daily.daily_features(daily.combine_minutes(of_days(steps, days), of_days(clean, days), allow_empty=True, keep_date=True), thresholds, days)


def enrich_treatments(features: DataFrame, games: DataFrame, link: DataFrame, sex: DataFrame, as_of: str) -> DataFrame:
    out = enrich.with_phase(enrich.with_games(features, games, link), link)
    out = enrich.with_treatment_order(enrich.with_demographics(out, link, sex), as_of)
    return enrich.flag_outliers(out, ["breath_count"])


def enrich_days(features: DataFrame, link: DataFrame, sex: DataFrame) -> DataFrame:
    out = enrich.with_demographics(features, link, sex, "userid", "hub_id", "date")
    return enrich.flag_outliers(enrich.with_week_score(out), ["mvpa_15_prev_method"])


def raw_index(store: Store, raw: str) -> Index:
    return Index(store, raw, {"patient_id": "patient_record_id", "session_id": "id"})


def clean_index(store: Store, clean: str) -> Index:
    return Index(store, clean, {"patient_id": "patient_id", "session_id": "session_id"})


def labelled_index(store: Store, labelled: str) -> Index:
    return Index(store, labelled, {"patient_id": "patient_id", "treatment_id": "treatment_id"})


def day_index(store: Store, samples: str) -> Index:
    return Index(store, samples, {"userid": "userid", "date": "to_date(time)"}, lows={"low": "value"})


def _sessions(index: Index) -> DataFrame:
    return treatments.with_date(index.spans().select("patient_id", "session_id", F.col("first").alias("session_start"), F.col("last").alias("session_end")))


#: A run has its parts by the first of these that cuts it into at most MOST_PARTS, or else by the last.
LABELS: dict[str, Callable[[Column], Column]] = {
    "day": lambda d: d.cast("string"),
    "week": treatments.week_label,
    "month": lambda d: F.format_string("%d-m%02d", F.year(d), F.month(d)),  # a letter: no reader takes it for a date
    "year": lambda d: F.format_string("y%d", F.year(d)),
}
MOST_PARTS = 31


def part_label(days: DataFrame, day: Column, names: Sequence[str] = tuple(LABELS)) -> Column:
    """The label of the part that a row of the given day goes to, in a run that has the days of `days` (date)."""
    counts = days.select("date").distinct().agg(*(F.count_distinct(LABELS[n](F.col("date"))).alias(n) for n in names)).first()
    return LABELS[next((n for n in names if counts[n] <= MOST_PARTS), names[-1])](day)


def ingest(store: Store, rows: DataFrame, table: str, run: str) -> None:
    """Raw rows (with a time) in parts by time, under a name of the caller's; a delivery that is written twice is there once. The
    rows' times are read before, to tell how many days there are."""
    day = F.to_date("time")
    store.write_run(rows, table, run, part_label(rows.select(day.alias("date")), day))


def clean_pressure_step(store: Store, raw: str, clean: str, ledger: str, start: str, end: str, link: DataFrame | None = None) -> bool:
    index, gate = raw_index(store, raw).refresh(), quality.pressure_gate() if link is not None else None

    def watched(rows: DataFrame) -> DataFrame:
        if gate is None:
            return rows
        people = link.select("patient_record_id", F.lit(True).alias("known")).distinct()
        return gate.watch(rows.join(people, "patient_record_id", "left")).drop("known")

    def write(run: str, todo: DataFrame) -> list[str]:
        rows = quality.require(index.read(todo.select(F.col("id").alias("session_id"))), schemas.RAW_PRESSURE)
        out = clean_pressure(watched(rows))
        quality.check_schema(out, schemas.CLEAN_PRESSURE)
        days = sessions.join(todo, F.col("session_id") == F.col("id"), "left_semi")
        store.write_run(out, clean, run, part_label(days, F.to_date("time")))
        return [clean]

    sessions = _sessions(index)
    units = between(sessions, "date", start, end).select(F.col("session_id").alias("id"))
    return run_step(store, ledger, ["id"], units, write, gate)


def label_pressure_step(store: Store, clean: str, labelled: str, ledger: str, start: str, end: str, gap_seconds: int = 3600) -> bool:
    """Whole treatments at a time: a treatment's later sessions never restart its numbering."""
    index = clean_index(store, clean).refresh()
    metadata = treatments.grouped_sessions(_sessions(index), gap_seconds)
    first = between(metadata.groupBy("treatment_id").agg(F.min("date").alias("date")), "date", start, end)

    def write(run: str, todo: DataFrame) -> list[str]:
        sessions = metadata.join(todo, "treatment_id", "left_semi")
        rows = quality.require(index.read(sessions.select("session_id")), schemas.CLEAN_PRESSURE)
        out = label_pressure(rows, sessions, covered=True)  # the sessions are the index's own
        quality.check_schema(out, schemas.LABELLED_PRESSURE)
        store.write_run(out, labelled, run, part_label(sessions, F.to_date("session_start")))
        return [labelled]

    return run_step(store, ledger, ["treatment_id"], first, write)


def featurise_treatments_step(store: Store, labelled: str, target: str, ledger: str, devices: DataFrame, start: str, end: str, extra: bool = False) -> bool:
    """`<target>_rows` gets what each treatment has by itself; of the weeks that the run touches, all rows of the target are
    worked out anew from it."""
    whole_weeks(start, end)
    index, own = labelled_index(store, labelled).refresh(), f"{target}_rows"
    starts = index.spans().select("treatment_id", F.to_date("first").alias("date"))
    units = between(starts, "date", start, end).select("treatment_id")

    def write(run: str, todo: DataFrame) -> list[str]:
        rows, week = quality.require(index.read(todo), schemas.LABELLED_PRESSURE), LABELS["week"](F.col("act_date"))
        store.write_run(treatments.treatment_rows(rows, extra), own, run, part_label(starts.join(todo, "treatment_id", "left_semi"), F.col("act_date"), ("week", "year")))
        every = store.read(own, runs=True)
        weeks = [r[0] for r in every.filter(F.col(RUN) == run).select(week).distinct().collect()]  # a label for each week
        parts = {*weeks, *(f"y{w.partition('-')[0]}" for w in weeks)}  # a year's part holds whole weeks
        found = treatments.with_adherence(treatments.with_daily(every.filter(F.col(LABEL).cast("string").isin(parts) & week.isin(weeks)).drop(RUN, LABEL)), devices, extra)
        if not extra:
            quality.check_schema(found, schemas.TREATMENTS)
        store.replace(found, target, treatments.week_label(F.col("act_date")))
        return [own]

    return run_step(store, ledger, ["treatment_id"], units, write)


def of_days(samples: DataFrame, days: DataFrame) -> DataFrame:
    """The samples (userid, time, ...) of the given (userid, date)."""
    return samples.withColumn("date", F.to_date("time")).join(days, ["userid", "date"], "left_semi").drop("date")


def _with_people(samples: DataFrame, link: DataFrame) -> DataFrame:
    return samples.join(link.groupBy(F.col("hub_id").alias("userid")).agg(F.min("date_recruited").alias("date_recruited")), "userid", "left")


def clean_days_step(store: Store, samples: str, clean: str, ledger: str, start: str, end: str, link: DataFrame | None = None, as_of: str | None = None) -> bool:
    index, gate = day_index(store, samples).refresh(), quality.samples_gate("heart", as_of) if link is not None else None

    def write(run: str, todo: DataFrame) -> list[str]:
        rows = quality.require(index.read(todo), schemas.HEART)
        rows = rows if gate is None else gate.watch(_with_people(rows, link)).drop("date_recruited")
        out = clean_days(rows)
        quality.check_schema(out, schemas.HEART)
        store.write_run(out, clean, run, part_label(todo, F.to_date("time")))
        return [clean]

    days = between(settled_days(index.spans().select("userid", "date")), "date", start, end)
    return run_step(store, ledger, ["userid", "date"], days, write, gate)


def featurise_days_step(store: Store, steps: str, clean: str, target: str, ledger: str, thresholds: DataFrame, link: DataFrame, start: str, end: str, as_of: str | None = None, checked: bool = False) -> bool:
    """Days that are not worth featurising enter the ledger too. Which are is told from the indexes. With `checked`, steps pass
    the gate of samples."""
    stepped, hearts = day_index(store, steps).refresh(), day_index(store, clean).refresh()
    gate = quality.samples_gate("steps", as_of) if checked else None
    keys = ["userid", "date"]
    days = between(stepped.spans().select(*keys).union(hearts.spans().select(*keys)).distinct(), "date", start, end)
    worth = days_after_recruitment(stepped.spans().filter("n > 1").select(*keys).join(hearts.spans().filter("n > 1 and low > 0").select(*keys), keys), link)

    def write(run: str, todo: DataFrame) -> list[str]:
        some = worth.join(todo, keys, "left_semi")
        rows = stepped.read(some if gate is None else todo)
        rows = rows if gate is None else gate.watch(_with_people(rows, link)).drop("date_recruited")
        out = featurise_days(rows, hearts.read(some), thresholds, link, some)
        quality.check_schema(out, schemas.DAILY)
        store.write_run(out, target, run, part_label(todo, F.col("date"), ("week", "month", "year")))
        return [target]

    return run_step(store, ledger, keys, days, write, gate)


def weeks_from(start: str, weeks: int) -> str:
    return (date.fromisoformat(start) + timedelta(weeks=weeks)).isoformat()
