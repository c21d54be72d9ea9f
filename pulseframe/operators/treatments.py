"""Treatments from labelled pressure rows: sessions and their groups, breath and break features, adherence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import auto_units, jan_week, seconds_between
from .series import sessionise

COMPLETE = 150
STRONG = 10.0
# Prescriptions where none is given.
DEFAULTS = {"prescr_n_sets": 10.0, "prescr_n_breaths": 10.0, "prescr_treatments_day": 2.0}


def session_spans(samples: DataFrame, keys: tuple = ("patient_id", "session_id")) -> DataFrame:
    """Start, end and date of each session."""
    return with_date(samples.groupBy(*keys).agg(F.min("time").alias("session_start"), F.max("time").alias("session_end")))


def with_date(spans: DataFrame) -> DataFrame:
    return spans.withColumn("date", F.to_date("session_start"))


def grouped_sessions(spans: DataFrame, gap_seconds: int = 3600) -> DataFrame:
    """session_spans with the treatment that each session belongs to."""
    return sessionise(spans, ["patient_id"], "session_start", "session_end", "session_id", gap_seconds)


def session_metadata(samples: DataFrame) -> DataFrame:
    return grouped_sessions(session_spans(samples))


def treatment_spans(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("patient_id", "treatment_id").agg(F.min("time").alias("treatment_start"), F.max("time").alias("treatment_end"))


def count_ids(column: Column) -> Column:
    """Aggregate: distinct ids that are not 0."""
    return F.count_distinct(F.when(column != 0, column)).cast("double")


def with_counts(rows: DataFrame) -> DataFrame:
    """Adds breath_count, break_count and set_count of each treatment to its rows."""
    counts = rows.groupBy("patient_id", "treatment_id").agg(count_ids(F.col("breath_id")).alias("breath_count"), count_ids(F.col("break_id")).alias("break_count"), count_ids(F.col("set_id")).alias("set_count"))
    return rows.join(counts, ["patient_id", "treatment_id"])


def _four(column: Column | str, name: str) -> list[Column]:
    return [f(column).alias(f"{kind}_{name}") for kind, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("sd", F.stddev_samp))]


def _unit(seconds: Column, mixed_units: bool) -> Column:
    return auto_units(seconds) if mixed_units else seconds


def _middle(values: Column) -> Column:
    """The mean of the middle one or two of an array of (time, value), by time."""
    ordered, n = F.array_sort(values), F.size(values)
    at = lambda k: F.element_at(ordered, k.cast("int"))["pressure_detrend"]
    return F.when(n > 0, (at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2)


def breath_measures(labelled: DataFrame, mixed_units: bool = False) -> DataFrame:
    """Per breath: amplitude, mean amplitude, amplitude of the middle row (mean of two), duration in seconds."""
    duration = _unit(seconds_between(F.min("time"), F.max("time")), mixed_units).alias("duration")
    middle = _middle(F.collect_list(F.struct("time", "pressure_detrend"))).alias("middle_amplitude")
    return labelled.filter("breath_id > 0").groupBy("patient_id", "treatment_id", "breath_id").agg(F.max("pressure_detrend").alias("amplitude"), F.avg("pressure_detrend").alias("mean_amplitude"), duration, middle)


def break_durations(labelled: DataFrame, mixed_units: bool = False) -> DataFrame:
    duration = _unit(seconds_between(F.min("time"), F.max("time")), mixed_units).alias("duration")
    return labelled.filter("break_id > 0").groupBy("patient_id", "treatment_id", "break_id").agg(duration)


def breath_aggregates(extra: bool = False, where: Column | None = None) -> list[Column]:
    """Aggregates over a treatment's breaths (the rows where `where` holds): mean, min, max and sd of amplitude and duration; with
    `extra` the shares of adherent breaths."""
    of = lambda c: F.col(c) if where is None else F.when(where, F.col(c))
    aggs = _four(of("amplitude"), "breath_amplitude") + _four(of("duration"), "breath_duration")
    if extra:
        a, m, d = of("amplitude"), of("mean_amplitude"), of("duration")
        good = lambda x: (x > 10) & (x < 20)
        shares = {"pressure": good(a) | good(m), "peak_pressure": good(a), "breath_1s": d >= 1, "breath_2s": d >= 2, "breath_3s": d >= 3, "pressure_duration": (d >= 2) & (d < 6) & good(a)}
        every = F.count(F.lit(1) if where is None else F.when(where, 1))
        aggs += [F.avg(of("middle_amplitude")).alias("mean_breath_amplitude_middle")]
        aggs += [(F.sum(F.when(c, 1).otherwise(0)) / F.nullif(every, F.lit(0))).alias(f"{k}_treatment_adherence_score") for k, c in shares.items()]
    return aggs


def breath_features(measures: DataFrame, extra: bool = False) -> DataFrame:
    return measures.groupBy("patient_id", "treatment_id").agg(*breath_aggregates(extra))


def break_features(durations: DataFrame) -> DataFrame:
    return durations.groupBy("patient_id", "treatment_id").agg(*_four("duration", "break_duration"))


def treatment_rows(labelled: DataFrame, extra: bool = False, mixed_units: bool = False) -> DataFrame:
    """One row per treatment: all that depends on its own rows alone, and their number (`rows`).

    The labelled rows are read and shuffled once, as sums over cells of one breath and one break; each cell then counts to its
    breath and to its break, and those to the treatment.
    """
    key, v = ["patient_id", "treatment_id"], F.col("pressure_detrend")
    held = [F.collect_list(F.when(F.col("breath_id") > 0, F.struct("time", "pressure_detrend"))).alias("held")] if extra else []
    counts = ("breath_count", "break_count", "set_count")
    cells = labelled.groupBy(*key, "breath_id", "break_id").agg(
        F.min("time").alias("start"), F.max("time").alias("end"), F.count(F.lit(1)).alias("rows"), F.max(v).alias("amplitude"), F.sum(v).alias("total"), F.count(v).alias("values"),
        F.sum(F.when((F.col("breath_id") != 0) & (v >= STRONG), 1).otherwise(0)).alias("strong"), *(F.max(c).alias(c) for c in counts), *held,
    )
    both = F.explode(F.array(*(F.struct(F.lit(c == "breath_id").alias("breath"), F.col(c).alias("id")) for c in ("breath_id", "break_id"))))
    merged = {"start": F.min, "end": F.max, "rows": F.sum, "amplitude": F.max, "total": F.sum, "values": F.sum, "strong": F.sum} | dict.fromkeys(counts, F.max)
    held = [_middle(F.flatten(F.collect_list(F.when(F.col("of.breath"), F.col("held"))))).alias("middle_amplitude")] if extra else []
    parts = cells.withColumn("of", both).groupBy(*key, "of.breath", "of.id").agg(*(f(c).alias(c) for c, f in merged.items()), *held)
    parts = parts.withColumn("duration", _unit(seconds_between(F.col("start"), F.col("end")), mixed_units)).withColumn("mean_amplitude", F.col("total") / F.col("values"))
    breath, real = F.col("breath"), F.col("id") > 0
    whole = lambda c: F.sum(F.when(breath, F.col(c)).otherwise(0))  # noqa: E731  # every row counts to one breath, 0 if to none
    out = parts.groupBy(*key).agg(
        F.min("start").alias("treatment_start"), F.max("end").alias("treatment_end"), whole("rows").alias("rows"), (whole("strong") / 10).alias("seconds_above10"),
        (F.sum(F.when(breath & real, F.col("rows")).otherwise(0)) / whole("rows")).alias("percent_time_breathing"), *(F.max(c).alias(c) for c in counts),
        *breath_aggregates(extra, breath & real), *_four(F.when(~breath & real, F.col("duration")), "break_duration"),
    )
    out = out.withColumn("act_date", F.to_date("treatment_start")).withColumn("treatment_length", F.floor(seconds_between(F.col("treatment_start"), F.col("treatment_end"))).cast("double"))
    return out.withColumn("percentage_above10", F.col("seconds_above10") * 10 / F.col("rows") * 100)


def with_daily(rows: DataFrame) -> DataFrame:
    """treatment_rows with the counts of all of a patient's rows of the day on which the treatment began, in place of `rows`. They
    must be all of the day's treatments."""
    daily = F.sum("rows").over(Window.partitionBy("patient_id", "act_date")).cast("double")
    return rows.withColumn("pressures_daily_count", daily).withColumn("pressures_completeness_score", (F.col("pressures_daily_count") > COMPLETE).cast("double")).drop("rows")


def treatment_features(labelled: DataFrame, extra: bool = False, mixed_units: bool = False) -> DataFrame:
    """One row per treatment, with its day's counts."""
    return with_daily(treatment_rows(labelled, extra, mixed_units))


def week_label(date: Column) -> Column:
    """The week of its year, as the label of a part: all that day and week totals depend on lies in one."""
    return F.format_string("%d-w%02d", F.year(date), jan_week(date))


def worth_scoring(features: DataFrame) -> DataFrame:
    return features.filter("breath_count > 0 and pressures_completeness_score = 1")


def day_and_week(features: DataFrame) -> DataFrame:
    """Adds each treatment's day and week totals; a day's totals count once in its week (of its year). All windows are of one
    patient, so that rows dealt by patient are not dealt again."""
    day = Window.partitionBy("patient_id", "act_date")
    score = F.col("pressures_completeness_score")
    out = features.withColumn("year", F.year("act_date")).withColumn("act_week", jan_week(F.col("act_date")))
    out = out.withColumn("breaths_count_day", F.sum("breath_count").over(day) * score).withColumn("treatment_count_day", F.count(F.lit(1)).over(day) * score)
    first = F.row_number().over(day.orderBy("treatment_start", "treatment_id")) == 1
    week = Window.partitionBy("patient_id", "year", "act_week")
    out = out.withColumn("__first", first)
    for name in ("breaths", "treatment"):
        out = out.withColumn(f"{name}_count_week", F.sum(F.when(F.col("__first"), F.col(f"{name}_count_day"))).over(week))
    return out.drop("__first")


def prescriptions(devices: DataFrame) -> DataFrame:
    """Devices with the prescription columns renamed, numeric, and filled with the defaults."""
    names = {"treatments_per_day": "prescr_treatments_day", "number_of_sets": "prescr_n_sets", "breaths_per_set": "prescr_n_breaths"}
    out = devices.withColumnsRenamed(names)
    return out.withColumns({c: F.col(c).cast("double") for c in names.values()}).na.fill(DEFAULTS)


def adherence(features: DataFrame, devices: DataFrame, extra: bool = False) -> DataFrame:
    """Per treatment, what was done against what was prescribed (null where that is 0). A patient with several devices gets
    a row for each."""
    key = ["patient_id", "treatment_id", "act_date", "pressures_completeness_score"]
    presc = prescriptions(devices).select("patient_id", *DEFAULTS)
    out = day_and_week(features.repartition("patient_id")).join(presc, "patient_id")
    sets, breaths, day = (F.nullif(F.col(c), F.lit(0.0)) for c in ("prescr_n_sets", "prescr_n_breaths", "prescr_treatments_day"))
    scores = {
        "treatment_day_adherence_score": F.col("treatment_count_day") / day,
        "breaths_day_adherence_score": F.col("breaths_count_day") / day / sets / breaths,
        "treatment_week_adherence_score": F.col("treatment_count_week") / day / 7,
        "breaths_week_adherence_score": F.col("breaths_count_week") / day / sets / breaths / 7,
    }
    if extra:
        today = Window.partitionBy("patient_id", "act_date", *DEFAULTS)
        scores |= {"breaths_treatment_adherence_score": F.col("breath_count") / (sets * breaths), "sets_treatment_adherence_score": F.col("set_count") / sets, "sets_day_adherence_score": F.sum("set_count").over(today) / (sets * day)}
        scores |= {f"{k}_day_adherence_score": F.avg(f"{k}_treatment_adherence_score").over(today) for k in ("pressure", "peak_pressure", "pressure_duration")}
    return out.select(*key, *(c.alias(k) for k, c in scores.items()))


def with_adherence(features: DataFrame, devices: DataFrame, extra: bool = False) -> DataFrame:
    """Scored treatments with their features."""
    kept = worth_scoring(features)
    return adherence(kept, devices, extra).join(kept, ["patient_id", "treatment_id", "act_date", "pressures_completeness_score"], "left")
