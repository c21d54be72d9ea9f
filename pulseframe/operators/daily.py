"""Daily activity features from minute rows of heart rate and steps: one exchange of the samples, by user and day, serves
their minutes and all of a day's windows, and the day is one wide aggregate.

The groups of features are functions of columns that give {name: aggregate}; the queries use them on their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.calendar import DAY_PARTS, MINUTES, day_part
from ..functions.stats import divide, nan_to_null, variation
from .series import length_total, nearest_date, spread

KEYS = ("userid", "date")
ACTIVE_STEPS = 70
ACTIVE_HOUR = 500
RUN_LENGTHS = (0, 2, 5, 10, 20)
CHAINS = (2, 3, 5, 10, 20)


def combine_minutes(steps: DataFrame, heart: DataFrame, allow_empty: bool = False, keep_date: bool = False) -> DataFrame:
    """(userid, time, value_steps, value_hr) per minute from samples (userid, time, value): steps as they are, heart rate
    as the minute's mean, NaN left out. A minute that one side lacks has a null there; if a whole side is empty it is 0 instead.
    Both sides empty is an error unless that is allowed (which also saves the look into them). With keep_date, the rows have
    their date and are dealt by user and date.
    """
    if not allow_empty and steps.isEmpty() and heart.isEmpty():
        raise ValueError("neither steps nor heart rate")
    # Both sides in one exchange, by user and day; it serves the distinct, the minutes, and whatever windows a day has next.
    kind = lambda df, stepped: df.select("userid", F.to_date("time").alias("date"), F.date_trunc("minute", "time").alias("minute"), "time", nan_to_null(F.col("value").cast("double")).alias("value"), F.lit(stepped).alias("stepped"))
    rows = spread(kind(steps, True).unionByName(kind(heart, False)), KEYS).distinct()
    minute = Window.partitionBy(*KEYS, "minute")
    rows = rows.withColumns({"value_hr": F.avg(F.when(~F.col("stepped"), F.col("value"))).over(minute), "k": F.row_number().over(minute.orderBy(F.col("stepped").desc(), "time", "value"))})
    rows = rows.filter(F.col("stepped") | (F.col("k") == 1))  # the first one is a heart rate only where there are no steps
    some = lambda df, name: df.limit(1).select(F.lit(name).alias("side"))
    sides = some(steps, "s").unionByName(some(heart, "h")).agg(F.max(F.when(F.col("side") == "s", 1)).alias("__s"), F.max(F.when(F.col("side") == "h", 1)).alias("__h"))
    out = rows.join(F.broadcast(sides))  # one row
    fill = lambda c, n, name: F.when(F.col(n).isNull(), F.lit(0.0)).otherwise(c).alias(name)
    own = F.when(F.col("stepped"), F.col("value"))
    return out.select("userid", *(["date"] if keep_date else []), F.col("minute").alias("time"), fill(own, "__s", "value_steps"), fill(F.col("value_hr"), "__h", "value_hr"))


def worth_featurising(steps: DataFrame, heart: DataFrame) -> DataFrame:
    """(userid, date) of the days with more than one row of either kind and no heart rate of 0 or less."""
    day = F.to_date("time").alias("date")
    s = steps.groupBy("userid", day).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*KEYS)
    h = heart.groupBy("userid", day).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low")).filter("n > 1 and low > 0").select(*KEYS)
    return s.join(h, list(KEYS))


def finite(value: Column) -> Column:
    """The value, or null if it is missing, NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def lowest(value: Column, keys: Sequence[Column | str], most: int = 5) -> Column:
    """The value where it is one of the keys' lowest finite ones (as many as `most`), else null. A window, which Spark
    limits to so many rows a key before and after the exchange if nothing else is kept."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(finite(value).asc_nulls_last()))
    return F.when(rank <= most, finite(value))


def resting(df: DataFrame, keys: Sequence[str], value: str, keep: Column | None = None, most: int = 5, name: str = "resting_hr_proxy") -> DataFrame:
    """(keys, name): the mean of the lowest finite values, 0 if there is none; only keys with a row that is kept."""
    rows = df.select(*keys, finite(F.col(value)).alias("__v"), (F.lit(True) if keep is None else keep).alias("__keep"))
    low = rows.filter(F.col("__v").isNotNull() & F.col("__keep")).withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__v"))).filter(F.col("__k") <= most)
    means = low.groupBy(*keys).agg(F.avg("__v").alias(name))
    return rows.select(*keys).distinct().join(means, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def active_window(value: Column, time: Column, awake: float = 5, asleep: float = 25) -> tuple[Column, Column]:
    """Aggregates: first and last time of activity, which must be stronger before six."""
    active = (value > awake) & ((F.hour(time) >= 6) | (F.hour(time) <= 6) & (value > asleep))
    return F.min(F.when(active, time)), F.max(F.when(active, time))


def _total(c: Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0.0))


def _count(c: Column) -> Column:
    return F.sum(F.when(c, 1.0).otherwise(0.0))


def total_where(predicate: str, value: Column) -> Column:
    """Aggregate: the total over the rows that a predicate given as SQL text keeps."""
    return _total(F.when(F.expr(predicate), value))


def step_totals(steps: Column, time: Column) -> dict[str, Column]:
    return {"step_count": _total(steps)} | {f"step_count_{p}": _total(F.when(day_part(time, p), steps)) for p in ("q2", "q3", "q4", "q234")}


def hour_steps(total: Column, active: float = ACTIVE_HOUR) -> dict[str, Column]:
    """Over a row for each hour (null elsewhere): its steps."""
    return {"mean_hourly_steps_day": F.avg(total), "active_hours": _count(total > active), "low_active_hours": _count((total > 0) & (total <= active))}


def hour_hearts(mean: Column) -> dict[str, Column]:
    """Over a row for each hour (null elsewhere): its mean heart rate."""
    return {"max_hourly": total_of(F.max(mean)), "min_hourly": total_of(F.min(mean)), "median_hourly": total_of(F.median(mean))}


def wear_minutes(hr: Column, time: Column) -> dict[str, Column]:
    return {"mins_wear_total": _count(hr.isNotNull())} | {f"mins_wear_{p}": _count(hr.isNotNull() & day_part(time, p)) for p in DAY_PARTS}


def wear_percents() -> dict[str, Column]:
    """Of the columns of wear_minutes."""
    wear = {"": ("total", "day"), "_q1": ("q1", "quadrant"), "_q2": ("q2", "quadrant"), "_q3": ("q3", "quadrant"), "_q4": ("q4", "quadrant"), "_q234": ("q234", "q234")}
    out = {f"wear_percent{k}": F.col(f"mins_wear_{p}") / MINUTES[unit] * 100 for k, (p, unit) in wear.items()}
    out |= {f"gap_percent{k}": 100 - out[f"wear_percent{k}"] for k in ("", "_q1", "_q2", "_q3", "_q4")}
    return out | {"wear_during_sleep": F.when(out["gap_percent_q1"] > 25, 0.0).otherwise(1.0)}


def step_norms() -> dict[str, Column]:
    """Of the columns of step_totals, wear_minutes and wear_percents."""
    return {"step_count_norm": divide(F.col("step_count"), F.col("mins_wear_total"))} | {f"step_count_norm_{q}": divide(F.col(f"step_count_{q}"), F.col(f"wear_percent_{q}")) for q in ("q2", "q3", "q4")}


def variations(steps: Column, hr: Column, time: Column) -> dict[str, Column]:
    moving, parts = steps > 0, ("q1", "q2", "q3", "q4", "q234")
    out = {"cov_step": variation(steps, moving)} | {f"cov_step_{p}": variation(steps, moving & day_part(time, p)) for p in parts}
    return out | {"cov_hr": variation(hr)} | {f"cov_hr_{'q5' if p == 'q234' else p}": variation(hr, day_part(time, p)) for p in parts}


def daily_features(minutes: DataFrame, thresholds: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """The wide daily row of minutes (userid, time, value_steps, value_hr; a date too if combine_minutes kept it, by which they
    are dealt already); thresholds: (userid, date, thresh14, thresh14_low, thresh14_high), of which the row of the nearest
    date counts. days: all (userid, date) that minutes have, and maybe more; without it they are taken from the minutes, which
    are then made twice."""
    dealt = "date" in minutes.columns
    m = minutes.withColumns(({} if dealt else {"date": F.to_date("time")}) | {"hour": F.hour("time"), "seconds": F.unix_seconds("time")})
    m = m if dealt else spread(m, KEYS)
    near = nearest_date((m if days is None else days).select(*KEYS).distinct(), thresholds, "userid", "date", "date", ["thresh14", "thresh14_low", "thresh14_high"])
    near = near.select(*KEYS, F.col("thresh14").alias("thresh"), F.col("thresh14_low").alias("thresh_low"), F.col("thresh14_high").alias("thresh_high"))
    m = m.join(near, list(KEYS), "left")
    steps, hr, time = F.col("value_steps"), F.col("value_hr"), F.col("time")
    # One order for all of a day's windows; of one minute's rows those with steps come first.
    day = Window.partitionBy(*KEYS).orderBy("hour", "seconds", steps.desc_nulls_last(), hr)
    so_far, hour = day.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*KEYS, "hour")
    zero = F.coalesce(hr, F.lit(0.0))
    mvpa = F.coalesce(hr > F.col("thresh"), F.lit(False)) & F.coalesce(F.col("seconds") - F.col("stepped") <= 900, F.lit(False))
    first = F.coalesce(F.lag("hour").over(day) != F.col("hour"), F.lit(True))
    m = m.withColumns({"k": F.row_number().over(day), "before": F.lag(zero).over(day), "first": first, "stepped": F.last(F.when(steps > 0, F.col("seconds")), ignorenulls=True).over(so_far)})
    m = m.withColumns({"active": F.coalesce(steps, F.lit(0.0)) >= ACTIVE_STEPS, "mvpa": mvpa, "both": mvpa & F.coalesce(steps > ACTIVE_STEPS, F.lit(False)), "minute": F.floor(F.col("seconds") / 60)})
    m = m.withColumns({"in_run": F.when(F.col("active"), F.col("k") - F.coalesce(F.max(F.when(~F.col("active"), F.col("k"))).over(so_far), F.lit(0)))} | _flagged("mvpa", day) | _flagged("both", day))
    m = m.withColumns(_in_chain("mvpa", so_far) | _in_chain("both", so_far))
    m = m.withColumns({"hour_steps": F.when(F.col("first"), F.coalesce(F.sum("value_steps").over(hour), F.lit(0.0))), "hour_hr": F.when(F.col("first"), F.avg("value_hr").over(hour))})
    m = m.withColumns({"low_hr": lowest(hr, KEYS), "low_hr_1121": F.when(day_part(time, "1121"), lowest(hr, (*KEYS, day_part(time, "1121"))))})

    start, end = active_window(steps, time)
    up = lambda name: (F.col("before") < F.col(f"thresh{name}")) & (F.col(f"thresh{name}") < zero)
    aggs = step_totals(steps, time) | hour_steps(F.col("hour_steps")) | {"start_window": start, "end_window": end}
    aggs |= {f"active_mins_steps_{n}": length_total(F.col("in_run"), n).cast("double") for n in RUN_LENGTHS}
    aggs |= {"active_mins_steps_0_ap": _count(F.col("active") & day_part(time, "q234"))} | variations(steps, hr, time)
    aggs |= {"resting_hr_proxy": total_of(F.avg("low_hr")), "resting_hr_1121": total_of(F.avg("low_hr_1121"))} | hour_hearts(F.col("hour_hr")) | wear_minutes(hr, time)
    aggs |= {f"thresh{name}": F.first(f"thresh{name}") for name in ("", "_low", "_high")}
    aggs |= {"mvpa_15_prev_method": _count(F.col("mvpa"))} | {f"mvpa_15_prev_method{n}": length_total(F.col("mvpa_chain"), max(2, n)).cast("double") for n in CHAINS}
    aggs |= {"mvpa_15_prev_method_ap_8_21": _count(F.col("mvpa") & (F.col("hour") >= 8) & (F.col("hour") <= 21))}
    aggs |= {f"switch_thresh{name}": _count(F.coalesce(up(name), F.lit(False))) for name in ("", "_low", "_high")}
    aggs |= {"active_mins_hr_steps_thresh": _count(F.col("both"))} | {f"active_mins_hr_steps_thresh{n}": length_total(F.col("both_chain"), max(2, n)).cast("double") for n in CHAINS}
    aggs |= {"step_norm_thresh_mvpa": F.avg(F.when(F.col("mvpa"), steps)), "step_sedentary_thresh_mvpa": F.avg(F.when(hr <= F.col("thresh"), steps))}
    out = m.groupBy(*KEYS).agg(*(c.alias(name) for name, c in aggs.items()))
    return out.withColumns(wear_percents()).withColumns(step_norms()).select(*DAILY_COLUMNS)


def _flagged(flag: str, day: WindowSpec) -> dict[str, Column]:
    """How many flagged rows there are up to a row, and the minute of the last one before it."""
    so_far, before = day.rowsBetween(Window.unboundedPreceding, 0), day.rowsBetween(Window.unboundedPreceding, -1)
    return {f"{flag}_n": F.sum(F.col(flag).cast("int")).over(so_far), f"{flag}_last": F.last(F.when(F.col(flag), F.col("minute")), ignorenulls=True).over(before)}


def _in_chain(flag: str, so_far: WindowSpec) -> dict[str, Column]:
    """On flagged rows, how many flagged minutes in a row there are up to it."""
    n, begins = F.col(f"{flag}_n"), F.col(flag) & ~F.coalesce(F.col("minute") == F.col(f"{flag}_last") + 1, F.lit(False))
    return {f"{flag}_chain": F.when(F.col(flag), n - F.max(F.when(begins, n)).over(so_far) + 1)}


def total_of(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


# The columns of the daily feature table, in its order.
DAILY_COLUMNS = """userid date step_count step_count_q2 step_count_q3 step_count_q4 step_count_q234 mean_hourly_steps_day
active_hours low_active_hours active_mins_steps_0 active_mins_steps_2 active_mins_steps_5 active_mins_steps_10
active_mins_steps_20 active_mins_steps_0_ap cov_step cov_step_q1 cov_step_q2 cov_step_q3 cov_step_q4 cov_step_q234
resting_hr_proxy resting_hr_1121 cov_hr cov_hr_q1 cov_hr_q2 cov_hr_q3 cov_hr_q4 cov_hr_q5 mins_wear_total mins_wear_623
mins_wear_1121 mins_wear_q1 mins_wear_q2 mins_wear_q3 mins_wear_q4 mins_wear_q234 wear_percent wear_percent_q1
wear_percent_q2 wear_percent_q3 wear_percent_q4 wear_percent_q234 gap_percent gap_percent_q1 gap_percent_q2
gap_percent_q3 gap_percent_q4 wear_during_sleep step_count_norm step_count_norm_q2 step_count_norm_q3 step_count_norm_q4
start_window end_window max_hourly min_hourly median_hourly thresh thresh_low thresh_high mvpa_15_prev_method
mvpa_15_prev_method2 mvpa_15_prev_method3 mvpa_15_prev_method5 mvpa_15_prev_method10 mvpa_15_prev_method20
mvpa_15_prev_method_ap_8_21 switch_thresh switch_thresh_low switch_thresh_high active_mins_hr_steps_thresh
active_mins_hr_steps_thresh2 active_mins_hr_steps_thresh3 active_mins_hr_steps_thresh5 active_mins_hr_steps_thresh10
active_mins_hr_steps_thresh20 step_norm_thresh_mvpa step_sedentary_thresh_mvpa""".split()
