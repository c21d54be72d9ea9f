"""The engine's operators on the driver tables, each with the same result in SQL where SQL can say it.

`events` stands for samples (user, time, value), the kinds view and click for steps and the others for heart rate;
`orders` and `lineitem` for treatments and their breaths; `customer` for the link table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import DAY_PARTS, auto_units, day_part, jan_week, season, seconds_between
from ..functions.stats import near, proportional_difference, variation
from ..operators import daily, enrich, heart, pressure, quality, series, treatments
from ..sources.schemas import HEART, TREATMENTS
from ..sources.tables import Store, day_ledger, read_csv, remaining
from . import day_sql, pressure_sql, steps

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: tuple[str, ...] = ()):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[name] = lambda spark, sf: _as_text(f(spark, sf))
        if sql:
            said = ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in dates)
            _SQL[name] = f"SELECT * REPLACE ({said}) FROM ({sql})" if dates else sql
        return f

    return add


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "date" else f.name for f in df.schema))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def samples(spark: SparkSession, sf: str) -> DataFrame:
    time = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("userid"), time.alias("time"), F.to_date(time).alias("date"), F.hour(time).alias("hour"), "event_type", "value")


S = "(SELECT event_id, CAST(user_id AS VARCHAR) AS userid, ts AS time, CAST(ts AS DATE) AS date, hour(ts) AS hour, event_type, value FROM events)"
STEP = "event_type IN ('view', 'click')"


def r6(column) -> F.Column:
    """Six digits as the SQL rounds: of the value times 1e6, in doubles. F.round goes by the decimal text, and gives another
    neighbour for values next to the middle of two. What becomes 0 keeps its sign."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.abs(c * 1e6) < 0.5, c * 0.0).when(F.abs(c) < 1e300, F.round(c * 1e6, 0) / 1e6).otherwise(c)


# --- aggregates over a user's day -----------------------------------------------------------------------------------
def _six(df: DataFrame) -> DataFrame:
    """Doubles with six digits, times as micros."""
    return df.select(*(r6(f.name).alias(f.name) if f.dataType.simpleString() == "double" else F.unix_micros(f.name).alias(f.name) if f.dataType.simpleString() == "timestamp" else f.name for f in df.schema))


def _aggs(found: dict) -> list:
    return [c.alias(name) for name, c in found.items()]


_IN = {p: f"hour >= {a} AND hour < {b}" for p, (a, b) in DAY_PARTS.items()}
_TOTALS = ", ".join(f"round(coalesce(sum(CASE WHEN {_IN[p]} THEN value END), 0), 6) AS step_count_{p}" for p in ("q2", "q3", "q4", "q234"))


@query("daily_total", f"SELECT userid, date, round(sum(value), 6) AS step_count, count(*) AS n, {_TOTALS} FROM {S} WHERE {STEP} GROUP BY userid, date", dates=("date",))
def daily_total(spark, sf):
    return _six(samples(spark, sf).filter(STEP).groupBy("userid", "date").agg(*_aggs(daily.step_totals(F.col("value"), F.col("time"))), F.count("*").alias("n")))


def hours(spark, sf):
    return samples(spark, sf).groupBy("userid", "date", "hour").agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))


H = f"(SELECT userid, date, hour, sum(value) AS total, avg(value) AS mean FROM {S} GROUP BY userid, date, hour)"


@query("hourly_mean", f"SELECT userid, date, round(avg(total), 6) AS mean_hourly_steps_day FROM {H} GROUP BY userid, date", dates=("date",))
def hourly_mean(spark, sf):
    return _six(hours(spark, sf).groupBy("userid", "date").agg(daily.hour_steps(F.col("total"))["mean_hourly_steps_day"].alias("mean_hourly_steps_day")))


@query("active_hours", f"SELECT userid, date, count(CASE WHEN total > 50 THEN 1 END) AS active_hours, count(CASE WHEN total > 0 AND total <= 50 THEN 1 END) AS low_active_hours FROM {H} GROUP BY userid, date", dates=("date",))
def active_hours(spark, sf):
    found = daily.hour_steps(F.col("total"), active=50)
    return hours(spark, sf).groupBy("userid", "date").agg(*(found[c].cast("long").alias(c) for c in ("active_hours", "low_active_hours")))


@query("active_window", f"SELECT userid, date, coalesce(epoch_us(min(CASE WHEN value > 5 AND (hour >= 6 OR (hour <= 6 AND value > 25)) THEN time END)), -1) AS start_window, coalesce(epoch_us(max(CASE WHEN value > 5 AND (hour >= 6 OR (hour <= 6 AND value > 25)) THEN time END)), -1) AS end_window FROM {S} GROUP BY userid, date", dates=("date",))
def active_window(spark, sf):
    start, end = daily.active_window(F.col("value"), F.col("time"))
    return samples(spark, sf).groupBy("userid", "date").agg(F.coalesce(F.unix_micros(start), F.lit(-1)).alias("start_window"), F.coalesce(F.unix_micros(end), F.lit(-1)).alias("end_window"))


def _cv_sql(c: str) -> str:
    return f"CASE WHEN avg({c}) > 0 THEN round(stddev_samp({c}) / avg({c}) * 100, 6) ELSE 0 END"


@query("quadrant_cv", "SELECT userid, " + ", ".join(f"{_cv_sql(f'CASE WHEN value > 0 AND hour >= {a} AND hour < {b} THEN value END')} AS cov_step_{p}" for p, (a, b) in DAY_PARTS.items() if p[0] == "q") + f", {_cv_sql('value')} AS cov_hr FROM {S} GROUP BY userid")
def quadrant_cv(spark, sf):
    parts = [r6(variation(F.col("value"), (F.col("value") > 0) & day_part(F.col("time"), p))).alias(f"cov_step_{p}") for p in DAY_PARTS if p[0] == "q"]
    return samples(spark, sf).groupBy("userid").agg(*parts, r6(variation(F.col("value"))).alias("cov_hr"))


_WEAR = {"": ("true", 1440), "_q1": (_IN["q1"], 360), "_q2": (_IN["q2"], 360), "_q3": (_IN["q3"], 360), "_q4": (_IN["q4"], 360), "_q234": (_IN["q234"], 1080)}
_WORN = ", ".join(f"count(CASE WHEN {c} THEN value END)::DOUBLE / {n} * 100 AS w{k}" for k, (c, n) in _WEAR.items())


@query("wear_percent", f"SELECT userid, date, {', '.join(f'round(w{k}, 6) AS wear_percent{k}' for k in _WEAR)}, {', '.join(f'round(100 - w{k}, 6) AS gap_percent{k}' for k in _WEAR if k != '_q234')}, CASE WHEN 100 - w_q1 > 25 THEN 0 ELSE 1 END::DOUBLE AS wear_during_sleep FROM (SELECT userid, date, {_WORN} FROM {S} WHERE NOT {STEP} GROUP BY userid, date)", dates=("date",))
def wear_percent(spark, sf):
    n = samples(spark, sf).filter(f"NOT {STEP}").groupBy("userid", "date").agg(*_aggs(daily.wear_minutes(F.col("value"), F.col("time"))))
    return _six(n.select("userid", "date", *_aggs(daily.wear_percents())))


_NORMS = ", ".join(f"round(coalesce(sum(CASE WHEN {STEP} AND {_IN[q]} THEN value END) / nullif(count(CASE WHEN NOT {STEP} AND {_IN[q]} THEN value END) / 360 * 100, 0), 0), 6) AS step_count_norm_{q}" for q in ("q2", "q3", "q4"))


@query("step_norm", f"SELECT userid, date, round(coalesce(sum(CASE WHEN {STEP} THEN value END) / nullif(count(CASE WHEN NOT {STEP} THEN value END), 0), 0), 6) AS step_count_norm, {_NORMS} FROM {S} GROUP BY userid, date", dates=("date",))
def step_norm(spark, sf):
    step, value, time = F.expr(STEP), F.col("value"), F.col("time")
    n = samples(spark, sf).groupBy("userid", "date").agg(*_aggs(daily.step_totals(F.when(step, value), time) | daily.wear_minutes(F.when(~step, value), time)))
    return _six(n.withColumns(daily.wear_percents()).select("userid", "date", *_aggs(daily.step_norms())))


@query("resting_proxy", f"SELECT userid, round(coalesce(avg(CASE WHEN k <= 5 THEN value END), 0), 6) AS resting_hr_proxy, round(coalesce(avg(CASE WHEN day AND kd <= 5 THEN value END), 0), 6) AS resting_hr_1121 FROM (SELECT *, hour >= 11 AND hour < 21 AS day, row_number() OVER (PARTITION BY userid ORDER BY value, event_id) AS k, row_number() OVER (PARTITION BY userid, hour >= 11 AND hour < 21 ORDER BY value, event_id) AS kd FROM {S}) GROUP BY userid")
def resting_proxy(spark, sf):
    s = samples(spark, sf)
    part = daily.resting(s, ["userid"], "value", day_part(F.col("time"), "1121"), name="resting_hr_1121")
    return _six(daily.resting(s, ["userid"], "value").join(part, "userid"))


@query("hourly_interval", f"SELECT userid, date, round(max(mean), 6) AS max_hourly, round(min(mean), 6) AS min_hourly, round(median(mean), 6) AS median_hourly FROM {H} GROUP BY userid, date", dates=("date",))
def hourly_interval(spark, sf):
    return _six(hours(spark, sf).groupBy("userid", "date").agg(*_aggs(daily.hour_hearts(F.col("mean")))))


@query("dynamic_filter", f"SELECT userid, round(coalesce(sum(CASE WHEN hour(time) >= 6 AND hour(time) < 23 AND value > 10 THEN value END), 0), 6) AS kept FROM {S} GROUP BY userid")
def dynamic_filter(spark, sf):
    kept = daily.total_where("hour(time) >= 6 AND hour(time) < 23 AND value > 10", F.col("value"))
    return samples(spark, sf).groupBy("userid").agg(r6(kept).alias("kept"))


# --- ordered series ------------------------------------------------------------------------------------------------
_RUNS = f"""(SELECT *, count(*) OVER (PARTITION BY userid, run) AS len FROM (SELECT *, sum(new) OVER (PARTITION BY userid ORDER BY time, event_id) AS run FROM (
SELECT *, CASE WHEN f = lag(f) OVER (PARTITION BY userid ORDER BY time, event_id) THEN 0 ELSE 1 END AS new FROM (SELECT *, value >= 30 AS f FROM {S}))))"""


@query("active_runs", "SELECT userid, " + ", ".join(f"count(CASE WHEN f AND len >= {n} THEN 1 END) AS active_mins_{n}" for n in daily.RUN_LENGTHS) + f" FROM {_RUNS} GROUP BY userid")
def active_runs(spark, sf):
    return series.run_totals(samples(spark, sf), ["userid"], ["time", "event_id"], F.col("value") >= 30, {f"active_mins_{n}": n for n in daily.RUN_LENGTHS})


@query("long_runs", f"SELECT event_id, run, len AS run_length FROM {_RUNS}")
def long_runs(spark, sf):
    """Runs over whole histories, which are scanned week by week."""
    s = samples(spark, sf).withColumn("week", F.date_trunc("week", "time"))
    return series.with_long_runs(s, ["userid"], "week", ["time", "event_id"], F.col("value") >= 30).select("event_id", "run", "run_length")


@query("long_lookback", f"""SELECT event_id, coalesce((epoch_us(time) - last_value(CASE WHEN {STEP} AND value > 40 THEN epoch_us(time) END IGNORE NULLS) OVER w) / 1000000 <= 21600, false) AS any_active, coalesce(lag(value) OVER (PARTITION BY userid ORDER BY time, event_id) < 35 AND 35 < value, false) AS up FROM {S} WINDOW w AS (PARTITION BY userid ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def long_lookback(spark, sf):
    """Look-backs and up-crossings over whole histories, which are scanned day by day."""
    s = samples(spark, sf)
    seconds = F.unix_micros("time") / 1_000_000
    s = series.with_long_lookback(s, ["userid"], "date", ["time", "event_id"], F.expr(STEP) & (F.col("value") > 40), seconds, 21600)
    s = series.with_long_upcrossings(s, ["userid"], "date", ["time", "event_id"], F.col("value"), F.lit(35.0))
    return s.select("event_id", "any_active", F.coalesce("up", F.lit(False)).alias("up"))


@query("chain_runs", f"""SELECT userid, {", ".join(f"count(CASE WHEN len >= {max(2, n)} THEN 1 END) AS chain_{n}" for n in daily.CHAINS)} FROM (SELECT userid, count(*) OVER (PARTITION BY userid, g) AS len FROM (
SELECT userid, p - row_number() OVER (PARTITION BY userid ORDER BY p) AS g FROM (SELECT userid, epoch_us(time) // 3600000000 AS p FROM {S} WHERE value > 10 GROUP BY ALL))) GROUP BY userid""")
def chain_runs(spark, sf):
    h = samples(spark, sf).filter("value > 10").select("userid", F.floor(F.unix_seconds("time") / 3600).alias("p")).distinct()
    rows = series.with_chains(h, ["userid"], ["p"], F.lit(True), F.col("p"))
    return rows.groupBy("userid").agg(*(series.chain_total(F.lit(True), F.col("chain_length"), n).alias(f"chain_{n}") for n in daily.CHAINS))


@query("lookback_activity", f"""SELECT event_id, coalesce(max(CASE WHEN {STEP} THEN value END) OVER (PARTITION BY userid ORDER BY epoch_us(time) // 1000000 RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) > 40, false) AS any_steps FROM {S}""")
def lookback_activity(spark, sf):
    s = samples(spark, sf).withColumn("v", F.when(F.expr(STEP), F.col("value") - 40))
    return s.select("event_id", series.any_within(F.col("v"), ["userid"], F.unix_seconds("time"), 21600).alias("any_steps"))


@query("upcrossings", f"SELECT userid, count(CASE WHEN p < 35 AND 35 < value THEN 1 END) AS switch_thresh FROM (SELECT *, lag(value) OVER (PARTITION BY userid ORDER BY time, event_id) AS p FROM {S}) GROUP BY userid")
def upcrossings(spark, sf):
    up = series.upcrossing(F.col("value"), F.lit(35.0), ["userid"], ["time", "event_id"])
    return samples(spark, sf).withColumn("up", up).groupBy("userid").agg(F.count(F.when(F.col("up"), 1)).alias("switch_thresh"))


def sessions(spark, sf):
    s = samples(spark, sf)
    return s.select(F.col("userid").alias("patient_id"), F.concat_ws("-", "userid", F.floor(F.unix_seconds("time") / 7200).cast("string")).alias("session_id"), "time", F.col("value").alias("pressure_detrend"), "event_id")


_SESS = f"(SELECT userid AS patient_id, userid || '-' || CAST(epoch_us(time) // 7200000000 AS VARCHAR) AS session_id, time, value AS pressure_detrend, event_id FROM {S})"
_SPANS = f"(SELECT patient_id, session_id, min(time) AS session_start, max(time) AS session_end, CAST(min(time) AS DATE) AS date FROM {_SESS} GROUP BY patient_id, session_id)"
_GROUPS = f"""(SELECT patient_id, session_id, session_start, session_end, date, last_value(head IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY session_start, session_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS treatment_id FROM (
SELECT *, CASE WHEN coalesce(epoch_us(session_start) - epoch_us(lag(session_end) OVER (PARTITION BY patient_id ORDER BY session_start, session_id)) >= 36000000000, true) THEN session_id END AS head FROM {_SPANS}))"""


@query("session_meta", f"SELECT patient_id, session_id, epoch_us(session_start) AS session_start, epoch_us(session_end) AS session_end, date FROM {_SPANS}", dates=("date",))
def session_meta(spark, sf):
    return treatments.session_spans(sessions(spark, sf)).select("patient_id", "session_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "date")


@query("treatment_groups", f"SELECT patient_id, session_id, treatment_id FROM {_GROUPS}")
def treatment_groups(spark, sf):
    return series.sessionise(treatments.session_spans(sessions(spark, sf)), ["patient_id"], "session_start", "session_end", "session_id", 36000).select("patient_id", "session_id", "treatment_id")


@query("treatment_spans", f"SELECT patient_id, treatment_id, epoch_us(min(time)) AS treatment_start, epoch_us(max(time)) AS treatment_end FROM {_SESS} JOIN (SELECT session_id, treatment_id FROM {_GROUPS}) USING (session_id) GROUP BY ALL")
def treatment_spans(spark, sf):
    s = sessions(spark, sf)
    groups = series.sessionise(treatments.session_spans(s), ["patient_id"], "session_start", "session_end", "session_id", 36000)
    out = treatments.treatment_spans(s.join(groups.select("session_id", "treatment_id"), "session_id"))
    return out.select("patient_id", "treatment_id", F.unix_micros("treatment_start").alias("treatment_start"), F.unix_micros("treatment_end").alias("treatment_end"))


_BLOCKS = f"""(SELECT *, CASE WHEN n < 6 THEN 0 ELSE greatest((coalesce(other, n + 1) - 1) // 3 - 1, 0) END AS lev FROM (SELECT *, min(CASE WHEN p <> f THEN i END) OVER (PARTITION BY userid) AS other FROM (
SELECT *, min(CASE WHEN i = 1 + (i - 1) % 3 THEN p END) OVER (PARTITION BY userid, (i - 1) % 3) AS f FROM (SELECT *, row_number() OVER (PARTITION BY userid ORDER BY time, p) AS i, count(*) OVER (PARTITION BY userid) AS n FROM (SELECT userid, time, event_id, CASE WHEN value < 250 THEN 1.0::DOUBLE ELSE value END AS p FROM {S})))))"""


def blocky(spark, sf):
    return samples(spark, sf).select("userid", "time", "event_id", F.when(F.col("value") < 250, 1.0).otherwise(F.col("value")).alias("pressure"))


@query("dedup_blocks", f"SELECT event_id FROM {_BLOCKS} WHERE (i - 1) % ((lev + 1) * 3) < 3 OR i > n // ((lev + 1) * 3) * ((lev + 1) * 3)")
def dedup_blocks(spark, sf):
    return pressure.drop_resent_blocks(blocky(spark, sf), "userid", "pressure", 3).select("event_id")


@query("even_times", f"SELECT event_id, epoch_us(min(time) OVER (PARTITION BY userid)) + (row_number() OVER (PARTITION BY userid ORDER BY time, value, event_id) - 1) * 100000 AS time FROM {S}")
def even_times(spark, sf):
    return pressure.even_times(samples(spark, sf), "userid", "value", tie=["event_id"]).select("event_id", F.unix_micros("time").alias("time"))


# --- heart-rate cleaning -------------------------------------------------------------------------------------------
def _rule(value: str):
    return lambda spark, sf: samples(spark, sf).select("event_id", "userid", "time", F.expr(value).cast("double").alias("value"))


def _numbered(value: str) -> str:
    return f"(SELECT event_id, userid, time, value, row_number() OVER (PARTITION BY userid ORDER BY time, value) AS i, count(*) OVER (PARTITION BY userid) AS n FROM (SELECT event_id, userid, time, CAST({value} AS DOUBLE) AS value FROM {S}))"


_DEFAULT = "CASE WHEN value < 40 THEN 70 ELSE value END"


@query("edge_constant", f"""SELECT event_id FROM (SELECT *, sum(d::INT) OVER (PARTITION BY userid) AS l, coalesce(min(CASE WHEN NOT d THEN i END) OVER (PARTITION BY userid) - 1, n) AS m, bool_or(i = n AND d) OVER (PARTITION BY userid) AS e FROM (SELECT *, value = 70 AS d FROM {_numbered(_DEFAULT)}))
WHERE NOT (l >= 2 AND (i <= least(m, l - 1) OR (d AND e AND (i = n OR (i = n - 1 AND l >= 3)))))""")
def edge_constant(spark, sf):
    return heart.drop_default_edges(_rule(_DEFAULT)(spark, sf), ["userid"]).select("event_id")


_COARSE = "floor(value / 60)"


@query("rep_runs", f"""SELECT event_id FROM (SELECT *, count(*) OVER (PARTITION BY userid, mid, run) AS len FROM (SELECT *, sum(new) OVER (PARTITION BY userid, mid ORDER BY i) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY userid, mid ORDER BY i) THEN 0 ELSE 1 END AS new FROM (SELECT *, i > 1 AND i < n AS mid FROM {_numbered(_COARSE)})))) WHERE NOT (mid AND len > 4)""")
def rep_runs(spark, sf):
    return heart.drop_repeats(_rule(_COARSE)(spark, sf), ["userid"], 4).select("event_id")


@query("jump_islands", f"""SELECT event_id FROM (SELECT *, last_value(jump IGNORE NULLS) OVER (PARTITION BY userid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(jump.k IGNORE NULLS) OVER (PARTITION BY userid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM (
SELECT *, CASE WHEN (value > 0 AND abs(nx - value) * 100 / value >= 15) OR (value = 0 AND nx <> 0) THEN {{'k': i, 'v': nx, 't': st}} END AS jump FROM (SELECT *, lead(value) OVER (PARTITION BY userid ORDER BY i) AS nx, epoch_us(lead(time) OVER (PARTITION BY userid ORDER BY i)) - epoch_us(time) AS st FROM {_numbered("value")})))
WHERE NOT coalesce(b - a.k <= 5 AND a.v < 100 AND a.t < 40000000000, false)""")
def jump_islands(spark, sf):
    return heart.drop_jump_islands(_rule("value")(spark, sf), ["userid"], seconds=40000.0).select("event_id")


@query("gap_islands", f"""SELECT event_id FROM (SELECT *, greatest(1, coalesce(last_value(gap IGNORE NULLS) OVER (PARTITION BY userid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS a, least(coalesce(first_value(gap IGNORE NULLS) OVER (PARTITION BY userid ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n - 1), n - 1) AS b,
count(gap) OVER (PARTITION BY userid) AS g, min(gap) OVER (PARTITION BY userid) AS g1, max(gap) OVER (PARTITION BY userid) AS g2 FROM (SELECT *, CASE WHEN epoch_us(lead(time) OVER (PARTITION BY userid ORDER BY i)) - epoch_us(time) >= 36000000000 THEN i END AS gap FROM {_numbered("value")}))
WHERE NOT (g > 0 AND ((i > 1 AND i < n AND b - a <= 2) OR (g1 = 1 AND i <= 2) OR (g2 = n - 1 AND i >= n - 1)))""")
def gap_islands(spark, sf):
    return heart.drop_gap_islands(_rule("value")(spark, sf), ["userid"], 36000, 2).select("event_id")


@query("drop_indexes", f"SELECT event_id FROM (SELECT event_id, userid, row_number() OVER (PARTITION BY userid ORDER BY time, value, event_id) AS i FROM {S}) WHERE NOT (i <= CAST(userid AS INT) % 9 OR i = 20)")
def drop_indexes(spark, sf):
    s = samples(spark, sf).select("event_id", "userid", "time", F.struct("value", "event_id").alias("value"))
    users = s.select("userid").distinct()
    gone = users.select("userid", F.explode(F.concat(F.sequence(F.lit(0), F.col("userid").cast("int") % 9), F.array(F.lit(20)))).alias("i"))
    return heart.drop_indexes(s, gone, ["userid"]).select("event_id")


@query("clean_heart", f"SELECT userid, epoch_us(time) AS time, value FROM {day_sql.clean(f'(SELECT userid, date, time, value FROM {S} WHERE NOT {STEP})')}")
def clean_heart(spark, sf):
    return steps.clean_days(samples(spark, sf).filter(f"NOT {STEP}").select("userid", "time", "value")).withColumn("time", F.unix_micros("time"))


#: All events in some days of two users, one every ten seconds.
_DENSE = "(SELECT CAST(user_id % 2 + 1 AS VARCHAR) AS userid, TIMESTAMP '2024-01-01' + to_seconds(event_id * 10) AS time, CAST(TIMESTAMP '2024-01-01' + to_seconds(event_id * 10) AS DATE) AS date, CASE WHEN value < 4 THEN 70.0 WHEN value < 30 THEN 80.0 ELSE value END::DOUBLE AS value, event_type FROM events)"


def dense(spark, sf):
    time = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + F.col("event_id") * 10)
    value = F.when(F.col("value") < 4, 70.0).when(F.col("value") < 30, 80.0).otherwise(F.col("value"))
    return table(spark, sf, "events").select((F.col("user_id") % 2 + 1).cast("string").alias("userid"), time.alias("time"), value.alias("value"), "event_type")


@query("clean_dense_days", f"SELECT userid, epoch_us(time) AS time, value FROM {day_sql.clean(_DENSE)}")
def clean_dense_days(spark, sf):
    """Days of some hundred samples, of which many have the sensor's default or repeat."""
    return steps.clean_days(dense(spark, sf).drop("event_type")).withColumn("time", F.unix_micros("time"))


# --- minutes and daily features ------------------------------------------------------------------------------------
def _steps(spark, sf):
    return samples(spark, sf).filter(STEP).select("userid", "time", "value")


def _heart(spark, sf):
    return samples(spark, sf).filter(f"NOT {STEP}").select("userid", "time", "value")


@query("combine_streams", f"""SELECT userid, epoch_us(time) AS time, round(value_steps, 6) AS value_steps, round(value_hr, 6) AS value_hr FROM (SELECT DISTINCT userid, date_trunc('minute', time) AS time, value AS value_steps, time AS t FROM {S} WHERE {STEP})
FULL JOIN (SELECT userid, date_trunc('minute', time) AS time, avg(value) AS value_hr FROM (SELECT DISTINCT userid, time, value FROM {S} WHERE NOT {STEP}) GROUP BY ALL) USING (userid, time)""")
def combine_streams(spark, sf):
    return daily.combine_minutes(_steps(spark, sf), _heart(spark, sf)).select("userid", F.unix_micros("time").alias("time"), r6("value_steps").alias("value_steps"), r6("value_hr").alias("value_hr"))


def _thresholds(spark, sf):
    """By user and week. Means are summed in the order of the rows, so that their last digit, by which a value may be above
    them or not, does not depend on how the table is cut into tasks."""
    keys = ["userid", "date"]
    s = samples(spark, sf).select("userid", F.date_trunc("week", "time").cast("date").alias("date"), "time", "event_id", "value")
    so_far = Window.partitionBy(*keys).orderBy("time", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    means = s.withColumn("mean", F.avg("value").over(so_far)).groupBy(*keys)
    return means.agg(F.max_by("mean", F.struct("time", "event_id")).alias("thresh14"), F.min("value").alias("thresh14_low"), F.max("value").alias("thresh14_high"))


_STEPS, _HEART = (f"(SELECT userid, time, value FROM {S} WHERE {k} {STEP})" for k in ("", "NOT"))
_THRESHOLDS = f"(SELECT userid, CAST(date_trunc('week', time) AS DATE) AS date, avg(value) AS thresh, min(value) AS low, max(value) AS high FROM {S} GROUP BY ALL)"


@query("daily_features", day_sql.features(day_sql.minutes(_STEPS, _HEART), _THRESHOLDS), dates=("date",))
def daily_features(spark, sf):
    return _six(_all_days(spark, sf))


def _all_days(spark, sf):
    minutes = daily.combine_minutes(_steps(spark, sf), _heart(spark, sf), keep_date=True)
    return daily.daily_features(minutes, _thresholds(spark, sf), samples(spark, sf).select("userid", "date"))


_ALL_DAY = "(SELECT CAST(CAST(userid AS INT) % 7 AS VARCHAR) AS userid, CAST(DATE '2024-01-01' AS TIMESTAMP) + to_microseconds(epoch_us(time) % 86400000000) AS time, {0} AS value FROM {1})"


def _fixed_thresholds(spark):
    k = F.col("id")
    return spark.range(6).select(k.cast("string").alias("userid"), F.lit("2024-01-03").cast("date").alias("date"), (60.0 + k).alias("thresh14"), F.lit(40.0).alias("thresh14_low"), F.lit(110.0).alias("thresh14_high"))


def _folded(df: DataFrame, value) -> DataFrame:
    day = F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.unix_micros("time") % 86_400_000_000)
    return df.select((F.col("userid").cast("int") % 7).cast("string").alias("userid"), day.alias("time"), value.alias("value"))


@query("daily_features_dense", day_sql.features(day_sql.minutes(_ALL_DAY.format("value * 3", _STEPS), _ALL_DAY.format("value + 30", _HEART)), "(SELECT CAST(k AS VARCHAR) AS userid, DATE '2024-01-03' AS date, 60.0 + k AS thresh, 40.0 AS low, 110.0 AS high FROM range(0, 6) t(k))"), dates=("date",))
def daily_features_dense(spark, sf):
    """All samples in one day of seven users, so that runs, chains and hours are long; one user has no thresholds."""
    minutes = daily.combine_minutes(_folded(_steps(spark, sf), F.col("value") * 3), _folded(_heart(spark, sf), F.col("value") + 30))
    return _six(daily.daily_features(minutes, _fixed_thresholds(spark)))


#: After every day that a table's event ids can come to here; whole weeks from the first Monday that is asked for.
_EVER = steps.weeks_from("2023-12-25", 416_000)

#: All events in many days of three users: 150 a day, one every 10 seconds.
_DAILY = "(SELECT CAST(event_id // 150 % 3 + 1 AS VARCHAR) AS userid, TIMESTAMP '2024-01-01' + to_days(CAST(event_id // 150 AS INT)) + to_seconds(event_id % 150 * 10) AS time, CAST(TIMESTAMP '2024-01-01' + to_days(CAST(event_id // 150 AS INT)) AS DATE) AS date, CASE WHEN value < 2 THEN 70.0 WHEN value < 30 THEN 80.0 ELSE 80 + floor(value) / 8 END::DOUBLE AS value, event_type FROM events)"


def many_days(spark, sf):
    day, e = F.floor(F.col("event_id") / 150), F.col("event_id")
    time = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + day * 86_400 + e % 150 * 10)
    value = F.when(F.col("value") < 2, 70.0).when(F.col("value") < 30, 80.0).otherwise(80 + F.floor("value").cast("double") / 8)
    return table(spark, sf, "events").select((day % 3 + 1).cast("int").cast("string").alias("userid"), time.alias("time"), value.alias("value"), "event_type")


_SETTLED = f"(SELECT userid, time, value, date FROM (SELECT *, max(date) OVER (PARTITION BY userid) AS latest FROM {_DAILY} WHERE NOT {STEP}) WHERE date < latest)"
_CLEANED = "(SELECT userid, date, time, value FROM cleaned)"
_WORTH = f"""(SELECT userid, date FROM (SELECT userid, date FROM {_DAILY} WHERE {STEP} GROUP BY ALL HAVING count(*) > 1) JOIN (SELECT userid, date FROM {_CLEANED} GROUP BY ALL HAVING count(*) > 1 AND min(value) > 0) USING (userid, date)
JOIN (SELECT CAST(c_custkey AS VARCHAR) AS userid, DATE '2023-11-01' + CAST(c_custkey % 60 AS INT) AS rec FROM customer) USING (userid) WHERE date >= rec)"""
_OF = "(SELECT x.userid, x.time, x.value FROM {0} x JOIN worth w ON w.userid = x.userid AND w.date = x.date)"
_SET = "(SELECT CAST(k AS VARCHAR) AS userid, DATE '2024-01-03' AS date, 60.0 + k AS thresh, 40.0 AS low, 110.0 AS high FROM range(0, 6) t(k))"


def _own_store(spark) -> Store:
    """Tables of a query's own, in the warehouse."""
    return Store(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/own-{uuid.uuid4().hex}")


@query("days_by_steps", f"WITH cleaned AS MATERIALIZED (SELECT * FROM {day_sql.clean(_SETTLED)}), worth AS MATERIALIZED (SELECT * FROM {_WORTH}) SELECT * FROM ({day_sql.features(day_sql.minutes(_OF.format(f'(SELECT * FROM {_DAILY} WHERE {STEP})'), _OF.format(_CLEANED)), _SET)})", dates=("date",))
def days_by_steps(spark, sf):
    """Raw samples to daily features through the incremental steps, in two deliveries and two calls of each, in tables of their own."""
    store = _own_store(spark)
    rows = many_days(spark, sf)
    for k, end in enumerate(("2024-01-17", _EVER)):  # the first delivery's last day of each user is withheld
        start, later = "2024-01-01", F.col("time") >= "2024-01-20"
        some = rows.filter(later if k else ~later)
        steps.ingest(store, some.filter(f"NOT {STEP}").drop("event_type"), "heart", f"delivery{k}")
        steps.ingest(store, some.filter(STEP).drop("event_type"), "steps", f"delivery{k}")
        steps.clean_days_step(store, "heart", "clean", "clean_ledger", start, end)
        steps.featurise_days_step(store, "steps", "clean", "daily", "daily_ledger", _fixed_thresholds(spark), link(spark, sf), start, end)
    return _six(store.read("daily"))


_MINUTES = f"""(SELECT userid, time, CAST(time AS DATE) AS date, s, h FROM (SELECT DISTINCT userid, date_trunc('minute', time) AS time, value AS s, time AS t FROM {S} WHERE {STEP})
FULL JOIN (SELECT userid, date_trunc('minute', time) AS time, avg(value) AS h FROM (SELECT DISTINCT userid, time, value FROM {S} WHERE NOT {STEP}) GROUP BY ALL) USING (userid, time))"""
_NEAREST = f"""(SELECT * FROM (SELECT d.userid, d.date, t.thresh, t.low, row_number() OVER (PARTITION BY d.userid, d.date ORDER BY abs(date_diff('day', t.date, d.date)), t.date) AS r FROM (SELECT DISTINCT userid, date FROM {S}) d
LEFT JOIN (SELECT userid, CAST(date_trunc('week', time) AS DATE) AS date, avg(value) AS thresh, min(value) AS low FROM {S} GROUP BY ALL) t ON d.userid = t.userid) WHERE r = 1)"""


@query("daily_mvpa", f"""SELECT userid, date, count(CASE WHEN mvpa THEN 1 END) AS mvpa_15_prev_method, count(CASE WHEN mvpa AND hour(time) BETWEEN 8 AND 21 THEN 1 END) AS mvpa_15_prev_method_ap_8_21, count(CASE WHEN up THEN 1 END) AS switch_thresh, count(CASE WHEN up_low THEN 1 END) AS switch_thresh_low,
count(CASE WHEN mvpa AND s > 70 THEN 1 END) AS active_mins_hr_steps_thresh, count(CASE WHEN coalesce(s, 0) >= 70 THEN 1 END) AS active_mins_steps_0, round(any_value(thresh), 6) AS thresh, round(avg(CASE WHEN mvpa THEN s END), 6) AS step_norm_thresh_mvpa, round(avg(CASE WHEN h <= thresh THEN s END), 6) AS step_sedentary_thresh_mvpa,
count(h) AS mins_wear_total, round(coalesce(CASE WHEN count(h) <> 0 THEN coalesce(sum(s), 0) / count(h) END, 0), 6) AS step_count_norm FROM (
SELECT *, coalesce(h > thresh, false) AND coalesce(max(s) OVER (PARTITION BY userid, date ORDER BY epoch_us(time) // 1000000 RANGE BETWEEN 900 PRECEDING AND CURRENT ROW) > 0, false) AS mvpa,
lag(coalesce(h, 0)) OVER w < thresh AND thresh < coalesce(h, 0) AS up, lag(coalesce(h, 0)) OVER w < low AND low < coalesce(h, 0) AS up_low FROM {_MINUTES} JOIN {_NEAREST} USING (userid, date) WINDOW w AS (PARTITION BY userid, date ORDER BY time)) GROUP BY userid, date""", dates=("date",))
def daily_mvpa(spark, sf):
    out = _all_days(spark, sf)
    whole = ["mvpa_15_prev_method", "mvpa_15_prev_method_ap_8_21", "switch_thresh", "switch_thresh_low", "active_mins_hr_steps_thresh", "active_mins_steps_0", "mins_wear_total"]
    return out.select("userid", "date", *(F.col(c).cast("long").alias(c) for c in whole), *(r6(c).alias(c) for c in ("thresh", "step_norm_thresh_mvpa", "step_sedentary_thresh_mvpa", "step_count_norm")))


@query("worth_featurising", f"SELECT userid, date FROM (SELECT userid, date FROM {S} WHERE {STEP} GROUP BY ALL HAVING count(*) > 1) JOIN (SELECT userid, date FROM {S} WHERE NOT {STEP} GROUP BY ALL HAVING count(*) > 1 AND min(value) > 0) USING (userid, date)", dates=("date",))
def worth_featurising(spark, sf):
    return daily.worth_featurising(_steps(spark, sf), _heart(spark, sf))


@query("nearest_threshold", f"""SELECT userid, date, round(thresh14, 6) AS thresh14 FROM (SELECT d.userid, d.date, t.thresh14, row_number() OVER (PARTITION BY d.userid, d.date ORDER BY abs(date_diff('day', t.date, d.date)), t.date) AS r FROM (SELECT DISTINCT userid, date FROM {S}) d
LEFT JOIN (SELECT userid, CAST(date_trunc('week', time) AS DATE) AS date, avg(value) AS thresh14 FROM {S} GROUP BY ALL) t ON d.userid = t.userid) WHERE r = 1""", dates=("date",))
def nearest_threshold(spark, sf):
    days = samples(spark, sf).select("userid", "date").distinct()
    return series.nearest_date(days, _thresholds(spark, sf), "userid", "date", "date", ["thresh14"]).select("userid", "date", r6("thresh14").alias("thresh14"))


# --- treatments ----------------------------------------------------------------------------------------------------
def peaked(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("treatment_id").orderBy("time")
    s = samples(spark, sf).select(F.col("userid").alias("patient_id"), F.concat_ws("-", "userid", F.date_format("date", "yyyyMM")).alias("treatment_id"), "time", "event_id", F.col("value").alias("pressure_detrend"))
    v = F.col("pressure_detrend")
    return s.withColumn("prominent_peak", F.coalesce((v > 60) & (v > F.lag(v).over(w)) & (v > F.lead(v).over(w)), F.lit(False)))


_PEAKED = f"""(SELECT *, coalesce(v > 60 AND v > lag(v) OVER w AND v > lead(v) OVER w, false) AS peak, row_number() OVER w AS i, count(*) OVER (PARTITION BY treatment_id) AS n FROM (SELECT userid AS patient_id, userid || '-' || strftime(date, '%Y%m') AS treatment_id, time, event_id, value AS v FROM {S}) WINDOW w AS (PARTITION BY treatment_id ORDER BY time))"""
_EDGES = f"""(SELECT *, coalesce(last_value(CASE WHEN v <= 20 THEN i END IGNORE NULLS) OVER (PARTITION BY treatment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS l, coalesce(first_value(CASE WHEN v <= 20 THEN i END IGNORE NULLS) OVER (PARTITION BY treatment_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS r, sum(peak::INT) OVER (PARTITION BY treatment_id ORDER BY i) AS k FROM {_PEAKED})"""
_LABELLED = f"""(SELECT patient_id, treatment_id, time, event_id, v, CASE WHEN kk > 0 AND i <= rr THEN kk ELSE 0 END::DOUBLE AS breath_id, CASE WHEN kk = 0 THEN 1 WHEN i <= rr AND NOT (i = n AND rr = n) THEN 0 ELSE kk + 1 END::DOUBLE AS break_id FROM (
SELECT *, coalesce(b.k, 0) AS kk, coalesce(b.r, 0) AS rr FROM (SELECT e.*, last_value(s.b IGNORE NULLS) OVER (PARTITION BY e.treatment_id ORDER BY e.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM {_EDGES} e LEFT JOIN (SELECT treatment_id, l, max({{'k': k, 'r': r}}) AS b FROM {_EDGES} WHERE peak GROUP BY ALL) s ON s.treatment_id = e.treatment_id AND s.l = e.i)))"""


def labelled(spark, sf):
    rows = pressure.with_breaths(peaked(spark, sf), ["treatment_id"], edge=20.0).withColumn("set_id", F.lit(0.0))
    return treatments.with_counts(rows)


@query("breath_labels", f"SELECT event_id, breath_id, break_id FROM {_LABELLED}")
def breath_labels(spark, sf):
    return labelled(spark, sf).select("event_id", "breath_id", "break_id")


_BREATHS = f"(SELECT treatment_id, breath_id, max(v) AS a, avg(v) AS m, (epoch_us(max(time)) - epoch_us(min(time))) / 1000000 AS d, list(v ORDER BY time) AS vs FROM {_LABELLED} WHERE breath_id > 0 GROUP BY ALL)"
_FOUR = lambda c, n: ", ".join(f"round({f}({c}), 6) AS {k}_{n}" for k, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("sd", "stddev_samp")))


_SHARES = {"pressure": "a > 10 AND a < 20 OR m > 10 AND m < 20", "peak_pressure": "a > 10 AND a < 20", "breath_1s": "d >= 1", "breath_2s": "d >= 2", "breath_3s": "d >= 3", "pressure_duration": "d >= 2 AND d < 6 AND a > 10 AND a < 20"}


@query("breath_features", f"SELECT treatment_id, {_FOUR('a', 'breath_amplitude')}, {_FOUR('d', 'breath_duration').replace(', 6)', ', 3)')}, round(avg((vs[(len(vs) + 1) // 2] + vs[len(vs) // 2 + 1]) / 2), 6) AS mean_breath_amplitude_middle, {', '.join(f"round(avg(({c})::INT), 6) AS {n}_treatment_adherence_score" for n, c in _SHARES.items())} FROM {_BREATHS} GROUP BY treatment_id")
def breath_features(spark, sf):
    out = treatments.breath_features(treatments.breath_measures(labelled(spark, sf)), extra=True)
    names = [f"{k}_{n}" for n in ("breath_amplitude", "breath_duration") for k in ("mean", "min", "max", "sd")] + ["mean_breath_amplitude_middle", *(f"{n}_treatment_adherence_score" for n in _SHARES)]
    return out.select("treatment_id", *(F.round(c, 3 if "duration" in c else 6).alias(c) for c in names))


@query("break_features", f"SELECT treatment_id, {_FOUR('d', 'break_duration').replace(', 6)', ', 3)')} FROM (SELECT treatment_id, break_id, (epoch_us(max(time)) - epoch_us(min(time))) / 1000000 AS d FROM {_LABELLED} WHERE break_id > 0 GROUP BY ALL) GROUP BY treatment_id")
def break_features(spark, sf):
    out = treatments.break_features(treatments.break_durations(labelled(spark, sf)))
    return out.select("treatment_id", *(F.round(f"{k}_break_duration", 3).alias(f"{k}_break_duration") for k in ("mean", "min", "max", "sd")))


@query("treatment_features", f"""SELECT treatment_id, act_date, treatment_length, seconds_above10, round(seconds_above10 * 10 / n * 100, 6) AS percentage_above10, round(ptb, 6) AS percent_time_breathing, breath_count, break_count, pressures_daily_count, CASE WHEN pressures_daily_count > 150 THEN 1 ELSE 0 END::DOUBLE AS pressures_completeness_score FROM (SELECT *, sum(n) OVER (PARTITION BY patient_id, act_date)::DOUBLE AS pressures_daily_count FROM (
SELECT patient_id, treatment_id, CAST(min(time) AS DATE) AS act_date, floor((epoch_us(max(time)) - epoch_us(min(time))) / 1000000)::DOUBLE AS treatment_length, count(CASE WHEN breath_id <> 0 AND v >= 10 THEN 1 END) / 10 AS seconds_above10, count(*) AS n, avg((breath_id > 0)::INT) AS ptb, count(DISTINCT CASE WHEN breath_id <> 0 THEN breath_id END)::DOUBLE AS breath_count, count(DISTINCT CASE WHEN break_id <> 0 THEN break_id END)::DOUBLE AS break_count FROM {_LABELLED} GROUP BY ALL))""", dates=("act_date",))
def treatment_features(spark, sf):
    out = treatments.treatment_features(labelled(spark, sf))
    return out.select("treatment_id", "act_date", "treatment_length", "seconds_above10", r6("percentage_above10").alias("percentage_above10"), r6("percent_time_breathing").alias("percent_time_breathing"), "breath_count", "break_count", "pressures_daily_count", "pressures_completeness_score")


_BLIND = {"pressure": "l_discount", "peak_pressure": "l_tax", "pressure_duration": "l_quantity"}


def orders_as_treatments(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("double").alias("breath_count"), F.avg("l_quantity").alias("mean_breath_amplitude"), F.count_distinct("l_returnflag").cast("double").alias("set_count"), *(F.avg(c).alias(f"{k}_treatment_adherence_score") for k, c in _BLIND.items()))
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderkey").alias("treatment_id"), F.to_date("o_orderdate").alias("act_date"), F.col("o_orderdate").cast("timestamp").alias("treatment_start"), F.col("o_orderkey").alias("__k"))
    return o.join(lines, F.col("__k") == F.col("l_orderkey")).drop("__k", "l_orderkey").withColumn("pressures_completeness_score", F.lit(1.0))


def devices(spark, sf):
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("patient_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") % 3).alias("treatments_per_day"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_custkey") % 5).alias("number_of_sets"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_custkey") % 7).alias("breaths_per_set"))


_TREAT = "(SELECT CAST(o_custkey AS VARCHAR) AS patient_id, o_orderkey AS treatment_id, CAST(o_orderdate AS DATE) AS act_date, year(o_orderdate) AS year, (dayofyear(o_orderdate) - 1) // 7 + 1 AS week, n AS breath_count, amp, sets, pressure, peak_pressure, pressure_duration FROM orders JOIN (SELECT l_orderkey, count(*)::DOUBLE AS n, avg(l_quantity) AS amp, count(DISTINCT l_returnflag)::DOUBLE AS sets, avg(l_discount) AS pressure, avg(l_tax) AS peak_pressure, avg(l_quantity) AS pressure_duration FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"
_DEV = "(SELECT CAST(c_custkey AS VARCHAR) AS patient_id, coalesce(CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END, 2)::DOUBLE AS d, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_custkey % 5 END, 10)::DOUBLE AS s, coalesce(CASE WHEN c_custkey % 7 > 0 THEN c_custkey % 7 END, 10)::DOUBLE AS b FROM customer)"


@query("adherence_day_week", f"""SELECT treatment_id, round(tday / d, 6) AS treatment_day_adherence_score, round(bday / d / s / b, 6) AS breaths_day_adherence_score, round(tweek / d / 7, 6) AS treatment_week_adherence_score, round(bweek / d / s / b / 7, 6) AS breaths_week_adherence_score, round(breath_count / (s * b), 6) AS breaths_treatment_adherence_score, round(sets / s, 6) AS sets_treatment_adherence_score, round(sday / (s * d), 6) AS sets_day_adherence_score, round(p1, 6) AS pressure_day_adherence_score, round(p2, 6) AS peak_pressure_day_adherence_score, round(p3, 6) AS pressure_duration_day_adherence_score FROM (
SELECT *, sum(sets) OVER (PARTITION BY patient_id, act_date) AS sday, avg(pressure) OVER (PARTITION BY patient_id, act_date) AS p1, avg(peak_pressure) OVER (PARTITION BY patient_id, act_date) AS p2, avg(pressure_duration) OVER (PARTITION BY patient_id, act_date) AS p3, sum(breath_count) OVER (PARTITION BY patient_id, act_date) AS bday, count(*) OVER (PARTITION BY patient_id, act_date) AS tday, sum(breath_count) OVER (PARTITION BY patient_id, year, week) AS bweek, count(*) OVER (PARTITION BY patient_id, year, week) AS tweek FROM {_TREAT}) JOIN {_DEV} USING (patient_id)""")
def adherence_day_week(spark, sf):
    out = treatments.adherence(orders_as_treatments(spark, sf), devices(spark, sf), extra=True)
    names = [f"{a}_{b}_adherence_score" for b in ("day", "week") for a in ("treatment", "breaths")] + ["breaths_treatment_adherence_score", "sets_treatment_adherence_score", "sets_day_adherence_score", *(f"{k}_day_adherence_score" for k in _BLIND)]
    return out.select("treatment_id", *(r6(c).alias(c) for c in names))


@query("prescriptions", f"SELECT patient_id, d AS prescr_treatments_day, s AS prescr_n_sets, b AS prescr_n_breaths FROM {_DEV}")
def prescriptions(spark, sf):
    return treatments.prescriptions(devices(spark, sf))


_FLAT = f"(SELECT userid, time, event_id, floor(value / 4)::DOUBLE AS value FROM {S})"
_RUNS_OF = f"""(SELECT userid, value, min(i) AS a, max(i) AS b, max(n) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY userid, value ORDER BY i) AS g FROM (SELECT userid, event_id, value, row_number() OVER (PARTITION BY userid ORDER BY time, value) AS i, count(*) OVER (PARTITION BY userid) AS n FROM {_FLAT})) GROUP BY userid, value, g)"""


@query("peaks", f"""WITH RECURSIVE rows AS MATERIALIZED (SELECT userid, event_id, row_number() OVER (PARTITION BY userid ORDER BY time, value) AS i FROM {_FLAT}),
c AS MATERIALIZED (SELECT userid, (a + b) // 2 AS p, value, row_number() OVER (PARTITION BY userid ORDER BY value DESC, a DESC) AS k, count(*) OVER (PARTITION BY userid) AS m FROM (SELECT *, lag(value) OVER w AS l, lead(value) OVER w AS r FROM {_RUNS_OF} WINDOW w AS (PARTITION BY userid ORDER BY a)) WHERE value > 8 AND value > l AND value > r),
g(userid, k, stays) AS (SELECT userid, 1, [p] FROM c WHERE k = 1 AND m > 1 UNION ALL SELECT g.userid, c.k, CASE WHEN len(list_filter(g.stays, lambda q: abs(q - c.p) <= 5)) = 0 THEN list_append(g.stays, c.p) ELSE g.stays END FROM g JOIN c ON c.userid = g.userid AND c.k = g.k + 1),
kept AS (SELECT DISTINCT userid, unnest(stays) AS i FROM g)
SELECT event_id, kept.i IS NOT NULL AS prominent_peak FROM rows LEFT JOIN kept USING (userid, i)""")
def peaks(spark, sf):
    """Coarse values, so that there are plateaus and ties."""
    rows = samples(spark, sf).select("userid", "time", "event_id", F.floor(F.col("value") / 4).cast("double").alias("value"))
    return pressure.with_peaks(rows, ["userid"], "value").select("event_id", "prominent_peak")


def _grouped(spark, sf):
    from pyspark.sql import Window

    s = samples(spark, sf).select((F.col("userid").cast("int") % 23).cast("string").alias("treatment_id"), "time", "event_id", F.col("value").alias("pressure_detrend"))
    w = Window.partitionBy("treatment_id").orderBy("time", "event_id")
    s = s.withColumn("time", F.timestamp_micros(F.row_number().over(w).cast("long") * 100_000))
    v, w = F.col("pressure_detrend"), Window.partitionBy("treatment_id").orderBy("time")
    marked = s.withColumn("prominent_peak", F.coalesce((v > 60) & (v > F.lag(v).over(w)) & (v > F.lead(v).over(w)), F.lit(False)))
    return pressure.with_breaths(marked, ["treatment_id"], edge=20.0)


@query("set_tags", f"""WITH src AS MATERIALIZED (SELECT CAST(CAST(userid AS INT) % 23 AS VARCHAR) AS tid, event_id, value AS v, row_number() OVER (PARTITION BY CAST(userid AS INT) % 23 ORDER BY time, event_id) AS i, count(*) OVER (PARTITION BY CAST(userid AS INT) % 23) AS n FROM {S}),
pk AS MATERIALIZED (SELECT *, coalesce(v > 60 AND v > lag(v) OVER w AND v > lead(v) OVER w, false) AS peak FROM src WINDOW w AS (PARTITION BY tid ORDER BY i)),
ed AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN v <= 20 THEN i END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS l, coalesce(first_value(CASE WHEN v <= 20 THEN i END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS r, sum(peak::INT) OVER (PARTITION BY tid ORDER BY i) AS k FROM pk),
lab AS MATERIALIZED (SELECT tid, event_id, i, v, CASE WHEN b.k > 0 AND i <= b.r THEN b.k ELSE 0 END AS breath_id FROM (SELECT e.*, last_value(s.b IGNORE NULLS) OVER (PARTITION BY e.tid ORDER BY e.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM ed e LEFT JOIN (SELECT tid, l, max({{'k': k, 'r': r}}) AS b FROM ed WHERE peak GROUP BY ALL) s ON s.tid = e.tid AND s.l = e.i)),
top AS MATERIALIZED (SELECT tid, pos, row_number() OVER (PARTITION BY tid ORDER BY breath_id) AS j, count(*) OVER (PARTITION BY tid) AS m FROM (SELECT tid, breath_id, first(i ORDER BY v DESC, i) AS pos FROM lab WHERE breath_id > 0 GROUP BY ALL)),
gap AS (SELECT *, lead(pos) OVER (PARTITION BY tid ORDER BY j) - pos AS g FROM top),
bound AS MATERIALIZED (SELECT tid, m, j - 2 AS x FROM (SELECT *, lag(g) OVER (PARTITION BY tid ORDER BY j) AS p FROM gap) WHERE j >= 2 AND j < m AND g - p >= 2 * p),
nb AS (SELECT tid, max(m) AS m, count(*) AS n, (max(x) - min(x)) / (count(*) - 1)::DOUBLE AS mean FROM bound GROUP BY tid),
thin AS (SELECT tid, m, x + 1 AS y FROM (SELECT *, lead(x) OVER (PARTITION BY tid ORDER BY x) AS nx FROM bound) WHERE nx IS NULL OR nx - x > 2),
sizes AS (SELECT tid, y - coalesce(lag(y) OVER (PARTITION BY tid ORDER BY y), 0) AS z FROM thin UNION ALL SELECT tid, max(m) - max(y) FROM thin GROUP BY tid),
ok AS (SELECT tid FROM nb JOIN (SELECT tid, count(*) AS c FROM thin GROUP BY tid) USING (tid) JOIN (SELECT tid, avg(z) AS av, stddev_samp(z) AS sd FROM sizes GROUP BY tid) USING (tid)
  WHERE m > 8 AND n BETWEEN 2 AND 30 AND mean >= 4 AND c BETWEEN 2 AND 30 AND av BETWEEN 4 AND 25 AND sd <= CASE WHEN av < 8 THEN 3.5 ELSE 5.5 END),
tag AS (SELECT t.tid, t.pos AS i, CASE WHEN t.j = 1 THEN 0 ELSE 1 + (SELECT count(*) FROM bound b WHERE b.tid = t.tid AND b.x + 2 <= t.j - 1) END AS set_id FROM top t WHERE t.tid IN (SELECT tid FROM ok))
SELECT event_id, coalesce(set_id, 0)::DOUBLE AS set_id FROM lab LEFT JOIN tag USING (tid, i)""")
def set_tags(spark, sf):
    return pressure.with_sets(_grouped(spark, sf)).select("event_id", "set_id")


#: Sessions of 250 events, two at each time, four sessions a day: two that make one treatment, one of another patient, and one by itself.
_SESSION = "CAST(event_id // 250 AS INT)"
_BREATHED = f"""SELECT 'p' || CAST((s // 4) % 2 + (s % 4) // 2 % 2 AS VARCHAR) AS patient_id, CAST(s AS VARCHAR) AS session_id, TIMESTAMP '2024-01-01' + to_days(s // 4) + to_microseconds([0, 1800000000, 14400000000, 28800000000][1 + s % 4]) + to_milliseconds(event_id % 250 // 2 * 200) AS time, floor(value) / 4 - 3 AS v FROM (SELECT *, {_SESSION} AS s FROM events)"""
_PRESCRIBED = "SELECT 'p' || CAST(k AS VARCHAR) AS patient_id, 2.0 + k AS d, 3.0 AS s, 4.0 + k AS b FROM range(3) t(k)"


def breathed(spark, sf):
    """(patient_id, session_id, time, pressure_detrend), and the session's place in its day."""
    s, k = F.floor(F.col("event_id") / 250).cast("int"), F.col("s")
    offset = F.element_at(F.array(*(F.lit(x) for x in (0, 1_800_000_000, 14_400_000_000, 28_800_000_000))), (k % 4 + 1).cast("int"))
    micros = F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.floor(k / 4) * 86_400_000_000 + offset + F.floor(F.col("event_id") % 250 / 2) * 200_000
    patient = F.concat(F.lit("p"), (F.floor(k / 4) % 2 + F.floor(k % 4 / 2) % 2).cast("int").cast("string"))
    return table(spark, sf, "events").withColumn("s", s).select(patient.alias("patient_id"), k.cast("string").alias("session_id"), F.timestamp_micros(micros).alias("time"), (F.floor("value").cast("double") / 4 - 3).alias("pressure_detrend"), (k % 4).alias("place"))


def prescribed(spark):
    k = F.col("id")
    return spark.range(3).select(F.concat(F.lit("p"), k.cast("string")).alias("patient_id"), (k + 2).cast("int").alias("treatments_per_day"), F.lit(3).alias("number_of_sets"), (k + 4).cast("int").alias("breaths_per_set"))


@query("labelled_sessions", pressure_sql.labelled(_BREATHED))
def labelled_sessions(spark, sf):
    """Peaks, breaths, breaks and sets of treatments of one or two sessions."""
    rows = breathed(spark, sf).drop("place")
    out = steps.label_pressure(rows, treatments.session_metadata(rows))
    return out.select("patient_id", "session_id", "treatment_id", F.unix_micros("time").alias("time"), "pressure_detrend", "prominent_peak", "breath_id", "break_id", "set_id")


@query("treatments_by_steps", pressure_sql.rounded(pressure_sql.scored(_BREATHED, _PRESCRIBED), [f.name for f in TREATMENTS if f.dataType.simpleString() == "double"]), dates=("act_date",))
def treatments_by_steps(spark, sf):
    """Cleaned sessions to scored treatments through the incremental steps: the last session of each day comes later than the
    others, and weeks are featurised out of turn, in several calls."""
    store, rows = _own_store(spark), breathed(spark, sf)
    every = ("2023-12-25", _EVER)
    for k, (late, ranges) in enumerate(((F.col("place") < 3, (("2024-01-08", "2024-01-15"), every)), (F.col("place") == 3, (every,)))):
        steps.ingest(store, rows.filter(late).drop("place"), "clean", f"delivery{k}")
        steps.label_pressure_step(store, "clean", "labelled", "labelled_ledger", *every)
        for start, end in ranges:
            steps.featurise_treatments_step(store, "labelled", "treatments", "treatments_ledger", prescribed(spark), start, end)
    return _six(store.read("treatments"))


@query("detrend")
def detrend(spark, sf):
    return pressure.detrended(samples(spark, sf).select("userid", "time", "event_id", "value"), "userid", "value").select("event_id", r6("pressure_detrend").alias("pressure_detrend"))


# --- people, phases, outliers --------------------------------------------------------------------------------------
def link(spark, sf):
    c = table(spark, sf, "customer")
    k, base = F.col("c_custkey"), F.to_date(F.lit("2023-11-01"))
    day = lambda every, offset: F.when(k % every > 0, F.date_add(base, (k % 97 + offset).cast("int")))
    return c.select(
        k.cast("double").alias("study_email"), k.cast("string").alias("patient_record_id"), k.cast("string").alias("hub_id"), F.date_add(base, (k % 60).cast("int")).alias("date_recruited"), (k % 11 + 6).cast("int").alias("age_recruited"),
        day(3, 40).alias("date_feedback_start"), day(4, 60).alias("date_gaming_start"), day(5, 90).alias("date_gaming_ended"), day(6, 120).alias("date_feedback_end"), F.when(k % 8 == 0, F.date_add(base, (k % 70 + 50).cast("int"))).alias("date_withdrawn"),
    )


def _day(every: int, offset: int) -> str:
    return f"CASE WHEN c_custkey % {every} > 0 THEN DATE '2023-11-01' + CAST(c_custkey % 97 + {offset} AS INT) END"


_LINK = f"(SELECT c_custkey::DOUBLE AS study_email, CAST(c_custkey AS VARCHAR) AS id, DATE '2023-11-01' + CAST(c_custkey % 60 AS INT) AS rec, (c_custkey % 11 + 6)::DOUBLE AS age, {_day(3, 40)} AS fs, {_day(4, 60)} AS gs, {_day(5, 90)} AS ge, {_day(6, 120)} AS fe, CASE WHEN c_custkey % 8 = 0 THEN DATE '2023-11-01' + CAST(c_custkey % 70 + 50 AS INT) END AS wd FROM customer)"
_PHASES = f"(SELECT *, least(coalesce(ge, g + 240), wd) AS gend, least(coalesce(fe, f + 365), wd) AS fend FROM (SELECT *, least(coalesce(fs, rec + 61), wd) AS f, least(coalesce(gs, rec + 121), wd) AS g FROM {_LINK}))"


def user_days(spark, sf):
    return samples(spark, sf).groupBy("userid", "date").agg(F.sum("value").alias("mvpa_15_prev_method"))


@query("phase_assign", f"SELECT userid AS patient_id, date AS act_date, CASE WHEN date >= fend THEN 'feedback ended' WHEN date >= gend THEN 'gaming ended' WHEN date >= g THEN 'gaming' WHEN date >= f THEN 'feedback' ELSE 'blind' END AS phase FROM (SELECT DISTINCT userid, date FROM {S}) LEFT JOIN {_PHASES} ON id = userid", dates=("act_date",))
def phase_assign(spark, sf):
    days = user_days(spark, sf).select(F.col("userid").alias("patient_id"), F.col("date").alias("act_date"))
    return enrich.with_phase(days, link(spark, sf))


@query("games_join", f"SELECT d.userid AS patient_id, d.date AS act_date, (g.games IS NOT NULL)::INT::DOUBLE AS games, coalesce(g.games, '0') AS games_played FROM (SELECT DISTINCT userid, date FROM {S}) d LEFT JOIN (SELECT userid, date, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS games FROM {S} WHERE {STEP} AND userid IN (SELECT id FROM {_LINK}) GROUP BY ALL) g ON d.userid = g.userid AND d.date = g.date", dates=("act_date",))
def games_join(spark, sf):
    days = user_days(spark, sf).select(F.col("userid").alias("patient_id"), F.col("date").alias("act_date"))
    games = samples(spark, sf).filter(STEP).select("userid", "date", F.col("event_type").alias("display_name"))
    return enrich.with_games(days, games, link(spark, sf))


@query("demographics", f"SELECT userid, date, round(age + date_diff('day', rec, date) / 7 / 52.25::DOUBLE, 2) AS decimal_age, date_diff('day', rec, date)::DOUBLE AS day_in_study, dayname(date) AS day_of_week, month(date)::DOUBLE AS month, (month(date) % 12 // 3 + 1)::DOUBLE AS season, c_mktsegment AS gender FROM (SELECT DISTINCT userid, date FROM {S}) JOIN {_LINK} ON id = userid JOIN customer ON c_custkey = study_email", dates=("date",))
def demographics(spark, sf):
    sex = table(spark, sf, "customer").select(F.col("c_custkey").alias("study_email"), F.col("c_mktsegment").alias("gender"))
    out = enrich.with_demographics(user_days(spark, sf).select("userid", "date"), link(spark, sf), sex, "userid", "hub_id", "date")
    return out.select("userid", "date", "decimal_age", "day_in_study", "day_of_week", "month", "season", "gender")


@query("week_score", f"SELECT userid, date, week_n, year, round(sum(v) OVER (PARTITION BY userid, year, week_n), 6) AS mvpa_week, round(sum(v) OVER (PARTITION BY userid, year, week_n) / 420, 6) AS mvpa_week_score FROM (SELECT userid, date, ((dayofyear(date) - 1) // 7 + 1)::DOUBLE AS week_n, year(date)::DOUBLE AS year, sum(value) AS v FROM {S} GROUP BY ALL)", dates=("date",))
def week_score(spark, sf):
    return enrich.with_week_score(user_days(spark, sf)).select("userid", "date", "week_n", "year", r6("mvpa_week").alias("mvpa_week"), r6("mvpa_week_score").alias("mvpa_week_score"))


@query("treatment_order", f"SELECT treatment_id, row_number() OVER (PARTITION BY patient_id, act_date ORDER BY o_orderdate, treatment_id)::DOUBLE AS day_treatment, epoch_us(DATE '2024-06-01' + (o_orderdate - date_trunc('day', o_orderdate))) AS tr_start_time FROM {_TREAT} JOIN orders ON o_orderkey = treatment_id")
def treatment_order(spark, sf):
    return enrich.with_treatment_order(orders_as_treatments(spark, sf), "2024-06-01").select("treatment_id", "day_treatment", F.unix_micros("tr_start_time").alias("tr_start_time"))


_FENCE = "(SELECT quantile_cont(c_acctbal, 0.25) - 1.5 * (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) AS lo, quantile_cont(c_acctbal, 0.75) + 1.5 * (quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25)) AS hi FROM (SELECT c_acctbal * c_acctbal * c_acctbal AS c_acctbal FROM customer))"


def cubed(spark, sf):
    b = F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", (b * b * b).alias("c_acctbal"))


@query("tukey_flag", f"SELECT c_custkey, (c_acctbal * c_acctbal * c_acctbal <= lo OR c_acctbal * c_acctbal * c_acctbal >= hi) AS c_acctbal_is_out FROM customer, {_FENCE}")
def tukey_flag(spark, sf):
    return enrich.flag_outliers(cubed(spark, sf), ["c_acctbal"]).select("c_custkey", "c_acctbal_is_out")


@query("drop_outliers", f"SELECT c_custkey FROM (SELECT c_custkey, o, avg(o::INT) OVER () AS share FROM (SELECT c_custkey, (c_acctbal * c_acctbal * c_acctbal <= lo OR c_acctbal * c_acctbal * c_acctbal >= hi) AS o FROM customer, {_FENCE})) WHERE NOT (o AND share < 0.2)")
def drop_outliers(spark, sf):
    return enrich.drop_outliers(cubed(spark, sf), ["c_acctbal"], ratio=0.2).select("c_custkey")


_HOLES = "(SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal * c_acctbal * c_acctbal END AS v FROM customer)"


@query("nan_flags", f"SELECT c_custkey, v <= lo OR v >= hi AS v_is_out FROM {_HOLES}, (SELECT quantile_cont(v, 0.25) - 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS lo, quantile_cont(v, 0.75) + 1.5 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25)) AS hi FROM {_HOLES})")
def nan_flags(spark, sf):
    """NaN is no value: it moves no fence, and its flag is null."""
    rows = cubed(spark, sf).select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).otherwise(F.lit(float("nan"))).alias("v"))
    return enrich.flag_outliers(rows, ["v"]).select("c_custkey", "v_is_out")


@query("nan_minutes", f"""SELECT userid, epoch_us(time) AS time, round(value_steps, 6) AS value_steps, round(value_hr, 6) AS value_hr FROM (SELECT DISTINCT userid, date_trunc('minute', time) AS time, CASE WHEN event_id % 5 > 0 THEN value END AS value_steps, time AS t FROM {S} WHERE {STEP})
FULL JOIN (SELECT userid, date_trunc('minute', time) AS time, avg(value) AS value_hr FROM (SELECT DISTINCT userid, time, CASE WHEN event_id % 5 > 0 THEN value END AS value FROM {S} WHERE NOT {STEP}) GROUP BY ALL) USING (userid, time)""")
def nan_minutes(spark, sf):
    rows = samples(spark, sf).withColumn("value", F.when(F.col("event_id") % 5 > 0, F.col("value")).otherwise(F.lit(float("nan"))))
    sides = (rows.filter(f"{k} {STEP}").select("userid", "time", "value") for k in ("", "NOT"))
    return _six(daily.combine_minutes(*sides))


@query("patient_devices", f"SELECT patient_id, study_email, acapella FROM (SELECT id AS patient_id, study_email, (study_email % 4)::INT AS acapella FROM {_LINK})")
def patient_devices(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("double").alias("study_email"), (F.col("c_custkey") % 4).cast("int").alias("acapella"))
    return enrich.patient_devices(c, link(spark, sf)).select("patient_id", "study_email", "acapella")


# --- ledgers, windows, checks --------------------------------------------------------------------------------------
@query("ledger_remaining", f"SELECT DISTINCT date, userid FROM {S} s WHERE NOT EXISTS (SELECT 1 FROM {S} l WHERE l.userid = s.userid AND l.date = s.date AND l.event_type = 'purchase')", dates=("date",))
def ledger_remaining(spark, sf):
    s = samples(spark, sf)
    return remaining(s, s.filter("event_type = 'purchase'").select("date", "userid").distinct(), ["date", "userid"])


@query("coverage_check", f"SELECT DISTINCT session_id FROM {_SESS} WHERE session_id NOT IN (SELECT session_id FROM {_SESS} WHERE pressure_detrend > 60)")
def coverage_check(spark, sf):
    s = sessions(spark, sf)
    return quality.uncovered(s, s.filter("pressure_detrend > 60").select("session_id").distinct())


@query("validation_report", f"""SELECT true AS complete, true AS finite, (min(value) >= 30 AND max(value) <= 220) AS in_range, true AS column_names, true AS column_types, true AS column_number, NOT bool_or(CAST(time + INTERVAL 1 HOUR AS DATE) > DATE '2024-01-20') AS not_in_future, NOT coalesce(bool_or(CAST(time + INTERVAL 1 HOUR AS DATE) < rec), false) AS after_recruitment, bool_and(id IS NOT NULL) AS known_ids FROM {S} LEFT JOIN {_LINK} ON id = userid""")
def validation_report(spark, sf):
    return quality.samples_report(samples(spark, sf).select("userid", "time", "value"), link(spark, sf), "2024-01-20", "heart")


@query("raw_pressure_report", f"SELECT (min(value) >= -20 AND max(value) <= 119) AS values_in_range, true AS finite, bool_and(userid IN (SELECT id FROM {_LINK})) AS known_ids FROM {S}")
def raw_pressure_report(spark, sf):
    raw = samples(spark, sf).select(F.col("userid").alias("patient_record_id"), F.col("value").alias("pressurevalues"))
    return quality.raw_pressure_report(raw, link(spark, sf))


@query("settled_days", f"SELECT userid, date FROM (SELECT DISTINCT userid, date FROM {S}) QUALIFY date < max(date) OVER (PARTITION BY userid)", dates=("date",))
def settled_days(spark, sf):
    return steps.settled_days(samples(spark, sf).select("userid", "date").distinct())


@query("blind_windows", f"SELECT patient_id, a AS window_start, b + CAST((7 - (b - a) % 7) % 7 AS INT) AS window_end FROM (SELECT id AS patient_id, rec + 1 AS a, coalesce(fs, rec + 61) AS b FROM {_LINK})", dates=("window_start", "window_end"))
def blind_windows(spark, sf):
    return steps.blind_windows(link(spark, sf), featurise=True)


@query("within_windows", f"SELECT event_id FROM {S} JOIN {_LINK} ON id = userid WHERE date >= rec AND date < coalesce(fs, rec + 60)")
def within_windows(spark, sf):
    s = samples(spark, sf).withColumnRenamed("userid", "patient_id")
    return steps.within_windows(s, steps.blind_windows(link(spark, sf)), "date").select("event_id")


@query("calendar", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, CAST((dayofyear(o_orderdate) - 1) // 7 + 1 AS INT) AS week_n, CAST(month(o_orderdate) % 12 // 3 + 1 AS INT) AS season FROM orders", dates=("date",))
def calendar(spark, sf):
    d = F.to_date("o_orderdate").alias("date")
    return table(spark, sf, "orders").select(d).distinct().select("date", jan_week(F.col("date")).alias("week_n"), season(F.col("date")).alias("season"))


@query("first_differences", f"SELECT event_id, round(value - lag(value) OVER w, 6) AS step, round(abs(value - lag(value) OVER w) / lag(value) OVER w * 100, 6) AS prop, coalesce(abs(value - lag(value) OVER w) < 1, false) AS alike, round(CASE WHEN s < 60 THEN s WHEN s < 3600 THEN s / 60 WHEN s < 86400 THEN s / 3600 ELSE s / 86400 END, 6) AS gap FROM (SELECT *, (epoch_us(time) - epoch_us(lag(time) OVER (PARTITION BY userid ORDER BY time, event_id))) / 1000000 AS s FROM {S}) WINDOW w AS (PARTITION BY userid ORDER BY time, event_id)")
def first_differences(spark, sf):
    order = [F.col(c).asc_nulls_last() for c in ("time", "event_id")]
    w = Window.partitionBy("userid").orderBy(*order)
    before = F.lag("value").over(w)
    gap = auto_units(seconds_between(F.lag("time").over(w), F.col("time")))
    return samples(spark, sf).select("event_id", r6(series.first_differences(F.col("value"), ["userid"], order)).alias("step"), r6(proportional_difference(F.col("value"), before, infinite=True)).alias("prop"), F.coalesce(near(F.col("value"), before, 1.0), F.lit(False)).alias("alike"), r6(gap).alias("gap"))


@query("counts", f"SELECT userid, count(DISTINCT CASE WHEN hour <> 0 THEN hour END)::DOUBLE AS ids, count(DISTINCT event_type) AS kinds FROM {S} GROUP BY userid")
def counts(spark, sf):
    return samples(spark, sf).groupBy("userid").agg(treatments.count_ids(F.col("hour")).alias("ids"), F.count_distinct("event_type").alias("kinds"))


# --- sources, sinks, whole enrichments -------------------------------------------------------------------------------
@query("csv_samples", f"SELECT userid, epoch_us(date_trunc('second', time)) AS time, round(value, 6) AS value FROM {S}")
def csv_samples(spark, sf):
    path = f"{_own_store(spark).root}/samples"
    samples(spark, sf).select("userid", F.date_trunc("second", "time").alias("time"), "value").write.option("header", True).csv(path)
    return _six(read_csv(spark, path, HEART))


@query("sinks", f"SELECT 'appended' AS what, count(*) AS n FROM {S} WHERE {STEP} UNION ALL SELECT 'replaced', count(*) FROM {S} WHERE event_type = 'click' UNION ALL SELECT 'one part replaced', count(*) FILTER (event_type <> 'view' OR value > 30) FROM {S} UNION ALL SELECT 'dropped', 0 UNION ALL SELECT 'refused', 1")
def sinks(spark, sf):
    """Append, overwrite, replacing of one part, drop, and the table that is never written."""
    store, s = _own_store(spark), samples(spark, sf)
    for kind in ("view", "click"):
        store.write(s.filter(F.col("event_type") == kind), "appended")
        store.write(s.filter(F.col("event_type") == kind), "replaced", "overwrite")
    store.write(s, "parts", "partitions", ["event_type"])
    store.write(s.filter("event_type = 'view' AND value > 30"), "parts", "partitions", ["event_type"])
    store.write(s, "gone")
    store.drop("gone")
    try:
        store.write(s, "pressure_raw_vals")
        refused = 0
    except ValueError:
        refused = 1
    count = lambda name, of: store.read(name).agg(F.count("*").alias("n")).select(F.lit(of).alias("what"), "n")
    rest = spark.createDataFrame([("dropped", int(store.exists("gone"))), ("refused", refused)], "what string, n long")
    return count("appended", "appended").unionByName(count("replaced", "replaced")).unionByName(count("parts", "one part replaced")).unionByName(rest)


@query("day_ledgers", f"SELECT DISTINCT date, userid FROM {S} WHERE NOT {STEP} UNION SELECT DISTINCT date, userid FROM {S} WHERE {STEP}", dates=("date",))
def day_ledgers(spark, sf):
    return day_ledger(_heart(spark, sf)).union(day_ledger(_steps(spark, sf))).distinct()


@query("distinct_ids", f"SELECT DISTINCT id AS patient_record_id FROM {_LINK} JOIN {S} ON userid = id")
def distinct_ids(spark, sf):
    seen = link(spark, sf).join(samples(spark, sf).select(F.col("userid").alias("hub_id")), "hub_id")
    return enrich.distinct_ids(seen, "patient_record_id")


@query("physical_rows", f"SELECT event_id FROM {S} WHERE event_id % 7 <> 0 AND value * 2 - 20 BETWEEN -10 AND 120")
def physical_rows(spark, sf):
    raw = samples(spark, sf).select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value") * 2 - 20).alias("pressure_detrend"))
    return pressure.within_physical(pressure.complete_rows(raw)).select("event_id")


_SCORED = f"(SELECT * FROM {_TREAT} WHERE treatment_id % 5 <> 0 AND breath_count > 1)"


@query("scored_treatments", f"""SELECT treatment_id, act_date, round(tday / d, 6) AS treatment_day_adherence_score, round(bday / d / s / b, 6) AS breaths_day_adherence_score, round(tweek / d / 7, 6) AS treatment_week_adherence_score, round(bweek / d / s / b / 7, 6) AS breaths_week_adherence_score, breath_count, round(amp, 6) AS mean_breath_amplitude FROM (
SELECT *, sum(breath_count) OVER (PARTITION BY patient_id, act_date) AS bday, count(*) OVER (PARTITION BY patient_id, act_date) AS tday, sum(breath_count) OVER (PARTITION BY patient_id, year, week) AS bweek, count(*) OVER (PARTITION BY patient_id, year, week) AS tweek FROM {_SCORED}) JOIN {_DEV} USING (patient_id)""", dates=("act_date",))
def scored_treatments(spark, sf):
    """Treatments worth scoring, with their scores and features."""
    t = orders_as_treatments(spark, sf).withColumn("pressures_completeness_score", (F.col("treatment_id") % 5 != 0).cast("double"))
    t = t.withColumn("breath_count", F.when(F.col("breath_count") > 1, F.col("breath_count")).otherwise(0.0))
    out = treatments.with_adherence(t, devices(spark, sf))
    return _six(out.select("treatment_id", "act_date", *(f"{a}_{b}_adherence_score" for b in ("day", "week") for a in ("treatment", "breaths")), "breath_count", "mean_breath_amplitude"))


_PEOPLE = "round(age + date_diff('day', rec, date) / 7 / 52.25::DOUBLE, 2) AS decimal_age, date_diff('day', rec, date)::DOUBLE AS day_in_study, dayname(date) AS day_of_week, month(date)::DOUBLE AS month, (month(date) % 12 // 3 + 1)::DOUBLE AS season, c_mktsegment AS gender"
_DAYS = f"(SELECT userid, date, sum(value) AS v, max(time) AS t FROM {S} GROUP BY userid, date)"


def _fence_sql(value: str, rows: str) -> str:
    return f"(SELECT quantile_cont({value}, 0.25) - 1.5 * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS lo, quantile_cont({value}, 0.75) + 1.5 * (quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25)) AS hi FROM {rows})"


def _sex(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("study_email"), F.col("c_mktsegment").alias("gender"))


@query("enriched_days", f"""SELECT userid, date, round(v, 6) AS mvpa_15_prev_method, {_PEOPLE}, week_n, year, round(w, 6) AS mvpa_week, round(w / 420, 6) AS mvpa_week_score, (v <= lo OR v >= hi) AS mvpa_15_prev_method_is_out FROM (SELECT *, sum(v) OVER (PARTITION BY userid, year, week_n) AS w FROM (SELECT *, ((dayofyear(date) - 1) // 7 + 1)::DOUBLE AS week_n, year(date)::DOUBLE AS year FROM {_DAYS} JOIN {_LINK} ON id = userid)) JOIN customer ON c_custkey = study_email, {_fence_sql('v', f'(SELECT v FROM {_DAYS} WHERE userid IN (SELECT id FROM {_LINK}))')}""", dates=("date",))
def enriched_days(spark, sf):
    out = steps.enrich_days(user_days(spark, sf), link(spark, sf), _sex(spark, sf))
    return _six(out.drop("study_email", "age_recruited", "date_recruited"))


@query("enriched_treatments", f"""SELECT userid AS patient_id, date AS act_date, userid || '-' || CAST(date AS VARCHAR) AS treatment_id, v AS breath_count, {_PEOPLE}, games, games_played, phase, 1::DOUBLE AS day_treatment, epoch_us(DATE '2024-06-01' + (date_trunc('second', t) - date_trunc('day', t))) AS tr_start_time, (v <= lo OR v >= hi) AS breath_count_is_out FROM (SELECT * REPLACE (round(v, 6) AS v) FROM {_DAYS}) JOIN {_LINK} ON id = userid JOIN customer ON c_custkey = study_email
JOIN (SELECT id AS pid, f, g, gend, fend FROM {_PHASES}) ON pid = userid JOIN LATERAL (SELECT CASE WHEN date >= fend THEN 'feedback ended' WHEN date >= gend THEN 'gaming ended' WHEN date >= g THEN 'gaming' WHEN date >= f THEN 'feedback' ELSE 'blind' END AS phase) ON true
JOIN (SELECT d.userid AS gu, d.date AS gd, (p.names IS NOT NULL)::INT::DOUBLE AS games, coalesce(p.names, '0') AS games_played FROM {_DAYS} d LEFT JOIN (SELECT userid, date, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS names FROM {S} WHERE {STEP} GROUP BY ALL) p ON p.userid = d.userid AND p.date = d.date) ON gu = userid AND gd = date, {_fence_sql('v', f'(SELECT round(v, 6) AS v FROM {_DAYS} WHERE userid IN (SELECT id FROM {_LINK}))')}""", dates=("act_date",))
def enriched_treatments(spark, sf):
    days = samples(spark, sf).groupBy(F.col("userid").alias("patient_id"), F.col("date").alias("act_date")).agg(r6(F.sum("value")).alias("breath_count"), F.max("time").alias("treatment_start"))
    days = days.withColumn("treatment_id", F.concat_ws("-", "patient_id", F.col("act_date").cast("string")))
    games = samples(spark, sf).filter(STEP).select("userid", "date", F.col("event_type").alias("display_name"))
    out = steps.enrich_treatments(days, games, link(spark, sf), _sex(spark, sf), "2024-06-01")
    return _six(out.drop("study_email", "age_recruited", "date_recruited", "treatment_start"))


@query("steps_report", f"""SELECT bool_and(v IS NOT NULL) AS complete, bool_and(v IS NOT NULL) AS finite, (min(v) >= 0 AND max(v) <= 50000) AS in_range, true AS column_names, true AS column_types, true AS column_number, NOT bool_or(CAST(time + INTERVAL 1 HOUR AS DATE) > DATE '2024-01-20') AS not_in_future, NOT coalesce(bool_or(CAST(time + INTERVAL 1 HOUR AS DATE) < rec), false) AS after_recruitment, bool_and(id IS NOT NULL) AS known_ids FROM (SELECT *, CASE WHEN event_id % 11 > 0 THEN value - 5 END AS v FROM {S}) LEFT JOIN {_LINK} ON id = userid""")
def steps_report(spark, sf):
    rows = samples(spark, sf).select("userid", "time", F.when(F.col("event_id") % 11 > 0, F.col("value") - 5).alias("value"))
    return quality.samples_report(rows, link(spark, sf), "2024-01-20", "steps")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
