"""What SQL (DuckDB) says of a day: the cleaning rules in their order, and the wide row of features."""

from __future__ import annotations

from ..functions.calendar import DAY_PARTS
from ..operators.daily import CHAINS, RUN_LENGTHS

_KEY = "PARTITION BY userid, date"


def _numbered(rows: str) -> str:
    return f"(SELECT userid, date, time, value, row_number() OVER ({_KEY} ORDER BY time, value) AS i, count(*) OVER ({_KEY}) AS n FROM {rows})"


def _rule(rows: str, where: str) -> str:
    return f"(SELECT userid, date, time, value FROM {rows} WHERE NOT coalesce({where}, false))"


def _default_edges(rows: str) -> str:
    told = f"(SELECT *, sum(d::INT) OVER ({_KEY}) AS l, coalesce(min(CASE WHEN NOT d THEN i END) OVER ({_KEY}) - 1, n) AS m, bool_or(i = n AND d) OVER ({_KEY}) AS e FROM (SELECT *, coalesce(value = 70, false) AS d FROM {_numbered(rows)}))"
    return _rule(told, "l >= 2 AND (i <= least(m, l - 1) OR (d AND e AND (i = n OR (i = n - 1 AND l >= 3))))")


def _repeats(rows: str) -> str:
    runs = f"(SELECT *, sum(new) OVER ({_KEY}, mid ORDER BY i) AS run FROM (SELECT *, CASE WHEN value = lag(value) OVER ({_KEY}, mid ORDER BY i) THEN 0 ELSE 1 END AS new FROM (SELECT *, i > 1 AND i < n AS mid FROM {_numbered(rows)})))"
    return _rule(f"(SELECT *, count(*) OVER ({_KEY}, mid, run) AS len FROM {runs})", "mid AND len > 10")


def _jumps(rows: str) -> str:
    steps = f"(SELECT *, lead(value) OVER ({_KEY} ORDER BY i) AS nx, epoch_us(lead(time) OVER ({_KEY} ORDER BY i)) - epoch_us(time) AS st FROM {_numbered(rows)})"
    jumps = f"(SELECT *, CASE WHEN (value <> 0 AND abs(nx - value) * 100 / value >= 15) OR (value = 0 AND nx <> 0) THEN {{'k': i, 'v': nx, 't': st}} END AS jump FROM {steps})"
    near = f"(SELECT *, last_value(jump IGNORE NULLS) OVER ({_KEY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a, first_value(jump.k IGNORE NULLS) OVER ({_KEY} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM {jumps})"
    return _rule(near, "b - a.k <= 5 AND a.v < 100 AND a.t < 30000000")


def _gaps(rows: str) -> str:
    gaps = f"(SELECT *, CASE WHEN epoch_us(lead(time) OVER ({_KEY} ORDER BY i)) - epoch_us(time) >= 120000000 THEN i END AS gap FROM {_numbered(rows)})"
    near = f"""(SELECT *, greatest(1, coalesce(last_value(gap IGNORE NULLS) OVER ({_KEY} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1)) AS a, least(coalesce(first_value(gap IGNORE NULLS) OVER ({_KEY} ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), n - 1), n - 1) AS b,
count(gap) OVER ({_KEY}) AS g, min(gap) OVER ({_KEY}) AS g1, max(gap) OVER ({_KEY}) AS g2 FROM {gaps})"""
    return _rule(near, "g > 0 AND ((i > 1 AND i < n AND b - a <= 20) OR (g1 = 1 AND i <= 2) OR (g2 = n - 1 AND i >= n - 1))")


def clean(rows: str) -> str:
    """rows (userid, date, time, value) by all rules, gaps twice."""
    for rule in (_default_edges, _repeats, _jumps, _gaps, _gaps):
        rows = rule(rows)
    return rows


def minutes(steps: str, heart: str) -> str:
    """(userid, time, date, hour, s, h) of step and heart-rate samples (userid, time, value)."""
    return f"""(SELECT userid, time, CAST(time AS DATE) AS date, hour(time) AS hour, s, h FROM (SELECT DISTINCT userid, date_trunc('minute', time) AS time, value AS s, time AS t FROM {steps})
FULL JOIN (SELECT userid, date_trunc('minute', time) AS time, avg(value) AS h FROM (SELECT DISTINCT userid, time, value FROM {heart}) GROUP BY ALL) USING (userid, time))"""


def features(minute_rows: str, thresholds: str) -> str:
    """The wide daily row; thresholds: (userid, date, thresh, low, high). Times are micros, numbers have six digits."""
    part = lambda p: "hour >= {} AND hour < {}".format(*DAY_PARTS[p])
    r = lambda e, name: f"round({e}, 6) AS {name}"
    total = lambda e: f"coalesce(sum({e}), 0)"
    count = lambda c: f"count(CASE WHEN {c} THEN 1 END)::DOUBLE"
    cv = lambda e: f"CASE WHEN avg({e}) > 0 THEN stddev_samp({e}) / avg({e}) * 100 ELSE 0 END"
    when = lambda c, e: f"CASE WHEN {c} THEN {e} END"
    out = [r(total("s"), "step_count")] + [r(total(when(part(p), "s")), f"step_count_{p}") for p in ("q2", "q3", "q4", "q234")]
    out += [f"{total(when(f'act AND run_len >= {n}', '1'))}::DOUBLE AS active_mins_steps_{n}" for n in RUN_LENGTHS] + [f"{count(f'act AND {part('q234')}')} AS active_mins_steps_0_ap"]
    out += [r(cv(when("s > 0", "s")), "cov_step")] + [r(cv(when(f"s > 0 AND {part(p)}", "s")), f"cov_step_{p}") for p in ("q1", "q2", "q3", "q4", "q234")]
    out += [r(f"coalesce(avg({when('k5 <= 5', 'h')}), 0)", "resting_hr_proxy"), r(f"coalesce(avg({when(f'{part('1121')} AND d5 <= 5', 'h')}), 0)", "resting_hr_1121"), r(cv("h"), "cov_hr")]
    out += [r(cv(when(part(p), "h")), f"cov_hr_{'q5' if p == 'q234' else p}") for p in ("q1", "q2", "q3", "q4", "q234")]
    out += ["count(h)::DOUBLE AS mins_wear_total"] + [f"count({when(part(p), 'h')})::DOUBLE AS mins_wear_{p}" for p in DAY_PARTS]
    active = "s > 5 AND (hour >= 6 OR (hour <= 6 AND s > 25))"
    out += [f"epoch_us({f}({when(active, 'time')})) AS {name}" for f, name in (("min", "start_window"), ("max", "end_window"))]
    out += [r(f"any_value({c})", name) for c, name in (("thresh", "thresh"), ("low", "thresh_low"), ("high", "thresh_high"))]
    out += [f"{count('mvpa')} AS mvpa_15_prev_method"] + [f"{count(f'mvpa AND chain >= {max(2, n)}')} AS mvpa_15_prev_method{n}" for n in CHAINS] + [f"{count('mvpa AND hour BETWEEN 8 AND 21')} AS mvpa_15_prev_method_ap_8_21"]
    out += [f"{count(f'b4 < {c} AND {c} < coalesce(h, 0)')} AS switch_{name}" for c, name in (("thresh", "thresh"), ("low", "thresh_low"), ("high", "thresh_high"))]
    out += [f"{count('two')} AS active_mins_hr_steps_thresh"] + [f"{count(f'two AND chain2 >= {max(2, n)}')} AS active_mins_hr_steps_thresh{n}" for n in CHAINS]
    out += [r(f"avg({when('mvpa', 's')})", "step_norm_thresh_mvpa"), r(f"avg({when('h <= thresh', 's')})", "step_sedentary_thresh_mvpa")]
    wear = {"": ("total", 1440), "_q1": ("q1", 360), "_q2": ("q2", 360), "_q3": ("q3", 360), "_q4": ("q4", 360), "_q234": ("q234", 1080)}
    more = [r(f"mins_wear_{p} / {n} * 100", f"wear_percent{k}") for k, (p, n) in wear.items()] + [r(f"100 - mins_wear_{p} / {n} * 100", f"gap_percent{k}") for k, (p, n) in wear.items() if k != "_q234"]
    more += ["CASE WHEN 100 - mins_wear_q1 / 360 * 100 > 25 THEN 0 ELSE 1 END::DOUBLE AS wear_during_sleep", r("coalesce(step_count / nullif(mins_wear_total, 0), 0)", "step_count_norm")]
    more += [r(f"coalesce(step_count_{q} / nullif(mins_wear_{q} / 360 * 100, 0), 0)", f"step_count_norm_{q}") for q in ("q2", "q3", "q4")]
    order, w = f"{_KEY} ORDER BY time, s DESC NULLS LAST, h NULLS FIRST", f"{_KEY} ORDER BY k"
    so_far, before = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    chain = lambda flag, name: f"CASE WHEN {flag} THEN count(CASE WHEN {flag} THEN 1 END) OVER ({_KEY}, {name}) END"
    begins = lambda flag: f"sum(({flag} AND coalesce(minute <> 1 + last_{flag}, true))::INT) OVER ({w} {so_far})"
    return f"""WITH near AS (SELECT * FROM (SELECT d.userid, d.date, t.thresh, t.low, t.high, row_number() OVER (PARTITION BY d.userid, d.date ORDER BY abs(date_diff('day', t.date, d.date)), t.date) AS r FROM (SELECT DISTINCT userid, date FROM {minute_rows}) d LEFT JOIN {thresholds} t ON d.userid = t.userid) WHERE r = 1),
m1 AS (SELECT m.*, thresh, low, high, epoch_us(time) // 60000000 AS minute, lag(coalesce(h, 0)) OVER ({order}) AS b4, last_value(CASE WHEN s > 0 THEN epoch_us(time) END IGNORE NULLS) OVER ({order} {so_far}) AS stepped, row_number() OVER ({order}) AS k, coalesce(s, 0) >= 70 AS act,
  row_number() OVER ({_KEY} ORDER BY h NULLS LAST) AS k5, row_number() OVER ({_KEY}, {part("1121")} ORDER BY h NULLS LAST) AS d5 FROM {minute_rows} m JOIN near USING (userid, date)),
m2 AS (SELECT *, coalesce(h > thresh, false) AND coalesce(epoch_us(time) - stepped <= 900000000, false) AS mvpa, k - sum(act::INT) OVER ({w} {so_far}) AS run FROM m1),
m3 AS (SELECT *, mvpa AND coalesce(s > 70, false) AS two, count(*) OVER ({_KEY}, act, run) AS run_len FROM m2),
m4 AS (SELECT *, last_value(CASE WHEN mvpa THEN minute END IGNORE NULLS) OVER ({w} {before}) AS last_mvpa, last_value(CASE WHEN two THEN minute END IGNORE NULLS) OVER ({w} {before}) AS last_two FROM m3),
m5 AS (SELECT *, {begins("mvpa")} AS c1, {begins("two")} AS c2 FROM m4),
m6 AS (SELECT *, {chain("mvpa", "c1")} AS chain, {chain("two", "c2")} AS chain2 FROM m5),
hours AS (SELECT userid, date, round(avg(t), 6) AS mean_hourly_steps_day, {count("t > 500")} AS active_hours, {count("t > 0 AND t <= 500")} AS low_active_hours, round(coalesce(max(a), 0), 6) AS max_hourly, round(coalesce(min(a), 0), 6) AS min_hourly, round(coalesce(median(a), 0), 6) AS median_hourly
  FROM (SELECT userid, date, hour, coalesce(sum(s), 0) AS t, avg(h) AS a FROM {minute_rows} GROUP BY ALL) GROUP BY userid, date),
days AS (SELECT userid, date, {", ".join(out)} FROM m6 GROUP BY userid, date)
SELECT *, {", ".join(more)} FROM days JOIN hours USING (userid, date)"""
