"""What SQL (DuckDB) says of treatments: sessions, peaks, breaths, breaks, sets, features, and scores from whole days and weeks."""

from __future__ import annotations

_SO_FAR, _BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_FOUR = lambda c, name: ", ".join(f"{f}({c}) AS {kind}_{name}" for kind, f in (("mean", "avg"), ("min", "min"), ("max", "max"), ("sd", "stddev_samp")))
_SECONDS = "(epoch_us(max(time)) - epoch_us(min(time))) / 1000000"


def _labels(rows: str, gap_seconds: int) -> str:
    """CTEs up to lab: rows (patient_id, session_id, time, v) with their treatment (tid), place (i of n), breath, break and set."""
    return f"""src AS MATERIALIZED ({rows}),
span AS (SELECT patient_id, session_id, min(time) AS s, max(time) AS e FROM src GROUP BY ALL),
grp AS MATERIALIZED (SELECT session_id, last_value(head IGNORE NULLS) OVER (PARTITION BY patient_id ORDER BY s, session_id {_SO_FAR}) AS tid FROM (SELECT *, CASE WHEN coalesce(epoch_us(s) - epoch_us(lag(e) OVER (PARTITION BY patient_id ORDER BY s, session_id)) >= {gap_seconds}000000, true) THEN session_id END AS head FROM span)),
num AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY time, v) AS i, count(*) OVER (PARTITION BY tid) AS n FROM src JOIN grp USING (session_id)),
run AS (SELECT tid, v, min(i) AS a, max(i) AS b FROM (SELECT *, i - row_number() OVER (PARTITION BY tid, v ORDER BY i) AS g FROM num) GROUP BY tid, v, g),
cand AS MATERIALIZED (SELECT tid, (a + b) // 2 AS p, row_number() OVER (PARTITION BY tid ORDER BY v DESC, a DESC) AS k, count(*) OVER (PARTITION BY tid) AS m FROM (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM run WINDOW w AS (PARTITION BY tid ORDER BY a)) WHERE v > 8 AND v > l AND v > r),
greedy(tid, k, stays) AS (SELECT tid, 1, [p] FROM cand WHERE k = 1 AND m > 1 UNION ALL SELECT g.tid, c.k, CASE WHEN len(list_filter(g.stays, lambda q: abs(q - c.p) <= 5)) = 0 THEN list_append(g.stays, c.p) ELSE g.stays END FROM greedy g JOIN cand c ON c.tid = g.tid AND c.k = g.k + 1),
mark AS MATERIALIZED (SELECT num.*, pk.i IS NOT NULL AS peak FROM num LEFT JOIN (SELECT DISTINCT tid, unnest(stays) AS i FROM greedy) pk USING (tid, i)),
edge AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN v <= 2 THEN i END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY i {_BEFORE}), 1) AS l, coalesce(first_value(CASE WHEN v <= 2 THEN i END IGNORE NULLS) OVER (PARTITION BY tid ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), n) AS r, sum(peak::INT) OVER (PARTITION BY tid ORDER BY i) AS k FROM mark),
begun AS (SELECT e.*, last_value(s.b IGNORE NULLS) OVER (PARTITION BY e.tid ORDER BY e.i {_SO_FAR}) AS b FROM edge e LEFT JOIN (SELECT tid, l, max({{'k': k, 'r': r}}) AS b FROM edge WHERE peak GROUP BY ALL) s ON s.tid = e.tid AND s.l = e.i),
breath AS MATERIALIZED (SELECT *, CASE WHEN kk > 0 AND i <= rr THEN kk ELSE 0 END::DOUBLE AS breath_id, CASE WHEN kk = 0 THEN 1 WHEN i <= rr AND NOT (i = n AND rr = n) THEN 0 ELSE kk + 1 END::DOUBLE AS break_id FROM (SELECT *, coalesce(b.k, 0) AS kk, coalesce(b.r, 0) AS rr FROM begun)),
top AS MATERIALIZED (SELECT tid, pos, row_number() OVER (PARTITION BY tid ORDER BY breath_id) AS j, count(*) OVER (PARTITION BY tid) AS m FROM (SELECT tid, breath_id, first(i ORDER BY v DESC, i) AS pos FROM breath WHERE breath_id > 0 GROUP BY ALL)),
gap AS (SELECT *, lead(pos) OVER (PARTITION BY tid ORDER BY j) - pos AS g FROM top),
bound AS MATERIALIZED (SELECT tid, m, j - 2 AS x FROM (SELECT *, lag(g) OVER (PARTITION BY tid ORDER BY j) AS p FROM gap) WHERE j >= 2 AND j < m AND g - p >= 2 * p),
thin AS (SELECT tid, m, x + 1 AS y FROM (SELECT *, lead(x) OVER (PARTITION BY tid ORDER BY x) AS nx FROM bound) WHERE nx IS NULL OR nx - x > 2),
size AS (SELECT tid, y - coalesce(lag(y) OVER (PARTITION BY tid ORDER BY y), 0) AS z FROM thin UNION ALL SELECT tid, max(m) - max(y) FROM thin GROUP BY tid),
sets AS (SELECT tid FROM (SELECT tid, max(m) AS m, count(*) AS n, (max(x) - min(x)) / (count(*) - 1)::DOUBLE AS mean FROM bound GROUP BY tid) JOIN (SELECT tid, count(*) AS c FROM thin GROUP BY tid) USING (tid) JOIN (SELECT tid, avg(z) AS av, stddev_samp(z) AS sd FROM size GROUP BY tid) USING (tid)
  WHERE m > 8 AND n BETWEEN 2 AND 30 AND mean >= 4 AND c BETWEEN 2 AND 30 AND av BETWEEN 4 AND 25 AND sd <= CASE WHEN av < 8 THEN 3.5 ELSE 5.5 END),
tag AS (SELECT t.tid, t.pos AS i, CASE WHEN t.j = 1 THEN 0 ELSE 1 + (SELECT count(*) FROM bound b WHERE b.tid = t.tid AND b.x + 2 <= t.j - 1) END AS set_id FROM top t WHERE t.tid IN (SELECT tid FROM sets)),
lab AS MATERIALIZED (SELECT breath.*, coalesce(set_id, 0)::DOUBLE AS set_id FROM breath LEFT JOIN tag USING (tid, i))"""


def labelled(rows: str, gap_seconds: int = 3600) -> str:
    return f"WITH RECURSIVE {_labels(rows, gap_seconds)} SELECT patient_id, session_id, tid AS treatment_id, epoch_us(time) AS time, v AS pressure_detrend, peak AS prominent_peak, breath_id, break_id, set_id FROM lab"


def scored(rows: str, devices: str, gap_seconds: int = 3600, complete: int = 150) -> str:
    """The table of treatments; devices: (patient_id, d, s, b), what is prescribed a day, a treatment and a set."""
    return f"""WITH RECURSIVE {_labels(rows, gap_seconds)},
head AS (SELECT patient_id, tid, CAST(min(time) AS DATE) AS act_date, epoch_us(min(time)) AS treatment_start, epoch_us(max(time)) AS treatment_end, floor({_SECONDS})::DOUBLE AS treatment_length, count(*) AS rows, count(CASE WHEN breath_id <> 0 AND v >= 10 THEN 1 END) / 10 AS seconds_above10,
  avg((breath_id > 0)::INT) AS percent_time_breathing, count(DISTINCT CASE WHEN breath_id <> 0 THEN breath_id END)::DOUBLE AS breath_count, count(DISTINCT CASE WHEN break_id <> 0 THEN break_id END)::DOUBLE AS break_count, count(DISTINCT CASE WHEN set_id <> 0 THEN set_id END)::DOUBLE AS set_count FROM lab GROUP BY ALL),
blow AS (SELECT tid, {_FOUR('a', 'breath_amplitude')}, {_FOUR('d', 'breath_duration')} FROM (SELECT tid, breath_id, max(v) AS a, {_SECONDS} AS d FROM lab WHERE breath_id > 0 GROUP BY ALL) GROUP BY tid),
rest AS (SELECT tid, {_FOUR('d', 'break_duration')} FROM (SELECT tid, break_id, {_SECONDS} AS d FROM lab WHERE break_id > 0 GROUP BY ALL) GROUP BY tid),
day AS (SELECT *, sum(rows) OVER (PARTITION BY patient_id, act_date)::DOUBLE AS pressures_daily_count FROM head),
good AS (SELECT *, 1::DOUBLE AS pressures_completeness_score, seconds_above10 * 10 / rows * 100 AS percentage_above10, year(act_date) AS y, (dayofyear(act_date) - 1) // 7 AS w FROM day WHERE breath_count > 0 AND pressures_daily_count > {complete}),
total AS (SELECT *, sum(breath_count) OVER (PARTITION BY patient_id, act_date) AS bd, count(*) OVER (PARTITION BY patient_id, act_date) AS td, sum(breath_count) OVER (PARTITION BY patient_id, y, w) AS bw, count(*) OVER (PARTITION BY patient_id, y, w) AS tw FROM good)
SELECT patient_id, tid AS treatment_id, act_date, pressures_completeness_score, td / d AS treatment_day_adherence_score, bd / d / s / b AS breaths_day_adherence_score, tw / d / 7 AS treatment_week_adherence_score, bw / d / s / b / 7 AS breaths_week_adherence_score, percent_time_breathing,
  {', '.join(f'{k}_{n}' for n in ('breath_amplitude', 'breath_duration', 'break_duration') for k in ('mean', 'min', 'max', 'sd'))}, breath_count, break_count, set_count, pressures_daily_count, treatment_start, treatment_end, treatment_length, seconds_above10, percentage_above10
FROM total JOIN ({devices}) USING (patient_id) LEFT JOIN blow USING (tid) LEFT JOIN rest USING (tid)"""


def rounded(sql: str, columns: list[str]) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({sql})"
