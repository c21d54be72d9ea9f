"""What surrounds the features: devices, games, study phases, demographics, outlier flags, weekly scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.calendar import jan_week, season
from ..functions.stats import nan_to_null

WEEK_GOAL = 420


def patient_devices(devices: DataFrame, link: DataFrame) -> DataFrame:
    """Devices of the linked patients."""
    ids = link.select("study_email", F.col("patient_record_id").alias("patient_id"))
    return devices.join(ids, "study_email").withColumn("study_email", F.col("study_email").cast("double"))


def distinct_ids(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def with_games(features: DataFrame, games: DataFrame, link: DataFrame) -> DataFrame:
    """Adds games (1 on days on which the patient played, else 0) and games_played (their names in order, or "0")."""
    ids = link.select(F.col("hub_id").alias("userid"), F.col("patient_record_id").alias("patient_id"))
    played = games.join(ids, "userid").groupBy("patient_id", F.col("date").alias("act_date")).agg(F.array_join(F.sort_array(F.collect_set("display_name")), ",").alias("games_played"))
    out = features.join(played, ["patient_id", "act_date"], "left")
    return out.withColumn("games", F.col("games_played").isNotNull().cast("double")).withColumn("games_played", F.coalesce("games_played", F.lit("0")))


def phase_dates(link: DataFrame) -> DataFrame:
    """Each phase's first day: the recorded one, or so many days after the phase before, none after withdrawal."""
    clamp = lambda c: F.least(c, F.col("date_withdrawn"))
    out = link.withColumn("phase_start", F.date_add("date_recruited", 1))
    out = out.withColumn("phase_feedback", clamp(F.coalesce("date_feedback_start", F.date_add("phase_start", 60))))
    out = out.withColumn("phase_gaming", clamp(F.coalesce("date_gaming_start", F.date_add("phase_start", 120))))
    out = out.withColumn("phase_gaming_ended", clamp(F.coalesce("date_gaming_ended", F.date_add("phase_gaming", 240))))
    return out.withColumn("phase_feedback_ended", clamp(F.coalesce("date_feedback_end", F.date_add("phase_feedback", 365))))


def phase_of(date: Column) -> Column:
    """The phase of a date beside phase_dates; the latest that applies."""
    names = (("phase_feedback_ended", "feedback ended"), ("phase_gaming_ended", "gaming ended"), ("phase_gaming", "gaming"), ("phase_feedback", "feedback"))
    out = F.lit("blind")
    for column, name in reversed(names):
        out = F.when(date >= F.col(column), name).otherwise(out)
    return out


def with_phase(features: DataFrame, link: DataFrame, date: str = "act_date") -> DataFrame:
    dates = phase_dates(link).select(F.col("patient_record_id").alias("patient_id"), "phase_feedback", "phase_gaming", "phase_gaming_ended", "phase_feedback_ended")
    out = features.join(dates, "patient_id", "left").withColumn("phase", phase_of(F.col(date)))
    return out.drop("phase_feedback", "phase_gaming", "phase_gaming_ended", "phase_feedback_ended")


def demographics(date: Column, age: Column, recruited: Column) -> dict[str, Column]:
    days = F.datediff(date, recruited)
    return {"decimal_age": F.round(age + days / F.lit(7.0) / F.lit(52.25), 2), "day_in_study": days.cast("double"), "day_of_week": F.date_format(date, "EEEE"), "month": F.month(date).cast("double"), "season": season(date).cast("double")}


def with_demographics(features: DataFrame, link: DataFrame, sex: DataFrame, key: str = "patient_id", link_key: str = "patient_record_id", date: str = "act_date") -> DataFrame:
    people = link.select(F.col(link_key).alias(key), F.col("study_email").cast("double").alias("study_email"), F.col("age_recruited").cast("double").alias("age_recruited"), "date_recruited")
    out = features.join(people, key).join(sex.select(F.col("study_email").cast("double").alias("study_email"), "gender"), "study_email")
    return out.withColumns(demographics(F.col(date), F.col("age_recruited"), F.col("date_recruited")))


def with_treatment_order(features: DataFrame, as_of: str) -> DataFrame:
    """Adds day_treatment (the treatment's number on its day) and tr_start_time (its time of day, on the day `as_of`)."""
    w = Window.partitionBy("patient_id", "act_date").orderBy("treatment_start", "treatment_id")
    return features.withColumn("day_treatment", F.row_number().over(w).cast("double")).withColumn("tr_start_time", F.to_timestamp(F.concat(F.lit(f"{as_of} "), F.date_format("treatment_start", "HH:mm:ss"))))


def with_week_score(features: DataFrame, value: str = "mvpa_15_prev_method", goal: float = WEEK_GOAL) -> DataFrame:
    out = features.withColumn("week_n", jan_week(F.col("date")).cast("double")).withColumn("year", F.year("date").cast("double"))
    total = F.sum(value).over(Window.partitionBy("userid", "year", "week_n"))
    return out.withColumn("mvpa_week", total).withColumn("mvpa_week_score", total / goal)


def numeric_columns(df: DataFrame, logical: bool = False) -> list[str]:
    found = [f.name for f in df.schema if isinstance(f.dataType, NumericType) or logical and f.dataType.simpleString() == "boolean"]
    if not found:
        raise ValueError("no numeric column")
    return found


def quartiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float] = (0.25, 0.75)) -> dict[str, list[float | None]]:
    """Exact percentiles of each column, interpolated, nulls and NaN left out (None for a column without values).

    Sketches bracket each percentile; the values below the brackets are counted, and only those inside are told apart (by
    their counts). So what one task or the driver sees is a small share of the rows, whatever the values are.
    """
    places = [(c, q) for c in columns for q in shares]
    df = df.select(*(nan_to_null(F.col(c)).alias(c) for c in columns))
    n = df.agg(*(F.count(c).alias(c) for c in columns)).first()
    accuracy = min(1_000_000, max(10_000, *(n[c] // 10_000 for c in columns)))
    pad = {c: 2 / accuracy + 1.5 / max(1, n[c]) for c in columns}  # the sketch's error, and the next row
    ends = [x for c, q in places for x in (max(0.0, q - pad[c]), min(1.0, q + pad[c]))]
    near = df.agg(*(F.percentile_approx(c, ends[2 * k : 2 * k + 2], accuracy).alias(f"r{k}") for k, (c, _) in enumerate(places))).first()
    some = [k for k, (c, _) in enumerate(places) if n[c]]
    if not some:
        return {c: [None] * len(shares) for c in columns}
    below = df.agg(*(F.count(F.when(F.col(places[k][0]) < near[f"r{k}"][0], 1)).alias(f"b{k}") for k in some)).first()
    inside = F.array(*(F.struct(F.lit(k).alias("k"), F.when(F.col(places[k][0]).between(*near[f"r{k}"]), F.col(places[k][0]).cast("double")).alias("v")) for k in some))
    told = df.select(F.explode(inside).alias("x")).filter("x.v is not null").groupBy("x.k", "x.v").agg(F.count("*").alias("n")).collect()  # brackets of a few rows in `accuracy`
    out: dict[str, list[float | None]] = {c: [] for c in columns}
    for k, (c, q) in enumerate(places):
        if k not in some:
            out[c].append(None)
            continue
        at, place, values = (n[c] - 1) * q, below[f"b{k}"], []
        for r in sorted((r for r in told if r.k == k), key=lambda r: r.v):
            values += [r.v] * sum(place <= i < place + r.n for i in {int(at), min(int(at) + 1, n[c] - 1)})
            place += r.n
        out[c].append(values[0] + (values[-1] - values[0]) * (at - int(at)))
    return out


def fences(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> dict[str, tuple[float | None, float | None]]:
    """The quartiles of each column less and plus k times their distance."""
    return {c: (None, None) if low is None else (low - k * (high - low), high + k * (high - low)) for c, (low, high) in quartiles(df, columns).items()}


def flag_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Adds <c>_is_out: at or beyond Tukey's fences. All rows stay. With equal quartiles, values equal to them are out.
    The flag of a missing value (null or NaN) is null."""
    names = [c for c in (columns or df.columns) if c in numeric_columns(df)]
    if not names:
        raise ValueError("no numeric column")
    found = fences(df, names, k)
    return df.select("*", *(((nan_to_null(F.col(c)) <= F.lit(found[c][0])) | (nan_to_null(F.col(c)) >= F.lit(found[c][1]))).alias(f"{c}_is_out") for c in names))


def drop_outliers(df: DataFrame, columns: Sequence[str] | None = None, ratio: float = 0.03, k: float = 1.5) -> DataFrame:
    """Without the rows that are outliers in a column of which fewer than `ratio` of the rows are."""
    flagged = flag_outliers(df, columns, k)
    flags = [c for c in flagged.columns if c.endswith("_is_out") and c not in df.columns]
    shares = flagged.agg(*(F.avg(F.col(c).cast("double")).alias(f"share_{c}") for c in flags))
    out = flagged.join(F.broadcast(shares))  # one row
    for c in flags:
        out = out.filter(~F.coalesce(F.col(c) & (F.col(f"share_{c}") < ratio), F.lit(False)))
    return out.select(*df.columns)
