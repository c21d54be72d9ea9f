"""Input checks as one-pass aggregates: each returns a one-row report of booleans; `demand` raises on the first false."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Admissible ranges.
PRESSURE = (-20.0, 119.0)
STEPS = (0.0, 50_000.0)
HEART = (30.0, 220.0)


def check_schema(df: DataFrame, schema: StructType) -> None:
    """Raises unless df has the schema's columns and types, in any order."""
    want, have = {(f.name, f.dataType.simpleString()) for f in schema}, {(f.name, f.dataType.simpleString()) for f in df.schema}
    if want != have:
        raise ValueError(f"missing: {sorted(want - have)}; unexpected: {sorted(have - want)}")


def require(df: DataFrame, schema: StructType) -> DataFrame:
    """df; raises unless it has the schema's columns and types, whatever else it has."""
    have = {(f.name, f.dataType.simpleString()) for f in df.schema}
    if lacking := sorted({(f.name, f.dataType.simpleString()) for f in schema} - have):
        raise ValueError(f"missing: {lacking}")
    return df


def in_range(column: str, low: float, high: float) -> Column:
    """Aggregate: all values lie within the closed range."""
    return F.coalesce((F.min(column) >= low) & (F.max(column) <= high), F.lit(True))


def finite(column: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf")), 1).otherwise(0)) == 0, F.lit(True))


def all_of(condition: Column) -> Column:
    """Aggregate: the condition holds for every row."""
    return F.coalesce(F.min(F.coalesce(condition, F.lit(False)).cast("int")) == 1, F.lit(True))


def complete(df: DataFrame) -> Column:
    missing = F.lit(False)
    for f in df.schema:
        missing = missing | F.col(f.name).isNull()
    return F.coalesce(F.sum(F.when(missing, 1).otherwise(0)) == 0, F.lit(True))


def known(df: DataFrame, column: str, link: DataFrame, link_column: str) -> DataFrame:
    """One row: whether all ids are in the link table."""
    strangers = df.select(column).distinct().join(link.select(F.col(link_column).alias(column)), column, "left_anti")
    return strangers.agg((F.count(F.lit(1)) == 0).alias("known_ids"))


def uncovered(sessions: DataFrame, metadata: DataFrame, key: str = "session_id") -> DataFrame:
    """Sessions without metadata."""
    return sessions.select(key).distinct().join(metadata.select(key), key, "left_anti")


def raw_pressure_report(raw: DataFrame, link: DataFrame) -> DataFrame:
    values = raw.agg(in_range("pressurevalues", *PRESSURE).alias("values_in_range"), finite("pressurevalues").alias("finite"))
    return values.join(F.broadcast(known(raw, "patient_record_id", link, "patient_record_id")))  # one row each


def dates_report(samples: DataFrame, link: DataFrame, as_of: str, key: str = "userid", link_key: str = "hub_id", shift_hours: int = 1) -> DataFrame:
    """One row: no time after `as_of` and none before the person's recruitment; times are shifted for summer time."""
    people = link.select(F.col(link_key).alias(key), "date_recruited")
    day = F.to_date(F.col("time") + F.expr(f"interval {shift_hours} hours"))
    joined = samples.select(key, day.alias("day")).join(people, key, "left")
    none = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)) == 0, F.lit(True))
    return joined.agg(none(F.col("day") > F.to_date(F.lit(as_of))).alias("not_in_future"), none(F.col("day") < F.col("date_recruited")).alias("after_recruitment"))


def samples_report(samples: DataFrame, link: DataFrame, as_of: str, kind: str) -> DataFrame:
    """The eight checks of heart-rate (kind "heart") or step samples (userid, time, value)."""
    low, high = HEART if kind == "heart" else STEPS
    types = {f.name: f.dataType.simpleString() for f in samples.schema}
    wrong = [types.get("userid") != "string", types.get("time") != "timestamp", types.get("value") not in ("double", "int", "bigint", "float")]
    values = samples.agg(complete(samples).alias("complete"), finite("value").alias("finite"), in_range("value", low, high).alias("in_range"))
    values = values.withColumns({"column_names": F.lit({"userid", "time", "value"} <= set(samples.columns)), "column_types": F.lit(not all(wrong)), "column_number": F.lit(len(samples.columns) == 3)})
    return values.join(F.broadcast(dates_report(samples, link, as_of))).join(F.broadcast(known(samples, "userid", link, "hub_id")))  # one row each


def refuse(found: dict[str, bool | None]) -> None:
    """Raises with the names of the checks that failed."""
    failed = [k for k, v in found.items() if v is False]
    if failed:
        raise ValueError(f"failed: {', '.join(failed)}")


def demand(report: DataFrame) -> None:
    refuse(report.first().asDict())


class Gate:
    """Checks that are gathered while rows pass on their way to a table, and asked for once they are written. They cost no scan
    of their own; each is an aggregate that rows counted twice (a task done again) do not change."""

    def __init__(self, checks: dict[str, Column]):
        self.checks, self.seen = checks, []

    def _named(self) -> list[Column]:
        return [c.alias(k) for k, c in self.checks.items()]

    def watch(self, rows: DataFrame) -> DataFrame:
        self.seen.append((Observation(), rows))
        return rows.observe(self.seen[-1][0], *self._named())

    def demand(self) -> None:
        """Raises unless all that was watched, and written since, has passed."""
        for seen, rows in self.seen:
            try:
                found = seen.get
            except Py4JJavaError:  # nothing came of the rows: adaptive execution has dropped what gathers the metrics
                found = rows.agg(*self._named()).first().asDict()
            refuse(found)


def pressure_gate() -> Gate:
    """Of raw pressure rows beside `known` (whether the patient is linked). Missing values are dropped later, and no fault."""
    return Gate({"values_in_range": in_range("pressurevalues", *PRESSURE), "finite": all_of(F.col("pressurevalues").isNull() | (F.abs("pressurevalues") < float("inf"))), "known_ids": all_of(F.col("known"))})


def samples_gate(kind: str, as_of: str | None = None, shift_hours: int = 1) -> Gate:
    """Of heart-rate ("heart") or step samples (userid, time, value) beside `date_recruited` (null for strangers)."""
    low, high = HEART if kind == "heart" else STEPS
    day = F.to_date(F.col("time") + F.expr(f"interval {shift_hours} hours"))
    checks = {"complete": all_of(F.col("value").isNotNull() & F.col("time").isNotNull()), "finite": finite("value"), "in_range": in_range("value", low, high), "known_ids": all_of(F.col("date_recruited").isNotNull()), "after_recruitment": all_of(F.coalesce(day >= F.col("date_recruited"), F.lit(True)))}
    return Gate(checks | ({"not_in_future": all_of(day <= F.to_date(F.lit(as_of)))} if as_of else {}))
