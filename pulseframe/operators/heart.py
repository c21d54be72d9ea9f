"""Cleaning rules for heart-rate samples of one user and day, as windows over (keys; time).

Each rule takes rows (keys..., time, value) and drops the rows that its closed form names; i counts a key's rows from 1
to n in time order. The rules keep the study's edge cases on purpose; they are spelled out with each rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .series import spread

DAY = ("userid", "date")
DEFAULT = 70  # Fixed value: what the sensor reports when it has no reading.


def _numbered(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*keys)
    return df.withColumn("__i", F.row_number().over(w.orderBy("time", "value"))).withColumn("__n", F.count(F.lit(1)).over(w))


def _from_here(keys: Sequence[str]) -> WindowSpec:
    """A row and all after it, as a running frame of the reversed order (a frame that follows without bound is computed anew
    for each row)."""
    return Window.partitionBy(*keys).orderBy(F.col("__i").desc()).rowsBetween(Window.unboundedPreceding, 0)


def _done(df: DataFrame, drop) -> DataFrame:
    return df.filter(~F.coalesce(drop, F.lit(False))).drop(*(c for c in df.columns if c.startswith("__")))


def drop_indexes(df: DataFrame, indexes: DataFrame, keys: Sequence[str] = DAY, index: str = "i") -> DataFrame:
    """Without the rows whose place in their key's order (from 1) is among indexes (keys, i)."""
    gone = indexes.select(*keys, F.col(index).cast("int").alias("__i")).distinct()
    return _numbered(df, keys).join(gone, [*keys, "__i"], "left_anti").select(*df.columns)


def drop_default_edges(df: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """Leading and trailing runs of the sensor's default.

    With L defaults in all (nothing happens below 2) and a leading run of m: rows 1 to min(m, L - 1) go. If row n is a
    default it goes; if row n - 1 is one too and L is at least 3, that goes as well, but no more than these two.
    """
    w = Window.partitionBy(*keys)
    rows = _numbered(df, keys).withColumn("__is", F.coalesce(F.col("value") == DEFAULT, F.lit(False)))
    rows = rows.withColumn("__L", F.sum(F.col("__is").cast("int")).over(w)).withColumn("__m", F.coalesce(F.min(F.when(~F.col("__is"), F.col("__i"))).over(w) - 1, F.col("__n")))
    rows = rows.withColumn("__last", F.max(F.when(F.col("__i") == F.col("__n"), F.col("__is"))).over(w))
    head = F.col("__i") <= F.least(F.col("__m"), F.col("__L") - 1)
    tail = F.col("__is") & F.col("__last") & ((F.col("__i") == F.col("__n")) | (F.col("__i") == F.col("__n") - 1) & (F.col("__L") >= 3))
    return _done(rows, (F.col("__L") >= 2) & (head | tail))


def drop_repeats(df: DataFrame, keys: Sequence[str] = DAY, longest: int = 10) -> DataFrame:
    """Maximal runs of equal values of more than `longest` rows within rows 2 to n - 1 (the first and last row stay)."""
    rows = _numbered(df, keys).withColumn("__in", (F.col("__i") > 1) & (F.col("__i") < F.col("__n")))
    w = Window.partitionBy(*keys, "__in").orderBy("__i")
    rows = rows.withColumn("__run", F.sum(F.when(F.col("value").eqNullSafe(F.lag("value").over(w)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__len", F.count(F.lit(1)).over(Window.partitionBy(*keys, "__in", "__run")))
    return _done(rows, F.col("__in") & (F.col("__len") > longest))


def drop_jump_islands(df: DataFrame, keys: Sequence[str] = DAY, percent: float = 15.0, rows_at_most: int = 5, below: float = 100.0, seconds: float = 30.0) -> DataFrame:
    """Islands of few rows between two jumps of at least `percent`, if the island's first value is below `below` and came
    less than `seconds` after the row before the island. A jump k stands between rows k and k + 1; any
    change from 0 is one."""
    w = Window.partitionBy(*keys).orderBy("__i")
    rows = _numbered(df, keys)
    rows = rows.withColumn("__next", F.lead("value").over(w)).withColumn("__step", F.unix_micros(F.lead("time").over(w)) - F.unix_micros("time"))
    change = F.abs(F.col("__next") - F.col("value"))
    jump = (change * 100 / F.nullif(F.col("value"), F.lit(0.0)) >= percent) | (F.col("value") == 0) & (change > 0)
    rows = rows.withColumn("__jump", F.when(jump, F.struct(F.col("__i").alias("k"), F.col("__next").alias("v"), F.col("__step").alias("t"))))
    a = F.last("__jump", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    b = F.min(F.col("__jump.k")).over(_from_here(keys))
    rows = rows.withColumn("__a", a).withColumn("__b", b)
    drop = (F.col("__b") - F.col("__a.k") <= rows_at_most) & (F.col("__a.v") < below) & (F.col("__a.t") < seconds * 1_000_000)
    return _done(rows, drop)


def drop_gap_islands(df: DataFrame, keys: Sequence[str] = DAY, gap_seconds: int = 120, rows_at_most: int = 20) -> DataFrame:
    """Islands of few rows between gaps of at least `gap_seconds`. A gap k stands between rows k and k + 1.

    Rows 2 to n - 1: the island reaches from the last gap before the row (or 1) to the first gap from the row on (or
    n - 1), and goes if these are at most `rows_at_most` apart. A gap at 1 drops rows 1 and 2, one at n - 1 drops rows
    n - 1 and n. Without gaps nothing goes.
    """
    whole = Window.partitionBy(*keys)
    w = whole.orderBy("__i")
    rows = _numbered(df, keys)
    gap = F.unix_micros(F.lead("time").over(w)) - F.unix_micros("time") >= gap_seconds * 1_000_000
    rows = rows.withColumn("__gap", F.when(gap, F.col("__i")))
    rows = rows.withColumn("__a", F.greatest(F.lit(1), F.last("__gap", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))))
    rows = rows.withColumn("__b", F.least(F.min("__gap").over(_from_here(keys)), F.col("__n") - 1))
    rows = rows.withColumn("__any", F.count("__gap").over(whole) > 0).withColumn("__first", F.min("__gap").over(whole) == 1).withColumn("__last", F.max("__gap").over(whole) == F.col("__n") - 1)
    middle = (F.col("__i") > 1) & (F.col("__i") < F.col("__n")) & (F.col("__b") - F.col("__a") <= rows_at_most)
    edge = F.col("__first") & (F.col("__i") <= 2) | F.col("__last") & (F.col("__i") >= F.col("__n") - 1)
    return _done(rows, F.col("__any") & (middle | edge))


def clean(samples: DataFrame, keys: Sequence[str] = DAY) -> DataFrame:
    """All rules in the study's order; gap islands twice. One exchange: repartition by the keys comes first."""
    out = spread(samples, keys)
    for rule in (drop_default_edges, drop_repeats, drop_jump_islands, drop_gap_islands, drop_gap_islands):
        out = rule(out, keys)
    return out
