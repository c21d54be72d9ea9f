"""Ordered-series operators as window expressions: runs, chains, crossings, look-backs, gaps, nearest rows.

Windows are partitioned by the series' keys, so one exchange on the keys serves all operators of a plan. Every order has
the caller's tiebreak. Keys with long series (hot keys) are bounded by time (days, sessions) in the callers, or scanned in
chunks (`scanned`): then no task has more rows of a series than a chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType
from pyspark.sql.pandas.types import to_arrow_type


def scanned(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], columns: dict[str, tuple[str, Column]], deal: bool = True) -> DataFrame:
    """df with columns that run along whole series, which are scanned in chunks. `chunk` must rise with the order, the order be
    total, and neither it nor a key be null. columns: {name: (kind, value)}, the kinds being "sum" and "last" (not null) up to
    a row, "next" (not null) from a row on, "lag" and "lead" (of the row before or behind; null at the end).

    Each chunk is summed up; the sums, one row a chunk, are carried along the series; each row combines its place in its chunk
    with what was carried to it. Rows are dealt by key and chunk, unless they are already (deal).
    """
    parts, row = [*keys, chunk], F.struct(*order)
    here, back = Window.partitionBy(*parts).orderBy(*order), Window.partitionBy(*parts).orderBy(*(F.col(c).desc() for c in order))
    carried_on = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried_back = Window.partitionBy(*keys).orderBy(F.col(chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    up_to, down_to = (w.rowsBetween(Window.unboundedPreceding, 0) for w in (here, back))
    held = lambda v: F.struct(v.alias("v"))  # noqa: E731  # a null value is not a missing row
    placed = lambda v: F.struct(row.alias("at"), held(v).alias("v"))
    told = lambda v: F.when(v.isNotNull(), placed(v))
    kinds = {  # of a chunk, carried to a chunk, within a chunk
        "sum": (F.sum, lambda c: F.sum(c).over(carried_on), lambda v: F.sum(v).over(up_to)),
        "last": (lambda v: F.max(told(v))["v"], lambda c: F.last(c, ignorenulls=True).over(carried_on), lambda v: F.last(F.when(v.isNotNull(), held(v)), ignorenulls=True).over(up_to)),
        "next": (lambda v: F.min(told(v))["v"], lambda c: F.last(c, ignorenulls=True).over(carried_back), lambda v: F.last(F.when(v.isNotNull(), held(v)), ignorenulls=True).over(down_to)),
        "lag": (lambda v: F.max(placed(v))["v"], lambda c: F.last(c).over(carried_on), lambda v: F.lag(held(v)).over(here)),
        "lead": (lambda v: F.min(placed(v))["v"], lambda c: F.last(c).over(carried_back), lambda v: F.lag(held(v)).over(back)),
    }
    rows = spread(df, parts) if deal else df
    sums = rows.groupBy(*parts).agg(*(kinds[kind][0](v).alias(f"__{name}") for name, (kind, v) in columns.items()))
    carried = sums.select(*parts, *(kinds[kind][1](F.col(f"__{name}")).alias(f"__{name}") for name, (kind, _) in columns.items()))
    out = rows.withColumns({name: kinds[kind][2](v) for name, (kind, v) in columns.items()}).join(carried, parts, "left")
    for name, (kind, _) in columns.items():
        own, come = F.col(name), F.col(f"__{name}")
        some = F.when(own.isNotNull() | come.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(come, F.lit(0)))
        out = out.withColumn(name, some if kind == "sum" else F.coalesce(own, come)["v"])
    return out.select(*df.columns, *columns)


def with_long_runs(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], flag: Column, run: str = "run", length: str = "run_length") -> DataFrame:
    """with_runs in chunks (see scanned). A run's length comes from the places of its first and last row, so that it may be as
    long as its series."""
    flagged = F.struct(F.col("__f").alias("f"))
    out = scanned(df.withColumn("__f", flag), keys, chunk, order, {"__before": ("lag", flagged), "__behind": ("lead", flagged), "__at": ("sum", F.lit(1))})
    differs = lambda c: F.when(F.col(c).isNull(), True).otherwise(~F.col(f"{c}.f").eqNullSafe(F.col("__f")))
    out = out.withColumns({"__new": differs("__before"), "__over": differs("__behind")})
    ends = {run: ("sum", F.col("__new").cast("int")), "__first": ("last", F.when(F.col("__new"), F.col("__at"))), "__last": ("next", F.when(F.col("__over"), F.col("__at")))}
    out = scanned(out, keys, chunk, order, ends, deal=False)
    return out.withColumn(length, F.col("__last") - F.col("__first") + 1).select(*df.columns, run, length)


def long_run_totals(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], flag: Column, least: dict[str, int]) -> DataFrame:
    """run_totals in chunks."""
    runs = with_long_runs(df.withColumn("__flag", F.coalesce(flag, F.lit(False))), keys, chunk, order, F.col("__flag"))
    return runs.groupBy(*keys).agg(*(F.sum(F.when(F.col("__flag") & (F.col("run_length") >= n), 1).otherwise(0)).alias(name) for name, n in least.items()))


def with_long_lookback(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], active: Column, seconds: Column, before: int, name: str = "any_active") -> DataFrame:
    """Adds whether a row up to this one, of the last so many seconds, is active; in chunks. Rows of one time see those before them
    in the order."""
    out = scanned(df.withColumn("__s", seconds), keys, chunk, order, {"__when": ("last", F.when(active, F.col("__s")))})
    return out.withColumn(name, F.coalesce(F.col("__s") - F.col("__when") <= before, F.lit(False))).drop("__s", "__when")


def with_long_upcrossings(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], value: Column, threshold: Column, name: str = "up") -> DataFrame:
    """upcrossing in chunks."""
    out = scanned(df.withColumn("__v", F.coalesce(value, F.lit(0.0))), keys, chunk, order, {"__p": ("lag", F.col("__v"))})
    return out.withColumn(name, (F.col("__p") < threshold) & (threshold < F.col("__v"))).drop("__v", "__p")


def with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, run: str = "run", length: str = "run_length") -> DataFrame:
    """Adds the number of each run of equal `flag` among the rows in order, and its length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("__f", flag).withColumn("__new", F.when(F.col("__f").eqNullSafe(F.lag("__f").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    out = out.withColumn(run, F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn(length, F.count(F.lit(1)).over(Window.partitionBy(*keys, run))).drop("__f", "__new")


def run_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, least: dict[str, int]) -> DataFrame:
    """Per key, the rows that stand in runs of `flag` of at least so many rows; least: {name: length}."""
    runs = with_runs(df.withColumn("__flag", F.coalesce(flag, F.lit(False))), keys, order, F.col("__flag"))
    return runs.groupBy(*keys).agg(*(F.sum(F.when(F.col("__flag") & (F.col("run_length") >= n), 1).otherwise(0)).alias(name) for name, n in least.items()))


def with_chains(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, position: Column, length: str = "chain_length") -> DataFrame:
    """Adds to flagged rows the length of their chain: flagged rows whose positions follow each other by one."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__f", F.coalesce(flag, F.lit(False)))
    out = out.withColumn("__c", F.when(F.col("__f"), position - F.sum(F.col("__f").cast("int")).over(w)))
    return out.withColumn(length, F.when(F.col("__f"), F.count(F.lit(1)).over(Window.partitionBy(*keys, "__f", "__c")))).drop("__f", "__c")


def chain_total(flagged: Column, length: Column, least: int) -> Column:
    """Aggregate: the flagged rows in chains of at least two and at least so many."""
    return F.sum(F.when(flagged & (length >= max(2, least)), 1).otherwise(0))


def length_total(place: Column, least: int) -> Column:
    """Aggregate: the rows of runs of at least so many rows, from each row's place in its run (1, 2, ..., null outside): a run
    brings `least` when it gets that long, and 1 for each row more."""
    least = max(1, least)
    return F.coalesce(F.sum(F.when(place == least, least).when(place > least, 1)), F.lit(0))


def upcrossing(value: Column, threshold: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Whether the value rose strictly through the threshold since the row before; missing values count as 0."""
    v = F.coalesce(value, F.lit(0.0))
    return (F.lag(v).over(Window.partitionBy(*keys).orderBy(*order)) < threshold) & (threshold < v)


def any_within(value: Column, keys: Sequence[str], seconds: Column, before: int) -> Column:
    """Whether a value above 0 occurred in the last so many seconds, now included."""
    return F.coalesce(F.max(value).over(Window.partitionBy(*keys).orderBy(seconds).rangeBetween(-before, 0)) > 0, F.lit(False))


def sessionise(sessions: DataFrame, keys: Sequence[str], start: str, end: str, session: str, gap_seconds: int = 3600, name: str = "treatment_id") -> DataFrame:
    """Names each session by the first of its group: a group begins where the previous session (by start) ended at least
    `gap_seconds` before. Only the previous row's end counts, also if an earlier session ended later."""
    w = Window.partitionBy(*keys).orderBy(start, session)
    gap = (F.unix_micros(F.col(start)) - F.unix_micros(F.lag(end).over(w))) >= gap_seconds * 1_000_000
    head = F.when(F.coalesce(gap, F.lit(True)), F.col(session))
    return sessions.withColumn("__head", head).withColumn(name, F.last("__head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__head")


def nearest_date(probes: DataFrame, history: DataFrame, key: str, date: str, history_date: str, columns: Sequence[str]) -> DataFrame:
    """probes with the columns of the key's history row whose date is nearest, the earlier one of two. Unmatched keys keep
    nulls. probes must be unique by (key, date).

    Both sides are put in one order, in which each probe sees the last history row up to it and the first one from it on:
    the work is that of a sort, however long a key's history is. Of a key's history rows of one date, the one of least
    columns counts.
    """
    row = F.struct(F.col(history_date).cast("date").alias("d"), *columns)
    told = history.filter(F.col(history_date).isNotNull()).groupBy(key, F.col(history_date).cast("date").alias("__at")).agg(F.min(row).alias("__row"))
    both = probes.withColumn("__at", F.col(date).cast("date")).withColumn("__probe", F.lit(True)).unionByName(told.withColumn("__probe", F.lit(False)), allowMissingColumns=True)
    up, down = Window.partitionBy(key).orderBy("__at", "__probe"), Window.partitionBy(key).orderBy(F.col("__at").desc(), "__probe")
    before = F.last("__row", ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, 0))
    after = F.last("__row", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("__a", before).withColumn("__b", after).filter("__probe")
    far = lambda c: F.abs(F.datediff("__at", F.col(f"{c}.d")))
    best = F.when(F.col("__b").isNull() | (F.col("__a").isNotNull() & (far("__a") <= far("__b"))), F.col("__a")).otherwise(F.col("__b"))
    best = F.when(F.col("__at").isNull(), F.coalesce("__a", "__b")).otherwise(best)
    return both.withColumn("__best", best).select(*probes.columns, *(F.col(f"__best.{c}").alias(c) for c in columns))


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df dealt by the keys into the session's number of shuffle partitions. Without a number, adaptive execution puts few
    bytes of much work into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def with_kernel(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], name: str, kind: DataType, together: int = 20_000, place: str | None = None) -> DataFrame:
    """df with a column that kernel(values, starts) computes from whole series, in order; starts are the places at which the
    series of a call begin. Many series go into one call. A task holds its batch and one series. `place` names a column for the
    row's place in its series (1, 2, ...), by which rows that are equal in the order are told apart from then on."""
    placed = spread(df, keys).sortWithinPartitions(*keys, *order)
    names, arrow = df.columns, to_arrow_type(kind)
    at, own = names.index(value), [names.index(k) for k in keys]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                values = table.column(at).to_numpy().astype(float)
                out = table.append_column(name, pa.array(kernel(values, np.flatnonzero(fresh)), arrow))
                if place:
                    rows_at = np.arange(len(fresh))
                    out = out.append_column(place, pa.array(rows_at - np.maximum.accumulate(np.where(fresh, rows_at, 0)) + 1, pa.int64()))
                yield from out.combine_chunks().to_batches()

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < together:
                continue
            table = pa.Table.from_batches(held)
            fresh = _fresh(table, own)
            last = int(np.flatnonzero(fresh)[-1])  # the last series may go on
            yield from done(table.slice(0, last), fresh[:last])
            held, rows = table.slice(last).to_batches(), table.num_rows - last
        if rows:
            table = pa.Table.from_batches(held)
            yield from done(table, _fresh(table, own))

    places = [StructField(place, LongType())] if place else []
    return placed.mapInArrow(scan, StructType([*df.schema.fields, StructField(name, kind), *places]))


def _fresh(table: pa.Table, keys: Sequence[int]) -> np.ndarray:
    """Where a row's key differs from that of the row before."""
    fresh = np.zeros(table.num_rows, dtype=bool)
    fresh[:1] = True
    for k in keys:
        ids = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        ids = (ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids).indices.to_numpy()
        fresh[1:] |= ids[1:] != ids[:-1]
    return fresh


def first_differences(value: Column, keys: Sequence[str], order: Sequence[str]) -> Column:
    return value - F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
