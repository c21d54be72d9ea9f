"""What a table holds, by unit (session, treatment, day): kept as a small table of its own, brought up to date part by part.

The index has, for each part of the table and each unit in it, first and last time, the number of rows, and further
minima. Bringing it up to date reads only parts that it does not know (told from two listings), and forgets those that are
gone; a unit in several parts is put together when the index is read. Rows of some units are read from the parts that
hold any of them, and from no others. So what a run costs grows with what is new, not with what is there.

Where a store cannot tell parts (tables without runs in catalogs and databases), the same is computed from the whole table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import PART, Store


@dataclass(frozen=True)
class Index:
    """keys: the unit's columns, each as SQL text over the table's rows; lows: further minima, likewise."""

    store: Store
    table: str
    keys: dict[str, str]
    time: str = "time"
    lows: dict[str, str] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.table}_index"

    def _of(self, rows: DataFrame, *by: str) -> DataFrame:
        named = rows.select(*by, *(F.expr(e).alias(k) for k, e in self.keys.items()), F.col(self.time).alias("first"), F.col(self.time).alias("last"), F.lit(1).cast("long").alias("n"), *(F.expr(e).alias(k) for k, e in self.lows.items()))
        return self._merged(named, *by)

    def _merged(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by, *self.keys).agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), *(F.min(k).alias(k) for k in self.lows))

    def stale(self) -> tuple[set[str], set[str]] | None:
        """The table's parts that the index does not know, and those it knows that are gone; None where parts cannot be told."""
        parts = self.store.parts(self.table)
        if parts is None:
            return None
        known = self.store.parts(self.name) or set()
        return parts - known, known - parts

    def refresh(self) -> Index:
        """Reads the parts that are new. Broken off and done again it gives the same."""
        if found := self.stale():
            fresh, gone = found
            if gone:
                self.store.drop_parts(self.name, gone)
            if fresh:
                self.store.write(self._of(self.store.read_parts(self.table, fresh), PART), self.name, "partitions", [PART])
        return self

    def _rows(self) -> DataFrame | None:
        if not self.store.tells_parts(self.table) or not self.store.exists(self.name):
            return None
        return self.store.read(self.name, runs=True)

    def spans(self) -> DataFrame:
        """(keys, first, last, n, lows) of every unit."""
        rows = self._rows()
        return self._of(self.store.read(self.table)) if rows is None else self._merged(rows)

    def parts_of(self, units: DataFrame) -> set[str] | None:
        """The parts that hold rows of the units (some of the keys)."""
        rows = self._rows()
        if rows is None:
            return None
        return {r[0] for r in rows.join(units.distinct(), units.columns, "left_semi").select(F.col(PART).cast("string")).distinct().collect()}  # folders, not rows

    def read(self, units: DataFrame) -> DataFrame:
        """The table's rows of the units (some of the keys)."""
        parts = self.parts_of(units)
        rows = self.store.read(self.table) if parts is None else self.store.read_parts(self.table, parts).drop(PART)
        names = {k: f"__{k}" for k in units.columns}
        told = rows.withColumns({n: F.expr(self.keys[k]) for k, n in names.items()})
        return told.join(units.withColumnsRenamed(names), list(names.values()), "left_semi").drop(*names.values())
