"""Sources, sinks and ledgers. A store is a folder of Parquet tables, a catalog, or a JDBC database; readers stay lazy.

Steps write a table in runs, and within a run by a label (a day or week), so that a table in a folder has a part for each
run and label. Runs and labels are partition columns that readers do not see. A table that others append to has a part
for each name of a file. Whoever notes which parts it has read (plans.index) later reads the others alone.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from dataclasses import dataclass, field
from datetime import date
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.stats import without_nan

#: Fixed value: a table that no sink may replace.
PROTECTED = ("pressure_raw_vals",)
#: The columns by which a step's rows are told apart, and those of an index by the part they are of; readers do not see them.
RUN, LABEL, PART = "_run", "_label", "_part"
HIDDEN = (RUN, LABEL, PART)
#: The label of a run without rows.
NONE = "none"


@dataclass(frozen=True)
class Store:
    """Tables by name: under `root` as Parquet, over JDBC with `jdbc` options, else in the session's catalog.

    Over JDBC a table that was written in runs is read by one task for each of `tasks` groups of runs, and another one by ranges
    of the numeric, date or time column that `split` names for it. Writers fill a staging table, which takes the place of
    what it replaces in one transaction of the database.
    """

    spark: SparkSession
    root: str | None = None
    jdbc: dict[str, str] = field(default_factory=dict)
    split: dict[str, str] = field(default_factory=dict)
    tasks: int = 8

    @property
    def _database(self) -> bool:
        return bool(self.jdbc) and not self.root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _place(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self, name: str) -> list[str]:
        """The paths of a folder table's files below its folder, other than what an unfinished write leaves. Spark lists them,
        on the executors where they are many."""
        place, system = self._place(self.path(name))
        if not system.exists(place):
            return []
        above = len(system.makeQualified(place).toUri().getPath()) + 1
        return [urlparse(unquote(x)).path[above:] for x in self.spark.read.schema("x int").parquet(self.path(name)).inputFiles()]

    def exists(self, name: str) -> bool:
        if self.root:
            return bool(self._files(name))
        if self._database:
            try:
                return bool(self._loader(name).load().schema) or True
            except Exception as e:  # the driver's own error class is not known here
                if "exist" in str(e).lower() or "not found" in str(e).lower():
                    return False
                raise
        return self.spark.catalog.tableExists(name)

    def read(self, name: str, schema: StructType | None = None, runs: bool = False) -> DataFrame:
        """The table, NaN as null; with the runs and labels of its rows only if asked for."""
        if self.root:
            reader = self.spark.read.schema(schema) if schema else self.spark.read
            df = reader.parquet(self.path(name))
        elif self._database:
            df = self._from_database(name)
        else:
            df = self.spark.table(name)
        return without_nan(df if runs else df.drop(*HIDDEN))

    def _loader(self, table: str):
        return self.spark.read.format("jdbc").options(dbtable=table, **self.jdbc)

    def _labels(self, name: str) -> list[str]:
        """The hidden columns of a database's table, by which its parts are told."""
        have = self._loader(name).load().columns
        return [c for c in HIDDEN if c in have]

    def _quoted(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.jdbc["url"]).quoteIdentifier(name)

    def _known_parts(self, name: str, labels: list[str]) -> list[tuple]:
        """The parts' labels, as the database tells them."""
        listed = ", ".join(map(self._quoted, labels))
        return sorted(map(tuple, self._loader(f"(SELECT DISTINCT {listed} FROM {name}) parts").load().collect()))  # a row for each part

    def _of_parts(self, name: str, labels: list[str], parts: list[tuple]) -> DataFrame:
        """Each task asks the database for some of the parts."""
        said = lambda v: "'" + str(v).replace("'", "''") + "'"
        asked = ["(" + " AND ".join(f"{self._quoted(c)} = {said(v)}" for c, v in zip(labels, part, strict=True)) + ")" for part in parts] or ["1 = 0"]
        each = -(-len(asked) // self.tasks)
        predicates = [" OR ".join(asked[k : k + each]) for k in range(0, len(asked), each)]
        rest = {k: v for k, v in self.jdbc.items() if k != "url"}
        return self.spark.read.jdbc(self.jdbc["url"], name, predicates=predicates, properties=rest)

    def _from_database(self, name: str) -> DataFrame:
        if labels := self._labels(name):
            return self._of_parts(name, labels, self._known_parts(name, labels))
        if name not in self.split:
            return self._loader(name).load()
        column = self._quoted(self.split[name])
        low, high = self._loader(f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {name}) ends").load().first()
        if low is None:
            return self._loader(name).load()
        if not isinstance(low, date):  # whole numbers; they only cut, and leave no row out
            low, high = math.floor(low), math.ceil(high)
        return self._loader(name).option("partitionColumn", self.split[name]).option("lowerBound", str(low)).option("upperBound", str(high)).option("numPartitions", self.tasks).load()

    def tells_parts(self, name: str) -> bool:
        if self.root or not self.exists(name):
            return bool(self.root)
        return bool(self._labels(name)) if self._database else any(c.isPartition and c.name in HIDDEN for c in self.spark.catalog.listColumns(name))

    def parts(self, name: str) -> set[str] | None:
        """The names of a table's parts, from a listing alone; None where they cannot be told (tables without runs in catalogs and databases)."""
        if self.root:
            return {self._part_of(below) for below in self._files(name)}
        if not self.tells_parts(name):
            return None
        if self._database:
            return {"/".join(map(str, part)) for part in self._known_parts(name, self._labels(name))}
        return {self._part_of(f"{r[0]}/x") for r in self.spark.sql(f"SHOW PARTITIONS {name}").collect()}

    @staticmethod
    def _part_of(below: str) -> str:
        *folders, file = below.split("/")
        labels = [unquote(x.partition("=")[2]) for x in folders if x.partition("=")[0] in HIDDEN]
        return "/".join(labels) or file

    def read_parts(self, name: str, parts: Collection[str]) -> DataFrame:
        """The rows of some parts, with the name of each one's part."""
        if self.root:
            wanted, folders = set(parts), set()
            for below in self._files(name):
                if self._part_of(below) in wanted:
                    folder, _, file = below.rpartition("/")
                    folders.add(folder if any(x.partition("=")[0] in HIDDEN for x in folder.split("/")) else f"{folder}/{file}".lstrip("/"))
            df = self.spark.read.option("basePath", self.path(name)).parquet(*(f"{self.path(name)}/{x}" for x in sorted(folders))) if folders else self.spark.read.parquet(self.path(name)).limit(0)
        elif self._database:
            df = self._of_parts(name, (own := self._labels(name)), [x for x in self._known_parts(name, own) if "/".join(map(str, x)) in set(parts)])
        else:
            df = self.spark.table(name)
        labels = [c for c in HIDDEN if c in df.columns]
        if not self.root and not self._database:  # sets of values prune partitions; their pairs are told apart below
            for k, c in enumerate(labels):
                df = df.filter(F.col(c).cast("string").isin({p.split("/")[k] for p in parts}))
        told = df.withColumn(PART, F.concat_ws("/", *(F.col(c).cast("string") for c in labels))) if labels else df.select("*", F.col("_metadata.file_name").alias(PART))
        return without_nan((told if self.root else told.filter(F.col(PART).isin(set(parts)))).drop(RUN, LABEL))

    def write(self, df: DataFrame, name: str, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
        """mode: append, overwrite, or "partitions" (replaces only the partitions that df has). Errors are not swallowed."""
        self._guard(name)
        if mode == "partitions" and not self.root and not self._database and self.exists(name):
            df.select(*self.spark.table(name).columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").insertInto(name)
            return
        writer = df.write.mode("overwrite" if mode == "partitions" else mode)
        if mode == "partitions":
            writer = writer.option("partitionOverwriteMode", "dynamic")
        if partition_by and not self._database:
            writer = writer.partitionBy(*partition_by)
        if self.root:
            writer.parquet(self.path(name))
        elif self._database:
            if mode == "partitions":
                self._swap(df, name, partition_by)
            else:
                writer.format("jdbc").options(dbtable=name, **self.jdbc).save()
        else:
            writer.saveAsTable(name)

    @staticmethod
    def _guard(name: str) -> None:
        if name.rpartition(".")[2] in PROTECTED:
            raise ValueError(f"{name} holds raw data and is not written")

    def write_run(self, df: DataFrame, name: str, run: str, label: Column | None = None) -> None:
        """Writes df as the rows of the given run in place of any that the run has left there before; with a label (text), in
        a part for each. Rows of one label go to as few files as their size allows."""
        self._guard(name)
        if label is not None:
            df = df.withColumn(LABEL, F.coalesce(label.cast("string"), F.lit(NONE)))
            df = df if self._database else df.hint("rebalance", LABEL)
        if self.root:  # the run's own folder; one without rows holds the schema
            place = f"{self.path(name)}/{RUN}={run}"
            writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
            (writer if label is None else writer.partitionBy(LABEL)).parquet(place)
            if label is not None and not self._files(f"{name}/{RUN}={run}"):
                df.drop(LABEL).limit(0).write.mode("overwrite").parquet(f"{place}/{LABEL}={NONE}")
            return
        rows = df.withColumn(RUN, F.lit(run))
        if self._database:
            self._swap(rows, name, [RUN], [(RUN, run)])
        else:
            if label is not None:  # the run's labels may have been others
                self.drop_run(name, run)
            self.write(rows, name, "partitions", [RUN] if label is None else [RUN, LABEL])

    def replace(self, df: DataFrame, name: str, label: Column) -> None:
        """Writes df in place of all that the table has under the same labels. Repeated after a failure it gives the same. Labels are
        dealt to all tasks, one file for each: they may be many, of few rows."""
        self._guard(name)
        rows = df.withColumn(LABEL, F.coalesce(label.cast("string"), F.lit(NONE)))
        if self.root and not self.exists(name):  # the schema, should there be no row
            df.limit(0).write.mode("overwrite").parquet(f"{self.path(name)}/{LABEL}={NONE}")
        self.write(rows if self._database else rows.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), LABEL), name, "partitions", [LABEL])

    def drop_run(self, name: str, run: str) -> None:
        """Removes what a run has written."""
        if self.root:
            place, system = self._place(f"{self.path(name)}/{RUN}={run}")
            system.delete(place, True)
        elif self.exists(name):
            if self._database:
                self._transact([(f"DELETE FROM {name} WHERE {self._quoted(RUN)} = ?", [run])])
            else:  # each by all of its columns: not every catalog takes some of them for all that match
                found = [r[0] for r in self.spark.sql(f"SHOW PARTITIONS {name} PARTITION ({RUN} = '{run}')").collect()]
                specs = (", ".join(f"{k} = '{unquote(v)}'" for k, _, v in (x.partition("=") for x in part.split("/"))) for part in found)
                if found:
                    self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS " + ", ".join(f"PARTITION ({spec})" for spec in specs))

    def drop_parts(self, name: str, parts: Collection[str]) -> None:
        """Removes parts of an index."""
        for part in parts:
            if self.root:
                for below in {x.rpartition("/")[0] for x in self._files(name) if self._part_of(x) == part}:
                    place, system = self._place(f"{self.path(name)}/{below}")
                    system.delete(place, True)
            elif self._database:
                self._transact([(f"DELETE FROM {name} WHERE {self._quoted(PART)} = ?", [part])])
            else:
                self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({PART} = '{part}')")

    def _swap(self, rows: DataFrame, name: str, by: Sequence[str], gone: Sequence[tuple[str, str]] = ()) -> None:
        """Puts rows in place of those that are equal to `gone`, or to any of them in the columns `by`: tasks fill a staging
        table, and one transaction deletes and inserts. A failure before its end leaves the table as it was."""
        stage, types = f"{name}__stage", ", ".join(f"{c} VARCHAR(128)" for c in HIDDEN if c in rows.columns)
        sink = lambda df, table, mode: df.write.mode(mode).format("jdbc").options(dbtable=table, createTableColumnTypes=types, **self.jdbc).save()
        sink(rows, stage, "overwrite")
        if not self.exists(name):
            sink(rows.limit(0), name, "append")
        listed = ", ".join(map(self._quoted, rows.columns))
        if gone:
            deletes = [(f"DELETE FROM {name} WHERE {self._quoted(c)} = ?", [v]) for c, v in gone]
        else:
            deletes = [(f"DELETE FROM {name} WHERE {self._quoted(by[0])} IN (SELECT {self._quoted(by[0])} FROM {stage})", [])]
        self._transact([*deletes, (f"INSERT INTO {name} ({listed}) SELECT {listed} FROM {stage}", [])])
        self._transact([(f"DROP TABLE {stage}", [])])

    def _transact(self, statements: Sequence[tuple[str, Sequence[str]]]) -> None:
        """All statements or none, through a connection of the driver's own."""
        settings = self.spark._jvm.java.util.Properties()
        for k in ("user", "password"):
            if k in self.jdbc:
                settings.setProperty(k, self.jdbc[k])
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.jdbc["url"], settings)
        try:
            connection.setAutoCommit(False)
            for sql, values in statements:
                statement = connection.prepareStatement(sql)
                for k, v in enumerate(values, 1):
                    statement.setString(k, v)
                statement.executeUpdate()
            connection.commit()
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    def drop(self, name: str) -> None:
        if self.root:
            place, system = self._place(self.path(name))
            system.delete(place, True)
        elif self._database:
            if self.exists(name):
                self._transact([(f"DROP TABLE {name}", [])])
        else:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def read_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """NaN is read as null."""
    reader = spark.read.option("header", True)
    return without_nan((reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path))


def remaining(units: DataFrame, ledger: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Distinct units that the ledger does not have yet."""
    todo = units.select(*keys).distinct()
    return todo if ledger is None else todo.join(ledger.select(*keys), list(keys), "left_anti")


def day_ledger(samples: DataFrame, user: str = "userid", time: str = "time") -> DataFrame:
    return samples.select(F.to_date(time).alias("date"), user).distinct()
