"""What the operators share on the Spark side: durable cuts of lineage, size-checked broadcasts, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder. Only a session
    in one process (as in tests) gets a temporary one where neither is set."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    context, scala = spark.sparkContext, spark.sparkContext._jsc.sc()
    if scala.getCheckpointDir().isEmpty():
        if not set_to and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="checkpoints-"))
    return set_to or scala.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, kept in the shared folder, free of its lineage. Survives lost executors."""
    shared_dir(session(df))
    return df.checkpoint()


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df marked for broadcast if it has at most max_rows rows, unmarked (a shuffled join) beyond."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """The given names, each with as many underscores before it as make it new to df."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, for every node that reaches a smaller one.

    Alternating large-star and small-star rounds. Each round is joins and minima on the edges alone; a star's hub is
    met by partial aggregation and by the planner's skew splitting, never by collecting its neighbours.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = cut(e)
    for _ in range(most_rounds):
        # Done when every node points at one root: none points twice, and none that is pointed at points on.
        twice = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u")
        onward = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        if not twice.unionByName(onward).limit(1).count():
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small_star = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = cut(small_star.filter("u <> v").distinct())
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def small_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on at most so many bytes travel to a Python worker at once, however long the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def bitmap(wanted: DataFrame, least: int = 1 << 20, most: int = 1 << 30) -> np.ndarray:
    """A power of two of bits, those set that the wanted ids hash to: a filter that loses no id and lets few others pass. It
    has eight bits for each row of wanted, and 128 MB at most (beyond a hundred million ids it lets more pass)."""
    n = wanted.count()
    bits = min(most, max(least, 1 << (8 * n).bit_length()))
    slot = F.pmod(F.xxhash64("id"), F.lit(bits)).alias("s")
    words = wanted.select(slot).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return out


def rows_in(df: DataFrame, id_col: str, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows of df whose id's bit is set, or not set, with all their columns."""
    held, names = df.sparkSession.sparkContext.broadcast(bits), list(range(len(df.columns)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column(len(names)).to_numpy()
            hit = (held.value[s >> 6] >> (s & 63)) & 1 == 1
            yield batch.select(names).filter(pa.array(hit == inside))

    slot = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(64 * len(bits)))
    return df.select("*", slot.alias(unused(df, "slot")[0])).mapInArrow(scan, df.schema)


def texts_in(docs: DataFrame, bits: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows of docs (id, text) whose id's bit is set, or not set."""
    return rows_in(docs.select("id", "text"), "id", bits, inside)


def lacking(df: DataFrame, gone: DataFrame, id_col: str, most: int = 500_000) -> DataFrame:
    """df without the rows whose id is in gone (id; distinct). Few ids are sent to all tasks; of many, only the rows that a
    filter lets through are shuffled."""
    name = unused(df, "gone")[0]
    gone = gone.select(F.col("id").alias(name))
    if gone.limit(most + 1).count() <= most:
        return df.join(F.broadcast(gone), F.col(id_col).cast("long") == F.col(name), "left_anti")
    bits = bitmap(gone.select(F.col(name).alias("id")))
    met = rows_in(df, id_col, bits).join(gone, F.col(id_col).cast("long") == F.col(name), "left_anti")
    return rows_in(df, id_col, bits, inside=False).unionByName(met)
