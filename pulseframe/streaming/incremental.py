"""Streams of heart-rate samples: days are cleaned once a later day has begun, late rows are dropped.

The batch ledger withholds a user's latest day and never revisits a day; on a stream the same is a watermark of one day
and append mode. Each micro-batch of finished days goes through the same cleaning plan as the batch step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import heart
from ..sources.tables import Store


def daily_totals(samples: DataFrame, late: str = "1 day") -> DataFrame:
    """(userid, date, total, samples) of a stream (userid, time, value), each day once it is over."""
    windows = samples.withWatermark("time", late).groupBy("userid", F.window("time", "1 day").alias("w"))
    return windows.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("samples")).select("userid", F.to_date("w.start").alias("date"), "total", "samples")


def finished_days(samples: DataFrame, late: str = "1 day") -> DataFrame:
    """(userid, date, rows) with a day's samples as an array, once it is over."""
    windows = samples.withWatermark("time", late).groupBy("userid", F.window("time", "1 day").alias("w"))
    return windows.agg(F.collect_list(F.struct("time", "value")).alias("rows")).select("userid", F.to_date("w.start").alias("date"), "rows")


def clean_stream(samples: DataFrame, store: Store, target: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Writes cleaned samples, one folder for each micro-batch, so that a repeated micro-batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("userid", "date", F.explode("rows").alias("x")).select("userid", "date", "x.time", "x.value")
        store.write(heart.clean(rows).withColumn("batch", F.lit(number)), target, "partitions", ["batch"])

    return finished_days(samples, late).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
