"""Streams with state against the batch operators on the same rows, late ones included."""

import random
from datetime import datetime, timedelta

import pytest

from pulseframe.operators import daily, treatments
from pulseframe.sources.schemas import HEART
from pulseframe.streaming import stateful

D0 = datetime(2024, 1, 1)
SPANS = "patient_id string, session_id string, session_start timestamp, session_end timestamp"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(stateful.ROCKS[0])
    spark.conf.set(*stateful.ROCKS)
    yield spark
    spark.conf.set(stateful.ROCKS[0], before)


def through(spark, schema, batches, folder, make, name):
    """The rows of a stream that reads a file for each batch."""
    places = [f"{folder}/{name}{k}" for k in range(len(batches))]
    for place, parts in zip(places, batches, strict=True):
        for k, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{place}/part={k}")
    streams = [spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place).drop("part") for place in places]
    out = f"{folder}/{name}-out"
    query = make(*streams).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/{name}-checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return spark.read.parquet(out)


def test_sessions_are_grouped_as_in_batch(rocks, tmp_path):
    """Sessions arrive up to some hours late and out of order; ties, nested sessions and gaps of exactly an hour are there."""
    spark, rng, rows = rocks, random.Random(3), []
    for p in "abc":
        start = D0
        for k in range(60):
            start += timedelta(minutes=rng.choice([0, 5, 30, 60, 70, 90, 300]))
            rows.append((p, f"{p}{k:02d}", start, start + timedelta(minutes=rng.choice([0, 10, 30, 45]))))
    arrival = sorted(rows, key=lambda r: r[2] + timedelta(hours=rng.random() * 5))
    cuts = [arrival[k : k + 30] for k in range(0, len(arrival), 30)]
    last = max(r[2] for r in rows)
    flush = [("z", "z0", last + timedelta(days=9), last + timedelta(days=9))], [("z", "z1", last + timedelta(days=30), last + timedelta(days=30))]
    late = [("a", "dropped", D0 - timedelta(days=20), D0)]
    got = through(spark, SPANS, [[*cuts, flush[0], [*late, *flush[1]]]], tmp_path, lambda s: stateful.grouped_sessions(s, "12 hours"), "sessions")
    want = treatments.grouped_sessions(treatments.with_date(spark.createDataFrame(rows, SPANS)))
    found = got.filter("patient_id <> 'z'")
    assert set(found.columns) == set(want.columns)
    assert sorted(map(tuple, found.select(want.columns).collect())) == sorted(map(tuple, want.collect())) and found.count() == 180


def test_minutes_are_joined_as_in_batch(spark, tmp_path):
    rng, sides = random.Random(5), []
    for _ in range(2):
        rows = [(rng.choice("uv"), D0 + timedelta(seconds=rng.randrange(0, 5400, 7)), rng.choice([float(rng.randrange(200)), float("nan") if rng.random() < 0.1 else 3.0])) for _ in range(300)]
        rows += rng.sample(rows, 40)  # sent twice
        arrival = sorted(rows, key=lambda r: r[1] + timedelta(minutes=rng.random() * 20))
        flush = [[("w", D0 + timedelta(days=d), 1.0)] for d in (2, 4, 6, 8)]
        sides.append((rows, [arrival[k : k + 120] for k in range(0, len(arrival), 120)] + flush))
    got = through(spark, HEART, [s[1] for s in sides], tmp_path, lambda s, h: stateful.combined_minutes(s, h, "1 hour"), "minutes").filter("userid <> 'w'")
    want = daily.combine_minutes(*(spark.createDataFrame(s[0], HEART) for s in sides))
    assert sorted(map(repr, got.select(want.columns).collect())) == sorted(map(repr, want.collect())) and got.count() > 150
