import pytest
from pyspark.sql import functions as F

from corvane.streaming import events

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def run(stream, name, spark, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i // 4} 0{i % 4}:00:00", i % 2, "a" if i % 3 else "b", float((i * 7) % 10)) for i in range(16)]
    frame = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    for i in range(2):
        frame.filter(F.floor(F.col("event_id") / 8) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), frame


def test_windows_equal_batch(spark, folder):
    path, frame = folder
    got = {(r.start, r.event_type): r.n for r in run(events.windowed(events.read(spark, path, SCHEMA)), "windows", spark, "complete")}
    assert got == {(r.start, r.event_type): r.n for r in events.windowed(frame).collect()}


def test_crossings_and_cooldown(spark, folder):
    path, frame = folder
    stream = events.read(spark, path, SCHEMA, files_per_batch=10)
    got = sorted((r.key, r.ts) for r in run(events.crossings(stream, "user_id", 5.0), "crossings", spark))
    want = []
    for user in (0, 1):
        above = False
        for r in sorted((r for r in frame.collect() if r.user_id == user), key=lambda r: r.ts):
            if r.value > 5 and not above:
                want.append((str(user), r.ts))
            above = r.value > 5
    assert got == sorted(want)
    cooled = run(events.with_cooldown(events.read(spark, path, SCHEMA, files_per_batch=10), "user_id", 7200.0), "cooled", spark)
    by = {}
    for r in sorted(cooled, key=lambda r: r.ts):
        assert r.key not in by or (r.ts - by[r.key]).total_seconds() >= 7200
        by[r.key] = r.ts


def test_charging_queue(spark, tmp_path):
    rows = [(1, "a", "arrive"), (2, "b", "arrive"), (3, "c", "arrive"), (4, "c", "leave"), (5, "a", "leave"), (6, "b", "leave")]
    frame = spark.createDataFrame([(i, f"2024-01-01 00:00:0{i}", "s", agent, action) for i, agent, action in rows], "event_id long, t string, station string, agent string, action string")
    frame.withColumn("ts", F.to_timestamp("t")).drop("t").coalesce(1).write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema("event_id long, station string, agent string, action string, ts timestamp").parquet(str(tmp_path / "c"))
    got = [(r.agent, r.state) for r in sorted(run(events.charging(stream, 1), "charging", spark), key=lambda r: (r.ts, r.state == "charging"))]
    assert got == [("a", "charging"), ("b", "queued"), ("c", "queued"), ("c", "gave up"), ("a", "done"), ("b", "charging"), ("b", "done")]


def test_codec_and_perception(spark):
    lines = spark.createDataFrame([('{"event_id": "1", "event_type": "x", "priority": 2, "spatial": {"lat": 55.0, "lon": -3.0, "radius_km": 1.0}, "payload": "{}"}',), ('{"event_id": "2", "event_type": "y"}',), ("broken",)], "value string")
    found = events.decoded(lines)
    assert sorted(r.event_id for r in found.collect()) == ["1", "2"]
    assert events.decoded(events.encoded(found)).count() == 2
    agents = spark.createDataFrame([("near", -3.0, 55.005, 0.1), ("wide", -3.0, 55.5, 90.0), ("far", -3.0, 58.0, 1.0)], "agent string, lon double, lat double, radius_km double")
    assert sorted((r.event_id, r.agent) for r in events.perceived(found, agents).collect()) == [("1", "near"), ("1", "wide"), ("2", "far"), ("2", "near"), ("2", "wide")]
    assert events.perceived(found, agents, fallback=False).count() == 2


def test_perception_of_all_radii_equals_a_loop(spark):
    import math
    import random

    rng = random.Random(3)
    km = lambda a, b: 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2)))
    place = lambda: (rng.uniform(-4, -2), rng.uniform(54, 57))
    radius = lambda: rng.choice([None, 0.0, 0.3, 2.0, 15.0, 120.0])
    happen = [(str(i), *place(), radius()) for i in range(60)] + [("60", -3.0, 55.0, 900.0)]
    people = [(f"a{i}", *place(), radius()) for i in range(60)] + [("here", *happen[0][1:3], 0.0)]
    e = spark.createDataFrame(happen, "event_id string, lon double, lat double, radius_km double").select("event_id", F.lit("x").alias("event_type"), F.struct("lon", "lat", "radius_km").alias("spatial"))
    got = sorted((r.event_id, r.agent) for r in events.perceived(e, spark.createDataFrame(people, "agent string, lon double, lat double, radius_km double")).collect())
    assert got == sorted((i, a) for i, *p, r in happen for a, *q, s in people if km(p, q) <= max(r or 0, s or 0))
