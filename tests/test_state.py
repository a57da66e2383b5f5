"""Agents, lives of events and channels as streams, against a replay in plain Python."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corvane.streaming import state

START = datetime(2024, 1, 1)
UPDATE = "agent string, ts timestamp, seq int, action string, lon double, lat double, radius_km double"


def stream_of(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
    paths = [f"{folder}/part={i}" for i in range(len(batches))]
    return paths, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/part=*").withWatermark("ts", "1 hour")


def run(spark, stream, name, checkpoint):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    state.stateful(spark)
    yield spark
    spark.conf.unset(key)


def km(a, b):
    h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def test_agents_move_and_meet_events(rocks, tmp_path):
    spark, rng = rocks, random.Random(5)
    place = lambda: (round(-3.2 + rng.uniform(-0.2, 0.2), 6), round(55.9 + rng.uniform(-0.2, 0.2), 6))
    batches, seq = [], 0
    for b in range(3):
        rows = []
        for _ in range(25):
            seq += 1
            late = rng.random() < 0.2
            ts = START + timedelta(minutes=b * 30 + rng.randrange(30) - (25 if late else 0))
            agent = f"a{rng.randrange(6)}"
            action = rng.choice(["register", "register", "move", "leave"])
            rows.append((agent, ts, seq, action, *place(), rng.choice([None, 0.5, 8.0])))
        batches.append(rows)
    _, stream = stream_of(spark, str(tmp_path / "in"), batches, UPDATE)
    got = run(spark, state.agent_changes(stream, idle=10**6, strict=False), "agent_changes", str(tmp_path / "c"))
    held, want = {}, []
    for rows in batches:
        for a, ts, s, action, lon, lat, radius in sorted(rows, key=lambda r: (r[1], r[2])):
            old = held.get(a)
            if old and ts < old[0]:
                continue
            if action == "leave":
                if old:
                    want.append((a, ts, old, None))
                held.pop(a, None)
            elif action == "register" or old:
                held[a] = (ts, lon, lat, radius if radius is not None else old[3] if old else 0.0)
                want.append((a, ts, old, held[a]))
    tidy = lambda rows: sorted(rows, key=str)
    assert tidy((r.agent, r.ts, tuple(r.gone) if r.gone else None, tuple(r.here) if r.here else None) for r in got.collect()) == tidy(want)
    # What they meet, by cells and by comparing all.
    events = [(i, START + timedelta(minutes=rng.randrange(90), seconds=30), *place(), rng.choice([0.0, 3.0, 12.0])) for i in range(40)] + [(99, START, None, None, 1.0)]
    frame = spark.createDataFrame(events, "event_id int, ts timestamp, lon double, lat double, radius_km double")
    met = sorted((r.event_id, r.agent) for r in state.meetings(state.stays(got), frame).collect())
    brute = []
    for i, ts, lon, lat, radius in events:
        for a in {w[0] for w in want}:
            mine = sorted((w for w in want if w[0] == a), key=lambda w: (w[1], w[3] is not None))
            now = [w for n, w in enumerate(mine) if w[3] and w[1] <= ts and (n + 1 == len(mine) or ts < mine[n + 1][1])]
            brute += [(i, a) for w in now if lon is not None and km((lon, lat), w[3][1:3]) <= max(radius, w[3][3])]
    assert met == sorted(brute) and met
    cells = state.cell_changes(got).groupBy("agent").pivot("kind", ["enter", "leave"]).count().collect()
    assert all(r.enter >= (r.leave or 0) for r in cells)


def test_unknown_agents_raise_and_idle_ones_go(rocks, tmp_path):
    spark = rocks
    hour = lambda h: START + timedelta(hours=h)
    _, bad = stream_of(spark, str(tmp_path / "bad"), [[("x", hour(0), 1, "move", 0.0, 0.0, 1.0)]], UPDATE)
    with pytest.raises(Exception, match="not known"):
        run(spark, state.agent_changes(bad), "bad", str(tmp_path / "cb"))
    batches = [[("x", hour(0), 1, "register", 0.0, 0.0, 1.0), ("y", hour(0), 2, "register", 1.0, 1.0, 1.0)], [("y", hour(5), 3, "move", 2.0, 1.0, None)], [("y", hour(9), 4, "move", 3.0, 1.0, None)], [("y", hour(9), 5, "move", 3.0, 2.0, None)]]
    _, stream = stream_of(spark, str(tmp_path / "in"), batches, UPDATE)
    rows = run(spark, state.agent_changes(stream, idle=4 * 3600), "idle", str(tmp_path / "c")).collect()
    gone = [(r.agent, r.gone.lon) for r in rows if r.here is None]
    assert gone.count(("x", 0.0)) == 1 and [r.here.lon for r in rows if r.agent == "y" and r.here][:3] == [1.0, 2.0, 3.0]


def test_events_end_after_their_time_to_live(rocks, tmp_path):
    spark = rocks
    minute = lambda m: START + timedelta(minutes=m)
    batches = [[("a", minute(0), 600), ("b", minute(1), 36_000), ("a", minute(5), 3600)], [("c", minute(200), 60)], [("d", minute(400), 60)], [("e", minute(900), 60)]]
    _, stream = stream_of(spark, str(tmp_path / "in"), batches, "event_id string, ts timestamp, ttl int")
    got = {(r.event_id, r.change): r.ts for r in run(spark, state.lives(stream), "lives", str(tmp_path / "c")).collect()}
    assert {k: v for k, v in got.items() if k[0] in "abc"} == {("a", "begins"): minute(0), ("a", "ends"): minute(65), ("b", "begins"): minute(1), ("b", "ends"): minute(601), ("c", "begins"): minute(200), ("c", "ends"): minute(201)}
    assert got["e", "begins"] == minute(900) and ("e", "ends") not in got


def test_a_batch_sent_twice_is_published_once(spark, tmp_path):
    rows = [(i, ["policy_change", "grid"][i % 2], i % 5, START) for i in range(20)]
    frame = spark.createDataFrame(rows, "event_id int, event_type string, priority int, ts timestamp")
    frame.filter("event_id < 10").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    path = str(tmp_path / "bus")
    q = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in/*")).writeStream.foreachBatch(state.publish(path)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    again, second = frame.filter("event_id < 10"), frame.filter("event_id >= 10")
    for batch, number in ((again, 0), (second, 1), (second, 1)):
        state.publish(path)(batch, number)
    found = state.subscribed(spark, path)
    assert sorted(r.event_id for r in found.collect()) == list(range(20))
    assert {r.channel for r in found.select("channel").distinct().collect()} == {f"rtd:events:{t}{p}" for t in ("policy_change", "grid") for p in ("", ":high", ":critical")}
    high = state.subscribed(spark, path, ["rtd:events:grid:high"])
    assert sorted(r.event_id for r in high.collect()) == [3, 13]
    stats = {r.channel: (r.events, r.batches) for r in state.bus_statistics(found).collect()}
    assert stats["rtd:events:grid:high"] == (2, 2) and sum(n for n, _ in stats.values()) == 20
    assert frame.filter(state.channel(F.col("event_type"), F.col("priority")).isNull()).count() == 0


def test_meetings_of_long_and_short_stays(spark):
    rng = random.Random(5)
    spot = lambda: (rng.choice([0.0, 55.0]) + rng.random() / 4, 55 + rng.random() / 4)
    changes = []
    for a in range(12):
        at = START
        for _ in range(1 if a < 3 else 40):
            changes.append((a, at, (at, *spot(), rng.choice([0.0, 2.0, 7.0, 40.0]))))
            at += timedelta(seconds=rng.choice([1, 60, 5000]))
    events = [(i, START + timedelta(seconds=rng.randrange(90_000)), *spot(), rng.choice([None, 0.0, 6.0, 90.0])) for i in range(60)]
    held = state.stays(spark.createDataFrame(changes, "agent int, ts timestamp, here struct<at: timestamp, lon: double, lat: double, radius_km: double>"))
    # A stay is one row, however many cells its circle comes into.
    assert held.count() == len(changes)
    frame = spark.createDataFrame(events, "event_id int, ts timestamp, lon double, lat double, radius_km double")
    want = []
    for i, ts, lon, lat, radius in events:
        for a in range(12):
            now = [w[2] for w in changes if w[0] == a and w[1] <= ts][-1]
            want += [(i, a)] * (km((lon, lat), now[1:3]) <= max(radius or 0.0, now[3]))
    assert sorted((r.event_id, r.agent) for r in state.meetings(held, frame).collect()) == sorted(want) and want
    zoneless = state.meetings(held.withColumns({c: held[c].cast("timestamp_ntz") for c in ("since", "until")}), frame.withColumn("ts", frame["ts"].cast("timestamp_ntz")))
    assert sorted((r.event_id, r.agent) for r in zoneless.collect()) == sorted(want)
    assert state.meetings(held, frame.filter("event_id < 0")).count() == 0 and state.meetings(held.filter("agent < 0"), frame).count() == 0
