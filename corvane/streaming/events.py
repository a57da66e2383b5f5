"""Event streams: typed payloads, spatial subscriptions, windows, thresholds, cooldowns and charging sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.functions.geo import haversine_km

EVENT = "event_id string, event_type string, timestamp timestamp, priority int, spatial struct<lat: double, lon: double, radius_km: double>, payload string, source string"


def decoded(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines; the payload stays JSON text."""
    return lines.select(F.from_json(column, EVENT).alias("e")).select("e.*").filter("event_id IS NOT NULL")


def encoded(events: DataFrame) -> DataFrame:
    return events.select(F.to_json(F.struct(*events.columns)).alias("value"))


def read(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, with ``ts`` as an event time that may be late by an hour."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def windowed(events: DataFrame, width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Events and their sum of values by type in tumbling (or sliding) windows of event time."""
    return events.groupBy(F.window("ts", width, slide or width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


#: Degrees of the finest cell in which events and agents meet; each further level is twice as wide.
CELL, LEVELS = 0.005, 12


def _level(km: Column) -> Column:
    """The level whose cells are about as high as a circle's radius."""
    return F.least(F.greatest(F.ceil(F.log2(F.greatest(km, F.lit(0.001)) / (110.5 * CELL))), F.lit(0)), F.lit(LEVELS - 1)).cast("int")


def _own(lon: Column, lat: Column, level: Column) -> Column:
    size = CELL * F.pow(F.lit(2.0), level)
    return F.struct(level.cast("int").alias("level"), F.floor(lon / size).alias("x"), F.floor(lat / size).alias("y"))


def _reached(lon: Column, lat: Column, km: Column) -> Column:
    """The cells of its level that a circle comes into."""
    level = _level(km)
    size, high = CELL * F.pow(F.lit(2.0), level), km / 110.5
    wide = high / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + high, F.lit(89.0)))), F.lit(0.017))
    span = lambda x, by: F.sequence(F.floor((x - by) / size), F.floor((x + by) / size))
    return F.flatten(F.transform(span(lat, high), lambda y: F.transform(span(lon, wide), lambda x: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))


def perceived(events: DataFrame, agents: DataFrame, fallback: bool = True) -> DataFrame:
    """Events that agents (agent, lon, lat, radius_km) are near enough to: within the larger of both radii.

    Events without a place reach everyone if ``fallback``: that part is each event with each agent by its meaning. Agents are the static side of a stream.
    """
    placed = F.col("spatial").isNotNull()
    at = (F.col("spatial.lon"), F.col("spatial.lat"))
    km = haversine_km(*at, F.col("lon"), F.col("lat"))
    reach, own = F.coalesce("spatial.radius_km", F.lit(0.0)), F.coalesce("radius_km", F.lit(0.0))
    every = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    # Equality joins on cells as wide as the circles: what an event reaches, and beyond that what an agent's own radius does.
    e, wanted = events.filter(placed), ("event_id", "event_type", "agent")
    in_all = lambda rows, lon, lat: rows.withColumn("cell", F.explode(F.transform(every, lambda n: _own(lon, lat, n))))
    reached = e.withColumn("cell", F.explode(_reached(*at, reach))).join(in_all(agents, F.col("lon"), F.col("lat")), "cell").filter(km <= reach).select(*wanted)
    seen = in_all(e, *at).join(agents.withColumn("cell", F.explode(_reached(F.col("lon"), F.col("lat"), own))), "cell").filter((km <= own) & (km > reach)).select(*wanted)
    with_place = reached.unionByName(seen)
    if not fallback:
        return with_place
    return with_place.unionByName(events.filter(~placed).crossJoin(agents.select("agent")).select("event_id", "event_type", "agent"))


def _crossed(threshold: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (total, above) = state.get if state.exists else (0.0, False)
        rows = []
        for frame in frames:
            for t, x in sorted(zip(frame["ts"], frame["value"], strict=True)):
                total = x
                if total > threshold and not above:
                    rows.append((key[0], t, total))
                above = total > threshold
        state.update((total, above))
        yield pd.DataFrame(rows, columns=["key", "ts", "value"])

    return step


def crossings(events: DataFrame, key: str, threshold: float) -> DataFrame:
    """Values that rise above the threshold, once until they have fallen back; state by key across batches."""
    rows = events.select(F.col(key).cast("string").alias("key"), "ts", F.col("value").cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(_crossed(threshold), "key string, ts timestamp, value double", "value double, above boolean", "append", GroupStateTimeout.NoTimeout)


def _cooled(seconds: float):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = []
        for t in sorted(t for frame in frames for t in frame["ts"]):
            if last is None or t.timestamp() - last >= seconds:
                last = t.timestamp()
                rows.append((key[0], t))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(rows, columns=["key", "ts"])

    return step


def with_cooldown(events: DataFrame, key: str, seconds: float) -> DataFrame:
    """Events of a key of which each comes at least ``seconds`` after the last one let through."""
    rows = events.select(F.col(key).cast("string").alias("key"), "ts")
    return rows.groupBy("key").applyInPandasWithState(_cooled(seconds), "key string, ts timestamp", "last double", "append", GroupStateTimeout.NoTimeout)


def _charged(ports: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        charging, queue = (list(x) for x in (state.get if state.exists else ([], [])))
        rows = []
        events = sorted((r.ts, r.event_id, r.agent, r.action) for frame in frames for r in frame.itertuples())
        for t, _, agent, action in events:
            if action == "arrive" and agent not in charging and agent not in queue:
                if len(charging) < ports:
                    charging.append(agent)
                    rows.append((key[0], t, agent, "charging"))
                else:
                    queue.append(agent)
                    rows.append((key[0], t, agent, "queued"))
            elif action == "leave" and agent in charging:
                charging.remove(agent)
                rows.append((key[0], t, agent, "done"))
                if queue:
                    first = queue.pop(0)
                    charging.append(first)
                    rows.append((key[0], t, first, "charging"))
            elif action == "leave" and agent in queue:
                queue.remove(agent)
                rows.append((key[0], t, agent, "gave up"))
        state.update((charging, queue))
        yield pd.DataFrame(rows, columns=["station", "ts", "agent", "state"])

    return step


def charging(events: DataFrame, ports: int) -> DataFrame:
    """Arrivals and departures (event_id, ts, station, agent, action) as states of agents at stations with a queue first come, first served."""
    rows = events.select("event_id", "ts", F.col("station").cast("string").alias("station"), F.col("agent").cast("string").alias("agent"), "action")
    return rows.groupBy("station").applyInPandasWithState(_charged(ports), "station string, ts timestamp, agent string, state string", "charging array<string>, queue array<string>", "append", GroupStateTimeout.NoTimeout)
