"""Streams that keep state with an end: where agents are, which events they meet, and events with a time to live.

State lies in the RocksDB store (see :func:`stateful`), by key and variable, and ends by timers of event time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from corvane.functions.geo import haversine_km
from corvane.operators.graph import kept

#: The beginning of channel names, and the priorities that have channels of their own.
PREFIX = "rtd:events"
PRIORITIES = {3: "high", 4: "critical"}
#: Degrees of a cell in which agents and events meet.
CELL = 0.05
#: Slices of time that events and stays meet in, at most.
MOST_SLICES = 100_000

# Times are microseconds inside, which no time zone touches.
_LOCATION = StructType([StructField("at", LongType()), StructField("lon", DoubleType()), StructField("lat", DoubleType()), StructField("radius_km", DoubleType())])
_CHANGE = StructType([StructField("agent", StringType()), StructField("us", LongType()), StructField("gone", _LOCATION), StructField("here", _LOCATION)])


def stateful(spark: SparkSession) -> None:
    """Let new queries of this session keep their state in RocksDB, as timers and several variables by key need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _place(held: tuple | None) -> Row | None:
    return None if held is None else Row(at=held[0], lon=held[1], lat=held[2], radius_km=held[3])


class _Agents(StatefulProcessor):
    """The last place of each agent; for each change where it was and where it is."""

    def __init__(self, idle_ms: int, strict: bool):
        self.idle_ms, self.strict = idle_ms, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.place = handle, handle.getValueState("place", _LOCATION)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.place.get() if self.place.exists() else None
        for r in sorted(rows, key=lambda r: (r.us, r.seq)):
            if held is not None and r.us < held[0]:
                continue  # older than what is known
            if r.action == "move" and held is None:
                if self.strict:
                    raise ValueError(f"agent {key[0]} is not known")
                continue
            before = _place(held)
            if r.action == "leave":
                if held is not None:
                    held = None
                    yield Row(agent=key[0], us=r.us, gone=before, here=None)
                continue
            radius = r.radius_km if r.radius_km is not None else held[3] if held is not None else 0.0
            held = (r.us, r.lon, r.lat, radius)
            yield Row(agent=key[0], us=r.us, gone=before, here=_place(held))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held is None:
            self.place.clear()
        else:
            self.place.update(held)
            self.handle.registerTimer(held[0] // 1000 + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.place.exists():
            held = self.place.get()
            self.place.clear()
            yield Row(agent=key[0], us=held[0], gone=_place(held), here=None)

    def close(self) -> None:
        pass


def agent_changes(updates: DataFrame, idle: int = 86_400, strict: bool = True) -> DataFrame:
    """agent, ts, gone, here: every change of an agent's place (structs of at, lon, lat, radius_km; null: none).

    ``updates``: a stream with a watermark on ts: agent, ts, seq (order of equal times), action (register, move, leave), lon, lat, radius_km (null: as before). The last one by
    time wins: one older than what is known changes nothing, whenever it comes. A move of an agent that is not known raises if ``strict``, else nothing happens.
    An agent without a word for ``idle`` seconds of event time is forgotten, and ``gone`` says so.
    """
    rows = updates.select(F.col("agent").cast("string").alias("agent"), "ts", F.unix_micros("ts").alias("us"), "seq", "action", "lon", "lat", "radius_km")
    out = rows.groupBy("agent").transformWithState(_Agents(idle * 1000, strict), _CHANGE, "append", "eventTime")
    timed = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.timestamp_micros(f"{c}.at").alias("at"), f"{c}.lon", f"{c}.lat", f"{c}.radius_km")).alias(c)
    return out.select("agent", F.timestamp_micros("us").alias("ts"), timed("gone"), timed("here"))


def _cells(lon: Column, lat: Column, km: Column, size: Column | float = CELL) -> Column:
    """Cells that a circle comes into: rows of latitude, and in them columns as wide as it gets there."""
    high = km / 110.5
    wide = high / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + high, F.lit(89.0)))), F.lit(math.cos(math.radians(89.0))))
    span = lambda x, by: F.sequence(F.floor((x - by) / size), F.floor((x + by) / size))
    return F.flatten(F.transform(span(lat, high), lambda j: F.transform(span(lon, wide), lambda i: F.struct(i.alias("i"), j.alias("j")))))


def cell_changes(changes: DataFrame) -> DataFrame:
    """i, j, agent, ts, kind (leave or enter), lon, lat, radius_km: what each change means for every cell that an agent's circle comes into."""
    own = lambda place: _cells(F.col(f"{place}.lon"), F.col(f"{place}.lat"), F.col(f"{place}.radius_km"))
    part = lambda place, kind: F.transform(own(place), lambda c: F.struct(c["i"].alias("i"), c["j"].alias("j"), F.lit(kind).alias("kind"), F.col(f"{place}.lon").alias("lon"), F.col(f"{place}.lat").alias("lat"), F.col(f"{place}.radius_km").alias("radius_km")))
    none = F.slice(part("here", "none"), 1, 0)
    every = F.concat(F.when(F.col("gone").isNotNull(), part("gone", "leave")).otherwise(none), F.when(F.col("here").isNotNull(), part("here", "enter")).otherwise(none))
    return changes.select("agent", "ts", F.explode(F.coalesce(every, F.array())).alias("c")).select("c.i", "c.j", "agent", "ts", "c.kind", "c.lon", "c.lat", "c.radius_km")


def _level(km: Column) -> Column:
    """The level whose cells are at least as high as a circle's radius; cells of each level are twice as wide as those before."""
    return F.greatest(F.ceil(F.log2(F.greatest(km, F.lit(0.001)) / (110.5 * CELL))), F.lit(0)).cast("int")


def _seconds(rows: DataFrame, column: str) -> Column:
    """Whole seconds in the order of a time, with a time zone or without."""
    if rows.schema[column].dataType.typeName() != "timestamp_ntz":
        return F.unix_seconds(column)
    return F.datediff(column, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(column) * 3600 + F.minute(column) * 60 + F.floor(F.second(column))


def meetings(steps: DataFrame, events: DataFrame) -> DataFrame:
    """event_id, agent, ts, km: events (event_id, ts, lon, lat, radius_km) and the agents that are near enough when they happen, within the larger of both radii.

    ``steps``: agent, since, until, lon, lat, radius_km: where agents were for how long (until null: still). Both sides meet by cell and slice of time, each pair
    once: at the level of the larger radius, in the agent's own cell and the event's own slice. Slices are as long as the mean stay, so stays are
    in two slices on average, however long some of them last.
    """
    e = events.filter("lon IS NOT NULL AND lat IS NOT NULL AND ts IS NOT NULL").select("event_id", "ts", _seconds(events, "ts").alias("at"), F.col("lon").alias("x"), F.col("lat").alias("y"), F.coalesce("radius_km", F.lit(0.0)).alias("reach")).withColumn("theirs", _level(F.col("reach")))
    # Some twenty levels at most reach the driver.
    times = e.groupBy("theirs").agg(F.min("at").alias("first"), F.max("at").alias("last")).collect()
    first, last = min((r["first"] for r in times), default=0), max((r["last"] for r in times), default=0)
    held = steps.filter("lon IS NOT NULL AND lat IS NOT NULL AND radius_km IS NOT NULL").select("agent", "since", "until", "lon", "lat", "radius_km", _level(F.col("radius_km")).alias("own"), F.greatest(_seconds(steps, "since"), F.lit(first)).alias("from"), F.least(F.coalesce(_seconds(steps, "until"), F.lit(last)), F.lit(last)).alias("to"))
    held = kept(held.filter(F.col("from") <= F.col("to")))
    radii = held.groupBy("own").agg(F.max("radius_km").alias("most"), F.count("*").alias("n"), F.sum((F.col("to") - F.col("from")).cast("double")).alias("seconds")).collect()
    number = max(1, sum(r["n"] for r in radii))
    long = int(max(sum(r["seconds"] for r in radii) / number, (last - first) / MOST_SLICES)) + 1
    size = lambda level: F.lit(CELL) * F.pow(F.lit(2.0), level)
    levels = lambda mine, others: F.filter(F.array(*(F.lit(n) for n in sorted(set(others))), mine), lambda n: n >= mine)
    here = held.withColumn("level", F.explode(F.array_distinct(levels(F.col("own"), [r["theirs"] for r in times]))))
    here = here.select("*", F.floor(F.col("lon") / size(F.col("level"))).alias("i"), F.floor(F.col("lat") / size(F.col("level"))).alias("j"), F.explode(F.sequence(F.floor(F.col("from") / long), F.floor(F.col("to") / long))).alias("slice")).drop("from", "to")
    most = F.lit(0.0)
    for r in radii:
        most = F.greatest(most, F.when(F.col("level") >= r["own"], F.lit(float(r["most"]))).otherwise(0.0))
    there = e.withColumn("level", F.explode(F.array_distinct(levels(F.col("theirs"), [r["own"] for r in radii]))))
    there = there.withColumn("c", F.explode(_cells(F.col("x"), F.col("y"), F.greatest(F.col("reach"), most), size(F.col("level")))))
    there = there.select("event_id", "ts", "x", "y", "reach", "theirs", "level", "c.i", "c.j", F.floor(F.col("at") / long).alias("slice"))
    met = here.join(there, ["level", "i", "j", "slice"]).filter((F.greatest("own", "theirs") == F.col("level")) & (F.col("since") <= F.col("ts")) & F.coalesce(F.col("ts") < F.col("until"), F.lit(True)))
    met = met.withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")))
    return met.filter(F.col("km") <= F.greatest("reach", "radius_km")).select("event_id", "agent", "ts", "km")


def stays(changes: DataFrame) -> DataFrame:
    """agent, since, until, lon, lat, radius_km of the ``changes`` of agents so far (a table that :func:`agent_changes` wrote)."""
    from pyspark.sql import Window

    by = Window.partitionBy("agent").orderBy("ts", F.col("here").isNotNull())
    held = changes.withColumn("until", F.lead("ts").over(by)).filter("here IS NOT NULL")
    return held.select("agent", F.col("ts").alias("since"), "until", "here.lon", "here.lat", "here.radius_km")


class _Living(StatefulProcessor):
    """The end of each event's life."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.end = handle, handle.getValueState("end", StructType([StructField("end", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        end = self.end.get()[0] if self.end.exists() else None
        began = end is not None
        for r in sorted(rows, key=lambda r: r.us):
            if not began:
                began = True
                yield Row(event_id=key[0], us=r.us, change="begins")
            end = r.ends if end is None else max(end, r.ends)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.end.update((end,))
        self.handle.registerTimer(end // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        end = self.end.get()[0]
        self.end.clear()
        yield Row(event_id=key[0], us=end, change="ends")

    def close(self) -> None:
        pass


def lives(events: DataFrame) -> DataFrame:
    """event_id, ts, change (begins, ends): of a stream of events (event_id, ts with a watermark, ttl in seconds).

    An event that comes again lives until the latest of its ends and begins once. It ends when event time has passed its end; its state goes then.
    """
    rows = events.select(F.col("event_id").cast("string").alias("event_id"), "ts", F.unix_micros("ts").alias("us"), (F.unix_micros("ts") + F.col("ttl").cast("long") * 1_000_000).alias("ends"))
    schema = StructType([StructField("event_id", StringType()), StructField("us", LongType()), StructField("change", StringType())])
    return rows.groupBy("event_id").transformWithState(_Living(), schema, "append", "eventTime").select("event_id", F.timestamp_micros("us").alias("ts"), "change")


def channel(event_type: Column, priority: Column) -> Column:
    """The name of the channel of an event: its type, and its priority if that is high or critical."""
    names = F.create_map(*(F.lit(x) for p, n in PRIORITIES.items() for x in (p, f":{n}")))
    return F.concat(F.lit(f"{PREFIX}:"), event_type, F.coalesce(F.try_element_at(names, priority.cast("int")), F.lit("")))


def publish(path: str):
    """For ``foreachBatch``: events (event_type, priority, ...) of a batch into a folder of ``path`` by batch and channel.

    A batch that is sent again after a failure takes the place of its first writing, so that every event is there once.
    """

    def write(batch: DataFrame, number: int) -> None:
        named = batch.withColumn("channel", channel(F.col("event_type"), F.col("priority")))
        named.write.mode("overwrite").partitionBy("channel").parquet(f"{path}/batch={number}")

    return write


def subscribed(spark: SparkSession, path: str, channels: list[str] | None = None) -> DataFrame:
    """Events that were published to one of ``channels`` (None: to any)."""
    found = spark.read.option("basePath", path).parquet(path)
    return found if channels is None else found.filter(F.col("channel").isin(channels))


def bus_statistics(published: DataFrame) -> DataFrame:
    """channel, events, batches, first and last ts of what was published."""
    return published.groupBy("channel").agg(F.count("*").alias("events"), F.count_distinct("batch").alias("batches"), F.min("ts").alias("first"), F.max("ts").alias("last"))
