"""Transit feeds: the CSV files of a folder or a zip, cut down to a service day and a box."""

from __future__ import annotations

import os
import tempfile
import zipfile
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.clock import feed_seconds
from corvane.functions.geo import in_box
from corvane.operators.text import route_fuel, route_mode

#: The columns of each file that are read, all as text.
COLUMNS = {
    "calendar": "service_id monday tuesday wednesday thursday friday saturday sunday start_date end_date",
    "calendar_dates": "service_id date exception_type",
    "stops": "stop_id stop_name stop_lat stop_lon stop_code wheelchair_boarding location_type parent_station",
    "stop_times": "trip_id stop_id arrival_time departure_time stop_sequence pickup_type drop_off_type",
    "trips": "trip_id route_id service_id shape_id direction_id trip_headsign",
    "routes": "route_id agency_id route_short_name route_long_name route_desc route_color route_type",
    "shapes": "shape_id shape_pt_sequence shape_pt_lat shape_pt_lon",
}


def unpacked(path: str, folder: str | None = None) -> str:
    """The folder of a feed; a zip is unpacked into ``folder``, which executors must be able to read."""
    if not path.endswith(".zip"):
        return path
    folder = folder or tempfile.mkdtemp(prefix="spark-feed-")
    with zipfile.ZipFile(path) as z:
        for name in z.namelist():
            base = os.path.basename(name)
            if base.endswith(".txt"):
                with z.open(name) as src, open(os.path.join(folder, base), "wb") as dst:
                    while part := src.read(1 << 20):
                        dst.write(part)
    return folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One file with its known columns as text, null where it lacks one; no rows if the file is missing."""
    wanted = COLUMNS[name].split()
    empty = spark.createDataFrame([], ", ".join(f"{c} string" for c in wanted))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.txt")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    found = spark.read.csv(f"{folder}/{name}.txt", header=True, inferSchema=False, encoding="UTF-8", mode="PERMISSIVE")
    found = found.toDF(*(c.lstrip("﻿").strip() for c in found.columns))
    if name == "calendar_dates":
        place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
        return empty.withColumn("place", F.lit(None).cast("struct<block: bigint, row: bigint>")).unionByName(found.select(*(c for c in found.columns if c in wanted), place.alias("place")), allowMissingColumns=True)
    return empty.unionByName(found.select(*(c for c in found.columns if c in wanted)), allowMissingColumns=True)


def active_services(calendar: DataFrame, exceptions: DataFrame, day: date | None) -> DataFrame | None:
    """Services of a day: by weekday and period, with added and without removed ones; None for no filter."""
    if day is None:
        return None
    weekday = day.strftime("%A").lower()
    on = F.lit(day)
    period = on.between(F.try_to_date("start_date", "yyyyMMdd"), F.try_to_date("end_date", "yyyyMMdd"))
    regular = calendar.filter(period & (F.col(weekday) == "1")).select("service_id")
    that_day = exceptions.filter((F.try_to_date("date", "yyyyMMdd") == on) & F.col("exception_type").isin("1", "2"))
    # Of several exceptions of one service the last in the file counts.
    last = F.max_by("exception_type", "place") if "place" in that_day.columns else F.min("exception_type")
    changed = that_day.groupBy("service_id").agg(last.alias("exception_type"))
    return regular.join(changed, "service_id", "left_anti").unionByName(changed.filter("exception_type = '1'").select("service_id")).distinct()


def stops(raw: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Stops with coordinates: one at (0, 0) takes those of its parent or goes; ``box``: west, south, east, north."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    s = raw.select("stop_id", "stop_name", "stop_code", number("stop_lon").alias("lon"), number("stop_lat").alias("lat"), (F.coalesce("wheelchair_boarding", F.lit("0")) == "1").alias("wheelchair"), "parent_station")
    known = s.filter("lon <> 0 OR lat <> 0")
    parents = known.groupBy(F.col("stop_id").alias("parent_station")).agg(F.first("lon").alias("plon"), F.first("lat").alias("plat"))
    lost = s.filter("lon = 0 AND lat = 0").join(parents, "parent_station")
    lost = lost.select("stop_id", "stop_name", "stop_code", F.col("plon").alias("lon"), F.col("plat").alias("lat"), "wheelchair", "parent_station")
    out = known.unionByName(lost)
    return out.filter(in_box(F.col("lon"), F.col("lat"), *box)) if box else out


def load(spark: SparkSession, path: str, day: date | None = None, box: tuple[float, float, float, float] | None = None, fuels: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The tables of a feed, each cut down to what the others leave: stops, stop_times, trips, routes, shapes.

    ``fuels``: the fuel of routes by their id, where it is known better than their names tell.
    """
    folder = unpacked(path)
    raw = {name: table(spark, folder, name) for name in COLUMNS}
    at_stops = stops(raw["stops"], box)
    times = raw["stop_times"].join(at_stops.select("stop_id"), "stop_id", "left_semi")
    arrival, departure = feed_seconds(F.col("arrival_time")), feed_seconds(F.col("departure_time"))
    times = times.select(
        "trip_id", "stop_id", F.when(arrival < 0, departure).otherwise(arrival).alias("arrival"), F.when(departure < 0, arrival).otherwise(departure).alias("departure"),
        F.coalesce(F.col("stop_sequence").try_cast("int"), F.lit(0)).alias("seq"),
    ).filter("arrival >= 0")
    services = active_services(raw["calendar"], raw["calendar_dates"], day)
    trips = raw["trips"].join(times.select("trip_id").distinct(), "trip_id", "left_semi")
    if services is not None:
        trips = trips.join(services, "service_id", "left_semi")
    routes = raw["routes"].join(trips.select("route_id"), "route_id", "left_semi")
    kind = F.coalesce(F.col("route_type").try_cast("int"), F.lit(3))
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in fuels.items() for x in pair)), F.col("route_id")) if fuels else None
    fuel = route_fuel(F.concat_ws(" ", "route_desc", "route_long_name", "route_color"), kind, known)
    routes = routes.withColumn("fuel", fuel).withColumn("mode", route_mode(kind, F.col("fuel"))).withColumn("color", F.coalesce(F.concat(F.lit("#"), F.nullif("route_color", F.lit(""))), F.lit("#888888")))
    shapes = raw["shapes"].join(trips.select("shape_id"), "shape_id", "left_semi").select("shape_id", F.col("shape_pt_sequence").try_cast("int").alias("seq"), F.col("shape_pt_lon").try_cast("double").alias("lon"), F.col("shape_pt_lat").try_cast("double").alias("lat"))
    return {"stops": at_stops, "stop_times": times, "trips": trips, "routes": routes, "shapes": shapes}


def headways(feed: dict[str, DataFrame], window: tuple[int, int] = (25_200, 34_200), default: int = 3600) -> DataFrame:
    """route_id, stop_id, departures, headway (whole seconds) between departures in a window of the day."""
    from corvane.operators.series import headways as gaps

    rows = feed["stop_times"].join(feed["trips"].select("trip_id", "route_id"), "trip_id").filter(F.col("departure").between(*window))
    return gaps(rows, ["route_id", "stop_id"], "departure", default)


def summary(feed: dict[str, DataFrame]) -> DataFrame:
    """kind, name, n: rows of each table, routes of each mode and of each fuel."""
    parts = [feed[k].agg(F.lit("rows").alias("kind"), F.lit(k).alias("name"), F.count("*").alias("n")) for k in ("stops", "routes", "trips")]
    parts.append(feed["shapes"].agg(F.lit("rows").alias("kind"), F.lit("shapes").alias("name"), F.countDistinct("shape_id").alias("n")))
    parts += [feed["routes"].groupBy(F.lit(k).alias("kind"), F.col(k).alias("name")).agg(F.count("*").alias("n")) for k in ("mode", "fuel")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Seconds between departures that look right.
HEADWAYS = (30, 7200)


def checked(feed: dict[str, DataFrame], links: DataFrame | None = None) -> DataFrame:
    """name, state (ok, warn, fail), n: whether a loaded feed looks right. ``links``: its :func:`edges`, made here if not given.

    No stop may lie at longitude and latitude 0; headways should lie between 30 seconds and two hours (of both faults the short ones are told first), and there should be some; every mode
    of the edges is told with its number.
    """
    links = edges(feed) if links is None else links
    zero = feed["stops"].agg(F.count_if((F.col("lon") == 0) & (F.col("lat") == 0)).alias("n")).select(F.lit("stops at 0, 0").alias("name"), F.when(F.col("n") > 0, "fail").otherwise("ok").alias("state"), "n")
    h = F.when(F.col("headway") > 0, F.col("headway"))
    gaps = links.agg(F.count(h).alias("all"), F.count_if(h < HEADWAYS[0]).alias("short"), F.count_if(h > HEADWAYS[1]).alias("long"))
    name = F.when(F.col("all") == 0, "no headways").when(F.col("short") > 0, "short headways").when(F.col("long") > 0, "long headways").otherwise("headways")
    n = F.when(F.col("all") == 0, 0).when(F.col("short") > 0, F.col("short")).when(F.col("long") > 0, F.col("long")).otherwise(F.col("all"))
    gaps = gaps.select(name.alias("name"), F.when(name == "headways", "ok").otherwise("warn").alias("state"), n.cast("long").alias("n"))
    modes = links.groupBy("mode").agg(F.count("*").alias("n")).select(F.concat(F.lit("mode "), F.coalesce("mode", F.lit("unknown"))).alias("name"), F.lit("ok").alias("state"), "n")
    return zero.unionByName(gaps).unionByName(modes)


def pair_times(feed: dict[str, DataFrame]) -> DataFrame:
    """route_id, u, v of consecutive stops and the mean seconds between them (60 where negative) over a route's trips."""
    from pyspark.sql import Window

    w = Window.partitionBy("trip_id").orderBy("seq")
    hop = feed["stop_times"].join(feed["trips"].select("trip_id", "route_id"), "trip_id")
    hop = hop.select("route_id", F.col("stop_id").alias("u"), F.lead("stop_id").over(w).alias("v"), (F.lead("arrival").over(w) - F.col("departure")).alias("s")).filter("v IS NOT NULL")
    return hop.groupBy("route_id", "u", "v").agg(F.avg(F.when(F.col("s") < 0, 60).otherwise(F.col("s"))).alias("seconds"), F.count("*").alias("trips"))


def running_pair_times(feed: dict[str, DataFrame], order: str = "trip_id") -> DataFrame:
    """route_id, u, v, seconds, trips: as :func:`pair_times`, but each trip halves the distance to its own time, in the ``order`` of trips (a column of trips; equal ones by trip_id).

    The last trip counts a half, the one before a quarter and so on; the first counts as much as the second. So the time is one weighted sum, not a fold.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("trip_id").orderBy("seq")
    hop = feed["stop_times"].join(feed["trips"].select("trip_id", "route_id", F.col(order).alias("__order")), "trip_id")
    hop = hop.select("route_id", "trip_id", "__order", "seq", F.col("stop_id").alias("u"), F.lead("stop_id").over(w).alias("v"), (F.lead("arrival").over(w) - F.col("departure")).alias("s")).filter("v IS NOT NULL")
    pair = Window.partitionBy("route_id", "u", "v")
    hop = hop.withColumns({"back": F.row_number().over(pair.orderBy(F.desc("__order"), F.desc("trip_id"), F.desc("seq"))), "n": F.count("*").over(pair)})
    weight = F.pow(F.lit(0.5), F.when(F.col("back") == F.col("n"), F.col("n") - 1).otherwise(F.col("back")))
    return hop.groupBy("route_id", "u", "v").agg(F.sum(F.when(F.col("s") < 0, 60).otherwise(F.col("s")) * weight).alias("seconds"), F.count("*").alias("trips"))


def edges(feed: dict[str, DataFrame], headway: DataFrame | None = None) -> DataFrame:
    """u, v of consecutive stops of active trips: mean seconds (60 where negative), trips, route_ids, mode and fuel of the first trip, headway."""
    from pyspark.sql import Window

    w = Window.partitionBy("trip_id").orderBy("seq")
    hop = feed["stop_times"].join(feed["trips"].select("trip_id", "route_id"), "trip_id").join(feed["routes"].select("route_id", "mode", "fuel"), "route_id")
    hop = hop.select("trip_id", "route_id", "mode", "fuel", F.col("stop_id").alias("u"), F.lead("stop_id").over(w).alias("v"), (F.lead("arrival").over(w) - F.col("departure")).alias("s")).filter("v IS NOT NULL")
    out = hop.groupBy("u", "v").agg(
        F.avg(F.when(F.col("s") < 0, 60).otherwise(F.col("s"))).alias("seconds"), F.count("*").alias("trips"), F.sort_array(F.collect_set("route_id")).alias("route_ids"), F.min(F.struct("trip_id", "mode", "fuel")).alias("first")
    )
    out = out.select("u", "v", "seconds", "trips", "route_ids", "first.mode", "first.fuel")
    least = (headways(feed) if headway is None else headway).groupBy(F.col("stop_id").alias("u")).agg(F.min("headway").alias("headway"))
    return out.join(least, "u", "left").withColumn("headway", F.coalesce("headway", F.lit(3600)))
