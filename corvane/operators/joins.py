"""Joins that are more than equality: range, nearest, as-of, band, skyline, outer differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.geo import EARTH_KM, KM_PER_DEGREE, haversine_km


#: Rows of a place that are joined as one, so that a pair of places gives this squared of pairs at most at a time.
TOGETHER = 1024


def _near(a: DataFrame, b: DataFrame, km: float) -> DataFrame:
    """Rows of ``a`` (lon, lat, more) with those of ``b`` (lon2, lat2, more) at most ``km`` apart, and km.

    An equality join on grid cells: rows of latitude as high as the radius, cut into cells as wide as
    the radius is there. The left side lies in its own cell, the right side in every cell in reach.
    """
    high = km / KM_PER_DEGREE
    row = lambda lat: F.floor(lat / high)
    # The widest that the radius gets in a row: at its edge nearer to a pole.
    wide = lambda r: km / (KM_PER_DEGREE * F.greatest(F.cos(F.radians(F.least(F.lit(89.9), F.greatest(F.abs(r * high), F.abs((r + 1) * high))))), F.lit(math.cos(math.radians(89.9)))))
    a = a.withColumn("row", row(F.col("lat"))).withColumn("cell", F.floor(F.col("lon") / wide(F.col("row"))))
    b = b.withColumn("row", F.explode(F.sequence(row(F.col("lat2")) - 1, row(F.col("lat2")) + 1)))
    reach = wide(F.col("row"))
    b = b.withColumn("cell", F.explode(F.sequence(F.floor((F.col("lon2") - reach) / reach), F.floor((F.col("lon2") + reach) / reach))))
    pairs = a.join(b, ["row", "cell"]).withColumn("km", haversine_km(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")))
    return pairs.filter(F.col("km") <= km).drop("row", "cell")


def near_places(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """lon, lat, lon2, lat2, km: different places of ``left`` and ``right`` (both lon, lat) at most ``km`` apart; rows of one place count as one."""
    a = left.select("lon", "lat").distinct()
    b = right.select(F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).distinct()
    return _near(a, b, km).select("lon", "lat", "lon2", "lat2", "km")


def _together(rows: DataFrame, ids: str) -> DataFrame:
    """lon, lat, ``ids``: ids of rows of one place, ``TOGETHER`` of them at most."""
    order = Window.partitionBy("lon", "lat").orderBy("id")
    some = rows.filter("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat", "id").withColumn("__n", F.floor((F.row_number().over(order) - 1) / TOGETHER))
    return some.groupBy("lon", "lat", "__n").agg(F.collect_list(F.struct("id")).alias(ids)).drop("__n")


def radius_join(left: DataFrame, right: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """Pairs of rows (each with id, lon, lat) at most ``km`` apart: id, other, km (rounded to ``digits``, if given).

    Distances are those of places, found for many rows of a place at once; no pair is built that isn't one of the result. Near places are dealt out evenly
    before their pairs are, as a few of them may give most pairs.
    """
    far = F.col("km") if digits is None else F.round("km", digits)
    there = _together(right, "others").withColumnsRenamed({"lon": "lon2", "lat": "lat2"})
    near = _near(_together(left, "ids"), there, km).select("ids", "others", far.alias("km"))
    near = near.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return near.select(F.explode("ids").alias("a"), "others", "km").select("a.id", F.explode("others").alias("b"), "km").select("id", F.col("b.id").alias("other"), "km")


def nearest_join(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """For each left row the nearest right row within ``km`` (of equally near ones the least id), else null. Found once for each place."""
    first = right.groupBy(F.col("lon").alias("lon2"), F.col("lat").alias("lat2")).agg(F.min("id").alias("other"))
    best = near_places(left, right, km).join(first, ["lon2", "lat2"]).groupBy("lon", "lat").agg(F.min(F.struct("km", "other")).alias("best"))
    return left.select("id", "lon", "lat").join(best, ["lon", "lat"], "left").select("id", F.col("best.other").alias("nearest"), F.col("best.km").alias("km"))


def nearest(left: DataFrame, right: DataFrame, k: int = 1, first_km: float = 0.5, farthest_km: float = math.pi * EARTH_KM, fits: str = "true") -> DataFrame:
    """id, rank (from 1), other, km: the ``k`` nearest rows of ``right`` for each of ``left`` (both id, lon, lat), however far, up to ``farthest_km``.

    Distances that agree to a tenth of a millimetre are equal; the least id comes first then. ``fits`` is SQL over both sides (``a`` and ``b``) that a pair must
    meet, such as ``a.id <> b.id``. Rows without a place find and are found by nothing.

    Without a condition, or with this one, all rows of a place have the same nearest rows, but for their own number: these are sought once a place, of each
    place of ``right`` only the least ids. Ids are unique on either side.
    """
    spare = {"true": 0, "a.id <> b.id": 1}.get(fits)
    if spare is None:
        return _nearest(left, right, k, first_km, farthest_km, fits)
    most, place = k + spare, F.struct("lon", "lat").alias("id")
    number = Window.partitionBy("lon", "lat").orderBy("id")
    some = right.select("id", "lon", "lat").withColumn("__n", F.row_number().over(number)).filter(F.col("__n") <= most).drop("__n")
    places = left.filter("lon IS NOT NULL AND lat IS NOT NULL").select("lon", "lat").distinct().select(place, "lon", "lat")
    found = _nearest(places, some, most, first_km, farthest_km, "true").select("id.lon", "id.lat", "rank", "other", "km")
    near = found.groupBy("lon", "lat").agg(F.sort_array(F.collect_list(F.struct("rank", "other", "km"))).alias("near"))
    met = left.select("id", "lon", "lat").join(near, ["lon", "lat"])
    mine = F.col("near") if not spare else F.filter("near", lambda x: x["other"] != F.col("id"))
    return met.select("id", F.posexplode(F.slice(mine, 1, k)).alias("rank", "x")).select("id", (F.col("rank") + 1).alias("rank"), "x.other", "x.km")


def _nearest(left: DataFrame, right: DataFrame, k: int, first_km: float, farthest_km: float, fits: str) -> DataFrame:
    """As :func:`nearest`, row by row.

    Both sides lie in cubes around the points of the unit sphere, so poles and the date line are like any other place. Cubes are as wide as
    the radius; only rows that have found fewer than ``k`` go on with twice the radius, so that dense places are searched near by alone.
    """
    from corvane.operators.graph import kept

    def placed(rows: DataFrame) -> DataFrame:
        lon, lat = F.radians("lon"), F.radians("lat")
        return rows.filter("lon IS NOT NULL AND lat IS NOT NULL").withColumns({"__x": F.cos(lat) * F.cos(lon), "__y": F.cos(lat) * F.sin(lon), "__z": F.sin(lat)})

    a, b, out, radius = placed(left), placed(right), None, min(first_km, farthest_km)
    while True:
        wide = 2 * math.sin(min(radius / EARTH_KM, math.pi) / 2) * (1 + 1e-9)
        cell = lambda c: F.floor(F.col(c) / wide)  # noqa: B023, E731
        beside = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))  # noqa: B023, E731
        x = a.withColumns({"__i": cell("__x"), "__j": cell("__y"), "__k": cell("__z")}).alias("a")
        y = b.withColumn("__i", beside("__x")).withColumn("__j", beside("__y")).withColumn("__k", beside("__z")).alias("b")
        met = x.join(y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("__i", "__j", "__k")])
        met = met.filter(fits).select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), haversine_km(F.col("a.lon"), F.col("a.lat"), F.col("b.lon"), F.col("b.lat")).alias("km")).filter(F.col("km") <= radius)
        order = Window.partitionBy("id").orderBy(F.round("km", 7), "other")
        best = kept(met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("id", "rank", "other", "km"))
        if radius >= farthest_km:
            return best if out is None else out.unionByName(best)
        full = best.filter(F.col("rank") == k).select("id")
        done = best.join(full, "id", "left_semi")
        out = done if out is None else out.unionByName(done)
        a = kept(a.join(full, "id", "left_anti"))
        if a.isEmpty():
            return out
        radius = min(2 * radius, farthest_km)


def nearest_by_tier(left: DataFrame, tiers: list[tuple[DataFrame, float]], fits: str = "true") -> DataFrame:
    """id, tier (from 1), other, km: the nearest row of the first of ``tiers`` (rows and how far they may be, in km) that has one; rows without any are left out."""
    out, rest = None, left
    for i, (right, most) in enumerate(tiers, 1):
        found = nearest(rest, right, 1, min(0.5, most), most, fits).select("id", F.lit(i).alias("tier"), "other", "km")
        out = found if out is None else out.unionByName(found)
        rest = rest.join(found.select("id"), "id", "left_anti")
    return out


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, since: str, value: str) -> DataFrame:
    """Each left row with the ``value`` of the last right row of its key with ``since`` <= ``at``; null if none.

    Both sides are merged in order of time within a key, so no pair of rows is ever built.
    """
    columns = left.columns
    a = left.select(key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*columns).alias("__row"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(key, F.col(since).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    merged = b.unionByName(a).withColumn("__last", F.last("__v", ignorenulls=True).over(w))
    return merged.filter("__side = 1").select("__row.*", F.col("__last").alias(value))


def band_join(left: DataFrame, right: DataFrame, key: str, a: str, b: str, width: int) -> DataFrame:
    """Rows of one key whose whole numbers ``a`` and ``b`` differ by ``width`` at most, joined on buckets of that width."""
    x = left.withColumn("__bucket", F.floor(F.col(a) / width))
    y = right.withColumn("__bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(b) / width) + i)))
    return x.join(y, [key, "__bucket"]).filter(F.abs(F.col(a) - F.col(b)) <= width).drop("__bucket")


def outer_difference(before: DataFrame, after: DataFrame, key: str, value: str, least: float = 0.0) -> DataFrame:
    """key, before, after, change of every key on either side; what is missing counts as 0. Changes over ``least`` stay."""
    joined = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer")
    joined = joined.select(key, F.coalesce("before", F.lit(0.0)).alias("before"), F.coalesce("after", F.lit(0.0)).alias("after"))
    return joined.withColumn("change", F.col("after") - F.col("before")).filter(F.abs("change") > least)


def skyline(rows: DataFrame, group: list[str], costs: list[str]) -> DataFrame:
    """Rows that no row of their group beats: as good in every cost and better in one.

    Rows are first reduced to the distinct points of a group, and points that the group's
    best-by-sum point beats are left out before points are compared with each other.
    """
    points = rows.select(*group, *costs).distinct()
    total = sum((F.col(c) for c in costs[1:]), F.col(costs[0]))
    best = points.groupBy(*group).agg(F.min(F.struct(total.alias("__sum"), *costs)).alias("__best"))
    beats = lambda x, y: (all_of([x(c) <= y(c) for c in costs])) & any_of([x(c) < y(c) for c in costs])
    left = points.join(best, group).filter(~beats(lambda c: F.col(f"__best.{c}"), F.col)).drop("__best")
    other = left.select(*group, *(F.col(c).alias(f"__{c}") for c in costs))
    condition = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group] + [beats(lambda c: F.col(f"b.__{c}"), lambda c: F.col(f"a.{c}"))]
    front = left.alias("a").join(other.alias("b"), condition, "left_anti")
    return rows.join(front, [*group, *costs], "left_semi")


def all_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def any_of(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out
