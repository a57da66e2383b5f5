"""Many rows at few places: what is near is found for places, not for rows. Row by row each of these would build 10 billion pairs or more."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import choices, joins, lines, transit

N = 120_000


def _rows(spark, n=N):
    """``n`` rows of even and odd number at two places 0.4 km apart."""
    return spark.range(n).select("id", F.lit(0.0).alias("lon"), (F.col("id") % 2 * 0.4 / 111.19492664455873).alias("lat"))


def test_radius_join_builds_no_pair_beyond_the_radius(spark):
    left, right = _rows(spark), _rows(spark).filter("id % 2 = 1 OR id < 4")
    # One cell holds both places, but only 0 and 2 lie at the even one.
    got = joins.radius_join(left.filter("id % 2 = 0"), right, 0.3).groupBy("other").count().collect()
    assert {r.other: r["count"] for r in got} == {0: N // 2, 2: N // 2}


def test_pairs_of_one_place_are_dealt_out(spark):
    # 16 million pairs of one place and the next one; tasks give about as many each.
    left, right = _rows(spark, 4000).filter("id % 2 = 0"), _rows(spark, 8000).filter("id % 2 = 1")
    got = joins.radius_join(left.union(left), right, 0.5, 1).groupBy(F.spark_partition_id().alias("task"), "km").count().collect()
    assert {r.km for r in got} == {0.4} and sum(r["count"] for r in got) == 4000 * 4000
    assert max(r["count"] for r in got) < 0.6 * 4000 * 4000


def test_radius_join_keeps_rows_without_id(spark, monkeypatch):
    monkeypatch.setattr(joins, "TOGETHER", 2)
    frame = lambda rows: spark.createDataFrame(rows, "id int, lon double, lat double")
    left = frame([(None, 0.0, 0.0), (1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.001), (3, None, 0.0), (4, 1.0, None), (None, -0.0, 0.0)])
    got = sorted((str(r.id), r.other) for r in joins.radius_join(left, frame([(7, 0.0, 0.0), (7, 0.0, 0.0), (8, 0.0, 0.0), (9, None, None)]), 0.05).collect())
    assert got == sorted((str(x), y) for x in (None, None, 1, 1) for y in (7, 7, 8))


def test_nearest_join_at_one_place(spark):
    got = joins.nearest_join(_rows(spark), _rows(spark), 1.0).groupBy("nearest", "km").count().collect()
    assert {(r.nearest, r.km): r["count"] for r in got} == {(0, 0.0): N // 2, (1, 0.0): N // 2}


def test_deserts_at_one_place(spark):
    stops = _rows(spark).withColumn("headway", (600 + F.col("id") % 1000).cast("int"))
    got = transit.deserts(_rows(spark), stops).groupBy("km", "headway", "stops").count().collect()
    assert {(r.km, r.headway, r.stops): r["count"] for r in got} == {(0.0, 600, N): N // 2, (0.0, 601, N): N // 2}


def test_modal_shift_at_one_place(spark):
    trips = _rows(spark).withColumn("km", 1 + F.col("id") % 2)
    stops = _rows(spark).select("*", F.lit(600).alias("headway"), F.lit(0.1).alias("price"))
    got = transit.modal_shift(trips, stops).groupBy("km").agg(F.count("*").alias("n"), F.min("transit_cost").alias("a"), F.max("transit_cost").alias("b")).collect()
    assert {r.km: (r.n, r.a) for r in got} == {k: (N // 2, pytest.approx((k * 3 + 5) / 6 + k * 0.1)) for k in (1, 2)} and all(r.a == r.b for r in got)


def test_chargers_at_one_place(spark):
    trips = _rows(spark).select("*", F.lit("ev").alias("mode"), F.lit(260).alias("km"), F.lit(False).alias("critical"), F.lit(0.0).alias("occupancy"))
    got = choices.charge_feasible(trips, _rows(spark)).groupBy("feasible").count().collect()
    assert {r.feasible: r["count"] for r in got} == {True: N}


def test_transfer_totals_equal_the_pairs(spark):
    few = _rows(spark, 10).union(spark.createDataFrame([(99, 5.0, 5.0)], "id long, lon double, lat double"))
    pairs = choices.transfers(few).groupBy("u").agg(F.count("*").alias("n"), F.sum("seconds").alias("s")).collect()
    got = {r.u: (r.n, pytest.approx(r.seconds)) for r in choices.transfer_totals(few).collect()}
    assert {r.u: (r.n, r.s) for r in pairs} == got and 99 not in got and got[0][0] == 9
    all_of = choices.transfer_totals(_rows(spark)).agg(F.count("*").alias("u"), F.min("n").alias("a"), F.max("n").alias("b")).first()
    assert (all_of.u, all_of.a, all_of.b) == (N, N - 1, N - 1)


def test_totals_of_stops_between_equal_the_pairs(spark):
    ways = lambda n: spark.range(n).select(F.col("id").alias("way"), F.lit(-1.0).alias("lon1"), F.lit(0.001).alias("lat1"), F.lit(1.0 * 3).alias("lon2"), F.lit(0.001).alias("lat2"))
    pairs = choices.stops_between(ways(3), _rows(spark, 10)).groupBy("way").agg(F.count("*").alias("n"), F.sum("share").alias("s")).collect()
    got = {r.way: (r.stops, pytest.approx(r.shares)) for r in choices.stops_between_totals(ways(3), _rows(spark, 10)).collect()}
    assert {r.way: (r.n, r.s) for r in pairs} == got and got[0][0] == 10
    many = choices.stops_between_totals(ways(N), _rows(spark)).groupBy("stops").count().collect()
    assert [(r.stops, r["count"]) for r in many] == [(N, N)]


def test_nearest_by_tier_at_one_place(spark):
    tiers = [(_rows(spark).filter("id % 2 = 1"), 0.1), (_rows(spark), 2.0)]
    got = joins.nearest_by_tier(_rows(spark), tiers).groupBy("tier", "other").count().collect()
    assert {(r.tier, r.other): r["count"] for r in got} == {(1, 1): N // 2, (2, 0): N // 2}


def test_nearest_of_another_number_at_one_place(spark):
    got = joins.nearest(_rows(spark), _rows(spark), 2, fits="a.id <> b.id").filter("id < 5 OR id > 119_997".replace("_", "")).collect()
    found = {(r.id, r.rank): r.other for r in got}
    assert found == {(i, n): o for i in (0, 1, 2, 3, 4, N - 2, N - 1) for n, o in enumerate([x for x in range(i % 2, 8, 2) if x != i][:2], 1)}


def test_trips_with_the_same_ends_on_lines_with_the_same_points(spark):
    points = F.expr("transform(sequence(0, 3), k -> struct(k / 10.0D as lon, 0.0D as lat))")
    trips = spark.range(N).select(F.col("id").alias("trip"), F.lit(0.05).alias("lon1"), F.lit(0.001).alias("lat1"), (F.col("id") % 2 * 0.1 + 0.15).alias("lon2"), F.lit(0.0).alias("lat2"))
    got = lines.matched(trips, spark.range(5, 20_005).select(F.col("id").alias("line"), points.alias("points")))
    got = got.groupBy("line", F.round("to_offset", 9).alias("to"), F.size("points").alias("n")).count().collect()
    assert {(r.line, r.to, r.n): r["count"] for r in got} == {(5, 0.15, 3): N // 2, (5, 0.25, 4): N // 2}


def test_rides_between_stops_of_many_lines(spark):
    held = spark.range(N).select(F.col("id").alias("line"), F.array(F.lit(1), F.lit(2), (3 + F.col("id") % 2).cast("int"), F.lit(2), F.lit(9)).alias("stops"))
    trips = spark.range(N).select(F.col("id").alias("trip"), F.lit(9).alias("origin"), F.lit(2).alias("destination"))
    got = lines.ordered_ride(trips, held).groupBy("line", "stops").count().collect()
    assert [(r.line, r.stops, r["count"]) for r in got] == [(0, [9, 2, 3, 2], N)]


def test_rides_along_a_long_line(spark):
    held = spark.createDataFrame([(1, list(range(500))), (2, list(range(0, 500, 5))), (3, [7, 8, None, 7, 400])], "line int, stops array<int>")
    trips = spark.createDataFrame([(1, 0, 495), (2, 3, 4), (3, 499, 0), (4, 400, 7), (5, 3, 700)], "trip int, origin int, destination int")
    got = {r.trip: (r.line, r.stops) for r in lines.ordered_ride(trips, held).collect()}
    assert got == {1: (2, list(range(0, 500, 5))), 2: (1, [3, 4]), 3: (1, list(range(499, -1, -1))), 4: (3, [400, 7, None, 8, 7])}
