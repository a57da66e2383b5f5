"""Operators against values worked out by hand or by brute force."""

import heapq
import math
import random
from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import clock, cost, geo
from corvane.operators import graph, joins, policy, series, stats, text, transit


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_feed_seconds(spark):
    rows = spark.createDataFrame([("07:05:00",), ("25:30:00",), ("bad",), (None,), ("1:2",)], "t string")
    assert [r[0] for r in rows.select(clock.feed_seconds(F.col("t"))).collect()] == [25500, 91800, -1, -1, -1]


def test_geometry(spark):
    l = F.lit
    r = one(spark, geo.haversine_km(l(0.0), l(0.0), l(1.0), l(0.0)), geo.bearing(l(0.0), l(0.0), l(1.0), l(0.0)), geo.turn(l(10.0), l(190.0)), geo.grid_cell(l(-3.19), 0.009), geo.is_lonlat(l(200.0), l(0.0)))
    assert r[0] == pytest.approx(111.1949, abs=1e-3)
    assert r[1] == pytest.approx(90.0)
    assert (r[2], r[3], r[4]) == (180.0, -354, False)


def test_costs(spark):
    l = F.lit
    r = one(spark, cost.congestion_factor(l(3), l(12)), cost.congestion_factor(l(3), l(8)), cost.congestion_factor(l(0), l(8)), cost.adoption_flow(l(0.1), 0.05, 0.8, 100.0, 0.02, 0.03), cost.gradient_factor(l(0.5)))
    assert list(r) == pytest.approx([1.45, 2.175, 1.0, 0.027, 2.0])


def test_moving_average_and_gradient(spark):
    rows = spark.createDataFrame([(i, 1.0 if i == 15 else 0.0) for i in range(30)], "i int, x double")
    w = Window.orderBy("i")
    got = {r[0] for r in rows.select("i", series.smoothed("x", w).alias("s")).filter("s > 0").collect()}
    assert got == set(range(11, 21))
    squares = spark.createDataFrame([(i, float(i * i)) for i in range(4)], "i int, x double")
    assert [r[0] for r in squares.orderBy("i").select(series.gradient("x", w)).collect()] == [1, 2, 4, 5]


def test_shares_fill_zeros_from_the_first_step_on(spark):
    rows = [(0, m) for m in ("car", "car", "ev", "bus")] + [(1, m) for m in ("car", "ev", "ev", "ev")] + [(1, "tram")]
    got = {(r.step, r.mode): r.share for r in series.shares(spark.createDataFrame(rows, "step int, mode string"), "step", "mode").collect()}
    assert got[0, "car"] == 50 and got[1, "bus"] == 0 and (0, "tram") not in got


def test_headways(spark):
    rows = spark.createDataFrame([("a", 25200), ("a", 26100), ("a", 27600), ("b", 1)], "k string, t int")
    assert {r.k: r.headway for r in series.headways(rows, ["k"], "t").collect()} == {"a": 1200, "b": 3600}


def test_crossings_fire_again_after_falling_back(spark):
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate((0.29, 0.31, 0.32, 0.28, 0.33))], "k string, i int, x double")
    assert sorted(r.i for r in series.crossings(rows, "k", "i", "x", 0.3).collect()) == [1, 4]


def test_rules_cool_down(spark):
    states = spark.createDataFrame([("r", i, 1.0) for i in range(10)], "run string, step int, grid_load double")
    got = policy.fired(states, [{"name": "a", "condition": "grid_load > 0", "cooldown": 4}, {"name": "b", "condition": "temperature > 0"}]).collect()
    assert sorted((r.rule, r.step) for r in got) == [("a", 0), ("a", 4), ("a", 8)]


def test_statistics(spark):
    rows = spark.createDataFrame([({"time": 2.0, "cost": -2.0},), ({"time": 4.0},)], "f map<string,double>")
    assert {r.factor: r.percent for r in stats.factor_importance(rows, "f").collect()} == pytest.approx({"time": 60, "cost": 40})
    assert list(one(spark, *(stats.charger_efficiency(F.lit(u)) for u in (0.35, 0.75, 0.9)))) == pytest.approx([0.5, 1.0, 0.8])
    use = spark.createDataFrame([(0.97, 1), (0.1, 1), (0.1, 0), (0.5, 1)], "u double, c int")
    assert sorted((r.kind, round(r.severity, 4)) for r in stats.bottlenecks(use, "u", "c").collect()) == [("overloaded", 0.7), ("underused", 0.6667)]


def test_returns(spark):
    r = policy.returns(spark.createDataFrame([("x", 1000.0, 0.0, 2000.0, 5)], "policy string, implementation double, opex double, saved_kg double, agents int")).first()
    assert (r.total_cost, r.gain, r.bcr, r.payback_days) == pytest.approx((1000, 50, 0.05, 140))


def test_radius_and_nearest_equal_brute_force(spark):
    rng = random.Random(3)
    a = [(i, rng.uniform(-4, -2), rng.uniform(54, 61)) for i in range(150)] + [(900, 10.0, 88.0)]
    b = [(i, x + rng.gauss(0, 0.05), y + rng.gauss(0, 0.05)) for i, x, y in a]

    def km(p, q):
        h = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371 * math.asin(math.sqrt(min(1, h)))

    x, y = (spark.createDataFrame(r, "id long, lon double, lat double") for r in (a, b))
    got = {(r.id, r.other) for r in joins.radius_join(x, y, 6.0).collect()}
    assert got == {(p[0], q[0]) for p in a for q in b if km(p, q) <= 6.0}
    near = {r.id: r.nearest for r in joins.nearest_join(x, y, 6.0).collect()}
    assert near == {p[0]: min(((km(p, q), q[0]) for q in b if km(p, q) <= 6.0), default=(0, None))[1] for p in a}


def test_asof_and_band(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1), (3, "b", 9), (4, None, 9)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("c", 0, "z")], "k string, s int, v string")
    assert {r.id: r.v for r in joins.asof_join(left, right, "k", "t", "s", "v").collect()} == {1: "y", 2: None, 3: None, 4: None}
    x = spark.createDataFrame([("a", i) for i in (-11, 0, 9, 25)], "k string, p int")
    y = spark.createDataFrame([("a", i) for i in (-1, 10, 36)], "k string, q int")
    assert {(r.p, r.q) for r in joins.band_join(x, y, "k", "p", "q", 10).collect()} == {(p, q) for p in (-11, 0, 9, 25) for q in (-1, 10, 36) if abs(p - q) <= 10}


def test_skyline(spark):
    rows = spark.createDataFrame([("g", 1, 5), ("g", 2, 4), ("g", 2, 6), ("g", 1, 5)], "g string, a int, b int")
    assert sorted((r.a, r.b) for r in joins.skyline(rows, ["g"], ["a", "b"]).collect()) == [(1, 5), (1, 5), (2, 4)]


def edges_of(n, m, seed):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(m)})


def test_graph_operators_equal_brute_force(spark):
    e = edges_of(40, 45, 1)
    frame = spark.createDataFrame(e, "src long, dst long")
    label = {x: x for p in e for x in p}
    for _ in label:
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in graph.components(frame).collect()}
    assert got == {n: c for n, c in label.items() if any(n in p and p[0] != p[1] for p in e)}
    start = e[0][0]
    best, heap = {}, [(0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for a, b in e:
                if a == x:
                    heapq.heappush(heap, (d + 1 + (a * 7 + b) % 5, b))
    costs = frame.withColumn("cost", 1.0 + (F.col("src") * 7 + F.col("dst")) % 5)
    source = spark.createDataFrame([(start,)], "node long")
    assert {r.node: r.cost for r in graph.shortest_paths(costs, source).collect()} == best
    assert {r.node for r in graph.hops(frame, source).collect()} == set(best)


def test_roots_follow_chains_and_survive_cycles(spark):
    parents = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (7, 8), (8, 9), (9, 7), (10, 9), (20, 21)], "node long, parent long")
    got = {r.node: r.root for r in graph.roots(parents).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 20)} == {1: 1, 2: 1, 3: 1, 4: 1, 20: 21}
    assert got[7] == got[8] == got[9] == 7


def test_journeys_by_rounds(spark):
    patterns = spark.createDataFrame([("r", 0, 0, "a", 600), ("r", 0, 1, "b", 600), ("s", 0, 0, "b", 240), ("s", 0, 1, "c", 240)], "route string, pattern int, seq int, stop string, headway int")
    pairs = spark.createDataFrame([("r", "a", "b", 100)], "route string, u string, v string, seconds int")
    walk = spark.createDataFrame([("c", "d", 50)], "u string, v string, seconds int")
    got = {r.stop: (r.seconds, r.boardings) for r in transit.journeys(patterns, pairs, walk, spark.createDataFrame([(0, "a")], "origin int, stop string")).collect()}
    assert got == {"a": (0, 0), "b": (400, 1), "c": (400 + 600 + 120 + 60, 2), "d": (1230, 2)}


def test_desert_score(spark):
    people = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 50.0)], "id long, lon double, lat double")
    stops = spark.createDataFrame([(9, 0.4 / 111.19493, 0.0, 900)], "id long, lon double, lat double, headway int")
    got = {r.id: r.score for r in transit.deserts(people, stops).collect()}
    assert got[1] == pytest.approx(0.5333, abs=1e-4) and got[2] == 1.0


def test_text_rules(spark):
    rows = spark.createDataFrame([("Electric tram",), ("plain",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.route_fuel(F.col("t"), F.lit(3))).collect()] == ["electric", "diesel", "diesel"]
    kinds = {"a": ["bus", "tram"], "b": ["plain"]}
    assert [r[0] for r in rows.select(text.archetype(F.col("t"), kinds, "none")).collect()] == ["a", "b", "none"]
    payload = spark.createDataFrame([('{"a": 1}', "x"), ('{"a": null, "b": 2}', "x"), ("{}", "y")], "p string, k string")
    assert [r[0] for r in payload.select(text.missing_keys(F.col("p"), F.col("k"), {"x": ["a", "b"]})).collect()] == [["b"], ["a"], []]
    assert date(2024, 1, 1).strftime("%A").lower() == "monday"


def test_long_run_shares_equal_brute_force(spark):
    import numpy as np

    from corvane.operators.policy import stationary

    matrix = np.array([[0.9, 0.1, 0.0], [0.2, 0.5, 0.3], [0.0, 0.4, 0.6]])
    rows = [(f"m{i}", f"m{j}", float(matrix[i, j])) for i in range(3) for j in range(3) if matrix[i, j]]
    got = {r.mode: r.p for r in stationary(spark.createDataFrame(rows, "a string, b string, p double"), "a", "b").collect()}
    want = np.linalg.matrix_power(matrix, 4000)[0]
    assert [got[f"m{i}"] for i in range(3)] == pytest.approx(want, abs=1e-8)
    swing = spark.createDataFrame([("x", "y", 1.0), ("y", "x", 1.0)], "a string, b string, p double")
    assert {r.mode: r.p for r in stationary(swing, "a", "b").collect()} == pytest.approx({"x": 0.5, "y": 0.5})


def test_rules_fire_as_a_plain_loop_says(spark):
    import random

    from corvane.operators.policy import fired

    rng = random.Random(6)
    states = [(r, s, rng.random() * 100) for r in range(5) for s in range(60)]
    rules = [{"name": "high", "condition": "grid_load > 60", "cooldown": 4}, {"name": "low", "condition": "grid_load < 20", "cooldown": 0}, {"name": "unknown", "condition": "temperature < 5"}]
    want = []
    for rule, holds in (("high", lambda x: x > 60), ("low", lambda x: x < 20)):
        wait, last = {"high": 4, "low": 1}[rule], {}
        for r, s, x in states:
            if holds(x) and s - last.get(r, -99) >= wait:
                last[r] = s
                want.append((r, s, rule))
    got = fired(spark.createDataFrame(states, "run int, step int, grid_load double"), rules)
    assert sorted((r.run, r.step, r.rule) for r in got.collect()) == sorted(want)


def test_two_sided_probability(spark):
    import math

    from corvane.operators.stats import two_sided

    z = [0.0, 0.3, -1.0, 1.96, 3.5, -6.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(two_sided(F.col("z"))).collect()]
    assert got == pytest.approx([math.erfc(abs(x) / math.sqrt(2)) for x in z], rel=2e-7)


def test_ranks_over_many_partitions(spark):
    import random

    from corvane.operators.stats import before, exposure_summary

    rng = random.Random(3)
    rows = [(k, rng.randint(0, 500) / 10) for k in ("a", "b") for _ in range(400)] + [("c", 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(7)
    sizes = frame.groupBy("k", "v").agg(F.count("*").alias("t"))
    assert all(r.before == sum(v < r.v for k, v in rows if k == r.k) for r in before(sizes, "k", "v", "t").collect())
    for r in exposure_summary(frame, "k", "v").collect():
        own = sorted(v for k, v in rows if k == r.k)
        assert (r.n, r.least, r.greatest, r.median, r.p95) == (len(own), own[0], own[-1], own[len(own) // 2], own[int(len(own) * 0.95)] if len(own) > 20 else own[-1])


def test_lifecycle_of_a_car(spark):
    from corvane.functions.trips import lifecycle

    row = spark.range(1).select(*(c.alias(k) for k, c in lifecycle(F.lit(100.0), F.lit("car")).items())).first()
    assert (row.manufacturing_co2e_kg, row.energy_co2e_kg, row.upstream_co2e_kg, row.co2e_kg) == pytest.approx((4.0, 18.76, 3.5, 26.26))


def test_words_of_beliefs_jobs_and_times(spark):
    rows = spark.createDataFrame([("Every bus is late", "ambulance_run", "6:30", 90), ("Traffic jams", "van_delivery", "6", 4320), (None, "scenic_tour", "x", 600_000)], "belief string, job string, at string, minutes long")
    job = F.col("job")
    got = rows.select(text.belief_key(F.col("belief")), text.job_kind(job), text.ev_threshold(F.lit(0.5), job, text.job_kind(job)), text.clock_minutes(F.col("at")), text.duration(F.col("minutes"))).collect()
    assert [tuple(r) for r in got] == [("ev_is_viable", "nhs_operations", 0.65, 390, "1.5 hours"), ("congestion_likely", "freight", 0.6, 360, "3.0 days"), (None, "passenger_errand", 0.4, None, "1.1 years")]


def test_arcs_and_slices(spark):
    from corvane.functions.geo import arc, bounds_of, sliced

    p = lambda lon, lat: F.struct(F.lit(float(lon)).alias("lon"), F.lit(float(lat)).alias("lat"))
    one = spark.range(1)
    shape = F.array(*(p(x, 0) for x in range(6)))
    row = one.select(arc(p(0, 0), p(90, 0), 4).alias("a"), arc(p(5, 5), p(5, 5), 3).alias("same"), sliced(shape, p(1.1, 0.2), p(3.9, 0)).alias("s"), sliced(shape, p(4, 0), p(2, 0)).alias("back")).first()
    assert [x.lon for x in row.a] == pytest.approx([0, 30, 60, 90]) and [x.lat for x in row.a] == pytest.approx([0] * 4)
    assert [(x.lon, x.lat) for x in row.same] == [(5, 5)] * 3
    assert [x.lon for x in row.s] == [1, 2, 3, 4] and [x.lon for x in row.back] == [4, 3, 2]
    assert tuple(bounds_of(one.select(F.lit(1.0).alias("lon"), F.lit(2.0).alias("lat")).limit(0)).first()) == (0, 0, 0, 0)
