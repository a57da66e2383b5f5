"""Choices of travellers on the given tables: modes, chains, stops, transfers, alternatives, and what remains in the air."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import choices
from corvane.plans.registry import query, table


def _point(k, lon: str, lat: str):
    return (k % 300 / 1000.0 - 3.35).alias(lon), (k * 7 % 150 / 1000.0 + 55.85).alias(lat)


_ALL = ("walk", "bike", "e_scooter", "cargo_bike", "car", "ev", "bus", "van_diesel", "flight_domestic", "intercity_train")


def _chain() -> str:
    """The filters of a trip as SQL, one step after the other."""
    listed = lambda names: "[" + ", ".join(f"'{n}'" for n in names) + "]"
    high, air = listed(choices.HIGH_EMISSION), listed(choices.FRAGILE + choices.OPEN_AIR)
    far = "list_filter(['walk', 'bike', 'cargo_bike', 'e_scooter'], lambda f: km > CASE f WHEN 'walk' THEN 5.0 WHEN 'bike' THEN 20.0 WHEN 'cargo_bike' THEN 12.0 ELSE 10.0 END)"
    steps = [
        (high, "aim = 'minimize_carbon'"), (listed(choices.EXPENSIVE), "aim = 'minimize_cost'"), ("['walk']", "aim = 'minimize_time' AND km > 3"), (air, "critical AND km > 2 AND (ice OR rain > 5)"),
        (listed(choices.FRAGILE), "critical AND km > 2 AND NOT (ice OR rain > 5)"), (high, "clean_zone"), (air, "weather_sensitive AND ice"), (far, "km > 2"),
    ]
    return ", ".join(
        f"s{i + 1} AS (SELECT * EXCLUDE (modes), CASE WHEN {when} AND len(list_filter(modes, lambda m: NOT list_contains({gone}, m))) > 0 THEN list_filter(modes, lambda m: NOT list_contains({gone}, m)) ELSE modes END AS modes FROM s{i})"
        for i, (gone, when) in enumerate(steps)
    )


@query(f"""WITH s0 AS (SELECT o_orderkey % 40 AS km, CASE o_orderkey % 4 WHEN 0 THEN 'minimize_carbon' WHEN 1 THEN 'minimize_cost' WHEN 2 THEN 'minimize_time' ELSE 'comfort' END AS aim, o_custkey % 2 = 0 AS critical, o_custkey % 5 = 0 AS clean_zone, o_custkey % 3 = 0 AS weather_sensitive, o_orderkey % 7 = 0 AS ice,
    o_orderkey % 11 AS rain, CASE WHEN o_custkey % 4 = 0 THEN ['walk', 'bike'] ELSE [{", ".join(f"'{m}'" for m in _ALL)}] END AS modes FROM orders), {_chain()} SELECT array_to_string(modes, ',') AS candidates, aim, count(*) AS n FROM s8 GROUP BY 1, 2""")
def candidate_modes(spark, sf_dir):
    """Modes that are left for trips of many aims, in rain and ice."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    aim = F.when(o % 4 == 0, "minimize_carbon").when(o % 4 == 1, "minimize_cost").when(o % 4 == 2, "minimize_time").otherwise("comfort")
    modes = F.when(c % 4 == 0, F.array(F.lit("walk"), F.lit("bike"))).otherwise(F.array(*(F.lit(m) for m in _ALL)))
    trips = table(spark, sf_dir, "orders").select((o % 40).alias("km"), aim.alias("aim"), (c % 2 == 0).alias("critical"), (c % 5 == 0).alias("clean_zone"), (c % 3 == 0).alias("weather_sensitive"), (o % 7 == 0).alias("ice"), (o % 11).alias("rain"), modes.alias("modes"))
    return choices.candidate_modes(trips).groupBy(F.array_join("candidates", ",").alias("candidates"), "aim").agg(F.count("*").alias("n"))


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians({b}lat) - radians({a}lat)) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin((radians({b}lon) - radians({a}lon)) / 2), 2))))"


@query(f"""WITH t AS (SELECT c_custkey AS id, c_custkey % 300 / 1000.0 - 3.35 AS lon, c_custkey * 7 % 150 / 1000.0 + 55.85 AS lat, CASE c_custkey % 4 WHEN 0 THEN 'ev' WHEN 1 THEN 'van_electric' WHEN 2 THEN 'hgv_electric' ELSE 'car' END AS mode, c_custkey * 13 % 400 AS km, c_custkey % 3 = 0 AS critical, c_custkey % 10 / 10.0 AS busy FROM customer),
    s AS (SELECT s_suppkey * 5 % 300 / 1000.0 - 3.35 AS lon, s_suppkey * 11 % 150 / 1000.0 + 55.85 AS lat FROM supplier), n AS (SELECT t.id, min({_KM.format(a="t.", b="s.")}) AS near FROM t, s GROUP BY 1), x AS (SELECT t.*, km * 1.35 AS way, CASE WHEN near <= 5 THEN near END AS near, CASE mode WHEN 'ev' THEN 350.0 WHEN 'van_electric' THEN 200.0 WHEN 'hgv_electric' THEN 300.0 END AS most FROM t LEFT JOIN n USING (id))
    SELECT mode, count(*) AS n, count(*) FILTER (most IS NULL OR NOT ((critical AND (busy > 0.1 OR way > 0.7 * most)) OR (busy >= 0.85 AND way > 8) OR km > 0.9 * most OR (way > 0.8 * most AND coalesce(near > 2, true)) OR (km > 0.5 * most AND near IS NULL))) AS feasible FROM x GROUP BY 1""")
def charge_feasibility(spark, sf_dir):
    """Trips by electric modes that get there with the chargers at hand."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    mode = F.when(k % 4 == 0, "ev").when(k % 4 == 1, "van_electric").when(k % 4 == 2, "hgv_electric").otherwise("car")
    trips = table(spark, sf_dir, "customer").select(k.alias("id"), *_point(k, "lon", "lat"), mode.alias("mode"), (k * 13 % 400).alias("km"), (k % 3 == 0).alias("critical"), (k % 10 / 10.0).alias("occupancy"))
    stations = table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 5 % 300 / 1000.0 - 3.35).alias("lon"), (s * 11 % 150 / 1000.0 + 55.85).alias("lat"))
    out = choices.charge_feasible(trips, stations).join(trips.select("id", "mode"), "id")
    return out.groupBy("mode").agg(F.count("*").alias("n"), F.count_if("feasible").alias("feasible"))


_LEG = "CASE l_partkey % 4 WHEN 0 THEN 'walk' WHEN 1 THEN 'bus' WHEN 2 THEN 'tram' ELSE 'local_train' END"


@query(f"""WITH l AS (SELECT l_orderkey AS trip, l_linenumber AS leg, {_LEG} AS mode, CAST(l_quantity AS DOUBLE) AS km FROM lineitem), x AS (SELECT *, lag(mode) OVER (PARTITION BY trip ORDER BY leg, mode, km) AS before, row_number() OVER (PARTITION BY trip ORDER BY mode = 'walk', CASE WHEN mode = 'walk' THEN 0 ELSE -km END, leg, CASE WHEN mode = 'walk' THEN km ELSE 0 END, mode DESC) AS k FROM l)
    SELECT trip, sum(km) AS km, sum(km * 2) AS minutes, sum(km * 80) AS grams, string_agg(mode, '>' ORDER BY leg, mode, km) AS path, max(mode) FILTER (k = 1) AS "primary", count(*) FILTER (before <> mode) AS transfers FROM x GROUP BY 1""")
def trip_chains(spark, sf_dir):
    """Totals, modes, main mode and changes of chains of legs."""
    p = F.col("l_partkey")
    mode = F.when(p % 4 == 0, "walk").when(p % 4 == 1, "bus").when(p % 4 == 2, "tram").otherwise("local_train")
    km = F.col("l_quantity").cast("double")
    legs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("leg"), mode.alias("mode"), km.alias("km"), (km * 2).alias("minutes"), (km * 80).alias("grams"))
    out = choices.chains(legs, "trip", "leg")
    return out.select("trip", "km", "minutes", "grams", F.array_join("modes", ">").alias("path"), "primary", "transfers")


@query("""WITH w AS (SELECT c_custkey AS way, c_custkey % 300 / 1000.0 - 3.35 AS lon1, c_custkey * 7 % 150 / 1000.0 + 55.85 AS lat1, c_custkey * 17 % 300 / 1000.0 - 3.35 AS lon2, c_custkey * 11 % 150 / 1000.0 + 55.85 AS lat2 FROM customer), s AS (SELECT s_suppkey * 3 % 300 / 1000.0 - 3.3493 AS lon, s_suppkey * 13 % 150 / 1000.0 + 55.8503 AS lat FROM supplier),
    p AS (SELECT *, ((lon - lon1) * (lon2 - lon1) + (lat - lat1) * (lat2 - lat1)) / nullif((lon2 - lon1) * (lon2 - lon1) + (lat2 - lat1) * (lat2 - lat1), 0) AS share FROM w, s) SELECT way, count(*) AS stops, round(sum(share), 6) AS shares FROM p
    WHERE share > 0 AND share < 1 AND sqrt(pow(lon1 + share * (lon2 - lon1) - lon, 2) + pow(lat1 + share * (lat2 - lat1) - lat, 2)) < 0.005 GROUP BY 1""")
def stops_on_the_way(spark, sf_dir):
    """Stops beside straight ways."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    ways = table(spark, sf_dir, "customer").select(k.alias("way"), *_point(k, "lon1", "lat1"), (k * 17 % 300 / 1000.0 - 3.35).alias("lon2"), (k * 11 % 150 / 1000.0 + 55.85).alias("lat2"))
    stops = table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 3 % 300 / 1000.0 - 3.3493).alias("lon"), (s * 13 % 150 / 1000.0 + 55.8503).alias("lat"))
    return choices.stops_between_totals(ways, stops).withColumn("shares", F.round("shares", 6))


@query(f"""WITH s AS (SELECT s_suppkey AS id, s_suppkey % 30 / 1000.0 - 3.35 AS lon, s_suppkey * 7 % 15 / 1000.0 + 55.85 AS lat FROM supplier), p AS (SELECT a.id AS u, {_KM.format(a="a.", b="b.")} AS km FROM s a JOIN s b ON a.id <> b.id) SELECT u, count(*) AS n, round(sum(km * 1000 / 1.2), 4) AS seconds FROM p WHERE km <= 0.5 GROUP BY 1""")
def transfer_edges(spark, sf_dir):
    """Ways on foot between stops."""
    k = F.col("s_suppkey")
    stops = table(spark, sf_dir, "supplier").select(k.alias("id"), (k % 30 / 1000.0 - 3.35).alias("lon"), (k * 7 % 15 / 1000.0 + 55.85).alias("lat"))
    return choices.transfer_totals(stops).withColumn("seconds", F.round("seconds", 4))


@query("""WITH a AS (SELECT l_orderkey AS trip, l_linenumber AS way, l_quantity AS time, l_extendedprice AS cost, CASE WHEN l_linenumber % 3 > 0 THEN l_discount END AS emissions, CASE WHEN l_linenumber % 5 > 0 THEN l_tax END AS risk, l_quantity * 2 AS distance FROM lineitem)
    SELECT trip, way FROM a WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.trip = a.trip AND b.way <> a.way AND NOT (b.time > a.time OR b.cost > a.cost OR coalesce(b.emissions > a.emissions, false) OR coalesce(b.risk > a.risk, false) OR b.distance > a.distance)
    AND (b.time < a.time OR b.cost < a.cost OR coalesce(b.emissions < a.emissions, false) OR coalesce(b.risk < a.risk, false) OR b.distance < a.distance))""")
def alternatives_front(spark, sf_dir):
    """Alternatives of a trip that no other beats in time, cost, emissions, risk and distance, as far as these are known."""
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trip"), n.alias("way"), F.col("l_quantity").alias("time"), F.col("l_extendedprice").alias("cost"), F.when(n % 3 > 0, F.col("l_discount")).alias("emissions"), F.when(n % 5 > 0, F.col("l_tax")).alias("risk"), (F.col("l_quantity") * 2).alias("distance")
    )
    return choices.front(rows, "trip", "way", ["time", "cost", "emissions", "risk", "distance"]).select("trip", "way")


_STEP = "CAST(ts AS DATE) - DATE '2024-01-01'"


@query(f"""WITH e AS (SELECT user_id % 50 AS cell, value, (SELECT max({_STEP}) FROM events) - ({_STEP}) + 1 AS age FROM events) SELECT cell, round(sum(value * pow(0.8, age)), 6) AS current, round(sum(value * 0.8 * (1 - pow(0.8, age)) / 0.2), 4) AS total FROM e GROUP BY 1""")
def air_quality_levels(spark, sf_dir):
    """What is left of emissions in a steady wind, and what a cell took in over time."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("cell"), F.datediff("ts", F.lit("2024-01-01").cast("date")).alias("step"), "value")
    return choices.decayed_levels(e, "cell", "step", "value").select("cell", F.round("current", 6).alias("current"), F.round("total", 4).alias("total"))


@query(f"""WITH d AS (SELECT event_type AS mode, {_STEP} AS step, count(*) AS n FROM events GROUP BY 1, 2), h AS (SELECT mode, step, n / 1000.0 AS s, n / 10.0 AS flow, step % 10 / 10.0 AS built FROM d)
    SELECT mode, step, round(s, 9) AS share, round(0.8 - s, 9) AS distance, round(s / 0.8, 9) AS saturation, round(s * s, 9) AS squared, round(0.05 * s * (1 - s / 0.8), 9) AS logistic, round(1 - s / 0.8, 9) AS room, round(0.02 * built, 9) AS infrastructure, round(0.03 * s * (1 - s / 0.8), 9) AS social,
    round(s * (0.8 - s), 9) AS interaction, round(0.05 * (0.8 - s), 9) AS potential, round(coalesce(flow - lag(flow) OVER (PARTITION BY mode ORDER BY step), 0), 9) AS acceleration FROM h""")
def flow_features(spark, sf_dir):
    """Terms of the adoption equation, by mode and day."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("step")).agg(F.count("*").alias("n"))
    h = d.select("mode", "step", (F.col("n") / 1000.0).alias("share"), (F.col("n") / 10.0).alias("flow"), (F.col("step") % 10 / 10.0).alias("built"))
    out = choices.flow_features(h, "mode", "step", 0.05, 0.8, 0.02, 0.03)
    return out.select("mode", "step", *(F.round(c, 9).alias(c) for c in out.columns[2:]))


@query("""SELECT o_orderpriority AS kind, round(sum(100 * (0.85 + CAST('0x' || substr(sha256(o_orderkey || '|' || o_orderkey % 97 || '|' || o_custkey), 1, 8) AS BIGINT) % 1000 / 1000 * 0.3)), 4) AS weight FROM orders GROUP BY 1""")
def perturbed_weights(spark, sf_dir):
    """Weights of edges as each agent sees them."""
    weight = choices.perturbed(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderkey") % 97, F.lit(100.0))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("kind")).agg(F.round(F.sum(weight), 4).alias("weight"))
