"""What trips and roads cost in time, money and carbon, season, weather, minds: formulas of the study on the trade tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.functions import conditions, minds, trips
from corvane.functions import values as V
from corvane.plans.registry import query, table

#: Modes that rows of the trade tables stand for, in turn; two of them are in no table of trips.
_NAMES = [*V.MODES, "ebike", "hovercraft"]
_LIST = "[" + ", ".join(f"'{m}'" for m in _NAMES) + "]"


def _case(column: str, values: dict, default) -> str:
    """SQL of a table look-up."""
    return "CAST(CASE " + column + "".join(f" WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END AS DOUBLE)"


def _strings(names) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _mode(key: str):
    return F.element_at(F.array(*(F.lit(m) for m in _NAMES)), (F.col(key) % len(_NAMES) + 1).cast("int"))


def _trips(spark, sf_dir) -> DataFrame:
    """Lines as trips: a mode by part, km by quantity, and the points that are known of the way."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(_mode("l_partkey").alias("mode"), F.col("l_quantity").cast("double").alias("km"), F.when(F.col("l_linenumber") % 2 == 0, 2).otherwise(20).alias("points"), "l_orderkey", "l_tax", "l_discount", "l_linenumber", "l_shipdate")


_TRIPS = f"""t AS (SELECT list_extract({_LIST}, CAST(l_partkey % {len(_NAMES)} + 1 AS BIGINT)) AS mode, CAST(l_quantity AS DOUBLE) AS km, CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 20 END AS points, l_orderkey, l_tax, l_discount, l_linenumber, l_shipdate FROM lineitem)"""
_ENDS = f"(mode IN {_strings(V.DETOUR)} AND points <= 3)"


def _sums(rows: DataFrame, by: str, columns: dict, digits: int = 5) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"), *(F.round(F.sum(c), digits).alias(k) for k, c in columns.items()))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{v[0]}', {v[1]}, {v[2]}, {v[3]}, {v[4] if v[4] is not None else 'CAST(NULL AS INT)'})" for m, v in V.MODES.items()) + ") AS m(mode, network, grams_km, kmh, routed, range_km)")
def mode_parameters(spark, sf_dir):
    """The table of modes."""
    return spark.createDataFrame([(m, *v) for m, v in V.MODES.items()], "mode string, network string, grams_km int, kmh int, routed boolean, range_km int")


@query(f"""WITH {_TRIPS}, m AS (SELECT mode, km / {_case('mode', V.TRIP_SPEED, 0.1)} * CASE WHEN {_ENDS} THEN {_case('mode', V.DETOUR, 1.15)} ELSE 1 END + CASE WHEN {_ENDS} THEN {_case('mode', V.BOARDING, 20)} ELSE 0 END + CASE WHEN mode = 'tram' THEN 9 ELSE 0 END AS minutes,
    {_case('mode', {k: p[0] for k, p in V.TRIP_PRICE.items()}, 1)} + {_case('mode', {k: p[1] for k, p in V.TRIP_PRICE.items()}, 0)} * (CASE WHEN {_ENDS} THEN km * {_case('mode', V.DETOUR, 1.15)} ELSE km END) AS price,
    km * {_case('mode', V.TRIP_GRAMS, 100)} AS grams, {_case('mode', V.COMFORT, 0.5)} AS comfort, {_case('mode', V.RISK, 0.2)} AS risk FROM t)
    SELECT mode, count(*) AS n, round(sum(minutes), 5) AS minutes, round(sum(price), 5) AS price, round(sum(grams), 5) AS grams, round(avg(comfort), 5) AS comfort, round(avg(risk), 5) AS risk FROM m GROUP BY 1""")
def trip_metrics(spark, sf_dir):
    """Minutes, fares, grams, comfort and risk of all trips by mode."""
    km, mode, points = F.col("km"), F.col("mode"), F.col("points")
    out = _sums(_trips(spark, sf_dir), "mode", {"minutes": trips.minutes(km, mode, points), "price": trips.price(km, mode, points), "grams": trips.grams(km, mode)})
    return out.withColumns({"comfort": F.round(trips.comfort(mode), 5), "risk": F.round(trips.risk(mode), 5)})


_DRIVE = f"CASE WHEN mode IN {_strings([*V.DIESEL, *V.ELECTRIC, *V.HYDROGEN, *V.PASSENGER_KG])} THEN mode ELSE 'car' END"
_LIFE = f"""l AS (SELECT *, {_DRIVE} AS drive FROM t), u AS (SELECT *, km / 100 * {_case('drive', V.BURNT, 7)} AS used FROM l),
    e AS (SELECT mode, km, CASE WHEN mode IN {_strings(V.NOT_BUILT)} THEN 0 ELSE ({_case('mode', V.BUILT, 10000)} + 75 * {_case('mode', V.BATTERY, 0)}) / {_case('mode', V.LIFE, 250000)} * km END AS built,
    CASE WHEN mode IN {_strings(V.NO_ENERGY)} THEN 0 WHEN drive IN {_strings(V.DIESEL)} THEN used * 2.68 WHEN drive IN {_strings(V.PASSENGER_KG)} THEN km * {_case('drive', V.PASSENGER_KG, 0)} ELSE 0 END AS burnt,
    CASE WHEN mode IN {_strings(V.NO_ENERGY)} THEN 0 WHEN drive IN {_strings(V.DIESEL)} THEN used * 0.5 WHEN drive IN {_strings(V.ELECTRIC)} THEN used * 0.233 WHEN drive = 'hgv_hydrogen' THEN used * 10 ELSE 0 END AS made,
    km * {_case('mode', {m: p[0] for m, p in V.POLLUTANTS.items()}, 0)} AS dust, km * {_case('mode', {m: p[1] for m, p in V.POLLUTANTS.items()}, 0)} AS oxides, km * {_case('mode', {m: p[2] for m, p in V.POLLUTANTS.items()}, 0)} AS monoxide FROM u)"""


@query(f"""WITH {_TRIPS}, {_LIFE} SELECT mode, count(*) AS n, round(sum(built + burnt + made), 5) AS co2e_kg, round(sum(built), 5) AS manufacturing_co2e_kg, round(sum(burnt), 5) AS energy_co2e_kg, round(sum(made), 5) AS upstream_co2e_kg,
    round(sum(dust), 5) AS pm25_g, round(sum(oxides), 5) AS nox_g, round(sum(monoxide), 5) AS co_g FROM e GROUP BY 1""")
def lifecycle_emissions(spark, sf_dir):
    """Emissions over the vehicles' lives, in total by mode."""
    return _sums(_trips(spark, sf_dir), "mode", trips.lifecycle(F.col("km"), F.col("mode")))


@query(f"""WITH t AS (SELECT unnest({_LIST}) AS mode, CAST(10 AS DOUBLE) AS km), {_LIFE} SELECT mode, round((built + burnt + made) * 1000 / 10, 6) AS grams_km, round(dust, 6) AS pm25_g, round(oxides, 6) AS nox_g FROM e""")
def carbon_intensity(spark, sf_dir):
    """Grams of CO2e a km of each mode, of a trip of 10 km."""
    rows = spark.createDataFrame([(m, 10.0) for m in _NAMES], "mode string, km double")
    life = trips.lifecycle(F.col("km"), F.col("mode"))
    return rows.select("mode", F.round(life["co2e_kg"] * 1000 / 10.0, 6).alias("grams_km"), F.round(life["pm25_g"], 6).alias("pm25_g"), F.round(life["nox_g"], 6).alias("nox_g"))


@query(f"""WITH {_TRIPS}, {_LIFE}, s AS (SELECT sum(dust) AS d, sum(oxides) AS o FROM e) SELECT round(d, 5) AS total_pm25_g, round(o, 5) AS total_nox_g, round(d / 1e6 * 100 + o / 1e6 * 20, 8) AS years_life_lost, round(d / 1e6 * 70000 + o / 1e6 * 15000, 5) AS health_cost FROM s""")
def air_quality_impact(spark, sf_dir):
    """Years of life and money that the pollutants of all trips cost."""
    life = trips.lifecycle(F.col("km"), F.col("mode"))
    s = _trips(spark, sf_dir).agg(F.sum(life["pm25_g"]).alias("d"), F.sum(life["nox_g"]).alias("o"))
    d, o = F.col("d") / 1e6, F.col("o") / 1e6
    return s.select(
        F.round("d", 5).alias("total_pm25_g"), F.round("o", 5).alias("total_nox_g"),
        F.round(d * V.YEARS_LOST[0] + o * V.YEARS_LOST[1], 8).alias("years_life_lost"), F.round(d * V.HEALTH_COST[0] + o * V.HEALTH_COST[1], 5).alias("health_cost"),
    )


@query(f"""WITH {_TRIPS}, y AS (SELECT year(l_shipdate) AS year, sum(km * {_case('mode', V.TRIP_GRAMS, 100)}) / 1000 AS kg FROM t GROUP BY 1), b AS (SELECT arg_min(kg, year) AS base, min(year) AS first FROM y)
    SELECT year, round(base - kg, 4) AS reduction_kg, round((base - kg) / base * 100, 6) AS reduction_pct, round((year - first) / (first + 25.0 - first) * 100, 6) AS target_pct, (base - kg) / base * 100 >= (year - first) / 25.0 * 100 AS on_track,
    round(kg / (first + 25 - year), 4) AS yearly_kg FROM y, b""")
def net_zero_progress(spark, sf_dir):
    """Each year against the first, on a straight way to nothing 25 years later."""
    y = _trips(spark, sf_dir).groupBy(F.year("l_shipdate").alias("year")).agg((F.sum(trips.grams(F.col("km"), F.col("mode"))) / 1000).alias("kg"))
    b = y.agg(F.min_by("kg", "year").alias("base"), F.min("year").alias("first"))
    pct, target = (F.col("base") - F.col("kg")) / F.col("base") * 100, (F.col("year") - F.col("first")) / 25.0 * 100
    # One row for each year, beside one row.
    return y.crossJoin(b).select(
        "year", F.round(F.col("base") - F.col("kg"), 4).alias("reduction_kg"), F.round(pct, 6).alias("reduction_pct"), F.round(target, 6).alias("target_pct"),
        (pct >= target).alias("on_track"), F.round(F.try_divide(F.col("kg"), F.col("first") + 25 - F.col("year")), 4).alias("yearly_kg"),
    )


_ROADS = ["motorway", "primary", "residential", "cycleway", "unclassified", "trunk_link", "secondary"]
_STEEP = "least(3.0, CASE WHEN slope > 0 THEN 1 + slope * 5 ELSE greatest(0.5, 1 + slope * 2) END)"
_RATE = _case("mode", {m: v[1] for m, v in V.MODES.items()}, 100)


@query(f"""WITH {_TRIPS}, g AS (SELECT *, km * 10 AS m, list_extract([{', '.join(f"'{r}'" for r in _ROADS)}], CAST(l_linenumber AS BIGINT)) AS road, CAST(l_tax AS DOUBLE) * 4 - CAST(l_discount AS DOUBLE) * 4 AS slope, l_linenumber % 2 * 0.05 AS toll, greatest({_case('mode', V.TRIP_SPEED, 0.5)} * 1000, 1) AS speed, {_RATE} AS rate FROM t)
    SELECT mode, count(*) AS n, round(sum(m / speed), 5) AS time_weight, round(sum(m * CASE WHEN mode IN {_strings(V.ACTIVE)} THEN {_case('road', V.ROAD_RISK, 1)} ELSE 1 END), 5) AS safety_weight,
    round(sum(CASE WHEN rate = 0 THEN m / speed ELSE rate * m / 1000 * {_STEEP} END), 5) AS emission_weight, round(sum(m / 1000 * 0.12 + m / 1000 * rate / 1000 * 50 + m / 1000 * toll), 5) AS monetary_weight,
    round(sum((rate / 1000 * m / 1000 * {_STEEP} + {_case('mode', V.EMBODIED, 0.03)} * m / 1000) * (80 + 2.0 / 5 * 40) / 1000), 5) AS decarbonisation_weight FROM g GROUP BY 1""")
def edge_weights(spark, sf_dir):
    """Weights of road edges for time, safety, emissions, money and carbon, in total by mode."""
    road = F.element_at(F.array(*(F.lit(r) for r in _ROADS)), F.col("l_linenumber").cast("int"))
    slope = F.col("l_tax").cast("double") * 4 - F.col("l_discount").cast("double") * 4
    weights = trips.edge_weights(F.col("km") * 10, F.col("mode"), road, slope, F.col("l_linenumber") % 2 * 0.05, year=2027, tax=50.0)
    return _sums(_trips(spark, sf_dir), "mode", weights)


@query(f"""WITH c AS (SELECT list_extract({_LIST}, CAST(c_custkey % {len(_NAMES)} + 1 AS BIGINT)) AS mode, CAST(c_acctbal AS DOUBLE) AS km FROM customer), n AS (SELECT mode, km, CASE mode {''.join(f" WHEN '{m}' THEN '{v[0]}'" for m, v in V.MODES.items())} ELSE 'drive' END AS network FROM c)
    SELECT network, count(*) AS n, round(sum(km * {_case('network', V.ROUTE_FACTOR, 1.1)}), 5) AS km FROM n GROUP BY 1""")
def abstract_distances(spark, sf_dir):
    """Length of ways that only a straight line is known of, in total by network."""
    rows = table(spark, sf_dir, "customer").select(_mode("c_custkey").alias("mode"), F.col("c_acctbal").cast("double").alias("km"))
    network = V.lookup(F.col("mode"), {m: v[0] for m, v in V.MODES.items()}, "drive")
    return rows.groupBy(network.alias("network")).agg(F.count("*").alias("n"), F.round(F.sum(trips.straight_km(F.col("km"), F.col("mode"))), 5).alias("km"))


def _pick(index: str, values: tuple) -> str:
    return f"CAST(list_extract([{', '.join(map(str, values))}], {index}) AS DOUBLE)"


_SEASON, _DAY, _HOUR = "1 + (month(ts) % 12) // 3", "CASE WHEN isodow(ts) >= 6 THEN 1 WHEN isodow(ts) = 5 THEN 2 ELSE 3 END", "CASE WHEN hour(ts) < 6 THEN 1 WHEN hour(ts) < 10 THEN 2 WHEN hour(ts) < 16 THEN 3 WHEN hour(ts) < 20 THEN 4 ELSE 5 END"


@query(f"""SELECT event_type, {', '.join(f"round(avg({_pick(_SEASON, V.SEASONS[k])}), 6) AS {k}" for k in ("ev_range", "bike_adoption", "walk_adoption", "charging_time", "grid_heating_load"))},
    round(avg({_pick(_SEASON, V.SEASONS['freight_demand'])} * {_pick(_DAY, V.WEEK['freight_demand'])} * {_pick(_HOUR, V.HOURS['freight_demand'])}), 6) AS freight_demand, round(avg({_pick(_SEASON, V.SEASONS['tourism_demand'])} * {_pick(_DAY, V.WEEK['tourism_demand'])}), 6) AS tourism_demand,
    round(avg({_pick(_HOUR, V.HOURS['car_demand'])} * {_pick(_SEASON, V.SEASONS['car_demand'])}), 6) AS car_demand, round(avg({_pick(_HOUR, V.HOURS['bus_demand'])} * {_pick(_SEASON, V.SEASONS['bus_demand'])}), 6) AS bus_demand FROM events GROUP BY 1""")
def demand_multipliers(spark, sf_dir):
    """Mean factors of season, day and hour by kind of event."""
    factors = conditions.multipliers(F.month("ts"), F.weekday("ts"), F.hour("ts"))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*(F.round(F.avg(c), 6).alias(k) for k, c in factors.items()))


_WEATHER = "CAST(l_linenumber * 6 - 18 AS DOUBLE) AS temp, CAST(l_tax AS DOUBLE) * 4 AS rain, CASE WHEN l_discount > 0.08 THEN 12.0 WHEN l_discount > 0.06 THEN 3.0 ELSE 0.0 END AS snow, CASE WHEN l_orderkey % 10 = 0 THEN 500 ELSE 10000 END AS sight"


def _weather(spark, sf_dir) -> DataFrame:
    rows = _trips(spark, sf_dir)
    snow = F.when(F.col("l_discount") > 0.08, 12.0).when(F.col("l_discount") > 0.06, 3.0).otherwise(0.0)
    rows = rows.withColumns({"temp": (F.col("l_linenumber") * 6 - 18).cast("double"), "rain": F.col("l_tax").cast("double") * 4, "snow": snow, "sight": F.when(F.col("l_orderkey") % 10 == 0, 500).otherwise(10000)})
    return rows.withColumn("ice", conditions.icy(F.col("temp"), F.col("rain")))


@query(f"""WITH {_TRIPS}, w AS (SELECT *, {_WEATHER} FROM t), i AS (SELECT *, temp <= 2 AND rain > 0.1 AS ice FROM w),
    f AS (SELECT mode, km / {_case('mode', V.TRIP_SPEED, 0.1)} AS minutes, mode IN ('bike', 'ebike') AND (snow > 10 OR ice) AS unsafe, greatest(0.2, (CASE WHEN temp < 0 THEN CASE WHEN mode IN ('bike', 'ebike') THEN 0.5 ELSE 0.7 END ELSE 1 END) * (CASE WHEN rain > 0 THEN CASE WHEN mode IN ('bike', 'ebike', 'walk') THEN 0.85 ELSE 0.9 END ELSE 1 END)
    * (CASE WHEN snow > 0 THEN CASE WHEN mode IN ('bike', 'ebike') THEN 0.3 WHEN mode = 'walk' THEN 0.6 ELSE 0.5 END ELSE 1 END) * (CASE WHEN ice THEN 0.6 ELSE 1 END) * (CASE WHEN sight < 1000 THEN 0.7 ELSE 1 END))::DOUBLE AS factor FROM i)
    SELECT mode, count(*) FILTER (NOT unsafe) AS available, round(avg(factor), 6) AS speed_factor, round(avg(minutes / factor), 6) AS minutes FROM f GROUP BY 1""")
def weather_speeds(spark, sf_dir):
    """Speed and travel time left by the weather, and trips that it lets go, by mode."""
    rows = _weather(spark, sf_dir)
    factor = conditions.speed_factor(*(F.col(c) for c in ("mode", "temp", "rain", "snow", "ice", "sight")))
    rows = rows.withColumns({"factor": factor, "minutes": F.col("km") / V.lookup(F.col("mode"), V.TRIP_SPEED, 0.1), "free": conditions.available(F.col("mode"), F.col("snow"), F.col("ice"))})
    return rows.groupBy("mode").agg(F.count_if("free").alias("available"), F.round(F.avg("factor"), 6).alias("speed_factor"), F.round(F.avg(F.col("minutes") / F.col("factor")), 6).alias("minutes"))


@query("""WITH t AS (SELECT CAST(s_suppkey % 45 - 15 AS DOUBLE) AS temp FROM supplier) SELECT DISTINCT temp, CASE WHEN temp >= 20 THEN 1.0 WHEN temp >= 10 THEN 0.95 WHEN temp >= 0 THEN 0.85 WHEN temp >= -5 THEN 0.75 ELSE 0.65 END::DOUBLE AS by_steps,
    round((CASE WHEN temp >= 20 THEN 1 WHEN temp >= 10 THEN 1 - (20 - temp) * 0.01 WHEN temp >= 0 THEN 0.9 - (10 - temp) * 0.015 WHEN temp >= -10 THEN 0.75 + temp * 0.025 ELSE 0.5 END) * 350, 6) AS km_by_slope FROM t""")
def ev_ranges(spark, sf_dir):
    """Electric range left by temperature."""
    t = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 45 - 15).cast("double").alias("temp")).distinct()
    return t.select("temp", conditions.range_steps(F.col("temp")).alias("by_steps"), F.round(conditions.range_slope(F.col("temp")) * 350, 6).alias("km_by_slope"))


@query(f"""WITH {_TRIPS}, w AS (SELECT *, month(l_shipdate) AS m, {_WEATHER} FROM t) SELECT m AS month, count(*) AS n,
    round(avg((CASE WHEN m IN (12, 1, 2) THEN 1.2 WHEN m IN (6, 7, 8) THEN 0.8 ELSE 1 END) * (CASE WHEN rain > 0 THEN 1.2 ELSE 1 END) * (CASE WHEN snow > 0 THEN 1.5 ELSE 1 END)), 6) AS walk,
    round(avg((CASE WHEN m IN (12, 1, 2) THEN 1.5 WHEN m IN (6, 7, 8) THEN 0.7 ELSE 1 END) * (CASE WHEN rain > 0 THEN 1.3 ELSE 1 END) * (CASE WHEN snow > 0 THEN 2 ELSE 1 END) * (CASE WHEN temp < 0 THEN 1.4 ELSE 1 END)), 6) AS bike,
    round(avg(CASE WHEN m IN (12, 1, 2) THEN 0.8 ELSE 1 END), 6) AS bus, round(avg((CASE WHEN m IN (6, 7, 8) THEN 1.1 ELSE 1 END) * (CASE WHEN snow > 0 THEN 1.2 ELSE 1 END)), 6) AS car, round(avg(CASE WHEN temp < 0 THEN 1.1 ELSE 1 END), 6) AS ev FROM w GROUP BY 1""")
def mode_preferences(spark, sf_dir):
    """Mean factors of season and weather on the cost of modes, by month."""
    liked = conditions.preferences(F.month("l_shipdate"), F.col("temp"), F.col("rain"), F.col("snow"))
    return _weather(spark, sf_dir).groupBy(F.month("l_shipdate").alias("month")).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(k) for k, c in liked.items()))


@query("""WITH o AS (SELECT o_orderpriority AS persona, o_orderkey % 61 / 30.0 AS time, o_orderkey % 37 / 20.0 AS cost, o_orderkey % 5 / 4.0 AS wt, o_custkey % 5 / 4.0 AS wc, o_custkey % 11 / 10.0 AS share, o_orderkey % 8 AS uses FROM orders),
    s AS (SELECT *, CASE WHEN wt + wc > 0 THEN (wt * greatest(0, 1 - abs(time - 1)) + wc * greatest(0, 1 - abs(cost - 1))) / (wt + wc) ELSE 0.5 END AS met, 1 - 1 / (1 + uses / 5.0) AS habit FROM o),
    p AS (SELECT *, least(0.5, 0.2 * share + CASE WHEN share > 0.5 THEN 0.3 * (share - 0.5) ELSE 0 END) AS off, 1 - least(0.6, 0.4 * habit + 0.4 * (met - 0.5) * 2 + 0.2 * 0.5 * share + CASE WHEN share > 0.5 THEN (share - 0.5) * 0.3 ELSE 0 END) AS pull,
    CASE WHEN uses % 2 = 0 AND share < 0.3 THEN met ELSE greatest(0, least(1, 0.5 * met + 0.35 * habit + 0.15 * CASE WHEN uses % 2 = 0 THEN share ELSE met END)) END AS belief FROM s)
    SELECT persona, count(*) AS n, round(avg(met), 6) AS satisfaction, round(avg(off), 6) AS discount, round(avg(10 * pull), 6) AS cost, round(avg(belief), 6) AS belief FROM p GROUP BY 1""")
def mind_changes(spark, sf_dir):
    """Satisfaction, discount by peers, cost after habit, experience and peers, and belief, in the mean by persona."""
    from corvane.functions.cost import habit

    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("persona"), (F.col("o_orderkey") % 61 / 30.0).alias("time"), (F.col("o_orderkey") % 37 / 20.0).alias("cost"), (F.col("o_orderkey") % 5 / 4.0).alias("wt"), (F.col("o_custkey") % 5 / 4.0).alias("wc"), (F.col("o_custkey") % 11 / 10.0).alias("share"), (F.col("o_orderkey") % 8).alias("uses"))
    one, share = F.lit(1.0), F.col("share")
    o = o.withColumns({"met": minds.satisfaction(F.col("time"), one, F.col("cost"), one, F.col("wt"), F.col("wc")), "habit": habit(F.col("uses"))})
    out = {
        "satisfaction": F.col("met"), "discount": minds.peer_discount(share),
        "cost": minds.attractiveness(F.lit(10.0), F.col("habit"), (F.col("met") - 0.5) * 2, 0.5 * share, share),
        "belief": minds.belief(F.col("met"), share, F.col("habit"), F.col("uses") % 2 == 0, F.lit(0.3)),
    }
    return o.groupBy("persona").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(k) for k, c in out.items()))


@query("""WITH p AS (SELECT c_mktsegment AS policy, sum(c_acctbal) / 100 AS saved, -sum(c_acctbal) / 50 AS cost, count(*) FILTER (c_acctbal < 0) AS touched, count(*) AS people, avg(c_acctbal) - 4500 AS grid FROM customer GROUP BY 1)
    SELECT policy, CASE WHEN saved > 1000 THEN 5.0 WHEN saved > 500 THEN 3.0 WHEN saved > 100 THEN 1.0 ELSE 0.0 END + CASE WHEN cost < -1000 THEN 3.0 WHEN cost < -500 THEN 2.0 WHEN cost < 0 THEN 1.0 ELSE 0.0 END + CASE WHEN grid < 0 THEN 2.0 ELSE 0.0 END AS quality,
    CASE WHEN touched / people > 0.1 THEN 0.95 WHEN touched / people > 0.05 THEN 0.9 WHEN touched / people > 0.01 THEN 0.75 ELSE 0.5 END AS confidence FROM p""")
def policy_quality(spark, sf_dir):
    """Quality of life that a policy brings, and how far the effect can be trusted."""
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("policy")).agg(
        (F.sum("c_acctbal") / 100).alias("saved"), (-F.sum("c_acctbal") / 50).alias("cost"), F.count_if(F.col("c_acctbal") < 0).alias("touched"), F.count("*").alias("people"), (F.avg("c_acctbal") - 4500).alias("grid")
    )
    return p.select("policy", minds.quality_of_life(F.col("saved"), F.col("cost"), F.col("grid")).alias("quality"), minds.confidence(F.col("touched"), F.col("people")).alias("confidence"))
