"""Eligible modes, the shape of adoption flows, actions by priority, and running times, on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import flow
from corvane.operators import decisions, policy
from corvane.operators import eligibility as e
from corvane.plans.registry import query, table
from corvane.sources import feed

_KINDS = ("personal", "micro_mobility", "heavy_freight", "medium_freight", "commercial", "transit", None)


def _l(modes) -> str:
    return "[" + ", ".join(f"'{m}'" for m in modes) + "]"


_REACH = "CASE m " + " ".join(f"WHEN '{m}' THEN {km * (e.CARGO_BIKE_MARGIN if m == 'cargo_bike' else e.MARGIN)!r}" for m, km in e.FARTHEST_KM.items()) + " ELSE 1e9 END"
_KIND = "CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN {'NULL' if k is None else repr(k)}" for i, k in enumerate(_KINDS)) + " END"


@query(f"""WITH t AS (SELECT o_orderkey AS trip, o_orderkey * 13 % 300 * 1.0::DOUBLE AS km, coalesce({_KIND}, 'personal') AS kind, o_custkey % 4 = 0 AS needed, o_custkey % 3 = 0 AS cargo, o_custkey % 11 = 0 AS urgent, o_custkey % 13 = 0 AS taxi, o_custkey % 5 = 0 AS luggage, o_custkey % 6 = 0 AS coastal, o_custkey % 17 = 0 AS own FROM orders),
    c AS (SELECT *, CASE WHEN taxi THEN {_l(e.TAXI)} WHEN kind = 'micro_mobility' THEN CASE WHEN km > 20 THEN {_l(e.MICRO_FAR)} ELSE {_l(e.MICRO)} END {" ".join(f"WHEN kind = '{k}' THEN {_l(v)}" for k, v in e.BY_VEHICLE.items())} WHEN urgent THEN {_l(e.EMERGENCY)} WHEN luggage THEN {_l(e.ENCUMBERED)} ELSE {_l(e.DEFAULT)} END AS offer,
      CASE WHEN km > 80 THEN {_l(e.FAR)} WHEN km > 30 THEN {_l(e.MIDDLE)} ELSE []::VARCHAR[] END AS far, CASE WHEN coastal THEN {_l(e.WATER)} ELSE []::VARCHAR[] END AS water, CASE WHEN km < 15 AND NOT cargo THEN ['e_scooter'] ELSE []::VARCHAR[] END AS scooter FROM t),
    a AS (SELECT *, CASE WHEN own THEN ['ferry_electric', 'van_diesel', 'walk'] ELSE offer || CASE WHEN km > 0 AND NOT needed THEN far || water || scooter ELSE []::VARCHAR[] END END AS held FROM c),
    f AS (SELECT *, list_filter(list_filter(held, lambda m, i: NOT list_contains(held[1 : i - 1], m)), lambda m: (km <= 0 OR km < {_REACH}) AND NOT (needed AND list_contains({_l(e.ON_FOOT)}, m)) AND NOT (NOT own AND kind = 'personal' AND NOT needed AND list_contains({_l(e.FREIGHT)}, m))) AS kept FROM a)
    SELECT trip, array_to_string(CASE WHEN len(kept) > 0 THEN kept {" ".join(f"WHEN kind = '{k}' THEN {_l(v)}" for k, v in e.LEFT.items())} WHEN km > 200 THEN {_l(e.LEFT_BY_KM[0][1])} WHEN km > 50 THEN {_l(e.LEFT_BY_KM[1][1])} ELSE {_l(e.LEFT_BY_KM[2][1])} END, ',') AS modes FROM f""")
def eligible_modes(spark, sf_dir):
    """What trips of all kinds may use."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.get(F.array(*(F.lit(x).cast("string") for x in _KINDS)), (k % 7).cast("int"))
    trips = table(spark, sf_dir, "orders").select(
        k.alias("trip"), (k * 13 % 300).cast("double").alias("km"), kind.alias("vehicle_type"), (c % 4 == 0).alias("vehicle_required"), (c % 3 == 0).alias("cargo_capacity"), F.when(c % 11 == 0, "emergency").alias("priority"), F.when(c % 13 == 0, "taxi").alias("operator_type"),
        (c % 5 == 0).alias("luggage"), F.lit(None).cast("boolean").alias("wheelchair"), (c % 6 == 0).alias("coastal"), F.lit(False).alias("island"), F.when(c % 17 == 0, F.array(F.lit("ferry_electric"), F.lit("van_diesel"), F.lit("walk"))).alias("allowed"),
    )
    return e.eligible_modes(trips).select("trip", F.array_join("modes", ",").alias("modes"))


@query("""WITH d AS (SELECT event_type AS mode, CAST(ts AS DATE) AS day, count(*) AS n, avg(value) / 100 AS built FROM events GROUP BY 1, 2), s AS (SELECT mode, day, n / (SELECT max(n) * 1.5 FROM d) AS s, built FROM d), p AS (SELECT *, 0.05 * s * (1 - s / 0.8) AS a, 0.02 * s * built AS b, 0.03 * s * (1 - s / 0.8) AS c, s * (1 - s / 0.8) AS room, 0.08 * s * (s / (0.8 * 0.8)) AS cap FROM s),
    f AS (SELECT *, a + b + c AS flow FROM p) SELECT mode, day, round(flow, 9) AS flow, round(a / flow, 6) AS logistic, round(b / flow, 6) AS infrastructure, round(c / flow, 6) AS social, round(room * 0.05 / flow, 6) AS by_rate, round(cap * 0.8 / flow, 6) AS by_capacity, round(s * built * 0.02 / flow, 6) AS by_infrastructure, round(room * 0.03 / flow, 6) AS by_social,
    abs(a / flow) > abs(b / flow + c / flow) AS leads, abs(s - 0.3) < 0.05 AS near, s > 0.3 AS above FROM f""")
def flow_regimes(spark, sf_dir):
    """What drives adoption by mode and day, and how much each parameter matters."""
    d = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("mode"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.avg("value") / 100).alias("built"))
    # One row, the busiest day.
    s = d.crossJoin(F.broadcast(d.agg((F.max("n") * 1.5).alias("top")))).select("mode", "day", (F.col("n") / F.col("top")).alias("s"), "built")
    rate, capacity, infrastructure, social = (F.lit(x) for x in (0.05, 0.8, 0.02, 0.03))
    s = s.withColumn("parts", flow.contributions(F.col("s"), rate, capacity, infrastructure, social, F.col("built"))).withColumn("slopes", flow.slopes(F.col("s"), rate, capacity, social, F.col("built")))
    s = s.withColumn("by", flow.elasticities(F.col("slopes"), rate, capacity, infrastructure, social, F.col("parts.flow"))).withColumn("is", flow.regime(F.col("parts"), F.col("s")))
    return s.select("mode", "day", F.round("parts.flow", 9).alias("flow"), *(F.round(f"parts.{c}", 6).alias(c) for c in ("logistic", "infrastructure", "social")), *(F.round(f"by.{c}", 6).alias(f"by_{c}") for c in ("rate", "capacity", "infrastructure", "social")), F.col("is.logistic").alias("leads"), "is.near", "is.above")


_RULES = [
    {"name": "surge", "condition": "grid_load > 900 and ev_adoption > 0.1", "action": "apply_surge_pricing", "cooldown": 0, "priority": 2},
    {"name": "relief", "condition": "ev_count == 0 and time_of_day < 9", "action": "reduce_charging_costs", "cooldown": 0, "priority": 9},
    {"name": "build", "condition": "ev_adoption > 0.15", "action": "add_chargers", "cooldown": 0, "priority": 2},
]


@query("""WITH a AS (SELECT user_id % 7 AS run, CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT) AS step, CASE event_type WHEN 'error' THEN 'ev' WHEN 'purchase' THEN 'van_electric' ELSE 'bus' END AS mode, value FROM events),
    s AS (SELECT run, step, count(*) AS agents, count(*) FILTER (mode = 'ev') AS ev_count, count(*) FILTER (mode = 'van_electric') AS freight, sum(value) AS grid_load FROM a GROUP BY 1, 2), v AS (SELECT *, ev_count / agents AS ev_adoption FROM s),
    f AS (SELECT run, step, 2 AS priority, 0 AS listed, 'surge' AS rule, 'apply_surge_pricing' AS action FROM v WHERE grid_load > 900 AND ev_adoption > 0.1 UNION ALL SELECT run, step, 2, 2, 'build', 'add_chargers' FROM v WHERE ev_adoption > 0.15 UNION ALL SELECT run, step, 9, 1, 'relief', 'reduce_charging_costs' FROM v WHERE ev_count = 0)
    SELECT run, step, CAST(row_number() OVER (PARTITION BY run, step ORDER BY priority DESC, listed) AS INTEGER) AS place, rule, action, ev_count, freight AS freight_ev_count, round(ev_adoption, 6) AS ev_adoption FROM f JOIN v USING (run, step)""")
def policy_actions(spark, sf_dir):
    """What rules do at each step of seven runs, by priority, and the state that they saw."""
    t = F.col("event_type")
    mode = F.when(t == "error", "ev").when(t == "purchase", "van_electric").otherwise("bus")
    a = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("run"), F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long").alias("step"), mode.alias("mode"), "value")
    built = a.groupBy("run", "step").agg(F.sum("value").alias("grid_load"))
    none = {"time_of_day": "int", "grid_capacity": "double", "grid_utilization": "double", "charger_utilization": "double", "occupied_chargers": "int", "total_chargers": "int", "price": "double"}
    states = policy.state_vector(a, built.select("*", *(F.lit(None).cast(k).alias(c) for c, k in none.items())), 0.15)
    done = policy.actions(states, _RULES)
    return done.join(states.select("run", "step", "ev_count", "freight_ev_count", F.round("ev_adoption", 6).alias("ev_adoption")), ["run", "step"])


@query("""WITH h AS (SELECT l_orderkey % 20 AS route_id, l_orderkey AS trip, l_linenumber AS seq, l_partkey % 12 AS u, lead(l_partkey % 12) OVER w AS v, lead(l_quantity * 10 + l_linenumber * 300) OVER w - (l_quantity * 10 + l_linenumber * 300 + 100) AS s FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    o AS (SELECT route_id, u, v, list(CAST(CASE WHEN s < 0 THEN 60 ELSE s END AS DOUBLE) ORDER BY trip, seq) AS s FROM h WHERE v IS NOT NULL GROUP BY 1, 2, 3) SELECT route_id, u, v, CAST(floor(list_reduce(s, lambda a, x: (a + x) / 2) + 0.0001) AS BIGINT) AS seconds, CAST(len(s) AS BIGINT) AS trips FROM o""")
def running_times(spark, sf_dir):
    """Times between stops of a route as trips come one after the other."""
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "x.*")
    at = F.col("l_quantity") * 10 + F.col("l_linenumber") * 300
    times = rows.select(F.col("l_orderkey").alias("trip_id"), (F.col("l_partkey") % 12).alias("stop_id"), at.alias("arrival"), (at + 100).alias("departure"), F.col("l_linenumber").alias("seq"))
    trips = rows.select(F.col("l_orderkey").alias("trip_id"), (F.col("l_orderkey") % 20).alias("route_id")).distinct()
    out = feed.running_pair_times({"stop_times": times, "trips": trips})
    # Halves and quarters end in a 5 that rounds either way: whole seconds.
    return out.withColumn("seconds", F.floor(F.col("seconds") + 0.0001))


_CHOICES = ("walk", "bike", "ev", "car", "bus", "local_train", "van_electric", "cargo_bike", "ferry_electric")
_KINDS_OF_USE = ("personal", "transit", "commercial", "heavy_freight", "micro_mobility")


def _case(column: str, table: dict, default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


_OPTIONS = f"""o AS (SELECT l_orderkey AS agent, l_linenumber AS option, {_l(_CHOICES)}[CAST(l_partkey % 9 + 1 AS BIGINT)] AS mode, l_quantity * 2.0 AS minutes, l_extendedprice / 10000.0 AS money, l_discount * 5 AS comfort, l_tax AS risk, l_quantity * 11.0 AS grams, l_suppkey % 400 * 1.0 AS km, CASE WHEN l_orderkey % 3 > 0 THEN 0.9::DOUBLE ELSE 0.5 END AS w_time,
    CASE WHEN l_orderkey % 3 > 0 THEN 0.1::DOUBLE ELSE 0.5 END AS w_eco, {_l(_KINDS_OF_USE)}[CAST(l_orderkey % 5 + 1 AS BIGINT)] AS kind, l_orderkey % 11 = 0 AS urgent, CASE WHEN l_orderkey % 7 = 0 THEN 'scenic_rail' ELSE 'errand' END AS job, l_suppkey % 2 = 0 AS charger, l_suppkey % 4 = 0 AS free, l_partkey % 3 * 1.0 AS detour, 1.0 + l_orderkey % 2 * 0.2 AS stress, l_linenumber AS legs,
    l_partkey % 5 / 10.0 AS habit, CASE WHEN l_partkey % 4 = 0 THEN l_partkey % 8 / 7.0 END AS preference FROM lineitem),
    p AS (SELECT *, {_case("mode", decisions.RANGE_KM, "NULL")} AS reach, {_case("mode", decisions.CAPITAL_KM, "NULL")} AS capital, {_case("mode", decisions.BOARDING, "NULL")} AS boarding, kind IN ('commercial', 'heavy_freight', 'micro_mobility') AS business FROM o),
    q AS (SELECT *, reach IS NOT NULL AND charger AS charges, CASE WHEN reach IS NOT NULL AND stress > 1 THEN stress ELSE 1 END AS stretched FROM p),
    m AS (SELECT *, (least(1.0, minutes / 60) + CASE WHEN charges AND NOT free THEN 0.5 * w_time ELSE 0 END + CASE WHEN charges AND detour > 0.5 THEN detour / 30 ELSE 0 END) * stretched AS t, (least(1.0, money / 5) + CASE WHEN charges THEN km * 0.2 * 0.15 / 5 * 0.3 ELSE 0 END) * stretched AS c FROM q),
    s AS (SELECT *, CASE WHEN capital IS NOT NULL THEN least(c + capital * km * 0.8 / 5, 3.0) ELSE c END AS c2, CASE WHEN reach IS NULL THEN 0 WHEN km / reach > 0.9 THEN 1.0 WHEN km / reach > 0.7 THEN 0.25 ELSE 0 END + CASE WHEN charges AND NOT free AND w_time > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN reach IS NOT NULL AND NOT charger THEN 1 ELSE 0 END
      + CASE WHEN capital IS NOT NULL THEN greatest(0, 0.60 - w_eco) * 0.8 ELSE 0 END AS worry, CASE WHEN boarding IS NOT NULL AND job = 'errand' AND kind <> 'transit' THEN 0.5 * boarding / 60 * 0.5 ELSE 0 END AS missed FROM m),
    x AS (SELECT *, (CASE WHEN urgent THEN t WHEN business THEN 0.7 * t + 0.2 * c2 ELSE w_time * t + 0.3 * c2 END + 0.2 * (1 - comfort) + CASE WHEN urgent THEN 0 ELSE 0.2 * risk END + w_eco * least(1.0, grams / 500) + worry + missed)
      * CASE WHEN NOT (business AND mode IN ('van_electric', 'cargo_bike')) THEN 1 WHEN kind = 'micro_mobility' AND mode = 'cargo_bike' THEN 0.6 WHEN kind = 'heavy_freight' THEN 0.65 ELSE 0.7 END * CASE WHEN kind = 'transit' AND mode IN ('local_train', 'ferry_electric') AND legs >= 3 THEN 0.75 ELSE 1 END
      * (1 - 0.12 * habit) * CASE WHEN mode = 'car' THEN 1.1 ELSE 1 END * CASE WHEN preference IS NULL THEN 1 ELSE least(greatest(1.40 - 0.65 * least(preference, 1), 0.75), 1.40) END AS cost FROM s)"""


@query(f"WITH {_OPTIONS} SELECT agent, arg_min(mode, struct_pack(c := round(cost, 9), o := option, m := mode)) AS mode, round(min(cost), 6) AS cost, count(*) AS options FROM x GROUP BY 1")
def cheapest_decisions(spark, sf_dir):
    """The mode that costs each person least, with all wishes and circumstances."""
    o, p, s, n = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    pick = lambda names, key: F.get(F.array(*(F.lit(x) for x in names)), (key % len(names)).cast("int"))
    wishes = F.when(o % 3 > 0, F.create_map(F.lit("time"), F.lit(0.9), F.lit("eco"), F.lit(0.1))).otherwise(F.create_map(F.lit("other"), F.lit(1.0)))
    mode = pick(_CHOICES, p)
    rows = table(spark, sf_dir, "lineitem").select(
        o.alias("agent"), n.alias("option"), mode.alias("mode"), (F.col("l_quantity") * 2.0).alias("minutes"), (F.col("l_extendedprice") / 10000.0).alias("money"), (F.col("l_discount") * 5).alias("comfort"), F.col("l_tax").alias("risk"), (F.col("l_quantity") * 11.0).alias("grams"),
        (s % 400 * 1.0).alias("km"), wishes.alias("wishes"), pick(_KINDS_OF_USE, o).alias("vehicle_type"), F.when(o % 11 == 0, "emergency").alias("priority"), F.when(o % 7 == 0, "Scenic_Rail").otherwise("errand").alias("job"), F.lit(None).cast("double").alias("boarding_min"), (s % 2 == 0).alias("charger"),
        (s % 4 == 0).alias("charger_free"), F.lit(None).cast("double").alias("wait_min"), F.lit(None).cast("double").alias("kwh_price"), (p % 3 * 1.0).alias("detour_km"), (1.0 + o % 2 * 0.2).alias("grid_stress"), n.alias("legs"), (p % 5 / 10.0).alias("habit"),
        F.when(p % 4 == 0, p % 8 / 7.0).alias("preference"), F.when(mode == "car", 1.1).alias("factor"),
    )
    costs = decisions.decision_costs(rows).select("agent", "option", "mode", "cost")
    # Costs that agree to 9 digits are equal, options of one number go by mode; costs are worked out once.
    found = decisions.cheapest(costs.withColumn("rounded", F.round("cost", 9)), "agent", ["rounded", "option", "mode"])
    return found.select("agent", "mode", F.round("cost", 6).alias("cost"), "options")
