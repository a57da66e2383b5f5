"""Rules, compatibility and nearest stops on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import joins, rules
from corvane.plans.registry import query, table


@query("""WITH j AS (SELECT p_partkey AS job, CASE WHEN p_partkey % 5 > 0 THEN p_name ELSE '' END AS a, lower(p_type) AS b, lower(p_brand) AS c FROM part), x AS (SELECT job, lower(CASE WHEN a = '' THEN 'spare ' || b ELSE a END) AS name, b AS type, c AS brand FROM j),
    r AS (SELECT s_suppkey AS rule, s_nationkey AS persona, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'type' WHEN s_suppkey % 3 = 1 THEN 'brand' ELSE 'name' END AS field, CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 3 = 2 THEN 'contains' WHEN s_suppkey % 7 = 0 THEN 'not_equals' ELSE 'equals' END AS operator,
      lower(CASE WHEN s_suppkey % 3 = 0 THEN p_type WHEN s_suppkey % 3 = 1 THEN p_brand ELSE substr(p_name, CAST(1 + s_suppkey % 4 AS BIGINT), CAST(1 + s_suppkey % 5 AS BIGINT)) END) AS value FROM supplier JOIN part ON p_partkey = s_suppkey * 7),
    h AS (SELECT job, persona, min(rule) AS rule FROM x, r WHERE persona <> 3 AND CASE WHEN field IS NULL THEN true WHEN operator = 'equals' THEN CASE field WHEN 'type' THEN type ELSE brand END = value WHEN operator = 'not_equals' THEN CASE field WHEN 'type' THEN type ELSE brand END <> value ELSE contains(name, value) END GROUP BY 1, 2)
    SELECT job, coalesce(string_agg(persona, ',' ORDER BY rule), '') AS personas FROM x LEFT JOIN h USING (job) GROUP BY 1""")
def rule_whitelist(spark, sf_dir):
    """Who may do which job, by rules that come as rows."""
    p, k = table(spark, sf_dir, "part"), F.col("s_suppkey")
    params = F.create_map(F.lit("name"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise(""), F.lit("brand"), F.col("p_brand"))
    jobs = p.select(F.col("p_partkey").alias("job"), params.alias("parameters"), F.create_map(F.lit("name"), F.concat(F.lit("Spare "), "p_type"), F.lit("type"), F.col("p_type")).alias("top"))
    some = table(spark, sf_dir, "supplier").join(p, F.col("p_partkey") == k * 7)
    field = F.when(k % 11 == 0, None).when(k % 3 == 0, "type").when(k % 3 == 1, "brand").otherwise("name")
    operator = F.when(k % 11 == 0, None).when(k % 3 == 2, "contains").when(k % 7 == 0, "not_equals").otherwise("equals")
    value = F.when(k % 3 == 0, F.col("p_type")).when(k % 3 == 1, F.col("p_brand")).otherwise(F.substring("p_name", (1 + k % 4).cast("int"), (1 + k % 5).cast("int")))
    listed = some.select(k.alias("rule"), F.col("s_nationkey").alias("persona"), field.alias("field"), operator.alias("operator"), value.alias("value"))
    personas = table(spark, sf_dir, "nation").filter("n_nationkey <> 3").select(F.col("n_nationkey").alias("persona"))
    return rules.whitelist(jobs, personas, listed).select("job", F.array_join(F.transform("personas", lambda x: x.cast("string")), ",").alias("personas"))


_PERSONAS = tuple(sorted({*rules.HEALTH_CORE, *rules.HEALTH_COMMUTERS, *rules.FREIGHT_CORE, *rules.DELIVERY_CORE, *rules.BUSINESS_CORE, *rules.TOURIST_CORE, *rules.TRADES_CORE, *rules.TAXI_CORE, "concerned_parent"}))
_JOBS = ("commute", "nhs_supply_run", "ward_commute", "barge_transfer", "offshore_shift", "last_mile_scooter", "school_run_then_work", "island_ferry_trip", "cruise_day", "scenic_tour", "intercity_train_commute", "taxi_rank", "plumbing_call", "parcel_round")
_TYPES = (*rules.PASSENGER_JOBS, *rules.FREIGHT_JOBS, *rules.DELIVERY_JOBS, "service", "taxi_service", "general")
_OPERATORS, _VEHICLES = ("", "", "", "healthcare", "logistics", "taxi"), ("car", "heavy_truck", "")


def _pick(names, key: str) -> str:
    return f"[{', '.join(repr(n) for n in names)}][CAST({key} % {len(names)} + 1 AS BIGINT)]"


def _any(words, column: str = "job") -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def _in(column: str, names) -> str:
    return f"{column} IN ({', '.join(repr(n) for n in names)})"


@query(f"""WITH p AS (SELECT o_orderkey AS pair, {_pick(_PERSONAS, 'o_orderkey')} AS persona, CASE WHEN o_orderkey % 3 = 0 THEN 'freight' WHEN o_orderkey % 7 > 0 THEN 'passenger' END AS kind, {_pick(_JOBS, 'o_orderkey // 5')} AS job, {_pick(_TYPES, 'o_custkey')} AS type, {_pick(_OPERATORS, 'o_custkey // 3')} AS operator, {_pick(_VEHICLES, 'o_orderkey // 2')} AS vehicle FROM orders),
    q AS (SELECT pair, persona, coalesce(kind, 'passenger') AS kind, job, type, operator, vehicle FROM p), s AS (SELECT *, CASE WHEN job = 'parcel_round' AND persona = 'tourist' THEN 0 WHEN operator = 'healthcare' OR {_any(rules.HEALTH_WORDS)} THEN 1 WHEN {_in('type', rules.FREIGHT_JOBS)} OR {_in('operator', rules.FREIGHT_OPERATORS)} THEN 2 WHEN {_in('type', rules.DELIVERY_JOBS)} OR contains(job, 'last_mile') THEN 3
      WHEN {_in('job', rules.CARE_JOBS)} OR {_any(rules.CARE_WORDS)} THEN 4 WHEN {_in('type', rules.PASSENGER_JOBS)} THEN 5 WHEN type = 'service' THEN 6 WHEN {_in('type', rules.TAXI_JOBS)} OR {_in('operator', rules.TAXI_OPERATORS)} OR {_any(rules.TAXI_WORDS)} THEN 7 END AS stage FROM q)
    SELECT pair, stage, CASE stage WHEN 0 THEN true WHEN 1 THEN {_in('persona', rules.HEALTH_CORE)} OR ({_in('persona', rules.HEALTH_CONTRACTED)} AND {_in('type', rules.HEALTH_CONTRACTS)}) OR (kind = 'freight' AND {_any(rules.HEALTH_GOODS)}) OR ({_in('persona', rules.HEALTH_COMMUTERS)} AND contains(job, 'commute'))
      WHEN 2 THEN {_in('persona', rules.FREIGHT_CORE)} OR (persona = 'delivery_driver' AND NOT contains(vehicle, 'heavy')) OR (persona = 'eco_warrior' AND contains(job, 'barge')) OR (persona = 'shift_worker' AND contains(job, 'offshore'))
      WHEN 3 THEN CASE WHEN contains(type, 'passenger') OR contains(job, 'scooter') THEN kind = 'passenger' AND persona <> 'elderly_non_driver' ELSE {_in('persona', rules.DELIVERY_CORE)} END
      WHEN 4 THEN NOT (kind = 'freight' AND NOT contains(persona, 'operator')) AND ((persona = 'port_terminal_operator' AND contains(job, 'cruise')) OR kind = 'passenger')
      WHEN 5 THEN CASE WHEN kind = 'freight' THEN type = 'passenger_commute' WHEN type = 'business_travel' THEN {_in('persona', rules.BUSINESS_CORE)} WHEN type = 'passenger_special' OR {_any(rules.TOURIST_WORDS)} THEN {_in('persona', rules.TOURIST_CORE)} WHEN {_any(rules.RAIL_WORDS)} THEN kind = 'passenger' AND NOT {_in('persona', rules.RAIL_BLOCKED)} ELSE true END
      WHEN 6 THEN {_in('persona', rules.TRADES_CORE)} WHEN 7 THEN {_in('persona', rules.TAXI_CORE)} ELSE false END AS compatible FROM s""")
def persona_compatibility(spark, sf_dir):
    """Whether persona and job of each order fit, and which stage said so."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda names, key: F.get(F.array(*(F.lit(n) for n in names)), (key % len(names)).cast("int"))
    kind = F.when(k % 3 == 0, "freight").when(k % 7 > 0, "passenger")
    pairs = table(spark, sf_dir, "orders").select(
        k.alias("pair"), pick(_PERSONAS, k).alias("persona"), kind.alias("persona_type"), pick(_JOBS, F.floor(k / 5)).alias("job"), pick(_TYPES, c).alias("job_type"), pick(_OPERATORS, F.floor(c / 3)).alias("operator_type"), pick(_VEHICLES, F.floor(k / 2)).alias("vehicle_type"),
    )
    listed = pairs.filter("job = 'parcel_round'").select("job").distinct().withColumn("personas", F.array(F.lit("tourist")))
    return rules.compatible(pairs, listed).select("pair", "stage", "compatible")


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin((radians(b.lon) - radians(a.lon)) / 2), 2))))"


@query(f"""WITH a AS (SELECT c_custkey AS id, c_custkey * 37 % 360 - 180.0 AS lon, c_custkey * 53 % 180 - 90.0 AS lat FROM customer), b AS (SELECT s_suppkey AS id, s_suppkey * 71 % 360 - 179.5 AS lon, s_suppkey * 29 % 170 - 84.5 AS lat FROM supplier),
    p AS (SELECT a.id, b.id AS other, {_KM} AS km FROM a, b WHERE a.id <> b.id) SELECT id, CAST(rank AS INTEGER) AS rank, other, round(km, 6) AS km FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(km, 7), other) AS rank FROM p) WHERE rank <= 2""")
def nearest_stops_anywhere(spark, sf_dir):
    """The two nearest stops of places all over the globe, a place's own number apart."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 37 % 360 - 180.0).alias("lon"), (k * 53 % 180 - 90.0).alias("lat"))
    b = table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 71 % 360 - 179.5).alias("lon"), (s * 29 % 170 - 84.5).alias("lat"))
    return joins.nearest(a, b, 2, first_km=200.0, fits="a.id <> b.id").withColumn("km", F.round("km", 6))


@query(f"""WITH a AS (SELECT c_custkey AS id, c_custkey % 300 / 1000.0 - 3.35 AS lon, c_custkey * 7 % 150 / 1000.0 + 55.85 AS lat FROM customer), b AS (SELECT s_suppkey AS id, s_suppkey % 3 AS kind, s_suppkey * 37 % 300 / 1000.0 - 3.35 AS lon, s_suppkey * 53 % 150 / 1000.0 + 55.85 AS lat FROM supplier),
    p AS (SELECT a.id, b.id AS other, CASE WHEN kind = 0 THEN 1 ELSE 2 END AS tier, {_KM} AS km FROM a, b), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tier, round(km, 7), other) AS k FROM p WHERE km <= CASE tier WHEN 1 THEN 1.0 ELSE 4.0 END) SELECT id, tier, other, round(km, 6) AS km FROM t WHERE k = 1""")
def stops_by_tier(spark, sf_dir):
    """The nearest stop of the better register, else of the other one."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, sf_dir, "customer").select(k.alias("id"), (k % 300 / 1000.0 - 3.35).alias("lon"), (k * 7 % 150 / 1000.0 + 55.85).alias("lat"))
    b = table(spark, sf_dir, "supplier").select(s.alias("id"), (s * 37 % 300 / 1000.0 - 3.35).alias("lon"), (s * 53 % 150 / 1000.0 + 55.85).alias("lat"))
    return joins.nearest_by_tier(a, [(b.filter("id % 3 = 0"), 1.0), (b.filter("id % 3 <> 0"), 4.0)]).withColumn("km", F.round("km", 6))
