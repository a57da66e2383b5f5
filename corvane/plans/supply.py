"""Aggregations, joins and reports on the trade tables, whose keys stand for routes, vehicles and places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import joins, policy, stats, text, transit
from corvane.plans.registry import query, table

_LON, _LAT = "-3.35 + ({k} % 300) / 1000.0", "55.85 + (({k} * 7) % 150) / 1000.0"
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2)))"


def _points(name: str, key: str) -> str:
    return f"SELECT {key} AS id, CAST({_LON.format(k=key)} AS DOUBLE) AS lon, CAST({_LAT.format(k=key)} AS DOUBLE) AS lat FROM {name}"


def _at(rows: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return rows.withColumn("id", k).withColumn("lon", F.lit(-3.35) + (k % 300) / 1000.0).withColumn("lat", F.lit(55.85) + ((k * 7) % 150) / 1000.0)


def _rounded(rows: DataFrame, digits: int, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.round(c, digits) for c in columns})


@query("""SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_quantity > 0) AS quantity_n, round(avg(l_quantity) FILTER (l_quantity > 0), 6) AS quantity_mean, round(stddev_pop(l_quantity) FILTER (l_quantity > 0), 6) AS quantity_std,
    min(l_quantity) FILTER (l_quantity > 0) AS quantity_min, max(l_quantity) FILTER (l_quantity > 0) AS quantity_max, quantile_cont(l_quantity, 0.25) FILTER (l_quantity > 0) AS quantity_p25,
    quantile_cont(l_quantity, 0.5) FILTER (l_quantity > 0) AS quantity_p50, quantile_cont(l_quantity, 0.75) FILTER (l_quantity > 0) AS quantity_p75,
    count(*) FILTER (l_discount > 0) AS discount_n, round(avg(l_discount) FILTER (l_discount > 0), 6) AS discount_mean, round(stddev_pop(l_discount) FILTER (l_discount > 0), 6) AS discount_std,
    min(l_discount) FILTER (l_discount > 0) AS discount_min, max(l_discount) FILTER (l_discount > 0) AS discount_max, round(quantile_cont(l_discount, 0.25) FILTER (l_discount > 0), 6) AS discount_p25,
    round(quantile_cont(l_discount, 0.5) FILTER (l_discount > 0), 6) AS discount_p50, round(quantile_cont(l_discount, 0.75) FILTER (l_discount > 0), 6) AS discount_p75 FROM lineitem GROUP BY 1""")
def journey_statistics(spark, sf_dir):
    out = stats.positive_statistics(table(spark, sf_dir, "lineitem"), "l_returnflag", {"quantity": "l_quantity", "discount": "l_discount"})
    return _rounded(out, 6, "quantity_mean", "quantity_std", "discount_mean", "discount_std", "discount_p25", "discount_p50", "discount_p75")


@query("""WITH e AS (SELECT 'discount' AS factor, abs(l_discount * 100) AS w FROM lineitem UNION ALL SELECT 'tax', abs(-l_tax * 100) FROM lineitem UNION ALL SELECT 'quantity', abs(l_quantity) FROM lineitem),
    a AS (SELECT factor, avg(w) AS weight FROM e GROUP BY 1) SELECT factor, round(weight, 6) AS weight, round(weight * 100 / sum(weight) OVER (), 6) AS percent FROM a""")
def factor_importance(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.create_map(F.lit("discount"), F.col("l_discount") * 100, F.lit("tax"), -F.col("l_tax") * 100, F.lit("quantity"), F.col("l_quantity")).alias("factors"))
    return _rounded(stats.factor_importance(rows, "factors"), 6, "weight", "percent")


@query("""SELECT 'clear' AS bucket, count(*) AS n, round(avg(l_quantity) FILTER (l_quantity > 0), 6) AS mean FROM lineitem WHERE l_tax = 0 AND l_discount > 0.02
    UNION ALL SELECT 'cold', count(*), round(avg(l_quantity) FILTER (l_quantity > 0), 6) FROM lineitem WHERE l_discount < 0.02
    UNION ALL SELECT 'rain', count(*), round(avg(l_quantity) FILTER (l_quantity > 0), 6) FROM lineitem WHERE l_tax > 0
    UNION ALL SELECT 'ice', count(*), round(avg(l_quantity) FILTER (l_quantity > 0), 6) FROM lineitem WHERE l_tax > 0.05 AND l_discount < 0.02""")
def weather_impact(spark, sf_dir):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    buckets = {"clear": (tax == 0) & (discount > 0.02), "cold": discount < 0.02, "rain": tax > 0, "ice": (tax > 0.05) & (discount < 0.02)}
    return _rounded(stats.overlapping_buckets(table(spark, sf_dir, "lineitem"), "l_quantity", buckets), 6, "mean")


@query("""SELECT CASE WHEN l_tax > 0.05 AND l_discount < 0.02 THEN 'ice' WHEN l_tax > 0 THEN 'rain' WHEN l_discount <= 0.02 THEN 'cold' ELSE 'clear' END AS category, count(*) AS n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1""")
def weather_categories(spark, sf_dir):
    tax, discount = F.col("l_tax"), F.col("l_discount")
    kind = F.when((tax > 0.05) & (discount < 0.02), "ice").when(tax > 0, "rain").when(discount <= 0.02, "cold").otherwise("clear")
    return table(spark, sf_dir, "lineitem").groupBy(kind.alias("category")).agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"))


@query("""SELECT l_returnflag AS mode, l_linestatus AS kind, sum(l_quantity) AS km, count(*) AS trips FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())""")
def travel_totals(spark, sf_dir):
    return stats.travel_totals(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity")


@query("""SELECT DISTINCT c_custkey FROM customer SEMI JOIN (SELECT o_custkey FROM orders SEMI JOIN (SELECT l_orderkey FROM lineitem SEMI JOIN (SELECT s_suppkey FROM supplier SEMI JOIN
    (SELECT n_nationkey FROM nation SEMI JOIN (SELECT r_regionkey FROM region WHERE r_name = 'EUROPE') r ON n_regionkey = r_regionkey) n ON s_nationkey = n_nationkey) s ON l_suppkey = s_suppkey WHERE l_quantity > 45) l ON o_orderkey = l_orderkey) o ON c_custkey = o_custkey""")
def semi_join_cascade(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    suppliers = t("supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    lines = t("lineitem").filter("l_quantity > 45").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    orders = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return t("customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("""SELECT s_suppkey, CASE WHEN s_acctbal < 0 THEN n_name ELSE s_name END AS place, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def parent_rescue(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return s.select("s_suppkey", F.when(F.col("s_acctbal") < 0, F.col("n_name")).otherwise(F.col("s_name")).alias("place"), "r_name")


@query(f"""WITH a AS ({_points('customer', 'c_custkey')}), b AS ({_points('supplier', 's_suppkey')}) SELECT a.id, b.id AS other, round({_KM}, 6) AS km FROM a, b WHERE {_KM} <= 1.5""")
def radius_pairs(spark, sf_dir):
    return joins.radius_join(_at(table(spark, sf_dir, "customer"), "c_custkey"), _at(table(spark, sf_dir, "supplier"), "s_suppkey"), 1.5, 6)


@query(f"""WITH a AS ({_points('customer', 'c_custkey')}), b AS ({_points('supplier', 's_suppkey')}), p AS (SELECT a.id, b.id AS other, {_KM} AS km FROM a, b WHERE {_KM} <= 2),
    n AS (SELECT id, min(km) AS km FROM p GROUP BY 1) SELECT a.id, round(n.km, 6) AS km FROM a LEFT JOIN n ON a.id = n.id""")
def nearest_stop(spark, sf_dir):
    out = joins.nearest_join(_at(table(spark, sf_dir, "customer"), "c_custkey"), _at(table(spark, sf_dir, "supplier"), "s_suppkey"), 2.0)
    return _rounded(out, 6, "km").select("id", "km")


@query("""SELECT e.event_id, max_by(p.event_id, p.ts) AS last_purchase FROM events e LEFT JOIN events p ON p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts <= e.ts WHERE e.event_type = 'error' GROUP BY 1""")
def asof_last_purchase(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("last_purchase"))
    return joins.asof_join(left, right, "user_id", "ts", "since", "last_purchase").select("event_id", "last_purchase")


@query("""WITH x AS (SELECT o_orderkey, o_custkey AS k, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS d FROM orders WHERE o_orderpriority = '1-URGENT'),
    y AS (SELECT o_orderkey AS near, o_custkey AS k, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS e FROM orders WHERE o_orderpriority <> '1-URGENT')
    SELECT o_orderkey, near FROM x JOIN y USING (k) WHERE abs(d - e) <= 10""")
def band_neighbours(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")))
    x = o.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("day").alias("d"))
    y = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("near"), F.col("o_custkey").alias("k"), F.col("day").alias("e"))
    return joins.band_join(x, y, "k", "d", "e", 10).select("o_orderkey", "near")


@query("""SELECT p_partkey, p_type, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_type = a.p_type AND b.p_size <= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size < a.p_size OR b.p_retailprice < a.p_retailprice))""")
def pareto_front(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", "p_retailprice")
    return joins.skyline(rows, ["p_type"], ["p_size", "p_retailprice"]).select("p_partkey", "p_type", "p_size", "p_retailprice")


@query("""SELECT l_shipmonth, l_returnflag, rank, total FROM (SELECT *, row_number() OVER (PARTITION BY l_shipmonth ORDER BY total DESC, l_returnflag) AS rank FROM
    (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS l_shipmonth, l_returnflag, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2)) WHERE rank <= 2""")
def top_modes_per_month(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("l_shipmonth"), "l_returnflag").agg(F.sum("l_quantity").alias("total"))
    return stats.top_k(rows, ["l_shipmonth"], [F.desc("total"), F.asc("l_returnflag")], 2).select("l_shipmonth", "l_returnflag", "rank", "total")


@query(f"""WITH a AS ({_points('customer', 'c_custkey')}), b AS (SELECT *, 300 + (id * 37) % 3000 AS headway FROM ({_points('supplier', 's_suppkey')})),
    p AS (SELECT a.id, b.headway, b.id AS other, {_KM} AS km FROM a, b WHERE {_KM} <= 1.6),
    n AS (SELECT id, min(round(km, 9)) AS km, arg_min(headway, struct_pack(k := round(km, 9), o := other)) AS headway, count(*) FILTER (km <= 0.8) AS stops FROM p GROUP BY 1),
    s AS (SELECT a.id, coalesce(n.stops, 0) AS stops, coalesce(0.4 * least(1, n.km / 0.8) + 0.4 * least(1, n.headway / 1800) + 0.2 * greatest(0, 1 - coalesce(n.stops, 0) / 3), 1.0) AS score FROM a LEFT JOIN n ON a.id = n.id)
    SELECT id, stops, round(score, 3) AS score, score > 0.65 AS desert FROM s""")
def transit_deserts(spark, sf_dir):
    stops = _at(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("headway", F.lit(300) + (F.col("id") * 37) % 3000)
    out = transit.deserts(_at(table(spark, sf_dir, "customer"), "c_custkey").select("id", "lon", "lat"), stops.select("id", "lon", "lat", "headway"))
    return out.select("id", "stops", F.round("score", 3).alias("score"), "desert")


@query(f"""WITH a AS (SELECT *, 1 + id % 30 AS trip FROM ({_points('customer', 'c_custkey')})), b AS (SELECT *, 300 + (id * 37) % 3000 AS headway, 0.05 + (id % 10) / 100.0 AS price FROM ({_points('supplier', 's_suppkey')})),
    p AS (SELECT a.id, a.trip, b.headway, b.price, {_KM} AS walk FROM a, b WHERE {_KM} <= 1.5),
    n AS (SELECT id, min((trip / 20.0 * 60 + walk / 4.8 * 60 + headway / 60.0 / 2) / 60 * 10 + trip * price) AS c FROM p GROUP BY 1),
    s AS (SELECT a.id, greatest(0, (n.c - (trip / 35.0 * 10 + trip * 0.14)) / 10 * 120) AS f, n.c FROM a LEFT JOIN n ON a.id = n.id)
    SELECT CASE WHEN c IS NULL THEN 'never' WHEN f <= 5 THEN '<=5' WHEN f <= 15 THEN '<=15' WHEN f <= 30 THEN '<=30' ELSE '>30' END AS band, count(*) AS n, round(avg(CASE WHEN c IS NOT NULL THEN f END), 6) AS mean_flip FROM s GROUP BY 1""")
def modal_shift_bands(spark, sf_dir):
    trips = _at(table(spark, sf_dir, "customer"), "c_custkey").withColumn("km", 1 + F.col("id") % 30)
    stops = _at(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("headway", F.lit(300) + (F.col("id") * 37) % 3000).withColumn("price", F.lit(0.05) + (F.col("id") % 10) / 100.0)
    out = transit.modal_shift(trips.select("id", "lon", "lat", "km"), stops.select("id", "lon", "lat", "headway", "price"))
    return out.groupBy("band").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("transit_cost").isNotNull(), F.col("flip_minutes"))), 6).alias("mean_flip"))


@query("""WITH e AS (SELECT p_brand AS route, l_quantity * 100 AS m, 100 + p_size AS g, 300 + (l_partkey * 13) % 1500 AS h FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type NOT IN ('ECONOMY')),
    r AS (SELECT route, sum(m) / 1000 AS km, count(*) AS edges, avg(g) AS g, avg(h) AS h FROM e GROUP BY 1),
    t AS (SELECT *, km * (864 / greatest(h / 60, 1)) * 365 AS annual, km * (864 / greatest(h / 60, 1)) * 365 * g / 1e6 AS tonnes FROM r)
    SELECT route, round(km, 6) AS km, edges, round(annual, 2) AS annual_km, round(tonnes, 4) AS tonnes, km * 1.1 <= 250 AS in_range, round(tonnes / max(tonnes) OVER (), 6) AS impact FROM t""")
def electrification_ranking(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    edges = e.select(F.array("p_brand").alias("route_ids"), (F.col("l_quantity") * 100).alias("metres"), (100 + F.col("p_size")).alias("grams_km"), (300 + (F.col("l_partkey") * 13) % 1500).alias("headway"), F.when(F.col("p_type") == "ECONOMY", "electric").otherwise("diesel").alias("fuel"))
    out = transit.electrification(edges)
    return out.select("route", F.round("km", 6).alias("km"), "edges", F.round("annual_km", 2).alias("annual_km"), F.round("tonnes", 4).alias("tonnes"), "in_range", F.round("impact", 6).alias("impact"))


@query(f"""WITH p AS ({_points('lineitem', 'l_orderkey')}), s AS (SELECT lon, lat, l_returnflag AS mode, l_quantity AS grams FROM (SELECT {_LON.format(k='l_orderkey')} AS lon, {_LAT.format(k='l_orderkey')} AS lat, * FROM lineitem)),
    c AS (SELECT CAST(trunc(lon / 0.009) AS BIGINT) AS cell_x, CAST(trunc(lat / 0.0045) AS BIGINT) AS cell_y, mode, sum(grams) AS g, count(*) AS n FROM (SELECT CAST(lon AS DOUBLE) AS lon, CAST(lat AS DOUBLE) * 1.0 AS lat, mode, grams FROM s) GROUP BY 1, 2, 3)
    SELECT cell_x, cell_y, total, segments, top_mode FROM (SELECT cell_x, cell_y, sum(g) AS total, CAST(sum(n) AS BIGINT) AS segments, arg_min(mode, struct_pack(a := -g, b := mode)) AS top_mode FROM c GROUP BY 1, 2) ORDER BY total DESC, cell_x, cell_y LIMIT 20""")
def emission_hotspots(spark, sf_dir):
    # The report is the 20 greatest cells; cells are square in degrees of their own axis.
    rows = _at(table(spark, sf_dir, "lineitem"), "l_orderkey").select("lon", (F.col("lat") * 2.0).alias("lat"), F.col("l_returnflag").alias("mode"), F.col("l_quantity").alias("grams"))
    return transit.hotspots(rows, 0.009)


_POLICIES = """b AS (SELECT c_mktsegment AS policy, sum(c_acctbal) AS implementation, count(*) * 10.0 AS opex, sum(c_acctbal) / 50 AS saved_kg, count(*) AS agents FROM customer GROUP BY 1)"""


def _policies(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("policy")).agg(F.sum("c_acctbal").alias("implementation"), (F.count("*") * 10.0).alias("opex"), (F.sum("c_acctbal") / 50).alias("saved_kg"), F.count("*").alias("agents"))


@query(f"""WITH {_POLICIES}, c AS (SELECT policy, implementation + opex * 7 / 365 AS total, saved_kg / 1000 * 25 AS gain FROM b)
    SELECT policy, round(total, 4) AS total_cost, round(gain, 4) AS gain, round(gain / total, 6) AS bcr, round(total * 7 / gain, 3) AS payback_days,
    round(gain * 365 / 7 * (1 + 1 / 1.05 + 1 / 1.05 ** 2 + 1 / 1.05 ** 3 + 1 / 1.05 ** 4) - total, 3) AS npv FROM c""")
def policy_returns(spark, sf_dir):
    out = policy.returns(_policies(spark, sf_dir))
    return out.select("policy", F.round("total_cost", 4).alias("total_cost"), F.round("gain", 4).alias("gain"), F.round("bcr", 6).alias("bcr"), F.round("payback_days", 3).alias("payback_days"), F.round("npv", 3).alias("npv"))


@query(f"""WITH {_POLICIES} SELECT policy, rank() OVER (ORDER BY implementation DESC) AS implementation_rank, rank() OVER (ORDER BY agents DESC) AS agents_rank FROM b""")
def policy_ranks(spark, sf_dir):
    p = _policies(spark, sf_dir)
    return policy.ranked(p.withColumn("agents", F.col("agents").cast("double")), ["implementation", "agents"])


@query("""WITH u AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0 AS u FROM orders), s AS (SELECT o_orderkey, CASE WHEN u > 0.9 THEN 'overloaded' WHEN u < 0.3 THEN 'underused' END AS kind,
    CASE WHEN u > 0.9 THEN least(1, (u - 0.9) / 0.1) WHEN u < 0.3 THEN (0.3 - u) / 0.3 END AS v FROM u) SELECT o_orderkey, kind, round(v, 6) AS severity FROM s WHERE v >= 0.55""")
def bottlenecks(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 100) / 100.0).alias("u"), F.lit(1).alias("capacity"))
    return stats.bottlenecks(rows, "u", "capacity", 0.55).select("o_orderkey", "kind", F.round("severity", 6).alias("severity"))


@query("""SELECT o_orderkey % 100 AS u, round(CASE WHEN u / 100.0 < 0.7 THEN u / 70.0 WHEN u > 80 THEN greatest(0, 1 - 2 * (u / 100.0 - 0.8)) ELSE 1 END, 9) AS efficiency,
    CASE WHEN u >= 95 THEN 2.0 WHEN u >= 85 THEN 1.5 WHEN u >= 70 THEN 1.2 ELSE 1.0 END AS stress FROM (SELECT DISTINCT o_orderkey % 100 AS u, o_orderkey % 100 AS o_orderkey FROM orders)""")
def utilisation_efficiency(spark, sf_dir):
    from corvane.functions.cost import stress_factor

    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 100).alias("u")).distinct()
    return rows.select("u", F.round(stats.charger_efficiency(F.col("u") / 100.0), 9).alias("efficiency"), stress_factor(F.col("u") / 100.0).alias("stress"))


@query("""SELECT doc_id, CASE WHEN a = 0 AND b = 0 AND c = 0 THEN 'other' WHEN a >= b AND a >= c THEN 'article' WHEN b >= c THEN 'link' ELSE 'licence' END AS kind FROM
    (SELECT doc_id, (length(lower(text)) - length(replace(lower(text), ' the ', ''))) / 5 AS a, (length(lower(text)) - length(replace(lower(text), ' and ', ''))) / 5 AS b,
     (length(lower(text)) - length(replace(lower(text), 'licen', ''))) / 5 AS c FROM documents)""")
def text_archetypes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", text.archetype(F.col("text"), {"article": [" the "], "link": [" and "], "licence": ["licen"]}, "other").alias("kind"))


@query("""SELECT role, word, CAST(n AS BIGINT) AS n FROM (SELECT role, sum((length(lower(text)) - length(replace(lower(text), 'the', ''))) // 3) AS the, sum((length(lower(text)) - length(replace(lower(text), 'and', ''))) // 3) AS "and"
    FROM conversations GROUP BY 1) UNPIVOT (n FOR word IN (the, "and"))""")
def keyword_counts(spark, sf_dir):
    return text.keyword_counts(table(spark, sf_dir, "conversations"), "role", "text", ["the", "and"])


_TYPE = "CASE WHEN p_size < 15 THEN p_size WHEN p_size < 30 THEN 85 + p_size WHEN p_size < 40 THEN 370 + p_size ELSE 100 * (p_size - 35) END"
_MODE_CASE = f"CASE {_TYPE} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in text.ROUTE_MODES.items()) + " ELSE 'bus' END"


def _route_type():
    size = F.col("p_size")
    return F.when(size < 15, size).when(size < 30, 85 + size).when(size < 40, 370 + size).otherwise(100 * (size - 35)).cast("int")


@query(f"SELECT p_partkey, {_TYPE} AS route_type, {_MODE_CASE} AS mode FROM part")
def route_modes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", _route_type().cast("long").alias("route_type"), text.route_mode(_route_type()).alias("mode"))


_WORDS = ["Battery bus", "Zero-Emission fleet", "Trolley line", "fuel cell pilot", "FCEV", "diesel hybrid", "Petrol", "hybrid", "plain", "ZEV"]


@query(f"""WITH r AS (SELECT p_partkey, {_TYPE} AS t, lower(list_extract({_WORDS}, CAST(p_partkey % 10 + 1 AS BIGINT))) AS w FROM part), f AS (SELECT p_partkey, t, CASE WHEN t IN {text.ELECTRIC_TYPES} THEN 'electric' {' '.join(f"WHEN regexp_matches(w, '{k}') THEN '{v}'" for k, v in text.FUELS)} WHEN t IN {text.RAIL_TYPES} THEN 'electric' ELSE 'diesel' END AS fuel FROM r)
    SELECT CASE WHEN t = 4 OR t BETWEEN 1000 AND 1012 THEN CASE WHEN fuel = 'electric' THEN 'ferry_electric' ELSE 'ferry_diesel' END ELSE 'other' END AS ferry, fuel, count(*) AS n FROM f GROUP BY 1, 2""")
def route_fuels(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(_route_type().alias("t"), F.element_at(F.array(*(F.lit(w) for w in _WORDS)), (F.col("p_partkey") % 10 + 1).cast("int")).alias("w"))
    rows = rows.withColumn("fuel", text.route_fuel(F.col("w"), F.col("t")))
    mode = text.route_mode(F.col("t"), F.col("fuel"))
    return rows.groupBy(F.when(mode.startswith("ferry"), mode).otherwise("other").alias("ferry"), "fuel").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey % 50 AS day, count(*) AS n, CASE WHEN count(*) >= 320 THEN 'violation' WHEN count(*) >= 256 THEN 'warning' ELSE 'ok' END AS state FROM orders GROUP BY 1""")
def constraint_states(spark, sf_dir):
    return policy.checked(table(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 50).alias("day")).agg(F.count("*").alias("n")), "n", 320)


@query("""SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 5) THEN 'spring' WHEN month(o_orderdate) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
    dayofweek(o_orderdate) IN (0, 6) AS weekend, count(*) AS trips, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2""")
def seasonal_demand(spark, sf_dir):
    from corvane.functions.clock import season

    o = table(spark, sf_dir, "orders")
    return o.groupBy(season(F.month("o_orderdate")).alias("season"), F.weekday("o_orderdate").isin(5, 6).alias("weekend")).agg(F.count("*").alias("trips"), F.round(F.sum("o_totalprice"), 2).alias("value"))


@query("""WITH p AS (SELECT a.label, 1 - list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(len(a.embedding)) AS s FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
    SELECT label, count(*) AS n, round(avg(s), 6) AS similarity, count(*) FILTER (s > 0.8) AS family, count(*) FILTER (s > 0.6 AND s <= 0.8) AS friend FROM p GROUP BY 1""")
def tie_similarity(spark, sf_dir):
    """Strength of the ties of each vector with the next: 1 less their distance over the greatest, and the kinds of ties."""
    from corvane.functions.minds import tie

    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    square = F.aggregate(F.zip_with("embedding", "next", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    s = e.join(after, "vec_id").select("label", (1 - F.sqrt(square) / F.sqrt(F.size("embedding"))).alias("s")).withColumn("kind", tie(F.col("s")))
    return s.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("s"), 6).alias("similarity"), F.count_if(F.col("kind") == "family").alias("family"), F.count_if(F.col("kind") == "friend").alias("friend"))
