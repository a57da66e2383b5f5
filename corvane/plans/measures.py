"""Measures of single rows and short sequences: distances, turns, climbs, costs, habits, flows, trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import clock, cost, geo
from corvane.plans.registry import query, table

_TRACK = """t AS (SELECT user_id, ts, value, -3.35 + (event_id % 300) / 1000.0 AS lon, 55.85 + ((event_id * 7) % 150) / 1000.0 AS lat FROM events),
    p AS (SELECT *, lag(lon) OVER w AS lon0, lag(lat) OVER w AS lat0, lag(value) OVER w AS v0 FROM t WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, degrees(atan2(sin(radians(lon - lon0)) * cos(radians(lat)), cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lon - lon0)))) AS course FROM p)"""


def _track(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    e = F.col("event_id")
    t = table(spark, sf_dir, "events").select("user_id", "ts", "value", (F.lit(-3.35) + (e % 300) / 1000.0).alias("lon"), (F.lit(55.85) + ((e * 7) % 150) / 1000.0).alias("lat"))
    return t.withColumns({"lon0": F.lag("lon").over(w), "lat0": F.lag("lat").over(w), "v0": F.lag("value").over(w)})


@query(f"""WITH {_TRACK} SELECT user_id, round(sum(2 * 6371.0 * asin(sqrt(least(1.0, sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2)))), 4) AS km FROM p WHERE lon0 IS NOT NULL GROUP BY 1""")
def route_distance(spark, sf_dir):
    km = geo.haversine_km(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat"))
    return _track(spark, sf_dir).filter("lon0 IS NOT NULL").groupBy("user_id").agg(F.round(F.sum(km), 4).alias("km"))


@query(f"""WITH {_TRACK}, c AS (SELECT *, lag(course) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM b), d AS (SELECT user_id, abs(course - before) AS d FROM c WHERE before IS NOT NULL)
    SELECT user_id, count(*) AS reversals FROM d WHERE least(d, 360 - d) > 150 GROUP BY 1""")
def heading_reversals(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    t = _track(spark, sf_dir).withColumn("course", geo.bearing(F.col("lon0"), F.col("lat0"), F.col("lon"), F.col("lat")))
    t = t.withColumn("before", F.lag("course").over(w)).filter(geo.turn(F.col("before"), F.col("course")) > 150)
    return t.groupBy("user_id").agg(F.count("*").alias("reversals"))


@query(f"""WITH {_TRACK} SELECT user_id, round(sum(greatest(0, value - v0)), 4) AS gain, round(sum(greatest(0, v0 - value)), 4) AS loss, min(value) AS lowest, max(value) AS highest FROM p WHERE v0 IS NOT NULL GROUP BY 1""")
def climbs(spark, sf_dir):
    up = F.col("value") - F.col("v0")
    zero = F.lit(0.0)
    return _track(spark, sf_dir).filter("v0 IS NOT NULL").groupBy("user_id").agg(F.round(F.sum(F.greatest(zero, up)), 4).alias("gain"), F.round(F.sum(F.greatest(zero, -up)), 4).alias("loss"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("""SELECT l_shipmode, count(*) AS n, round(sum((l_quantity / 30 * 60 + 5) / 60 * 12 + l_quantity * 0.2 + l_quantity * 80 / 1000 * 0.05), 3) AS cost FROM
    (SELECT l_returnflag AS l_shipmode, l_quantity FROM lineitem) GROUP BY 1""")
def generalised_costs(spark, sf_dir):
    km = F.col("l_quantity")
    c = cost.generalised_cost(km / 30 * 60, F.lit(10.0), km, 12.0, 0.2, 80.0, 0.05)
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.count("*").alias("n"), F.round(F.sum(c), 3).alias("cost"))


@query("""SELECT user_id, event_type, count(*) AS uses, round(1 - 1 / (1 + count(*) / 5), 9) AS habit, round(sum(value * 0.9 ** date_diff('day', CAST(ts AS DATE), DATE '2024-01-31')), 6) AS influence FROM events GROUP BY 1, 2""")
def habits_and_influence(spark, sf_dir):
    old = F.datediff(F.lit("2024-01-31").cast("date"), F.to_date("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("uses"), F.round(cost.habit(F.count("*")), 9).alias("habit"), F.round(F.sum(cost.decayed(F.col("value"), 0.1, old)), 6).alias("influence"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS e FROM events GROUP BY 1)
    SELECT day, round(e, 9) AS share, round(0.05 * e * (1 - e / 0.8) + 1.0 * 0.02 + 0.03 * e * (1 - e / 0.8), 9) AS flow, round((0.05 + 0.03) * (1 - 2 * e / 0.8), 9) AS sensitivity FROM d""")
def adoption_flow(spark, sf_dir):
    d = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.avg(F.when(F.col("event_type") == "purchase", 1.0).otherwise(0.0)).alias("e"))
    e = F.col("e")
    return d.select("day", F.round(e, 9).alias("share"), F.round(cost.adoption_flow(e, 0.05, 0.8, 100.0, 0.02, 0.03), 9).alias("flow"), F.round((0.05 + 0.03) * (1 - 2 * e / 0.8), 9).alias("sensitivity"))


@query("""SELECT user_id, event_id AS best, round(v, 6) AS score FROM (SELECT user_id, event_id, 0.7 * value - 0.3 * CAST(json_extract(props, '$.k') AS INTEGER) AS v,
    row_number() OVER (PARTITION BY user_id ORDER BY 0.7 * value - 0.3 * CAST(json_extract(props, '$.k') AS INTEGER) DESC, event_id) AS r FROM events) WHERE r = 1""")
def ranked_alternatives(spark, sf_dir):
    v = F.col("value") * 0.7 - F.get_json_object("props", "$.k").cast("int") * 0.3
    best = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct((-v).alias("v"), "event_id")).alias("b"))
    return best.select("user_id", F.col("b.event_id").alias("best"), F.round(-F.col("b.v"), 6).alias("score"))


@query("""SELECT (c_custkey * 7) % 40 AS x, c_nationkey AS y, count(*) AS demand FROM customer GROUP BY 1, 2 ORDER BY demand DESC, x, y LIMIT 15""")
def demand_hotspots(spark, sf_dir):
    # The report is the 15 cells of most demand.
    cells = table(spark, sf_dir, "customer").groupBy(((F.col("c_custkey") * 7) % 40).alias("x"), F.col("c_nationkey").alias("y")).agg(F.count("*").alias("demand"))
    return cells.orderBy(F.desc("demand"), "x", "y").limit(15)


@query("""SELECT l_returnflag, l_linestatus, count(*) AS trips, sum(l_quantity) AS km FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def travel_rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("trips"), F.sum("l_quantity").alias("km"))


@query("""WITH c AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS r FROM c)
    SELECT event_type, round(avg(n) FILTER (r <= 5) - avg(n) FILTER (r > 5), 6) AS change FROM r WHERE r <= 10 GROUP BY 1""")
def network_tipping(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy(F.desc("day"))
    c = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    last = c.withColumn("r", F.row_number().over(w)).filter("r <= 10")
    return last.groupBy("event_type").agg(F.round(F.avg(F.when(F.col("r") <= 5, F.col("n"))) - F.avg(F.when(F.col("r") > 5, F.col("n"))), 6).alias("change"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE (o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + 5 END AS seconds FROM orders""")
def feed_times(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.when(k % 7 == 0, "late").otherwise(F.concat_ws(":", (k % 30).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("05")))
    return table(spark, sf_dir, "orders").select("o_orderkey", clock.feed_seconds(text).alias("seconds"))


@query("""SELECT hour(ts) BETWEEN 7 AND 9 OR hour(ts) BETWEEN 17 AND 19 AS rush, count(*) AS n, count(*) FILTER (-3.35 + (event_id % 300) / 1000.0 BETWEEN -3.25 AND -3.1 AND 55.85 + ((event_id * 7) % 150) / 1000.0 BETWEEN 55.9 AND 55.95) AS inside FROM events GROUP BY 1""")
def rush_hour_box(spark, sf_dir):
    e = F.col("event_id")
    inside = geo.in_box(F.lit(-3.35) + (e % 300) / 1000.0, F.lit(55.85) + ((e * 7) % 150) / 1000.0, -3.25, 55.9, -3.1, 55.95)
    return table(spark, sf_dir, "events").groupBy(clock.is_rush_hour(F.hour("ts")).alias("rush")).agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


@query("""WITH m AS (SELECT part.p_brand AS persona, s.s_nationkey AS job, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier s ON l_suppkey = s_suppkey GROUP BY 1, 2)
    SELECT b.p_brand AS persona, count(*) FILTER (m.n IS NULL) AS blocked, count(m.n) AS compatible FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (SELECT n_nationkey FROM nation) j LEFT JOIN m ON m.persona = b.p_brand AND m.job = j.n_nationkey GROUP BY 1""")
def compatibility_report(spark, sf_dir):
    """Personas and jobs are both short lists of a register; what they make together is the report."""
    met = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    met = met.groupBy(F.col("p_brand").alias("persona"), F.col("s_nationkey").alias("job")).agg(F.count("*").alias("n"))
    jobs = table(spark, sf_dir, "nation").agg(F.count("*").alias("jobs"))
    personas = table(spark, sf_dir, "part").select(F.col("p_brand").alias("persona")).distinct()
    out = personas.join(met.groupBy("persona").agg(F.count("*").alias("compatible")), "persona", "left").crossJoin(jobs)
    return out.select("persona", (F.col("jobs") - F.coalesce("compatible", F.lit(0))).alias("blocked"), F.coalesce("compatible", F.lit(0)).alias("compatible"))
