"""Trips on lines made of the trade tables, rides along ordered stops, and what events leave in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import lines, memory
from corvane.plans.registry import query, table

_PIECES = """p AS (SELECT s_suppkey // 8 AS line, s_suppkey AS k, s_suppkey * 37 % 300 / 1000.0::DOUBLE - 3.35 AS lon, s_suppkey * 53 % 150 / 1000.0::DOUBLE + 55.85 AS lat FROM supplier),
    s AS (SELECT *, lag(lon) OVER w AS x1, lag(lat) OVER w AS y1, coalesce(sqrt(pow(lon - lag(lon) OVER w, 2) + pow(lat - lag(lat) OVER w, 2)), 0) AS step FROM p WINDOW w AS (PARTITION BY line ORDER BY k)),
    v AS (SELECT *, sum(step) OVER (PARTITION BY line ORDER BY k) AS away FROM s), g AS (SELECT line, away - step AS start, x1, y1, lon AS x2, lat AS y2, step AS length FROM v WHERE step > 0 AND x1 IS NOT NULL),
    e AS (SELECT c_custkey AS trip, 1 AS e, c_custkey % 300 / 1000.0::DOUBLE - 3.35 AS lon, c_custkey * 7 % 150 / 1000.0::DOUBLE + 55.85 AS lat FROM customer UNION ALL SELECT c_custkey, 2, c_custkey * 17 % 300 / 1000.0::DOUBLE - 3.35, c_custkey * 11 % 150 / 1000.0::DOUBLE + 55.85 FROM customer),
    d AS (SELECT trip, e, line, sqrt(pow(x1 + share * (x2 - x1) - lon, 2) + pow(y1 + share * (y2 - y1) - lat, 2)) AS far, start + share * length AS away FROM (SELECT *, least(greatest(((lon - x1) * (x2 - x1) + (lat - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 0), 1) AS share FROM e, g)),
    n AS (SELECT trip, e, line, min(struct_pack(far := far, away := away)) AS b FROM d WHERE far <= 20.0 / 111.0 GROUP BY 1, 2, 3),
    m AS (SELECT a.trip, min(struct_pack(off := a.b.far * 111.0 + c.b.far * 111.0, line := a.line, p1 := a.b.away, p2 := c.b.away)) AS b FROM n a JOIN n c ON a.trip = c.trip AND a.line = c.line AND a.e = 1 AND c.e = 2 GROUP BY 1)"""


@query(f"""WITH {_PIECES} SELECT trip, b.line AS line, round(b.off, 6) AS off, round(b.p1, 6) AS from_offset, round(b.p2, 6) AS to_offset, (SELECT count(*) FROM v WHERE v.line = b.line AND away > least(b.p1, b.p2) AND away < greatest(b.p1, b.p2)) + 2 AS points,
    (SELECT round(x1 + (x2 - x1) * (b.p1 - start) / length, 6) FROM g WHERE g.line = b.line AND start + length >= b.p1 ORDER BY start LIMIT 1) AS lon FROM m""")
def line_matches(spark, sf_dir):
    """The line that serves each trip best, where it gets on and off, and how the way between looks."""
    k, s = F.col("c_custkey"), F.col("s_suppkey")
    trips = table(spark, sf_dir, "customer").select(k.alias("trip"), (k % 300 / 1000.0 - 3.35).alias("lon1"), (k * 7 % 150 / 1000.0 + 55.85).alias("lat1"), (k * 17 % 300 / 1000.0 - 3.35).alias("lon2"), (k * 11 % 150 / 1000.0 + 55.85).alias("lat2"))
    at = table(spark, sf_dir, "supplier").select(F.floor(s / 8).alias("line"), s.alias("k"), (s * 37 % 300 / 1000.0 - 3.35).alias("lon"), (s * 53 % 150 / 1000.0 + 55.85).alias("lat"))
    held = at.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("k", "lon", "lat"))).alias("p")).select("line", F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("points"))
    out = lines.matched(trips, held)
    return out.select("trip", "line", *(F.round(c, 6).alias(c) for c in ("off", "from_offset", "to_offset")), F.size("points").cast("long").alias("points"), F.round(F.get("points", F.lit(0))["lon"], 6).alias("lon"))


_STOP = "(p_partkey * 31 + p_size * 17) % 500"


def _rides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts by twenties as lines of stops; every part asks for the way to another one of its line."""
    k = F.col("p_partkey")
    at = table(spark, sf_dir, "part").select(k.alias("k"), F.floor(k / 20).alias("line"), ((k * 31 + F.col("p_size") * 17) % 500).alias("stop"))
    held = at.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("k", "stop"))).alias("s")).select("line", F.transform("s", lambda x: x["stop"]).alias("stops"))
    to = at.select(F.col("k").alias("other"), F.col("stop").alias("destination"))
    other = F.col("k") - F.col("k") % 20 + F.col("k") * 7 % 20
    trips = at.withColumn("other", other).join(to, "other").select(F.col("k").alias("trip"), F.col("stop").alias("origin"), "destination")
    return lines.ordered_ride(trips, held), at


_RIDES = f"""a AS (SELECT p_partkey AS k, p_partkey // 20 AS line, {_STOP} AS stop FROM part), l AS (SELECT line, list(stop ORDER BY k) AS stops FROM a GROUP BY 1), o AS (SELECT line, stop, min(i) AS i FROM (SELECT line, stop, row_number() OVER (PARTITION BY line ORDER BY k) AS i FROM a) GROUP BY 1, 2),
    t AS (SELECT a.k AS trip, a.stop AS origin, b.stop AS destination FROM a JOIN a b ON b.k = a.k - a.k % 20 + a.k * 7 % 20), r AS (SELECT trip, min(struct_pack(n := abs(x.i - y.i), line := x.line, i := x.i, j := y.i)) AS b FROM t JOIN o x ON x.stop = origin JOIN o y ON y.stop = destination AND y.line = x.line GROUP BY 1),
    w AS (SELECT trip, b.line AS line, CASE WHEN b.i <= b.j THEN stops[b.i : b.j] ELSE list_reverse(stops[b.j : b.i]) END AS stops FROM r JOIN l ON l.line = b.line)"""


@query(f"WITH {_RIDES} SELECT trip, line, array_to_string(stops, '>') AS path FROM w")
def ordered_rides(spark, sf_dir):
    """Stops passed between two stops of one line, in either direction."""
    return _rides(spark, sf_dir)[0].select("trip", "line", F.array_join(F.transform("stops", lambda s: s.cast("string")), ">").alias("path"))


@query(f"""WITH {_RIDES}, h AS (SELECT DISTINCT a.stop AS u, b.stop AS v FROM a JOIN a b ON b.k = a.k + 1 AND a.k % 3 = 0), q AS (SELECT trip, unnest(range(1, len(stops))) AS i, stops FROM w WHERE len(stops) > 1), c AS (SELECT trip, i, stops[i] AS u, stops[i + 1] AS v FROM q),
    z AS (SELECT trip, i, h.u IS NOT NULL AS own, h.u IS NULL AND k.u IS NOT NULL AS back, [c.u % 25 / 100.0::DOUBLE, c.u // 25 / 100.0::DOUBLE] AS pu, [c.v % 25 / 100.0::DOUBLE, c.v // 25 / 100.0::DOUBLE] AS pv, CASE WHEN h.u IS NOT NULL THEN [c.u / 1000.0::DOUBLE, c.v / 1000.0::DOUBLE] ELSE [c.v / 1000.0::DOUBLE, c.u / 1000.0::DOUBLE] END AS mid
      FROM c LEFT JOIN h ON h.u = c.u AND h.v = c.v LEFT JOIN h k ON k.u = c.v AND k.v = c.u),
    f AS (SELECT trip, flatten(list(CASE WHEN own OR back THEN [pu, mid, pv] ELSE [pu, pv] END ORDER BY i)) AS flat, count(*) FILTER (own) AS own, count(*) FILTER (back) AS back, count(*) FILTER (NOT own AND NOT back) AS straight FROM z GROUP BY 1),
    y AS (SELECT trip, list_filter(flat, lambda p, i: i = 1 OR p <> flat[i - 1]) AS points, own, back, straight FROM f) SELECT trip, CAST(len(points) AS BIGINT) AS points, round(list_sum(list_transform(points, lambda p: p[1])), 6) AS lon, round(list_sum(list_transform(points, lambda p: p[2])), 6) AS lat, own, back, straight FROM y""")
def ride_geometry(spark, sf_dir):
    """The line on the map of each ride: own shapes of its edges, those of the way back, or straight lines."""
    rides, at = _rides(spark, sf_dir)
    place = lambda s: ((s % 25 / 100.0).alias("lon"), (F.floor(s / 25) / 100.0).alias("lat"))
    stops = at.select(F.col("stop").alias("id")).distinct().select("id", *place(F.col("id")))
    follows = at.filter("k % 3 = 0").select((F.col("k") + 1).alias("k"), F.col("stop").alias("u")).join(at.select("k", F.col("stop").alias("v")), "k").select("u", "v").distinct()
    middle = F.struct((F.col("u") / 1000.0).alias("lon"), (F.col("v") / 1000.0).alias("lat"))
    shapes = follows.select("u", "v", F.array(F.struct(*place(F.col("u"))), middle, F.struct(*place(F.col("v")))).alias("points"))
    total = lambda c: F.round(F.aggregate("points", F.lit(0.0), lambda a, p: a + p[c]), 6).alias(c)
    return lines.stitched(rides, shapes, stops).select("trip", F.size("points").cast("long").alias("points"), total("lon"), total("lat"), "pieces.*")


_DAY = "CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT)"
_INFLUENCES = f"""i AS (SELECT user_id AS agent, event_type AS mode, {_DAY} AS step, event_id AS "order", value / 100.0 AS strength, CASE event_id % 3 WHEN 0 THEN 0.4 WHEN 1 THEN 0.8 ELSE 1.0 END::DOUBLE AS decay FROM events), q AS (SELECT DISTINCT agent, mode, step + 5 AS step FROM i)"""


def _influences(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    n = F.col("event_id") % 3
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long")
    i = table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), F.col("event_type").alias("mode"), day.alias("step"), F.col("event_id").alias("order"), (F.col("value") / 100.0).alias("strength"), F.when(n == 0, 0.4).when(n == 1, 0.8).otherwise(1.0).alias("decay"))
    return i, i.select("agent", "mode", (F.col("step") + 5).alias("step")).distinct()


@query(f"""WITH {_INFLUENCES} SELECT q.agent, q.mode, q.step, count(i.step) AS memories, round(coalesce(sum(strength * pow(1 - decay, q.step - i.step)), 0), 6) AS strength FROM q LEFT JOIN i ON i.agent = q.agent AND i.mode = q.mode AND i.step <= q.step AND i.step > q.step - 10 / decay GROUP BY 1, 2, 3""")
def remembered_influences(spark, sf_dir):
    """What is left of others' choices some days later, forgotten ones apart."""
    return memory.remembered(*_influences(spark, sf_dir)).withColumn("strength", F.round("strength", 6))


@query(f"""WITH {_INFLUENCES}, x AS (SELECT q.agent, q.mode, q.step, strength * pow(1 - decay, q.step - i.step) AS s, row_number() OVER (PARTITION BY q.agent, q.mode, q.step ORDER BY i.step DESC, i."order" DESC) AS k FROM q JOIN i ON i.agent = q.agent AND i.mode = q.mode AND i.step <= q.step AND q.step - i.step <= 10)
    SELECT agent, mode, step, round(least(1.0, sum(s) / 5), 6) AS influence FROM x WHERE k <= 5 GROUP BY 1, 2, 3""")
def peer_influences(spark, sf_dir):
    """How much recent influences weigh, a few of them at most."""
    i, q = _influences(spark, sf_dir)
    out = memory.peer_influence(i, q.withColumn("share", F.lit(0.3)))
    return out.select("agent", "mode", "step", F.round("influence", 6).alias("influence"))
