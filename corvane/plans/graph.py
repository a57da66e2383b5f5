"""Graph operators: parts sold together with suppliers, and users who follow each other through the day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import graph, paths, stats, transit
from corvane.plans.registry import query, table


def _trade(spark, sf_dir) -> DataFrame:
    """Trades between a part and a supplier, as edges between numbers of one space."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    return rows.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))


@query()
def connected_components(spark, sf_dir):
    return graph.components(_trade(spark, sf_dir))


@query("""WITH e AS (SELECT DISTINCT l_partkey * 2 AS src, l_suppkey * 2 + 1 AS dst FROM lineitem), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)
    SELECT src AS node, count(*) AS degree FROM u GROUP BY 1""")
def node_degrees(spark, sf_dir):
    # Pairs are told apart by the operator, once.
    rows = table(spark, sf_dir, "lineitem")
    return graph.degrees(rows.select((F.col("l_partkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")))


_FOLLOW = """f AS (SELECT user_id, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id) AS next FROM events), e AS (SELECT DISTINCT user_id AS src, next AS dst FROM f WHERE next IS NOT NULL AND next <> user_id),
    u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


def _follow(spark, sf_dir) -> DataFrame:
    """Who comes after whom on each day."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", F.col("user_id").alias("src"))
    after = stats.following(rows, "day", ["ts", "event_id"], "src").select("src", F.col("next").alias("dst"))
    return after.filter("dst IS NOT NULL AND dst <> src").distinct()


@query(f"""WITH {_FOLLOW}, d AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1), t AS (SELECT a.src AS node, count(*) / 2 AS n FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.dst AND c.src = a.src GROUP BY 1)
    SELECT d.node, degree, CAST(coalesce(n, 0) AS BIGINT) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 9) AS clustering FROM d LEFT JOIN t USING (node)""")
def clustering(spark, sf_dir):
    return graph.clustering(_follow(spark, sf_dir)).withColumn("clustering", F.round("clustering", 9))


@query(f"""WITH {_FOLLOW}, d AS (SELECT src AS node, count(*) AS degree FROM u GROUP BY 1), t AS (SELECT a.src AS node, count(*) / 2 AS n FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.dst AND c.src = a.src GROUP BY 1)
    SELECT count(*) AS agents, CAST(sum(degree) // 2 AS BIGINT) AS ties, round(avg(degree), 6) AS mean_degree, round(avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END), 6) AS clustering, round(sum(degree) / (count(*) * (count(*) - 1.0)), 9) AS density FROM d LEFT JOIN t USING (node)""")
def network_metrics(spark, sf_dir):
    """Size, mean degree, mean clustering and density of the whole network."""
    nodes = graph.clustering(_follow(spark, sf_dir))
    n, degrees = F.count("*"), F.sum("degree")
    return nodes.agg(n.alias("agents"), F.floor(degrees / 2).cast("long").alias("ties"), F.round(F.avg("degree"), 6).alias("mean_degree"), F.round(F.avg("clustering"), 6).alias("clustering"), F.round(degrees / (n * (n - 1.0)), 9).alias("density"))


@query()
def breadth_first_hops(spark, sf_dir):
    edges = _follow(spark, sf_dir)
    return graph.hops(edges, edges.agg(F.min("src").alias("node")))


@query()
def shortest_paths(spark, sf_dir):
    e = _follow(spark, sf_dir)
    return graph.shortest_paths(e.withColumn("cost", 1.0 + (F.col("src") * 31 + F.col("dst") * 17) % 23), e.agg(F.min("src").alias("node"))).select("node", "cost")


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey - o_orderkey % 10 WHEN o_orderkey % 100 <> 0 THEN o_orderkey - o_orderkey % 100 END AS parent FROM orders),
    r(node, top) AS (SELECT node, node FROM p UNION ALL SELECT r.node, p.parent FROM r JOIN p ON r.top = p.node WHERE p.parent IS NOT NULL AND p.parent IN (SELECT node FROM p)) SELECT node, min(top) AS root FROM r GROUP BY 1""")
def influence_roots(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("node"), F.when(k % 10 != 0, k - k % 10).when(k % 100 != 0, k - k % 100).alias("parent"))
    return graph.roots(rows)


@query(f"""WITH {_FOLLOW}, m AS (SELECT user_id, arg_max(event_type, ts) AS mode FROM events GROUP BY 1), n AS (SELECT u.src AS node, m.mode, count(*) AS n FROM u JOIN m ON u.dst = m.user_id GROUP BY 1, 2)
    SELECT node, mode, round(n / sum(n) OVER (PARTITION BY node), 9) AS share FROM n""")
def peer_mode_share(spark, sf_dir):
    modes = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("node")).agg(F.max_by("event_type", "ts").alias("mode"))
    return graph.peer_share(_follow(spark, sf_dir), modes).withColumn("share", F.round("share", 9))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS node, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderkey - o_orderkey % 10 WHEN o_orderkey % 100 <> 0 THEN o_orderkey - o_orderkey % 100 END AS parent FROM orders),
    r(node, top, hops) AS (SELECT node, node, 0 FROM p UNION ALL SELECT r.node, p.parent, hops + 1 FROM r JOIN p ON r.top = p.node WHERE p.parent IS NOT NULL AND p.parent IN (SELECT node FROM p)),
    o AS (SELECT node, arg_max(top, hops) AS origin, max(hops) AS hops FROM r GROUP BY 1), c AS (SELECT origin, count(*) AS adopters, min(day) AS first, max(day) AS last, max(hops) AS farthest, avg(hops) AS mean_hops FROM o JOIN p USING (node) WHERE parent IS NOT NULL AND hops > 0 GROUP BY 1)
    SELECT origin, adopters, CAST(first - DATE '1970-01-01' AS INT) AS first_step, CAST(last - first AS INT) AS duration, round(CASE WHEN last > first THEN adopters / (last - first) ELSE 0 END, 9) AS velocity, farthest, round(mean_hops, 9) AS mean_hops FROM c WHERE adopters >= 3""")
def cascade_metrics(spark, sf_dir):
    """Adoptions that one origin set off: how many, from when, for how long, how fast and over how many hops of influence."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("node"), F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("step"), F.when(k % 10 != 0, k - k % 10).when(k % 100 != 0, k - k % 100).alias("parent"))
    return graph.cascades(rows, 3).withColumns({"velocity": F.round("velocity", 9), "mean_hops": F.round("mean_hops", 9)})


@query()
def eigenvector_centrality(spark, sf_dir):
    return graph.eigenvector_centrality(_follow(spark, sf_dir))


@query()
def transit_journeys(spark, sf_dir):
    """Suppliers as stops, their nations as routes: a timetable made of the trade tables, asked from every stop.

    A leg takes a minute and a second for each unit that the balances of its two suppliers differ by.
    """
    from pyspark.sql import Window

    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), (F.col("s_nationkey") % 5).cast("string")).alias("route"), F.lit(0).alias("pattern"), F.col("s_suppkey").cast("int").alias("seq"), F.col("s_suppkey").alias("stop"), F.lit(600).alias("headway"), F.col("s_acctbal").alias("balance"))
    w = Window.partitionBy("route").orderBy("seq")
    legs = s.select("route", F.lag("stop").over(w).alias("u"), F.col("stop").alias("v"), (60 + F.abs(F.col("balance") - F.lag("balance").over(w))).cast("int").alias("seconds"))
    walk = s.select(F.col("stop").alias("u"), (F.col("stop") + 1).alias("v"), F.lit(300).alias("seconds")).join(s.select(F.col("stop").alias("v")), "v", "left_semi")
    return transit.journeys(s.drop("balance"), legs.filter("u IS NOT NULL"), walk.select("u", "v", "seconds"), s.select(F.col("stop").alias("origin"), "stop"))


def _routes(spark, sf_dir) -> DataFrame:
    """Suppliers as stops of routes of forty stops at most; a route keeps to one nation and one thousand of keys."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.col("s_nationkey").cast("string"), F.lit(":"), F.floor(F.col("s_suppkey") / 1000).cast("string"))
    return s.select(name.alias("route"), F.lit(0).alias("pattern"), F.col("s_suppkey").cast("int").alias("seq"), F.col("s_suppkey").alias("stop"), F.lit(600).alias("headway"))


@query()
def transit_journey_legs(spark, sf_dir):
    """Journeys with their legs from the first stop of every nation; ways on foot lead to the next stop and back."""
    from pyspark.sql import Window

    s = _routes(spark, sf_dir)
    w = Window.partitionBy("route").orderBy("seq")
    legs = s.select("route", F.lag("stop").over(w).alias("u"), F.col("stop").alias("v"), (60 + F.col("stop") * 37 % 400).cast("int").alias("seconds")).filter("u IS NOT NULL")
    on = s.select(F.col("stop").alias("u"), F.explode(F.array(F.col("stop") + 1, F.col("stop") - 1)).alias("v"), F.lit(300).alias("seconds"))
    walk = on.join(s.select(F.col("stop").alias("v")), "v", "left_semi").select("u", "v", "seconds")
    origins = s.groupBy(F.split_part("route", F.lit(":"), F.lit(1)).alias("origin")).agg(F.min("stop").alias("stop"))
    return transit.journey_legs(s, legs, walk, origins)


@query("""WITH p AS (SELECT s_nationkey || ':' || s_suppkey // 1000 AS route, s_suppkey AS seq, s_suppkey AS stop FROM supplier), q AS (SELECT c_custkey AS pair, c_custkey % (SELECT count(*) FROM supplier) AS origin, c_custkey * 7 % (SELECT count(*) FROM supplier) AS destination FROM customer)
    SELECT pair, a.route, split_part(a.route, ':', 2) AS name, CAST(b.seq - a.seq AS INTEGER) AS stops FROM q JOIN p a ON a.stop = origin JOIN p b ON b.stop = destination AND b.route = a.route WHERE a.seq < b.seq""")
def direct_routes(spark, sf_dir):
    """Routes that serve two stops without a change."""
    p = _routes(spark, sf_dir)
    n, k = p.agg(F.count("*").alias("n")), F.col("c_custkey")
    # One row, the number of stops.
    pairs = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).select(k.alias("pair"), (k % F.col("n")).alias("origin"), (k * 7 % F.col("n")).alias("destination"))
    return transit.direct_routes(pairs, p)


@query()
def alternative_paths(spark, sf_dir):
    """Three ways at most from the first to the last user of each kind of event, none much dearer than the best."""
    e = _follow(spark, sf_dir)
    ends = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("pair")).agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("origin"), F.max_by("user_id", F.struct("ts", "event_id")).alias("target"))
    return paths.alternative_paths(e.withColumn("cost", 1.0 + (F.col("src") * 31 + F.col("dst") * 17) % 23), ends)


@query()
def betweenness_centrality(spark, sf_dir):
    return paths.betweenness(_follow(spark, sf_dir))


@query()
def closeness_centrality(spark, sf_dir):
    return paths.closeness(_follow(spark, sf_dir))
