"""Step logs, journeys, adoption, charging and policies over time: what the study records of a run, from the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import records, text
from corvane.plans.registry import query, table

_LOG = "l AS (SELECT user_id AS agent, CAST(ts AS DATE) - DATE '2024-01-01' AS step, event_type AS mode, value, event_id, ts FROM events)"


def _log(spark, sf_dir) -> DataFrame:
    """Events as a step log: the agent, the day as a step, its mode and a value."""
    step = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("agent"), step.alias("step"), F.col("event_type").alias("mode"), "value", "event_id", "ts")


@query(f"WITH {_LOG} SELECT step, agent, mode, event_id FROM l WHERE step BETWEEN 3 AND 9")
def journeys_in_range(spark, sf_dir):
    """Journeys of the steps 3 to 9, both included."""
    return records.journeys(_log(spark, sf_dir), first=3, last=9).select("step", "agent", "mode", "event_id")


@query(f"WITH {_LOG} SELECT agent, count(*) AS n, round(sum(value), 4) AS value FROM l WHERE mode = 'purchase' AND step = 5 GROUP BY 1")
def journeys_of_a_mode(spark, sf_dir):
    """Journeys of one mode at one step, by agent."""
    rows = records.journeys(_log(spark, sf_dir), mode="purchase", first=5, last=5)
    return rows.groupBy("agent").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(f"WITH {_LOG} SELECT agent, string_agg(mode, '>' ORDER BY step, ts, event_id) AS path, count(*) AS n FROM l GROUP BY 1")
def agent_trajectories(spark, sf_dir):
    """The modes of each agent in the order of time."""
    return records.trajectories(_log(spark, sf_dir), "agent", ["step", "ts", "event_id"], "mode").select("agent", F.array_join("path", ">").alias("path"), F.size("path").cast("long").alias("n"))


@query(f"""WITH {_LOG}, x AS (SELECT *, CASE WHEN value < 20 THEN -999 ELSE -3.19 + agent % 50 / 1000.0 END AS lon FROM l) SELECT mode, count(*) FILTER (lon BETWEEN -180 AND 180) AS placed, count(*) FILTER (lon NOT BETWEEN -180 AND 180) AS lost FROM x GROUP BY 1""")
def placed_agents(spark, sf_dir):
    """Rows of the log with a place that can be, and without, by mode."""
    from corvane.functions.geo import is_lonlat

    rows = _log(spark, sf_dir).withColumn("lon", F.when(F.col("value") < 20, -999.0).otherwise(-3.19 + F.col("agent") % 50 / 1000.0))
    ok = is_lonlat(F.col("lon"), F.lit(55.9))
    return rows.groupBy("mode").agg(F.count_if(ok).alias("placed"), F.count_if(~ok).alias("lost"))


@query(f"""WITH {_LOG}, i AS (SELECT mode, agent, agent % 3 > 0 AS influenced FROM l) SELECT mode, count(*) FILTER (influenced) AS influenced, count(*) AS n, round(count(*) FILTER (influenced) / count(*), 9) AS rate FROM i GROUP BY 1""")
def social_influence(spark, sf_dir):
    """Journeys that peers had a part in, by mode; here agents whose number does not divide by 3 have one."""
    rows = _log(spark, sf_dir).withColumn("influenced_by", F.when(F.col("agent") % 3 > 0, F.array((F.col("agent") - 1))).otherwise(F.array().cast("array<bigint>")))
    return records.influence(rows, "mode", "influenced_by").withColumn("rate", F.round("rate", 9))


@query(f"""WITH {_LOG}, s AS (SELECT step, count(*) AS n, 100.0 * count(*) FILTER (mode IN ('purchase', 'signup')) / count(*) AS ev_share, avg(value) FILTER (value > 0) AS mean_value FROM l GROUP BY 1)
    SELECT CAST(step AS INT) AS step, n, round(ev_share, 6) AS ev_share, round(mean_value, 6) AS mean_value FROM s WHERE step % 5 = 0""")
def policy_snapshots(spark, sf_dir):
    """Every fifth step: how many, the share of some modes in per cent and the mean of what is not nothing."""
    return records.snapshots(_log(spark, sf_dir), "step", "mode", ["purchase", "signup"], "value", 5).select("step", "n", F.round("share", 6).alias("ev_share"), F.round("mean", 6).alias("mean_value"))


@query(f"""WITH {_LOG}, a AS (SELECT mode, count(*) FILTER (agent % 2 = 0) AS b, count(*) FILTER (agent % 2 = 1) AS i, avg(value) FILTER (agent % 2 = 0) AS bv, avg(value) FILTER (agent % 2 = 1) AS iv FROM l GROUP BY 1)
    SELECT mode, i - b AS change, round(100.0 * (i - b) / greatest(b, 1), 6) AS change_pct, round(iv - bv, 6) AS performance, abs(100.0 * i / sum(i) OVER () - 100.0 * b / sum(b) OVER ()) > 2 AS significant FROM a""")
def scenario_deltas(spark, sf_dir):
    """Agents of odd number as a scenario against those of even number: counts, mean values and shares that moved by more than 2 points."""
    out = records.scenario_deltas(_log(spark, sf_dir).withColumn("scenario", F.when(F.col("agent") % 2 == 0, "base").otherwise("changed")), "scenario", "base", "mode", "value")
    return out.select("mode", "change", F.round("change_pct", 6).alias("change_pct"), F.round("performance", 6).alias("performance"), "significant")


@query(f"""WITH {_LOG}, d AS (SELECT mode, step, count(*) AS n FROM l GROUP BY 1, 2) SELECT mode, step, n - coalesce(lag(n) OVER w, n) AS acceleration FROM d WINDOW w AS (PARTITION BY mode ORDER BY step)""")
def flow_acceleration(spark, sf_dir):
    """How much more of a mode a step has than the one before, 0 at first."""
    rows = _log(spark, sf_dir).groupBy("mode", "step").agg(F.count("*").alias("n"))
    return rows.select("mode", F.col("step").cast("long").alias("step"), records.acceleration("n", Window.partitionBy("mode").orderBy("step")).alias("acceleration"))


@query(f"""WITH {_LOG}, d AS (SELECT mode, step, count(*) AS n FROM l GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY step) - 1 AS i, count(*) OVER (PARTITION BY mode) AS c, last_value(n) OVER (PARTITION BY mode ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM d)
    SELECT mode, z - n AS growth FROM r WHERE i = CAST(floor(0.8 * c) AS BIGINT)""")
def late_growth(spark, sf_dir):
    """The last value of each mode less that at four fifths of the way."""
    rows = _log(spark, sf_dir).groupBy("mode", "step").agg(F.count("*").alias("n"))
    return records.late_growth(rows, "mode", "step", "n").select("mode", "growth")


@query(f"""WITH {_LOG}, d AS (SELECT mode, step, CAST(count(*) AS DOUBLE) AS n FROM l GROUP BY 1, 2), w AS (SELECT mode, step, row_number() OVER (PARTITION BY mode ORDER BY step) - 1 AS i, count(*) OVER a AS cb, regr_slope(n, step) OVER b AS sb, count(*) OVER b AS nb, stddev_pop(n) OVER b AS db, regr_slope(n, step) OVER a AS sa, count(*) OVER a AS na, stddev_pop(n) OVER a AS da FROM d
      WINDOW b AS (PARTITION BY mode ORDER BY step ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY mode ORDER BY step ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING))
    SELECT mode, step, round(CASE WHEN nb < 2 OR na < 2 OR db + da = 0 THEN 1 ELSE greatest(0.001, 1 / (1 + 10 * abs(sa - sb) / (db + da))) END, 6) AS p FROM w""")
def slope_significance(spark, sf_dir):
    """How far the ten steps from each one on differ in slope from the ten before it."""
    rows = _log(spark, sf_dir).groupBy("mode", "step").agg(F.count("*").cast("double").alias("n"))
    return records.slope_significance(rows, "mode", "step", "n").select("mode", F.col("step").cast("long").alias("step"), F.round("p", 6).alias("p"))


@query(f"""WITH {_LOG}, t AS (SELECT mode, step, agent % 3 > 0 AS influenced, CASE WHEN agent % 5 = 0 THEN 'unknown' WHEN agent % 2 = 0 THEN 'cost' ELSE 'time' END AS reason, event_id FROM l), p AS (SELECT DISTINCT mode, unnest([15, 40, 80]) AS turn FROM l),
    j AS (SELECT p.mode, p.turn, count(*) AS n, count(*) FILTER (influenced) AS i, arg_min(reason, struct_pack(s := step, e := event_id)) FILTER (reason <> 'unknown') AS early FROM p JOIN t ON p.mode = t.mode AND abs(t.step - p.turn) <= 10 GROUP BY 1, 2)
    SELECT mode, turn, CASE WHEN i > n * 0.5 THEN 'social_cascade' ELSE coalesce(early, 'unknown') END AS cause FROM j""")
def tipping_triggers(spark, sf_dir):
    """What set off the turns at three steps: peers, if they had a part in most changes nearby, else the first reason that is known."""
    reason = F.when(F.col("agent") % 5 == 0, "unknown").when(F.col("agent") % 2 == 0, "cost").otherwise("time")
    changes = _log(spark, sf_dir).select("mode", "step", (F.col("agent") % 3 > 0).alias("influenced"), reason.alias("reason"), "event_id")
    points = changes.select("mode").distinct().select("mode", F.explode(F.array(*(F.lit(x) for x in (15, 40, 80)))).alias("turn"))
    return records.triggers(points, changes, "mode", "turn", "step", 10)


@query(f"""WITH {_LOG}, s AS (SELECT step, count(*) AS occupied, 200 AS ports, count(*) % 7 AS queued FROM l GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY step DESC) AS k FROM s)
    SELECT CASE WHEN avg(occupied / ports) > 0.7 THEN 'increasing' ELSE 'stable' END AS trend, round(avg(occupied / ports), 6) AS utilisation, round(avg(queued), 6) AS queue, count(*) AS snapshots FROM r WHERE k <= 100""")
def availability_trend(spark, sf_dir):
    """Use of chargers over the last 100 snapshots."""
    rows = _log(spark, sf_dir).groupBy("step").agg(F.count("*").alias("occupied"), F.lit(200).alias("ports"), (F.count("*") % 7).alias("queued"))
    return records.availability_trend(rows, "step").select("trend", F.round("utilisation", 6).alias("utilisation"), F.round("queue", 6).alias("queue"), "snapshots")


@query("""SELECT s_nationkey AS zone, count(*) AS stations, CAST(sum(1 + s_suppkey % 4) AS BIGINT) AS ports, CAST(sum(least(1 + s_suppkey % 4, s_suppkey % 6)) AS BIGINT) AS occupied, round(sum(least(1 + s_suppkey % 4, s_suppkey % 6)) / sum(1 + s_suppkey % 4), 6) AS utilisation,
    var_pop(least(1 + s_suppkey % 4, s_suppkey % 6) / (1 + s_suppkey % 4)) < 0.05 AS balanced, CAST(sum(greatest(0, s_suppkey % 6 - 1 - s_suppkey % 4)) AS BIGINT) AS queued, round(avg(CASE WHEN s_suppkey % 6 < 1 + s_suppkey % 4 THEN 0 ELSE greatest(0, s_suppkey % 6 - 1 - s_suppkey % 4) * 30.0 / (1 + s_suppkey % 4) END), 6) AS wait FROM supplier GROUP BY 1""")
def infrastructure_metrics(spark, sf_dir):
    """Ports, their use, balance, queues and waiting time of stations by zone."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("zone"), (1 + k % 4).alias("ports"), F.least(1 + k % 4, k % 6).alias("occupied"), F.greatest(F.lit(0), k % 6 - 1 - k % 4).alias("queued"))
    return records.infrastructure(rows, "zone", 30.0).withColumns({"utilisation": F.round("utilisation", 6), "wait": F.round("wait", 6)})


@query("""WITH s AS (SELECT c_mktsegment AS station, sum(abs(c_acctbal)) AS revenue, count(*) * 5000.0 AS capital FROM customer GROUP BY 1) SELECT station, round(revenue - capital - capital * 0.1, 4) AS profit, round((revenue - capital * 0.1) / capital * 100, 6) AS roi_pct,
    round(CASE WHEN revenue - capital * 0.1 > 0 THEN capital / (revenue - capital * 0.1) END, 6) AS payback FROM s""")
def cost_recovery(spark, sf_dir):
    """What charging stations earn on what they cost, with a tenth of it a period to run."""
    s = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("station")).agg(F.sum(F.abs("c_acctbal")).alias("revenue"), (F.count("*") * 5000.0).alias("capital"))
    return records.cost_recovery(s).select("station", F.round("profit", 4).alias("profit"), F.round("roi_pct", 6).alias("roi_pct"), F.round("payback", 6).alias("payback"))


@query("""SELECT o_orderpriority AS persona, round(stddev_samp(o_orderkey % 61 / 60.0), 6) AS spread, count(*) AS n FROM orders GROUP BY 1""")
def desire_spread(spark, sf_dir):
    """Spread of what agents want, by persona."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("persona")).agg(F.round(F.stddev_samp(F.col("o_orderkey") % 61 / 60.0), 6).alias("spread"), F.count("*").alias("n"))


_FACTOR = "CASE WHEN h % 24 >= 20 THEN 0.75 WHEN h % 24 >= 17 THEN 1.75 WHEN h % 24 >= 9 THEN 1.0 WHEN h % 24 >= 6 THEN 1.75 ELSE 0.5 END"


@query(f"""WITH s AS (SELECT event_id, value AS kwh, hour(ts) AS start, 0.5 + event_id % 7 / 2.0 AS hours, event_type FROM events), e AS (SELECT *, unnest(range(CAST(ceil(hours) AS BIGINT))) AS k FROM s), p AS (SELECT event_type, kwh / hours * least(1.0, hours - k) * 0.16 * (SELECT {_FACTOR} FROM (SELECT start + k AS h)) AS cost FROM e)
    SELECT event_type, round(sum(cost), 4) AS cost FROM p GROUP BY 1""")
def charging_costs(spark, sf_dir):
    """Cost of charging sessions over the hours of the tariff, by kind."""
    from corvane.functions.cost import charging_cost

    s = table(spark, sf_dir, "events").select("event_type", charging_cost(F.col("value"), F.hour("ts"), 0.5 + F.col("event_id") % 7 / 2.0, 0.16).alias("cost"))
    return s.groupBy("event_type").agg(F.round(F.sum("cost"), 4).alias("cost"))


@query("""SELECT event_type, count(*) FILTER (minute(ts) = 0 AND second(ts) = 0) AS hourly, count(*) FILTER (day(ts) = 1) AS first_days, CAST(sum(CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', ts) / 60 / 15) AS BIGINT) % 1000) AS BIGINT) AS steps FROM events GROUP BY 1""")
def clock_steps(spark, sf_dir):
    """Times as steps of a quarter of an hour, and how many fall on the hour."""
    from corvane.functions.clock import step_of, triggers

    e = table(spark, sf_dir, "events")
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    step = step_of(F.col("ts"), start, 15)
    return e.groupBy("event_type").agg(F.count_if(triggers(F.col("ts"), "hourly")).alias("hourly"), F.count_if(F.day("ts") == 1).alias("first_days"), F.sum(step % 1000).alias("steps"))


@query("""SELECT key, CASE WHEN t LIKE '%ev%' OR t LIKE '%electric%' OR t LIKE '%battery%' THEN 1 ELSE 0 END AS about_ev, count(*) AS n FROM (SELECT lower(text) AS t, CASE WHEN regexp_matches(lower(text), 'ev|electric|battery') THEN 'ev_is_viable' WHEN regexp_matches(lower(text), 'transit|public transport|bus|train') THEN 'public_transport_reliable'
    WHEN regexp_matches(lower(text), 'congestion|traffic|jam') THEN 'congestion_likely' WHEN regexp_matches(lower(text), 'cost|afford|price|expensive') THEN 'cost_pressure_high' WHEN regexp_matches(lower(text), 'climate|carbon|emission|environment') THEN 'climate_urgency'
    WHEN regexp_matches(lower(text), 'range|anxiety|mileage') THEN 'range_anxiety' WHEN regexp_matches(lower(text), 'charger|charging|infrastructure') THEN 'charger_availability' END AS key FROM conversations) GROUP BY 1, 2""")
def belief_keys(spark, sf_dir):
    """What turns of conversations are about."""
    rows = table(spark, sf_dir, "conversations").select(text.belief_key(F.col("text")).alias("key"))
    return rows.groupBy("key", F.coalesce(F.col("key") == "ev_is_viable", F.lit(False)).cast("int").alias("about_ev")).agg(F.count("*").alias("n"))


@query("""SELECT min(c_custkey % 300 / 1000.0 - 3.35) AS west, min(c_custkey * 7 % 150 / 1000.0 + 55.85) AS south, max(c_custkey % 300 / 1000.0 - 3.35) AS east, max(c_custkey * 7 % 150 / 1000.0 + 55.85) AS north FROM customer""")
def bounds(spark, sf_dir):
    """The box around all customers."""
    from corvane.functions.geo import bounds_of

    k = F.col("c_custkey")
    return bounds_of(table(spark, sf_dir, "customer").select((k % 300 / 1000.0 - 3.35).alias("lon"), (k * 7 % 150 / 1000.0 + 55.85).alias("lat")))


@query("""WITH p AS (SELECT s_suppkey, s_suppkey % 90 - 45.0 AS lon1, s_suppkey % 50 - 10.0 AS lat1, s_suppkey % 70 - 30.0 AS lon2, s_suppkey % 30 + 20.0 AS lat2 FROM supplier)
    SELECT s_suppkey, round(lon1 + (lon2 - lon1) * 0.25, 9) AS lon, round(lat1 + (lat2 - lat1) * 0.25, 9) AS lat, CAST(greatest(1, floor(sqrt((lon2 - lon1) ** 2 + (lat2 - lat1) ** 2) / 0.5)) + 1 AS BIGINT) AS points FROM p""")
def interpolated_points(spark, sf_dir):
    """A quarter of the way between two points, and the points that a dense line has."""
    from corvane.functions.geo import along, densified

    k = F.col("s_suppkey")
    a, b = F.struct((k % 90 - 45.0).alias("lon"), (k % 50 - 10.0).alias("lat")), F.struct((k % 70 - 30.0).alias("lon"), (k % 30 + 20.0).alias("lat"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", along(a, b, F.lit(0.25)).alias("p"), F.size(densified(a, b, 0.5)).cast("long").alias("points"))
    return rows.select("s_suppkey", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"), "points")
