"""Series operators on the event table: the user is the agent, the event's type the mode, the day the step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import series, stats
from corvane.plans.registry import query, table

_DAILY = """
    c AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2),
    t AS (SELECT day, sum(n) AS total FROM c GROUP BY 1),
    f AS (SELECT event_type, min(day) AS first FROM c GROUP BY 1),
    s AS (SELECT t.day, f.event_type, coalesce(c.n, 0) AS n, coalesce(c.n, 0) * 100.0 / t.total AS share
          FROM t JOIN f ON t.day >= f.first LEFT JOIN c ON c.day = t.day AND c.event_type = f.event_type)"""
_MOVES = "m AS (SELECT user_id, ts, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS from_mode, event_type AS to_mode, props FROM events)"


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def _daily(spark, sf_dir) -> DataFrame:
    return series.shares(_events(spark, sf_dir), "day", "event_type")


def _moves(spark, sf_dir) -> DataFrame:
    return series.transitions(_events(spark, sf_dir), "user_id", "ts", "event_type")


@query(f"WITH {_DAILY} SELECT day, event_type, n, round(share, 9) AS share FROM s")
def mode_share(spark, sf_dir):
    return _daily(spark, sf_dir).select("day", "event_type", "n", F.round("share", 9).alias("share"))


@query(f"WITH {_DAILY} SELECT event_type, round(arg_max(share, day), 9) AS final_share FROM s GROUP BY 1")
def final_mode_share(spark, sf_dir):
    return _daily(spark, sf_dir).groupBy("event_type").agg(F.round(F.max_by("share", "day"), 9).alias("final_share"))


@query("""SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase,
    count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS "view" FROM events GROUP BY 1""")
def adoption_history(spark, sf_dir):
    kinds = ["click", "error", "purchase", "signup", "view"]
    return _events(spark, sf_dir).groupBy("day").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0, kinds)


@query(f"WITH {_MOVES} SELECT from_mode, to_mode, count(*) AS n FROM m WHERE from_mode IS NOT NULL GROUP BY 1, 2")
def transition_matrix(spark, sf_dir):
    return _moves(spark, sf_dir).groupBy("from_mode", "to_mode").agg(F.count("*").alias("n"))


@query(f"WITH {_MOVES} SELECT from_mode, to_mode, count(*) AS n FROM m WHERE from_mode <> to_mode GROUP BY 1, 2")
def transition_flows(spark, sf_dir):
    return _moves(spark, sf_dir).filter("from_mode <> to_mode").groupBy("from_mode", "to_mode").agg(F.count("*").alias("n"))


@query(f"""WITH {_MOVES} SELECT CASE WHEN k < 33 THEN 'cost' WHEN k < 66 THEN 'time' ELSE 'social' END AS reason, count(*) AS n, count(DISTINCT user_id) AS agents
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM m) WHERE from_mode IS NOT NULL GROUP BY 1""")
def transitions_by_reason(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    reason = F.when(k < 33, "cost").when(k < 66, "time").otherwise("social")
    return _moves(spark, sf_dir).groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("agents"))


@query(f"""WITH {_MOVES}, c AS (SELECT from_mode, to_mode, count(*) AS n FROM m WHERE from_mode IS NOT NULL GROUP BY 1, 2)
    SELECT from_mode, to_mode, round(n / sum(n) OVER (PARTITION BY from_mode), 9) AS p FROM c""")
def markov_probabilities(spark, sf_dir):
    from corvane.operators.policy import transition_probabilities

    return transition_probabilities(_moves(spark, sf_dir), "from_mode", "to_mode").withColumn("p", F.round("p", 9))


@query()
def markov_stationary(spark, sf_dir):
    from corvane.operators.policy import stationary, transition_probabilities

    return stationary(transition_probabilities(_moves(spark, sf_dir), "from_mode", "to_mode"), "from_mode", "to_mode")


@query("""SELECT user_id, event_type, count(*) AS departures,
    CASE WHEN count(*) >= 2 THEN CAST(trunc((max(s) - min(s)) / (count(*) - 1)) AS INTEGER) ELSE 3600 END AS headway
    FROM (SELECT user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events WHERE hour(ts) BETWEEN 7 AND 9) GROUP BY 1, 2""")
def headways(spark, sf_dir):
    rows = _events(spark, sf_dir).filter(F.hour("ts").between(7, 9)).withColumn("s", F.unix_seconds(F.col("ts").cast("timestamp")))
    return series.headways(rows, ["user_id", "event_type"], "s")


@query(f"""WITH {_DAILY} SELECT event_type, day, round(sum(share) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10, 6) AS smooth FROM s""")
def smoothed_share(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("day")
    return _daily(spark, sf_dir).select("event_type", "day", F.round(series.smoothed("share", w), 6).alias("smooth"))


@query(f"""WITH {_DAILY} SELECT event_type, day, round(CASE WHEN b IS NULL AND a IS NULL THEN 0 WHEN b IS NULL THEN a - n WHEN a IS NULL THEN n - b ELSE (a - b) / 2 END, 6) AS slope
    FROM (SELECT *, lag(n) OVER w AS b, lead(n) OVER w AS a FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day))""")
def share_gradient(spark, sf_dir):
    w = Window.partitionBy("event_type").orderBy("day")
    return _daily(spark, sf_dir).select("event_type", "day", F.round(series.gradient("n", w), 6).alias("slope"))


@query(f"""WITH {_DAILY}, a AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS c, sum(n) OVER (w ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING) / 10.0 AS m
      FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)),
    b AS (SELECT *, CASE WHEN lag(m) OVER w IS NULL THEN lead(m) OVER w - m WHEN lead(m) OVER w IS NULL THEN m - lag(m) OVER w ELSE (lead(m) OVER w - lag(m) OVER w) / 2 END AS v
      FROM a WINDOW w AS (PARTITION BY event_type ORDER BY day)),
    d AS (SELECT *, avg(v) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS mv, coalesce(lag(m, 5) OVER w, first_value(m) OVER w) AS before, 
      coalesce(lead(m, 5) OVER w, last_value(m) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS after FROM b WINDOW w AS (PARTITION BY event_type ORDER BY day))
    SELECT event_type, day, round(mv, 6) AS mean_velocity, round(before, 6) AS before, round(after, 6) AS after FROM d WHERE c >= 20 AND i < c - 5 AND mv >= 0.5""")
def tipping_points(spark, sf_dir):
    out = series.tipping_points(_daily(spark, sf_dir), "event_type", "day", "n", velocity=0.5)
    return out.select("event_type", "day", *(F.round(c, 6).alias(c) for c in ("mean_velocity", "before", "after")))


@query(f"""WITH {_DAILY}, a AS (SELECT *, lag(n, 9) OVER w AS previous, row_number() OVER w - 1 AS i FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day))
    SELECT day, event_type, n, previous, round((n - previous) / greatest(previous, 1), 9) AS growth FROM a WHERE i > 0 AND i % 5 = 0 AND n > 1.05 * previous""")
def growth_flags(spark, sf_dir):
    out = series.growth_flags(_daily(spark, sf_dir).drop("share"), "event_type", "day", "n", back=9, factor=1.05, every=5)
    return out.withColumn("growth", F.round("growth", 9))


@query(f"""WITH {_DAILY}, a AS (SELECT day, event_type, n, CASE WHEN n < lag(n) OVER w THEN 1 ELSE 0 END AS d FROM s WINDOW w AS (PARTITION BY event_type ORDER BY day)),
    b AS (SELECT *, sum(d) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS f FROM a) SELECT day, event_type, n FROM b WHERE f = 2""")
def trend_reversals(spark, sf_dir):
    return series.trend_reversals(_daily(spark, sf_dir).drop("share"), "event_type", "day", "n", window=3)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts) AS g FROM events)
    SELECT user_id, event_type, min(ts) AS started, count(*) AS length FROM a GROUP BY user_id, event_type, g HAVING count(*) >= 3""")
def habit_streaks(spark, sf_dir):
    return series.streaks(_events(spark, sf_dir), "user_id", "ts", "event_type").filter("length >= 3")


@query("""SELECT event_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b END AS habit FROM
    (SELECT event_id, event_type AS a, lag(event_type, 1) OVER w AS b, lag(event_type, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE a = b OR a = c OR b = c""")
def recent_mode_vote(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts")
    a, b, c = F.col("event_type"), F.lag("event_type", 1).over(w), F.lag("event_type", 2).over(w)
    s = _events(spark, sf_dir).select("event_id", a.alias("a"), b.alias("b"), c.alias("c"))
    vote = F.when((F.col("a") == F.col("b")) | (F.col("a") == F.col("c")), F.col("a")).when(F.col("b") == F.col("c"), F.col("b"))
    return s.select("event_id", vote.alias("habit")).filter("habit IS NOT NULL")


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS satisfaction FROM events""")
def recent_satisfaction(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts").rowsBetween(-9, 0)
    return _events(spark, sf_dir).select("event_id", F.round(F.avg("value").over(w), 6).alias("satisfaction"))


_FORECAST = "p AS (SELECT user_id, ts, value AS actual, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS predicted FROM events)"


def _forecast(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    return _events(spark, sf_dir).select("user_id", "ts", F.col("value").alias("actual"), F.lag("value").over(w).alias("predicted")).filter("predicted IS NOT NULL")


@query(f"""WITH {_FORECAST} SELECT user_id, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) ** 2)), 6) AS rmse, round(avg(actual - predicted), 6) AS bias,
    round(CASE WHEN var_pop(actual) * count(*) <= 1e-10 THEN 0 ELSE greatest(-1, least(1, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)))) END, 6) AS r2
    FROM p WHERE predicted IS NOT NULL GROUP BY 1""")
def forecast_errors(spark, sf_dir):
    out = series.forecast_errors(_forecast(spark, sf_dir), "user_id", "actual", "predicted")
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "bias", "r2")))


@query(f"""WITH {_FORECAST}, e AS (SELECT user_id, ts, avg(abs(actual - predicted)) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS m, row_number() OVER w AS i
    FROM p WHERE predicted IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT user_id, ts, round(m, 6) AS rolling_mae FROM e WHERE i >= 20""")
def rolling_error(spark, sf_dir):
    return series.rolling_error(_forecast(spark, sf_dir), "user_id", "ts", "actual", "predicted").withColumn("rolling_mae", F.round("rolling_mae", 6))


@query("""WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY user_id) // 3 AS t FROM events)
    SELECT user_id, round(avg(value) FILTER (i < t), 6) AS early, round(avg(value) FILTER (i >= t AND i < 2 * t), 6) AS middle, round(avg(value) FILTER (i >= 2 * t), 6) AS late FROM a GROUP BY 1""")
def drift_thirds(spark, sf_dir):
    out = series.thirds(_events(spark, sf_dir), "user_id", "ts", "value")
    return out.select("user_id", *(F.round(c, 6).alias(c) for c in ("early", "middle", "late")))


@query("""SELECT user_id, ts, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) WHERE value > 50 AND coalesce(p, 50) <= 50""")
def threshold_crossings(spark, sf_dir):
    return series.crossings(_events(spark, sf_dir), "user_id", "ts", "value", 50.0).select("user_id", "ts", "value")


@query("""WITH a AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 21600000000 THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    b AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a)
    SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM b GROUP BY user_id, s""")
def sessions(spark, sf_dir):
    return series.sessions(_events(spark, sf_dir), "user_id", "ts", 21_600)


@query("""WITH a AS (SELECT CAST(ts AS DATE) AS day, event_type, user_id % 2 AS half FROM events), c AS (SELECT day, event_type, count(*) FILTER (half = 0) AS x, count(*) FILTER (half = 1) AS y FROM a GROUP BY 1, 2)
    SELECT event_type, coalesce(min(day) FILTER (abs(x - y) > 10), DATE '1970-01-01') AS diverges, max(abs(x - y)) AS most FROM c GROUP BY 1""")
def divergence_step(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("half", F.col("user_id") % 2)
    c = e.groupBy("day", "event_type").agg(F.count_if(F.col("half") == 0).alias("x"), F.count_if(F.col("half") == 1).alias("y"))
    gap = F.abs(F.col("x") - F.col("y"))
    return c.groupBy("event_type").agg(F.coalesce(F.min(F.when(gap > 10, F.col("day"))), F.lit("1970-01-01").cast("date")).alias("diverges"), F.max(gap).alias("most"))


@query("""WITH a AS (SELECT event_type, count(*) * 100.0 / sum(count(*)) OVER () AS s FROM events WHERE user_id % 2 = 0 AND event_type <> 'view' GROUP BY 1),
    b AS (SELECT event_type, count(*) * 100.0 / sum(count(*)) OVER () AS s FROM events WHERE user_id % 2 = 1 AND event_type <> 'error' GROUP BY 1)
    SELECT event_type, round(coalesce(a.s, 0), 6) AS before, round(coalesce(b.s, 0), 6) AS after, round(coalesce(b.s, 0) - coalesce(a.s, 0), 6) AS change
    FROM a FULL JOIN b USING (event_type) WHERE abs(coalesce(b.s, 0) - coalesce(a.s, 0)) > 0.1""")
def policy_direct_impact(spark, sf_dir):
    from corvane.operators.joins import outer_difference

    def share(rows):
        n = rows.groupBy("event_type").agg(F.count("*").alias("n"))
        return n.crossJoin(n.agg(F.sum("n").alias("total"))).select("event_type", (F.col("n") * 100.0 / F.col("total")).alias("share"))

    e = _events(spark, sf_dir)
    out = outer_difference(share(e.filter("user_id % 2 = 0 AND event_type <> 'view'")), share(e.filter("user_id % 2 = 1 AND event_type <> 'error'")), "event_type", "share", 0.1)
    return out.select("event_type", *(F.round(c, 6).alias(c) for c in ("before", "after", "change")))


@query("""WITH a AS (SELECT event_type, value, user_id % 2 = 0 AS f FROM events),
    r AS (SELECT event_type, f, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY event_type, value) AS t FROM a),
    s AS (SELECT event_type, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(r) FILTER (f) AS r1, sum(t * t - 1.0) AS ties FROM r GROUP BY 1)
    SELECT event_type, n1, n2, round(r1 - n1 * (n1 + 1) / 2.0, 3) AS u,
      round((r1 - n1 * (n1 + 1) / 2.0 - n1 * n2 / 2.0) / sqrt(n1 * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1.0)))), 6) AS z FROM s""")
def rank_sum_test(spark, sf_dir):
    out = stats.rank_sum_test(_events(spark, sf_dir), "event_type", "value", F.col("user_id") % 2 == 0)
    return out.select("event_type", "n1", "n2", F.round("u", 3).alias("u"), F.round("z", 6).alias("z"))


@query("""WITH a AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, max(n) AS n, min(value) AS least, max(value) AS greatest, round(avg(value), 6) AS mean, max(value) FILTER (i = n // 2) AS median,
      max(value) FILTER (n <= 20 OR i <= floor(n * 0.95)) AS p95 FROM a GROUP BY 1""")
def exposure_summary(spark, sf_dir):
    return stats.exposure_summary(_events(spark, sf_dir), "event_type", "value").withColumn("mean", F.round("mean", 6))


@query("""WITH a AS (SELECT hour(ts) AS h, CAST(json_extract(props, '$.k') AS INTEGER) % 4 AS d, value FROM events), b AS (SELECT unnest(range(h, h + d + 1)) % 24 AS hour, value FROM a)
    SELECT CAST(hour AS INTEGER) AS hour, round(sum(value), 4) AS load, count(*) AS sessions FROM b GROUP BY 1""")
def charging_load_profile(spark, sf_dir):
    rows = _events(spark, sf_dir).select(F.hour("ts").alias("h"), (F.get_json_object("props", "$.k").cast("int") % 4).alias("d"), "value")
    out = stats.load_profile(rows, "h", "d", "value")
    return out.select(F.col("hour").cast("int").alias("hour"), F.round("load", 4).alias("load"), "sessions")


@query("""SELECT CASE WHEN hour(ts) >= 20 THEN 0.75 WHEN hour(ts) >= 17 THEN 1.75 WHEN hour(ts) >= 9 THEN 1.0 WHEN hour(ts) >= 6 THEN 1.75 ELSE 0.5 END AS factor, count(*) AS n,
    round(sum(value * 0.16 * CASE WHEN hour(ts) >= 20 THEN 0.75 WHEN hour(ts) >= 17 THEN 1.75 WHEN hour(ts) >= 9 THEN 1.0 WHEN hour(ts) >= 6 THEN 1.75 ELSE 0.5 END), 4) AS cost FROM events GROUP BY 1""")
def tariff_cost(spark, sf_dir):
    from corvane.functions.clock import tariff_factor

    rows = _events(spark, sf_dir).withColumn("factor", tariff_factor(F.hour("ts")).cast("double"))
    return rows.groupBy("factor").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * 0.16 * F.col("factor")), 4).alias("cost"))


@query("""WITH a AS (SELECT event_type AS edge, hour(ts) AS h, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2, 3)
    SELECT edge, h, d, round(greatest(1, least(3, (1 + 0.15 * n) * CASE WHEN h IN (7, 8, 9, 17, 18, 19) THEN 1.5 ELSE 1 END)), 9) AS factor FROM a""")
def congestion(spark, sf_dir):
    from corvane.functions.cost import congestion_factor

    n = _events(spark, sf_dir).groupBy(F.col("event_type").alias("edge"), F.hour("ts").alias("h"), F.col("day").alias("d")).agg(F.count("*").alias("n"))
    return n.select("edge", "h", "d", F.round(congestion_factor(F.col("n"), F.col("h")), 9).alias("factor"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'k' ELSE '' END AS missing FROM events""")
def payload_projection(spark, sf_dir):
    from corvane.operators.text import missing_keys

    need = {t: ["k"] for t in ("click", "error", "purchase", "signup", "view")}
    return _events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.array_join(missing_keys(F.col("props"), F.col("event_type"), need), ",").alias("missing"))


@query("""SELECT CAST(ts AS DATE) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2""")
def windowed_events(spark, sf_dir):
    from corvane.streaming.events import windowed

    rows = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed(rows).select(F.to_date("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@query("""SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100""")
def shared_agents(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.filter("event_type = 'purchase'").select("user_id").intersect(e.filter("event_type = 'signup' AND value > 100").select("user_id"))


@query("""SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE value > 250""")
def uncovered_agents(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("user_id").distinct().join(e.filter("value > 250").select("user_id"), "user_id", "left_anti")


@query("""SELECT user_id, arg_max(event_id, value) AS peak_event, max(value) AS peak, count(DISTINCT event_type) AS modes, count(*) AS trips FROM events GROUP BY 1""")
def journey_summary(spark, sf_dir):
    # Events without a value are no peak; of equal ones the least number is.
    most = F.when(F.col("value").isNotNull(), F.struct("value", -F.col("event_id")))
    return _events(spark, sf_dir).groupBy("user_id").agg(F.max_by("event_id", most).alias("peak_event"), F.max("value").alias("peak"), F.countDistinct("event_type").alias("modes"), F.count("*").alias("trips"))


@query()
def rule_firings(spark, sf_dir):
    from corvane.operators.policy import fired

    e = _events(spark, sf_dir)
    states = e.groupBy(F.col("user_id").alias("run"), F.datediff("day", F.lit("2024-01-01").cast("date")).alias("step")).agg(F.sum("value").alias("grid_load"), F.count("*").alias("agents"))
    return fired(states, [{"name": "peak", "condition": "grid_load > 100 and agents >= 2", "cooldown": 4}, {"name": "quiet", "condition": "grid_load < 20", "cooldown": 0}, {"name": "unknown", "condition": "temperature < 5"}])
