"""Events as messages: channels, and which users are near when something happens."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans.registry import query, table
from corvane.streaming import state


@query("""SELECT 'rtd:events:' || event_type || CASE event_id % 5 WHEN 3 THEN ':high' WHEN 4 THEN ':critical' ELSE '' END AS channel, count(*) AS events, count(DISTINCT CAST(ts AS DATE)) AS batches, min(ts) AS first, max(ts) AS last FROM events GROUP BY 1""")
def event_channels(spark, sf_dir):
    """What went over each channel, with a day as a batch."""
    e = table(spark, sf_dir, "events")
    named = e.select(state.channel(F.col("event_type"), F.col("event_id") % 5).alias("channel"), F.to_date("ts").alias("batch"), "ts")
    return state.bus_statistics(named)


_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin((radians(lat2) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon)) / 2), 2))))"


@query(f"""WITH s AS (SELECT user_id AS agent, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, event_id * 37 % 2000 / 100.0::DOUBLE - 10 AS lon, event_id * 53 % 1000 / 100.0::DOUBLE + 50 AS lat, event_id % 4 * 5.0::DOUBLE AS own FROM events),
    e AS (SELECT event_id, ts, event_id * 71 % 2000 / 100.0::DOUBLE - 10 AS lon2, event_id * 29 % 1000 / 100.0::DOUBLE + 50 AS lat2, event_id % 3 * 12.0::DOUBLE AS reach FROM events WHERE event_type = 'error'), m AS (SELECT event_id, agent, {_KM} AS km, greatest(own, reach) AS far FROM e JOIN s ON since <= ts AND (until IS NULL OR ts < until))
    SELECT event_id, count(*) AS agents, min(agent) AS first, round(min(km), 6) AS nearest FROM m WHERE km <= far GROUP BY 1""")
def event_meetings(spark, sf_dir):
    """Users near enough to take notice of each error, where they are at the time."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events")
    place = F.struct(F.col("ts").alias("at"), (k * 37 % 2000 / 100.0 - 10).alias("lon"), (k * 53 % 1000 / 100.0 + 50).alias("lat"), (k % 4 * 5.0).alias("radius_km"))
    changes = e.select(F.col("user_id").alias("agent"), "ts", place.alias("here"))
    errors = e.filter("event_type = 'error'").select("event_id", "ts", (k * 71 % 2000 / 100.0 - 10).alias("lon"), (k * 29 % 1000 / 100.0 + 50).alias("lat"), (k % 3 * 12.0).alias("radius_km"))
    met = state.meetings(state.stays(changes), errors)
    return met.groupBy("event_id").agg(F.count("*").alias("agents"), F.min("agent").alias("first"), F.round(F.min("km"), 6).alias("nearest"))
