"""Turns of conversations as stories, orders as jobs, errors as congestion."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import narrative as n
from corvane.plans.registry import query, table


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"


_WISHES = ", ".join(f"CASE WHEN told AND {_any(words)} THEN {strength}::DOUBLE ELSE 0.5::DOUBLE END AS {name}" for name, (words, strength) in n.WORDS.items())


@query(f"""WITH s AS (SELECT role, lower(text) AS t, coalesce(len(text) > 0, false) AS told, turn % 3 = 0 AS freight FROM conversations), w AS (SELECT *, {_WISHES} FROM s),
    x AS (SELECT *, CASE WHEN told AND freight THEN greatest(reliability, 0.8) ELSE reliability END AS r2, CASE WHEN told AND freight THEN greatest(cost, 0.7) ELSE cost END AS c2, CASE WHEN told AND freight AND {_any(n.COMPLIANCE_WORDS)} THEN 0.9::DOUBLE END AS law FROM w)
    SELECT role, eco, "time", c2 AS cost, comfort, safety, r2 AS reliability, law AS compliance, CASE WHEN eco > 0.7 THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS walk, CASE WHEN eco > 0.7 THEN 0.2::DOUBLE ELSE 0.5::DOUBLE END AS car_petrol, count(*) AS stories FROM x GROUP BY ALL""")
def narrative_wishes(spark, sf_dir):
    """Wishes that stories tell, and how much walking and driving are liked then."""
    s = table(spark, sf_dir, "conversations").select("role", n.wishes(F.col("text"), F.when(F.col("turn") % 3 == 0, "freight")).alias("w"))
    s = s.withColumn("l", n.likings(F.col("w")))
    kinds = ("eco", "time", "cost", "comfort", "safety", "reliability", "compliance")
    out = s.select("role", *(F.try_element_at("w", F.lit(k)).alias(k) for k in kinds), *(F.element_at("l", m).alias(m) for m in ("walk", "car_petrol")))
    return out.groupBy(*out.columns).agg(F.count("*").alias("stories"))


@query("""WITH j AS (SELECT o_orderkey AS job, ['freight', 'passenger_commute', 'taxi_service', NULL][CAST(o_custkey % 4 + 1 AS BIGINT)] AS kind, ['none', 'high', 'low', NULL][CAST(o_orderkey % 4 + 1 AS BIGINT)] AS flexibility, o_orderkey % 3 > 0 AS repeats, ['5/week', 'weekly', '2/month', NULL][CAST(o_orderkey // 4 % 4 + 1 AS BIGINT)] AS frequency, o_orderkey % 5 AS stops, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' END AS urgency FROM orders)
    SELECT coalesce(flexibility IN ('none', 'low'), false) AS schedule_fixed, CASE WHEN repeats AND coalesce(frequency, '5/week') = '5/week' THEN 'daily' WHEN repeats AND frequency = 'weekly' THEN 'weekly' END AS recurring, CASE WHEN stops > 1 THEN 'multi_stop' ELSE 'point_to_point' END AS plan_type,
    CASE WHEN urgency IS NOT NULL THEN 'minimize_time' WHEN kind IN ('freight', 'taxi_service') THEN 'minimize_cost' WHEN kind = 'passenger_commute' THEN 'minimize_time' END AS objective, coalesce(urgency = 'critical', false) AS critical, coalesce(urgency = 'high', false) AS time_sensitive, count(*) AS jobs FROM j GROUP BY ALL""")
def job_plans(spark, sf_dir):
    """Plans behind jobs, and how many there are of each."""
    k, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    pick = lambda names, key: F.get(F.array(*(F.lit(x).cast("string") for x in names)), (key % len(names)).cast("int"))
    jobs = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("job "), k.cast("string")).alias("job"), pick(("freight", "passenger_commute", "taxi_service", None), c).alias("job_type"), pick(("none", "high", "low", None), k).alias("flexibility"), (k % 3 > 0).alias("repeats"), pick(("5/week", "weekly", "2/month", None), F.floor(k / 4)).alias("frequency"),
        (k % 5).alias("stops"), F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").alias("urgency"),
    )
    return n.plans(jobs).groupBy("schedule_fixed", "recurring", "plan_type", "objective", "critical", "time_sensitive").agg(F.count("*").alias("jobs"))


@query("""SELECT user_id % 20 AS edge, count(*) AS events, round(avg(value), 6) AS mean, round(median(value), 6) AS median, max(value) AS peak, CAST(sum(event_id % 7) AS BIGINT) AS affected, round(avg(event_id % 7), 6) AS mean_affected FROM events WHERE event_type = 'error' GROUP BY 1""")
def congestion_summary(spark, sf_dir):
    """Delays and who they hit, by place."""
    e = table(spark, sf_dir, "events").filter("event_type = 'error'").select((F.col("user_id") % 20).alias("edge"), F.col("value").alias("delay"), (F.col("event_id") % 7).alias("affected"))
    out = n.congestion_summary(e, "edge")
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "median", "mean_affected")})
