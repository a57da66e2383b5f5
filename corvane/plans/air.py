"""Air quality on the given tables: events as emissions on a grid, days as steps, each with a wind of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import air
from corvane.plans.registry import query, table

_STEP = "CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS BIGINT)"
_KERNEL = ", ".join(f"({dx}, {dy}, CAST({share!r} AS DOUBLE))" for dx, dy, share in air.kernel(2.0, 1.0))

#: Emissions of events, spread, and the level of each cell after each day.
_LEVELS = f"""RECURSIVE e AS (SELECT {_STEP} AS step, CAST(trunc(user_id * 7 % 23 - 11 + 0.25) AS BIGINT) AS x, CAST(trunc(user_id * 5 % 17 - 8 + 0.75) AS BIGINT) AS y, value * 0.4 AS pm25, value * 2.0 AS nox, value * 30.0 AS co FROM events),
    k(dx, dy, share) AS (VALUES {_KERNEL}), c AS (SELECT step, x + dx AS cell_x, y + dy AS cell_y, sum(pm25 * share) AS pm25, sum(nox * share) AS nox, sum(co * share) AS co, count(*) AS measured FROM e, k GROUP BY 1, 2, 3),
    d AS (SELECT cell_x, cell_y, min(step) AS first FROM c GROUP BY 1, 2), w AS (SELECT step, 1.0 - (0.1 + 0.01 * (step * 13 % 60)) AS keep FROM (SELECT unnest(range((SELECT max(step) + 1 FROM e))) AS step)),
    l AS (SELECT d.cell_x, d.cell_y, d.first AS step, c.pm25 * keep AS pm25, c.nox * keep AS nox, c.co * keep AS co, c.pm25 * keep AS pm25_total, c.nox * keep AS nox_total, c.co * keep AS co_total FROM d JOIN c ON d.cell_x = c.cell_x AND d.cell_y = c.cell_y AND d.first = c.step JOIN w ON w.step = d.first
    UNION ALL SELECT n.*, pm25_total + pm25, nox_total + nox, co_total + co FROM (SELECT l.cell_x, l.cell_y, l.step + 1 AS step, (l.pm25 + coalesce(c.pm25, 0)) * keep AS pm25, (l.nox + coalesce(c.nox, 0)) * keep AS nox, (l.co + coalesce(c.co, 0)) * keep AS co, pm25_total AS a, nox_total AS b, co_total AS f
      FROM l JOIN w ON w.step = l.step + 1 LEFT JOIN c ON c.step = l.step + 1 AND c.cell_x = l.cell_x AND c.cell_y = l.cell_y) n)"""
_LEVELS = _LEVELS.replace("SELECT n.*, pm25_total + pm25, nox_total + nox, co_total + co FROM", "SELECT cell_x, cell_y, step, pm25, nox, co, a + pm25, b + nox, f + co FROM")


def _emissions(spark, sf_dir) -> DataFrame:
    u, v = F.col("user_id"), F.col("value")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "events").select(day.alias("step"), (u * 7 % 23 - 11 + 0.25).alias("lon"), (u * 5 % 17 - 8 + 0.75).alias("lat"), (v * 0.4).alias("pm25"), (v * 2.0).alias("nox"), (v * 30.0).alias("co"))


def _wind(emissions: DataFrame) -> DataFrame:
    days = emissions.agg(F.explode(F.sequence(F.lit(0).cast("long"), F.max("step"))).alias("step"))
    return days.select("step", (F.col("step") * 13 % 60).cast("double").alias("kmh"))


def _levels(spark, sf_dir) -> DataFrame:
    e = _emissions(spark, sf_dir)
    return air.levels(air.spread(e), _wind(e))


def _last(at: DataFrame) -> DataFrame:
    return at.join(F.broadcast(at.agg(F.max("step").alias("step"))), "step")


@query(f"WITH {_LEVELS} SELECT step, cell_x, cell_y, round(pm25, 6) AS pm25, round(nox, 6) AS nox, round(co, 5) AS co, round(pm25_total, 5) AS pm25_total, round(nox_total, 5) AS nox_total, round(co_total, 4) AS co_total FROM l")
def air_levels(spark, sf_dir):
    """Three pollutants in every cell after every day."""
    at = _levels(spark, sf_dir)
    digits = {"pm25": 6, "nox": 6, "co": 5, "pm25_total": 5, "nox_total": 5, "co_total": 4}
    return at.select("step", "cell_x", "cell_y", *(F.round(c, n).alias(c) for c, n in digits.items()))


@query(f"""WITH {_LEVELS}, x AS (SELECT step, 'pm25' AS pollutant, pm25 AS concentration, CAST(15.0 AS DOUBLE) AS "limit" FROM l UNION ALL SELECT step, 'nox', nox, 200.0 FROM l) SELECT step, pollutant, count(*) AS cells, round(max(concentration / "limit"), 6) AS worst, round(avg(concentration / "limit"), 6) AS mean FROM x WHERE concentration > "limit" GROUP BY 1, 2""")
def air_exceedances(spark, sf_dir):
    """Cells over the limits by day, and how far."""
    over = air.exceedances(_levels(spark, sf_dir), "hourly")
    return over.groupBy("step", "pollutant").agg(F.count("*").alias("cells"), F.round(F.max("severity"), 6).alias("worst"), F.round(F.avg("severity"), 6).alias("mean"))


@query(f"WITH {_LEVELS} SELECT cell_x, cell_y, round(nox, 6) AS concentration, CAST(300.0 AS DOUBLE) AS threshold, round(nox / 200.0, 6) AS factor FROM l WHERE step = (SELECT max(step) FROM l) AND nox > 300")
def air_quality_hotspots(spark, sf_dir):
    """Cells far over the limit at the end."""
    found = air.air_hotspots(_last(_levels(spark, sf_dir)), "nox", 1.5)
    return found.withColumns({"concentration": F.round("concentration", 6), "factor": F.round("factor", 6)})


@query(f"WITH {_LEVELS}, m AS (SELECT cell_x, cell_y, sum(measured) AS n FROM c GROUP BY 1, 2) SELECT cell_x, cell_y, round(pm25_total / n, 6) AS level FROM l JOIN m USING (cell_x, cell_y) WHERE step = (SELECT max(step) FROM l)")
def air_heatmap(spark, sf_dir):
    """Mean of what was measured in each cell."""
    e = _emissions(spark, sf_dir)
    reached = air.spread(e)
    return air.heatmap(_last(air.levels(reached, _wind(e))), reached, "pm25").withColumn("level", F.round("level", 6))


@query(f"""WITH {_LEVELS}, p AS (SELECT c_custkey % 23 - 11 AS cell_x, c_custkey % 19 - 9 AS cell_y, CAST(count(*) AS DOUBLE) AS people FROM customer GROUP BY 1, 2), t AS (SELECT * FROM l WHERE step = (SELECT max(step) FROM l)), x AS (SELECT people, coalesce(nox > 200, false) AS over, nox FROM p LEFT JOIN t USING (cell_x, cell_y)),
    s AS (SELECT sum(people) AS population, coalesce(sum(people) FILTER (over), 0) AS exposed, coalesce(sum(people * nox / 200.0) FILTER (over), 0) AS weighted FROM x) SELECT population, exposed, round(coalesce(exposed / nullif(population, 0), 0), 6) AS rate, round(weighted, 4) AS weighted, round(coalesce(weighted / nullif(exposed, 0), 0), 6) AS mean FROM s""")
def air_exposure(spark, sf_dir):
    """People who live in cells over the limit."""
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").groupBy((k % 23 - 11).alias("cell_x"), (k % 19 - 9).alias("cell_y")).agg(F.count("*").cast("double").alias("people"))
    out = air.exposure(people, _last(_levels(spark, sf_dir)), "nox")
    return out.withColumns({"rate": F.round("rate", 6), "weighted": F.round("weighted", 4), "mean": F.round("mean", 6)})
