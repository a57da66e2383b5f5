"""Air quality over grid cells: emissions spread, decay with the wind of each step, and are held against limits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.geo import grid_cell
from corvane.operators.graph import kept
from corvane.operators.scans import linear_scan

POLLUTANTS = ("pm25", "nox", "co")
#: Limits of the World Health Organization in micrograms a cubic metre.
WHO_LIMITS = {("pm25", "annual"): 5.0, ("pm25", "daily"): 15.0, ("nox", "annual"): 40.0, ("nox", "hourly"): 200.0, ("co", "daily"): 4000.0}
#: Which of these limits counts for a report over a period, and for hotspots and exposure.
REPORTED = {"hourly": (("pm25", "daily"), ("nox", "hourly")), "daily": (("co", "daily"),), "annual": ()}
HOTSPOT = {"pm25": "daily", "nox": "hourly", "co": "daily"}
#: Decay in calm air, and what a km/h of wind adds.
CALM, WIND = 0.1, 0.01


def kernel(radius: float, resolution: float) -> list[tuple[int, int, float]]:
    """Cells in reach of a source (steps in x and y) and the share of a Gaussian whose deviation is half the radius."""
    reach = int(radius / resolution) + 1
    out = []
    for dx in range(-reach, reach + 1):
        for dy in range(-reach, reach + 1):
            far = math.sqrt(dx * dx + dy * dy) * resolution
            if far <= radius:
                out.append((dx, dy, math.exp(-far * far / (2 * (radius / 2) ** 2))))
    return out


def spread(emissions: DataFrame, radius: float = 2.0, resolution: float = 1.0) -> DataFrame:
    """step, cell_x, cell_y, pm25, nox, co, measured of ``emissions`` (step, lon, lat, pm25, nox, co): what reaches each cell, and from how many emissions.

    Emissions of one cell and step are added up before they spread over the ``kernel``, so a cell with a third of all
    emissions is one row. Missing amounts count as 0, emissions without a place for nothing. Cells are cut toward zero.
    """
    own = emissions.filter("lon IS NOT NULL AND lat IS NOT NULL").groupBy("step", grid_cell(F.col("lon"), resolution).alias("x"), grid_cell(F.col("lat"), resolution).alias("y"))
    own = own.agg(*(F.coalesce(F.sum(p), F.lit(0.0)).alias(p) for p in POLLUTANTS), F.count("*").alias("measured"))
    cells = F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(share).alias("share")) for dx, dy, share in kernel(radius, resolution)))
    each = own.withColumn("k", F.explode(cells))
    out = each.groupBy("step", (F.col("x") + F.col("k.dx")).alias("cell_x"), (F.col("y") + F.col("k.dy")).alias("cell_y"))
    return out.agg(*(F.sum(F.col(p) * F.col("k.share")).alias(p) for p in POLLUTANTS), F.sum("measured").alias("measured"))


def levels(spread_emissions: DataFrame, wind: DataFrame) -> DataFrame:
    """step, cell_x, cell_y, pm25, nox, co at the end of each step from a cell's first emission on, and ``*_total``, their sums since then.

    ``wind``: step, kmh (null: calm), for every step of the run, numbered without gaps. A step keeps 1 - (0.1 + kmh / 100) of what there is, what the step adds included.
    """
    steps = kept(wind.select(F.col("step").cast("long").alias("step"), (1.0 - (CALM + WIND * F.coalesce("kmh", F.lit(0.0)))).alias("keep")))
    first = spread_emissions.groupBy("cell_x", "cell_y").agg(F.min("step").cast("long").alias("first"))
    last = steps.agg(F.max("step").alias("last"))
    # One row, the last step.
    dense = first.crossJoin(F.broadcast(last)).select("cell_x", "cell_y", "first", F.explode(F.sequence("first", "last")).alias("step")).filter("step >= first")
    dense = dense.join(steps, "step").join(spread_emissions.withColumn("step", F.col("step").cast("long")).drop("measured"), ["step", "cell_x", "cell_y"], "left")
    long = dense.select("cell_x", "cell_y", "step", (F.col("step") - F.col("first")).alias("place"), "keep", F.explode(F.array(*(F.struct(F.lit(p).alias("pollutant"), (F.coalesce(p, F.lit(0.0)) * F.col("keep")).alias("added")) for p in POLLUTANTS))).alias("e"))
    long = long.select("cell_x", "cell_y", "step", "place", "keep", "e.pollutant", "e.added")
    keys = ["cell_x", "cell_y", "pollutant"]
    now = linear_scan(long, keys, "place", "keep", "added", "level")
    both = now.withColumn("total", F.sum("level").over(Window.partitionBy(*keys).orderBy("place")))
    pick = lambda p, c: F.max(F.when(F.col("pollutant") == p, F.col(c)))
    return both.groupBy("step", "cell_x", "cell_y").agg(*(pick(p, "level").alias(p) for p in POLLUTANTS), *(pick(p, "total").alias(f"{p}_total") for p in POLLUTANTS))


def exceedances(at: DataFrame, period: str = "hourly") -> DataFrame:
    """step, cell_x, cell_y, pollutant, concentration, limit, severity of each level over the limit that counts for ``period`` (hourly, daily; annual: none)."""
    parts = [F.struct(F.lit(p).alias("pollutant"), F.col(p).alias("concentration"), F.lit(WHO_LIMITS[p, of]).alias("limit")) for p, of in REPORTED[period]]
    if not parts:
        return exceedances(at, "daily").limit(0)
    out = at.select("step", "cell_x", "cell_y", F.inline(F.array(*parts))).filter("concentration > limit")
    return out.withColumn("severity", F.col("concentration") / F.col("limit"))


def air_hotspots(at: DataFrame, pollutant: str, multiple: float = 2.0) -> DataFrame:
    """cell_x, cell_y, concentration, threshold, factor (of the limit) of cells over ``multiple`` times the limit at one step."""
    limit = WHO_LIMITS[pollutant, HOTSPOT[pollutant]]
    out = at.filter(F.col(pollutant) > limit * multiple)
    return out.select("cell_x", "cell_y", F.col(pollutant).alias("concentration"), F.lit(limit * multiple).alias("threshold"), (F.col(pollutant) / limit).alias("factor"))


def heatmap(at: DataFrame, measured: DataFrame, pollutant: str) -> DataFrame:
    """cell_x, cell_y, level: a cell's sum over time, divided by how many emissions ever reached it (``measured``: cell_x, cell_y, measured)."""
    counts = measured.groupBy("cell_x", "cell_y").agg(F.sum("measured").alias("n"))
    return at.join(counts, ["cell_x", "cell_y"], "left").select("cell_x", "cell_y", (F.col(f"{pollutant}_total") / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1))).alias("level"))


def exposure(people: DataFrame, at: DataFrame, pollutant: str) -> DataFrame:
    """population, exposed, rate, weighted (people times how often the limit is held), mean: of ``people`` (cell_x, cell_y, people) at one step's levels. Cells without a level are clean."""
    limit = WHO_LIMITS[pollutant, "daily" if pollutant == "pm25" else "hourly"]
    held = people.join(at.select("cell_x", "cell_y", F.col(pollutant).alias("level")), ["cell_x", "cell_y"], "left")
    over: Column = F.coalesce(F.col("level") > limit, F.lit(False))
    sums = held.agg(F.coalesce(F.sum("people"), F.lit(0.0)).cast("double").alias("population"), F.coalesce(F.sum(F.when(over, F.col("people"))), F.lit(0.0)).cast("double").alias("exposed"), F.coalesce(F.sum(F.when(over, F.col("people") * F.col("level") / limit)), F.lit(0.0)).alias("weighted"))
    share = lambda x, y: F.coalesce(F.try_divide(x, F.nullif(F.col(y), F.lit(0.0))), F.lit(0.0))
    return sums.select("population", "exposed", share(F.col("exposed"), "population").alias("rate"), "weighted", share(F.col("weighted"), "exposed").alias("mean"))
