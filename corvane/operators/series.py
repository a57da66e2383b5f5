"""Analytics of ordered series: shares, gaps, smoothing, slopes, tipping points, streaks, drift, crossings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shares(rows: DataFrame, step: str, mode: str) -> DataFrame:
    """step, mode, n and share (percent) of each mode in each step, with zeros from a mode's first step on."""
    counts = rows.groupBy(step, mode).agg(F.count("*").alias("n"))
    steps = counts.groupBy(step).agg(F.sum("n").alias("total"))
    # One row a mode and one a step: both small by nature, so every pair of them is the result's own size.
    first = counts.groupBy(mode).agg(F.min(step).alias("first"))
    grid = steps.join(first, F.col(step) >= F.col("first")).select(step, mode, "total")
    out = grid.join(counts, [step, mode], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(step, mode, "n", (F.col("n") * 100.0 / F.col("total")).alias("share"))


def transitions(rows: DataFrame, who: str, at: str, mode: str) -> DataFrame:
    """who, at, from_mode, to_mode of each step of ``who`` to its next mode."""
    w = Window.partitionBy(who).orderBy(at)
    return rows.withColumn("from_mode", F.lag(mode).over(w)).filter("from_mode IS NOT NULL").withColumnRenamed(mode, "to_mode")


def headways(rows: DataFrame, keys: list[str], at: str, default: int = 3600) -> DataFrame:
    """Average gap in whole seconds between the departures ``at`` of each key; ``default`` under two departures."""
    n = F.count("*")
    gap = ((F.max(at) - F.min(at)) / (n - 1)).cast("int")
    return rows.groupBy(*keys).agg(n.alias("departures"), F.when(n >= 2, gap).otherwise(default).alias("headway"))


def smoothed(value: str, w: Window, width: int = 10) -> Column:
    """Moving average over ``width`` rows, half of them before; rows beyond the ends count as 0."""
    return F.sum(value).over(w.rowsBetween(-(width // 2), width - width // 2 - 1)) / width


def gradient(value: str, w: Window) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)


def tipping_points(series: DataFrame, key: str, step: str, value: str, velocity: float = 0.5, duration: int = 5, width: int = 10) -> DataFrame:
    """Every step from which the smoothed value keeps a mean slope of ``velocity`` for ``duration`` steps.

    key, step, mean_velocity, before (``duration`` steps earlier) and after; keys under 2 * ``width`` steps have none.
    """
    w = Window.partitionBy(key).orderBy(step)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = series.select(key, step, F.col(value).alias("__x"), (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy(key)).alias("__n"))
    s = s.withColumn("__smooth", F.when(F.col("__n") >= width, smoothed("__x", w, width)).otherwise(F.col("__x")))
    s = s.withColumn("__slope", gradient("__smooth", w))
    s = s.withColumn("mean_velocity", F.avg("__slope").over(w.rowsBetween(0, duration - 1)))
    s = s.withColumn("before", F.coalesce(F.lag("__smooth", duration).over(w), F.first("__smooth").over(whole)))
    s = s.withColumn("after", F.coalesce(F.lead("__smooth", duration).over(w), F.last("__smooth").over(whole)))
    found = (F.col("__n") >= 2 * width) & (F.col("__i") < F.col("__n") - duration) & (F.col("mean_velocity") >= velocity)
    return s.filter(found).select(key, step, "mean_velocity", "before", "after")


def streaks(rows: DataFrame, who: str, at: str, mode: str) -> DataFrame:
    """Runs of one mode: who, mode, started, length."""
    w = Window.partitionBy(who).orderBy(at)
    marked = rows.withColumn("__island", F.row_number().over(w) - F.row_number().over(Window.partitionBy(who, mode).orderBy(at)))
    return marked.groupBy(who, mode, "__island").agg(F.min(at).alias("started"), F.count("*").alias("length")).drop("__island")


def growth_flags(series: DataFrame, key: str, step: str, value: str, back: int = 9, factor: float = 1.5, every: int = 10) -> DataFrame:
    """Steps, each ``every``-th, where the value exceeds ``factor`` times that of ``back`` rows before; with the growth."""
    w = Window.partitionBy(key).orderBy(step)
    s = series.withColumn("previous", F.lag(value, back).over(w)).withColumn("__i", F.row_number().over(w) - 1)
    s = s.filter((F.col("__i") > 0) & (F.col("__i") % every == 0) & (F.col(value) > factor * F.col("previous")))
    return s.withColumn("growth", (F.col(value) - F.col("previous")) / F.greatest(F.col("previous"), F.lit(1))).drop("__i")


def trend_reversals(series: DataFrame, key: str, step: str, value: str, window: int = 5) -> DataFrame:
    """Steps at which the last ``window`` values fell at every pair."""
    w = Window.partitionBy(key).orderBy(step)
    s = series.withColumn("__down", F.when(F.col(value) < F.lag(value).over(w), 1).otherwise(0))
    falls = F.sum("__down").over(w.rowsBetween(-(window - 2), 0))
    return s.withColumn("__falls", falls).filter(F.col("__falls") == window - 1).drop("__down", "__falls")


def forecast_errors(rows: DataFrame, key: str, actual: str, predicted: str) -> DataFrame:
    """MAE, RMSE, bias (actual - predicted) and R2 (between -1 and 1; 0 without variance) of each key."""
    error = F.col(actual) - F.col(predicted)
    out = rows.groupBy(key).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), F.sum(error * error).alias("__res"), (F.var_pop(actual) * F.count(actual)).alias("__tot")
    )
    r2 = F.when(F.col("__tot") <= 1e-10, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 1 - F.try_divide("__res", "__tot"))))
    return out.select(key, "mae", "rmse", "bias", r2.alias("r2"))


def rolling_error(rows: DataFrame, key: str, step: str, actual: str, predicted: str, window: int = 20) -> DataFrame:
    """Mean absolute error over the last ``window`` rows, from the first full window on."""
    w = Window.partitionBy(key).orderBy(step)
    s = rows.withColumn("__e", F.abs(F.col(actual) - F.col(predicted)))
    s = s.withColumn("rolling_mae", F.avg("__e").over(w.rowsBetween(-(window - 1), 0))).withColumn("__i", F.row_number().over(w))
    return s.filter(F.col("__i") >= window).select(key, step, "rolling_mae")


def thirds(rows: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Means of the early, middle and late third, cut at whole thirds of the length; the rest is late."""
    w = Window.partitionBy(key).orderBy(step)
    s = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__third", F.floor(F.count("*").over(Window.partitionBy(key)) / 3))
    part = F.when(F.col("__i") < F.col("__third"), "early").when(F.col("__i") < 2 * F.col("__third"), "middle").otherwise("late")
    return s.groupBy(key).agg(*(F.avg(F.when(part == p, F.col(value))).alias(p) for p in ("early", "middle", "late")))


def crossings(rows: DataFrame, key: str, step: str, value: str, threshold: float) -> DataFrame:
    """Rows at which the value rises from at most the threshold above it; it fires again only after falling back."""
    w = Window.partitionBy(key).orderBy(step)
    s = rows.withColumn("previous", F.lag(value).over(w))
    return s.filter((F.col(value) > threshold) & (F.coalesce("previous", F.lit(threshold)) <= threshold))


def sessions(rows: DataFrame, who: str, at: str, gap_seconds: int) -> DataFrame:
    """Runs of rows with gaps of at most ``gap_seconds``: who, started, ended, n."""
    w = Window.partitionBy(who).orderBy(at)
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    s = rows.withColumn("__s", seconds).withColumn("__new", F.when(F.col("__s") - F.lag("__s").over(w) <= gap_seconds, 0).otherwise(1))
    s = s.withColumn("__id", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(who, "__id").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n")).drop("__id")
