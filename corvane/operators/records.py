"""What a run records, and reports on it: journeys, snapshots, scenarios, turns and chargers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def journeys(log: DataFrame, agent=None, mode: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows of a step log of an agent, a mode and the steps ``first`` to ``last``, both included; None for any."""
    for column, value in (("agent", agent), ("mode", mode)):
        if value is not None:
            log = log.filter(F.col(column) == value)
    if first is not None:
        log = log.filter(F.col("step") >= first)
    return log if last is None else log.filter(F.col("step") <= last)


def trajectories(log: DataFrame, who: str, order: list[str], what: str) -> DataFrame:
    """who, path: what each one did in the order of ``order``, which must leave no ties."""
    steps = F.sort_array(F.collect_list(F.struct(*order, F.col(what).alias("__what"))))
    return log.groupBy(who).agg(F.transform(steps, lambda s: s["__what"]).alias("path"))


def influence(rows: DataFrame, mode: str, peers: str) -> DataFrame:
    """mode, influenced (rows that name a peer), n, rate."""
    named = F.coalesce(F.size(peers) > 0, F.lit(False))
    return rows.groupBy(mode).agg(F.count_if(named).alias("influenced"), F.count("*").alias("n")).withColumn("rate", F.col("influenced") / F.col("n"))


def snapshots(log: DataFrame, step: str, mode: str, chosen: list[str], value: str, every: int = 20) -> DataFrame:
    """Each ``every``-th step: n, share (per cent of the chosen modes) and the mean of values above 0."""
    rows = log.filter(F.col(step) % every == 0)
    return rows.groupBy(step).agg(F.count("*").alias("n"), (100.0 * F.count_if(F.col(mode).isin(*chosen)) / F.count("*")).alias("share"), F.avg(F.when(F.col(value) > 0, F.col(value))).alias("mean"))


def scenario_deltas(log: DataFrame, scenario: str, base: str, mode: str, value: str, points: float = 2.0) -> DataFrame:
    """By mode, all else against the base scenario: change of counts, in per cent of the base (of 1 if it has none), of the mean value, and whether the share moved by more than ``points``."""
    is_base = F.col(scenario) == base
    out = log.groupBy(mode).agg(F.count_if(is_base).alias("b"), F.count_if(~is_base).alias("i"), F.avg(F.when(is_base, F.col(value))).alias("bv"), F.avg(F.when(~is_base, F.col(value))).alias("iv"))
    # A row for each mode: the window over all of them is small.
    share = lambda c: 100.0 * F.col(c) / F.sum(c).over(Window.partitionBy())
    return out.select(
        mode, (F.col("i") - F.col("b")).alias("change"), (100.0 * (F.col("i") - F.col("b")) / F.greatest("b", F.lit(1))).alias("change_pct"),
        (F.col("iv") - F.col("bv")).alias("performance"), (F.abs(share("i") - share("b")) > points).alias("significant"),
    )


def acceleration(value: str, w: Window) -> Column:
    """Change from the row before, 0 at the first."""
    return F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0))


def late_growth(series: DataFrame, key: str, step: str, value: str, share: float = 0.8) -> DataFrame:
    """key, growth: the last value less that at the place ``share`` of the way (from 0, rounded down)."""
    w = Window.partitionBy(key).orderBy(step)
    s = series.select(key, value, (F.row_number().over(w) - 1).alias("__i"), F.count("*").over(Window.partitionBy(key)).alias("__n"))
    at = s.groupBy(key).agg(F.max(F.when(F.col("__i") == F.floor(F.lit(share) * F.col("__n")), F.col(value))).alias("cut"), F.max_by(value, "__i").alias("last"))
    return at.select(key, (F.col("last") - F.col("cut")).alias("growth"))


def slope_significance(series: DataFrame, key: str, step: str, value: str, width: int = 10) -> DataFrame:
    """key, step, p: small where the slope of ``width`` steps from here on differs much from that of the ``width`` before; 1 where either side is too short or level."""
    order = Window.partitionBy(key).orderBy(step)
    earlier, later = order.rowsBetween(-width, -1), order.rowsBetween(0, width - 1)
    stats = {f"{name}_{side}": f.over(w) for side, w in (("b", earlier), ("a", later)) for name, f in (("slope", F.regr_slope(value, step)), ("n", F.count("*")), ("sd", F.stddev_pop(value)))}
    s = series.withColumns(stats)
    spread = F.col("sd_b") + F.col("sd_a")
    p = F.greatest(F.lit(0.001), 1 / (1 + 10 * F.try_divide(F.abs(F.col("slope_a") - F.col("slope_b")), spread)))
    return s.select(key, step, F.when((F.col("n_b") < 2) | (F.col("n_a") < 2) | (spread == 0), 1.0).otherwise(p).alias("p"))


def triggers(points: DataFrame, changes: DataFrame, mode: str, at: str, step: str, reach: int) -> DataFrame:
    """mode, at, cause for ``points`` (mode, at) with changes (mode, step, influenced, reason, event_id) at most ``reach`` steps away."""
    from corvane.operators.joins import band_join

    near = band_join(points, changes, mode, at, step, reach)
    first = F.min(F.when(F.col("reason") != "unknown", F.struct(step, "event_id", "reason")))["reason"]
    out = near.groupBy(mode, at).agg(F.count("*").alias("n"), F.count_if("influenced").alias("i"), first.alias("first"))
    return out.select(mode, at, F.when(F.col("i") > F.col("n") * 0.5, "social_cascade").otherwise(F.coalesce("first", F.lit("unknown"))).alias("cause"))


def availability_trend(snapshots: DataFrame, step: str, last: int = 100) -> DataFrame:
    """trend, utilisation, queue, snapshots over the last ``last`` of snapshots (occupied, ports, queued), a report by its nature."""
    tail = snapshots.orderBy(F.desc(step)).limit(last)
    used = F.avg(F.col("occupied") / F.greatest("ports", F.lit(1)))
    return tail.agg(F.when(used > 0.7, "increasing").otherwise("stable").alias("trend"), used.alias("utilisation"), F.avg("queued").alias("queue"), F.count("*").alias("snapshots"))


def infrastructure(stations: DataFrame, zone: str, minutes: float) -> DataFrame:
    """By zone of stations (ports, occupied, queued): totals, utilisation, whether they are used alike, and the mean wait."""
    wait = F.when(F.col("occupied") < F.col("ports"), 0.0).otherwise(F.col("queued") * minutes / F.col("ports"))
    return stations.groupBy(zone).agg(
        F.count("*").alias("stations"), F.sum("ports").alias("ports"), F.sum("occupied").alias("occupied"), (F.sum("occupied") / F.sum("ports")).alias("utilisation"),
        (F.var_pop(F.col("occupied") / F.col("ports")) < 0.05).alias("balanced"), F.sum("queued").alias("queued"), F.avg(wait).alias("wait"),
    )


def cost_recovery(stations: DataFrame, running: float = 0.1) -> DataFrame:
    """station, profit, roi_pct, payback (periods; null if it never pays) from revenue and capital, ``running`` of which is spent a period."""
    gain = F.col("revenue") - F.col("capital") * running
    return stations.select("station", (gain - F.col("capital")).alias("profit"), (F.try_divide(gain, F.col("capital")) * 100).alias("roi_pct"), F.when(gain > 0, F.try_divide("capital", gain)).alias("payback"))
