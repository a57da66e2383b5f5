"""Aggregations with the rules of transport studies: per-metric filters, bands, efficiencies, tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positive_statistics(rows: DataFrame, key: str, metrics: dict[str, str]) -> DataFrame:
    """Of each metric's values above 0 alone: mean, population deviation, least, greatest, quartiles, n."""
    out = [F.count("*").alias("rows")]
    for name, column in metrics.items():
        x = F.when(F.col(column) > 0, F.col(column))
        out += [F.count(x).alias(f"{name}_n"), F.avg(x).alias(f"{name}_mean"), F.stddev_pop(x).alias(f"{name}_std"), F.min(x).alias(f"{name}_min"), F.max(x).alias(f"{name}_max")]
        out += [F.percentile(x, F.lit(q)).alias(f"{name}_p{int(q * 100)}") for q in (0.25, 0.5, 0.75)]
    return rows.groupBy(key).agg(*out)


def factor_importance(rows: DataFrame, factors: str) -> DataFrame:
    """Mean absolute weight of each factor of a map column, and its percentage of all."""
    each = rows.select(F.explode(factors).alias("factor", "weight")).groupBy("factor").agg(F.avg(F.abs("weight")).alias("weight"))
    total = each.agg(F.sum("weight").alias("total"))
    return each.crossJoin(total).select("factor", "weight", F.coalesce(F.try_divide(F.col("weight") * 100, "total"), F.lit(0.0)).alias("percent"))


def overlapping_buckets(rows: DataFrame, value: str, buckets: dict[str, Column]) -> DataFrame:
    """bucket, n and the mean of values above 0, for buckets that may share rows, in one pass."""
    parts = [F.struct(F.lit(b).alias("bucket"), F.count_if(c).alias("n"), F.avg(F.when(c & (F.col(value) > 0), F.col(value))).alias("mean")) for b, c in buckets.items()]
    return rows.agg(F.array(*parts).alias("__all")).select(F.inline("__all"))


def travel_totals(rows: DataFrame, mode: str, kind: str, km: str) -> DataFrame:
    """Distances by mode and, apart from that, by vehicle type, and in all (grouping sets)."""
    named = rows.select(F.col(mode).alias("mode"), F.col(kind).alias("kind"), F.col(km).alias("km"))
    return named.groupingSets([["mode"], ["kind"], []], "mode", "kind").agg(F.sum("km").alias("km"), F.count("*").alias("trips")).select("mode", "kind", "km", "trips")


def charger_efficiency(utilisation: Column) -> Column:
    """1 between 70 and 80 % use, falling off at twice the distance."""
    return F.when(utilisation < 0.7, F.greatest(F.lit(0.0), utilisation / 0.7)).when(utilisation > 0.8, F.greatest(F.lit(0.0), 1 - 2 * (utilisation - 0.8))).otherwise(1.0)


def bottlenecks(rows: DataFrame, utilisation: str, capacity: str, threshold: float = 0.6) -> DataFrame:
    """Over- and underused places whose severity reaches the threshold, as kind and severity."""
    u = F.col(utilisation)
    over, under = u > 0.9, (u < 0.3) & (F.col(capacity) > 0)
    s = rows.withColumn("kind", F.when(over, "overloaded").when(under, "underused")).withColumn("severity", F.when(over, F.least(F.lit(1.0), (u - 0.9) / 0.1)).when(under, (0.3 - u) / 0.3))
    return s.filter(F.col("severity") >= threshold)


def before(rows: DataFrame, key: str, by: str, amount: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``amount`` over the rows of the same key that come before in the order of ``by``.

    The order is that of a range partitioning, so that no task holds all rows of a key: sums within a partition, and sums of the partitions before it.
    """
    from corvane.operators.graph import kept

    dealt = kept(rows.repartitionByRange(key, by).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(key, "__part").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each key and partition it lies in.
    offsets = dealt.groupBy(key, "__part").agg(F.sum(amount).alias("__sum")).select(key, "__part", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    return dealt.withColumn("before", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(offsets, [key, "__part"]).withColumn("before", F.col("before") + F.col("__offset")).drop("__part", "__offset")


def following(rows: DataFrame, key: str, by: list[str], value: str) -> DataFrame:
    """``rows`` with ``next``: ``value`` of the row after it within its key, in the order of ``by``; null for the last one.

    The order is that of a range partitioning, so that no task holds all rows of a key: the next row of the same partition, or the first one of the key's next partition.
    """
    from corvane.operators.graph import kept

    dealt = kept(rows.repartitionByRange(key, *by).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(key, "__part").orderBy(*by)
    first = dealt.groupBy(key, "__part").agg(F.min_by(F.struct(value), F.struct(*by)).alias("__first"))
    first = first.select(key, "__part", F.lead("__first").over(Window.partitionBy(key).orderBy("__part")).alias("__then"))
    own = dealt.withColumn("next", F.lead(F.struct(value)).over(inside)).join(first, [key, "__part"])
    return own.withColumn("next", F.coalesce("next", "__then")[value]).drop("__part", "__then")


def rank_sum_test(rows: DataFrame, key: str, value: str, first: Column) -> DataFrame:
    """Mann-Whitney U of the rows where ``first`` holds against the others, by key: n1, n2, u, z and two-sided p (ties averaged, corrected; p with continuity)."""
    s = rows.select(key, value, first.alias("__a"))
    sizes = s.groupBy(key, value).agg(F.count("*").alias("__t"), F.count_if("__a").alias("__n1"))
    ranked = before(sizes, key, value, "__t").withColumn("__rank", F.col("before") + (F.col("__t") + 1) / 2)
    out = ranked.groupBy(key).agg(F.sum("__n1").alias("n1"), F.sum(F.col("__t") - F.col("__n1")).alias("n2"), F.sum(F.col("__rank") * F.col("__n1")).alias("__r1"), F.sum(F.col("__t") * F.col("__t") * F.col("__t") - F.col("__t")).cast("double").alias("__ties"))
    n = F.col("n1") + F.col("n2")
    out = out.withColumn("u", F.col("__r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("__ties") / (n * (n - 1))))
    out = out.withColumn("__spread", spread).withColumn("__far", F.col("u") - F.col("n1") * F.col("n2") / 2.0)
    return out.select(key, "n1", "n2", "u", F.try_divide("__far", "__spread").alias("z"), two_sided(F.try_divide(F.greatest(F.abs("__far") - 0.5, F.lit(0.0)), F.col("__spread"))).alias("p"))


def two_sided(z: Column) -> Column:
    """Probability that a normal variable lies at least ``z`` from its mean, to 1.2e-7 of it (a rational form of the complementary error function)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    #: Coefficients of the Chebyshev fit, from the constant on.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    sum_ = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        sum_ = F.lit(c) + t * sum_
    return t * F.exp(-x * x + sum_)


def exposure_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Least, greatest and mean; the upper median; the 95th percentile by rank (the greatest of up to 20 values). Rows without a value count for nothing."""
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("__t"))
    s = before(sizes, key, value, "__t").join(sizes.groupBy(key).agg(F.sum("__t").alias("n")), key)
    return s.groupBy(key).agg(
        F.max("n").alias("n"), F.min(value).alias("least"), F.max(value).alias("greatest"), (F.sum(F.col(value) * F.col("__t")) / F.max("n")).alias("mean"),
        F.max(F.when(F.col("before") <= F.floor(F.col("n") / 2), F.col(value))).alias("median"),
        F.max(F.when((F.col("n") <= 20) | (F.col("before") <= F.floor(F.col("n") * 0.95)), F.col(value))).alias("p95"),
    )


def top_k(rows: DataFrame, keys: list[str], by: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; ``by`` must leave no ties."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= k)


def load_profile(rows: DataFrame, start_hour: str, hours: str, power: str) -> DataFrame:
    """Power drawn in each hour of the day; a session counts in its first hour and as many whole hours after."""
    each = F.explode(F.sequence(F.col(start_hour), F.col(start_hour) + F.col(hours).cast("int")))
    return rows.select(power, each.alias("__h")).groupBy((F.col("__h") % 24).alias("hour")).agg(F.sum(power).alias("load"), F.count("*").alias("sessions"))
