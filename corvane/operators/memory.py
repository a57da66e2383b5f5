"""What agents remember of others' choices: influences that fade, end by their strength, and count up to a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.joins import asof_join
from corvane.operators.scans import linear_scan

#: An influence is forgotten after so many times 1 / decay; steps that count as recent, influences that count at once, and the part of the peers' share that stands for none.
FORGOTTEN, RECENT, SATURATION, SHARE = 10, 10, 5, 0.5


def remembered(influences: DataFrame, asked: DataFrame) -> DataFrame:
    """agent, mode, step, memories, strength: what is left at each step of ``asked`` (agent, mode, step).

    ``influences``: agent, mode, step, strength, decay (0 < decay <= 1; few different values). One made at step t is held
    from t on while step - ``FORGOTTEN`` / decay < t, and is then worth strength * (1 - decay) ** (step - t).

    Every influence comes in once and goes out once, so no influence meets all steps that it lasts: what comes and
    goes is one running sum for the number, and one recurrence for each decay for the strength. Repeated influences
    count each, repeated questions are one, and what nothing is remembered of is 0.
    """
    q = asked.select("agent", "mode", F.col("step").cast("long").alias("step")).distinct()
    lasts = F.ceil(F.lit(float(FORGOTTEN)) / F.col("decay") - 1e-9).cast("long")
    held = influences.select("agent", "mode", F.col("step").cast("long").alias("step"), "strength", "decay", lasts.alias("lasts"))
    gone = held.select("agent", "mode", (F.col("step") + F.col("lasts")).alias("step"), (-F.col("strength") * F.pow(1 - F.col("decay"), F.col("lasts"))).alias("strength"), "decay", F.lit(-1).alias("n"))
    change = held.select("agent", "mode", "step", "strength", "decay", F.lit(1).alias("n")).unionByName(gone)
    change = change.groupBy("agent", "mode", "decay", "step").agg(F.sum("strength").alias("strength"), F.sum("n").alias("n"))
    rates = held.select("agent", "mode", "decay").distinct()
    asks = q.join(rates, ["agent", "mode"]).select("agent", "mode", "decay", "step", F.lit(0.0).alias("strength"), F.lit(0).cast("long").alias("n"))
    rows = change.unionByName(asks).groupBy("agent", "mode", "decay", "step").agg(F.sum("strength").alias("strength"), F.sum("n").alias("n"))
    by = Window.partitionBy("agent", "mode", "decay").orderBy("step")
    rows = rows.withColumns({"place": F.row_number().over(by) - 1, "fades": F.coalesce(F.pow(1 - F.col("decay"), F.col("step") - F.lag("step").over(by)), F.lit(0.0)), "memories": F.sum("n").over(by)})
    found = linear_scan(rows, ["agent", "mode", "decay"], "place", "fades", "strength", "left")
    total = found.groupBy("agent", "mode", "step").agg(F.sum("memories").alias("memories"), F.sum("left").alias("strength"))
    out = q.join(total, ["agent", "mode", "step"], "left")
    # What has come and gone may leave a rounding error.
    some = F.coalesce(F.col("memories"), F.lit(0)) > 0
    return out.select("agent", "mode", "step", F.coalesce("memories", F.lit(0)).cast("long").alias("memories"), F.when(some, F.greatest("strength", F.lit(0.0))).otherwise(0.0).alias("strength"))


def peer_influence(influences: DataFrame, asked: DataFrame, recent: int = RECENT, saturation: int = SATURATION) -> DataFrame:
    """``asked`` (agent, mode, step, share: peers with the mode) with ``influence``, from 0 to 1.

    Of the influences of the last ``recent`` steps the last ``saturation`` count, each as much as is left of it, over ``saturation``;
    without any, half the peers' share. ``influences``: agent, mode, step, order (of equal steps), strength, decay. Each carries the few before it along, and a
    question takes those of the last one before it.
    """
    key = F.struct("agent", "mode")
    by = Window.partitionBy("agent", "mode").orderBy("step", "order").rowsBetween(1 - saturation, 0)
    last = influences.withColumn("held", F.collect_list(F.struct("step", "strength", "decay")).over(by))
    # Of one step only the last influence has all others of the step with it.
    last = last.groupBy("agent", "mode", "step").agg(F.max_by("held", "order").alias("held"))
    met = asof_join(asked.withColumn("__key", key), last.select(key.alias("__key"), F.col("step").alias("__since"), "held"), "__key", "step", "__since", "held")
    near = F.filter("held", lambda x: F.col("step") - x["step"] <= recent)
    total = F.aggregate(F.transform(near, lambda x: F.greatest(F.lit(0.0), x["strength"] * F.pow(1 - x["decay"], F.col("step") - x["step"]))), F.lit(0.0), lambda a, b: a + b)
    some = F.coalesce(F.size(near), F.lit(0)) > 0
    return met.withColumn("influence", F.when(some, F.least(F.lit(1.0), total / saturation)).otherwise(F.coalesce("share", F.lit(0.0)) * SHARE)).drop("__key", "held")
