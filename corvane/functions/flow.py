"""How the flow of adoption depends on its parameters: slopes, elasticities, shares of its terms, regimes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share at which adoption tips, how near counts as near, flow that counts as none.
TIPPING, NEAR, STILL = 0.30, 0.05, 1e-10


def _room(share: Column, capacity: Column) -> Column:
    return F.when(capacity > 0, 1 - share / capacity).otherwise(0.0)


def slopes(share: Column, rate: Column, capacity: Column, social: Column, built: Column) -> Column:
    """Slope of the flow by growth rate, capacity, strength of infrastructure and strength of social influence (a struct)."""
    room = share * _room(share, capacity)
    by_capacity = F.when(capacity > 0, (rate + social) * share * (share / (capacity * capacity))).otherwise(0.0)
    return F.struct(room.alias("rate"), by_capacity.alias("capacity"), (share * built).alias("infrastructure"), room.alias("social"))


def elasticities(slope: Column, rate: Column, capacity: Column, infrastructure: Column, social: Column, flow: Column) -> Column:
    """By how many per cent the flow changes for one per cent of each parameter; 0 where nothing flows."""
    values = {"rate": rate, "capacity": capacity, "infrastructure": infrastructure, "social": social}
    return F.struct(*(F.when(F.abs(flow) < STILL, 0.0).otherwise(slope[n] * p / F.nullif(flow, F.lit(0.0))).alias(n) for n, p in values.items()))


def contributions(share: Column, rate: Column, capacity: Column, infrastructure: Column, social: Column, built: Column) -> Column:
    """The flow and what part of it is logistic growth, infrastructure and social influence; 0 where nothing flows."""
    room = _room(share, capacity)
    parts = {"logistic": rate * share * room, "infrastructure": infrastructure * share * built, "social": social * share * room}
    total = parts["logistic"] + parts["infrastructure"] + parts["social"]
    return F.struct(total.alias("flow"), *(F.when(F.abs(total) > STILL, p / F.nullif(total, F.lit(0.0))).otherwise(0.0).alias(n) for n, p in parts.items()))


def regime(parts: Column, share: Column) -> Column:
    """Whether logistic growth or feedback leads, whether the tipping point is near, and whether it is passed."""
    feedback = parts["infrastructure"] + parts["social"]
    return F.struct((F.abs(parts["logistic"]) > F.abs(feedback)).alias("logistic"), (feedback > F.abs(parts["logistic"])).alias("feedback"), (F.abs(share - TIPPING) < NEAR).alias("near"), (share > TIPPING).alias("above"))
