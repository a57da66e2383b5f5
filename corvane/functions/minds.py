"""What travellers make of peers, habits, experience and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def satisfaction(minutes: Column, expected_minutes: Column, cost: Column, expected_cost: Column, time_weight: Column, cost_weight: Column) -> Column:
    """How close time and cost came to what was expected, weighted by what matters."""

    def met(actual: Column, expected: Column) -> Column:
        ratio = F.when(expected > 0, F.try_divide(actual, expected)).otherwise(1.0)
        return F.greatest(F.lit(0.0), 1.0 - F.abs(ratio - 1.0))

    weight = time_weight + cost_weight
    both = time_weight * met(minutes, expected_minutes) + cost_weight * met(cost, expected_cost)
    return F.when(weight > 0, F.try_divide(both, weight)).otherwise(0.5)


def peer_discount(share: Column, strength: float = 0.2, conformity: float = 0.3) -> Column:
    """Part of a cost that peers take off, half at most."""
    return F.least(strength * share + F.when(share > 0.5, conformity * (share - 0.5)).otherwise(0.0), F.lit(0.5))


def attractiveness(cost: Column, habit: Column, experience: Column, peers: Column, share: Column, strength: float = 0.2, conformity: float = 0.3) -> Column:
    """Cost after habit (0.4), experience (0.4) and peers (0.2), and a majority's pressure; at most 0.6 goes."""
    bonus = (0.4 * habit + 0.4 * experience + 0.2 * peers) * (strength / 0.2)
    return cost * (1.0 - F.least(F.lit(0.6), bonus + F.when(share > 0.5, (share - 0.5) * conformity).otherwise(0.0)))


def belief(prior: Column, peers: Column, experience: Column, about_ev: Column, threshold: Column) -> Column:
    """Belief after a step: half the prior, 0.35 of experience, 0.15 of peers; on electric cars frozen until enough peers drive one."""
    seen = F.when(about_ev, peers).otherwise(prior)
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * prior + 0.35 * experience + 0.15 * seen))
    return F.when(about_ev & (peers < threshold), prior).otherwise(moved)


# The bands and points from here to the end of the module.


def tie(strength: Column) -> Column:
    """The kind of a tie by its strength, 0 to 1."""
    return F.when(strength > 0.8, "family").when(strength > 0.6, "friend").when(strength > 0.4, "colleague").otherwise("acquaintance")


def quality_of_life(saved_kg: Column, cost_change: Column, grid_change: Column) -> Column:
    """Up to 5 points for emissions, 3 for costs, 2 for a calmer grid."""
    return (
        F.when(saved_kg > 1000, 5.0).when(saved_kg > 500, 3.0).when(saved_kg > 100, 1.0).otherwise(0.0)
        + F.when(cost_change < -1000, 3.0).when(cost_change < -500, 2.0).when(cost_change < 0, 1.0).otherwise(0.0)
        + F.when(grid_change < 0, 2.0).otherwise(0.0)
    )


def confidence(sample: Column, population: Column) -> Column:
    """Trust in an effect by the share of people it touched."""
    share = F.try_divide(sample, population)
    return F.when(share.isNull(), 0.0).when(share > 0.1, 0.95).when(share > 0.05, 0.9).when(share > 0.01, 0.75).otherwise(0.5)
