"""Costs, emissions and diffusion formulas as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def generalised_cost(minutes: Column, headway_minutes: Column, km: Column, value_of_time: float, price_per_km: float, grams_per_km: float, carbon_tax: float = 0.0) -> Column:
    """Time (half the headway as waiting) at its hourly value, fare by distance and taxed carbon."""
    return (minutes + headway_minutes / 2) / 60 * value_of_time + km * price_per_km + km * grams_per_km / 1000 * carbon_tax


def congestion_factor(n: Column, hour: Column, kind: str = "linear", capacity: float = 20.0) -> Column:
    """Slowdown by ``n`` vehicles on an edge, 1 to 3; peak hours count half as much again."""
    forms = {"linear": 1 + 0.15 * n, "bpr": 1 + 0.15 * F.pow(n / capacity, F.lit(4.0)), "exponential": F.pow(F.lit(1.1), n)}
    peak = hour.isin(7, 8, 9, 17, 18, 19)
    return F.when(n == 0, 1.0).otherwise(F.greatest(F.lit(1.0), F.least(F.lit(3.0), forms[kind] * F.when(peak, 1.5).otherwise(1.0))))


def stress_factor(utilisation: Column) -> Column:
    """Price factor of a loaded grid."""
    return F.when(utilisation >= 0.95, 2.0).when(utilisation >= 0.85, 1.5).when(utilisation >= 0.7, 1.2).otherwise(1.0)


def gradient_factor(slope: Column, most: float = 2.0) -> Column:
    """Emission factor of a slope (rise over run)."""
    return F.least(F.lit(most), F.when(slope >= 0, 1 + 5 * slope).otherwise(F.greatest(F.lit(0.5), 1 + 2 * slope)))


def adoption_flow(share: Column, rate: float, ceiling: float, infrastructure: float, feedback: float, social: float) -> Column:
    """Logistic growth, infrastructure push and social pull of a share."""
    logistic = share * (1 - share / ceiling)
    return rate * logistic + infrastructure / 100 * feedback + social * logistic


def net_present_value(yearly: Column, cost: Column, years: int = 5, rate: float = 0.05) -> Column:
    """Yearly gains discounted from the first year on (exponent 0), less the cost."""
    return yearly * sum((1 + rate) ** -y for y in range(years)) - cost


def decayed(strength: Column, rate: float, steps: Column) -> Column:
    return strength * F.pow(F.lit(1 - rate), steps)


def habit(uses: Column) -> Column:
    return 1 - 1 / (1 + uses / 5)


def charging_cost(kwh: Column, hour: Column, hours: Column, base: float) -> Column:
    """Price of energy drawn evenly over ``hours`` from ``hour`` on, hour by hour of the tariff."""
    from corvane.functions.clock import tariff_factor

    each = F.sequence(F.lit(0), (F.ceil(hours) - 1).cast("int"))
    part = lambda k: F.least(F.lit(1.0), hours - k) * tariff_factor((hour + k) % 24)
    return F.aggregate(F.transform(each, part), F.lit(0.0), lambda s, x: s + x) * kwh / hours * base
