"""Times of day that may pass midnight, seasons and tariffs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def feed_seconds(text: Column) -> Column:
    """Seconds of ``H:MM:SS``, also beyond 24 hours; -1 if it is no such time."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("int")
    return F.coalesce(F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)), F.lit(-1))


def is_rush_hour(hour: Column) -> Column:
    return hour.between(7, 9) | hour.between(17, 19)


def season(month: Column) -> Column:
    return F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").otherwise("autumn")


#: First hour of each tariff tier and its factor on the base price.
TARIFF = ((0, 0.5), (6, 1.75), (9, 1.0), (17, 1.75), (20, 0.75))


def tariff_factor(hour: Column) -> Column:
    out = F.lit(TARIFF[0][1])
    for start, factor in TARIFF[1:]:
        out = F.when(hour >= start, factor).otherwise(out)
    return out


def step_of(at: Column, start: Column, minutes: float, end: Column | None = None) -> Column:
    """The step of ``minutes`` each that a time falls in; null before the start and after the end."""
    step = F.floor((F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))) / 60 / minutes)
    inside = at >= start if end is None else at.between(start, end)
    return F.when(inside, step)


def triggers(at: Column, frequency: str) -> Column:
    """Whether a time begins an hour, day, week (Monday), month or year."""
    midnight = (F.hour(at) == 0) & (F.minute(at) == 0)
    exact = F.second(at) == 0
    return {
        "hourly": (F.minute(at) == 0) & exact, "daily": midnight & exact, "weekly": midnight & (F.weekday(at) == 0), "monthly": midnight & (F.day(at) == 1),
        "yearly": midnight & (F.day(at) == 1) & (F.month(at) == 1),
    }[frequency]
