"""Season, hour and weather as factors on demand, range, speed and preference."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import values as V


def _season(month: Column, four: tuple) -> Column:
    return F.when(month.isin(12, 1, 2), four[0]).when(month.isin(3, 4, 5), four[1]).when(month.isin(6, 7, 8), four[2]).otherwise(four[3])


def _day(weekday: Column, three: tuple) -> Column:
    return F.when(weekday.isin(5, 6), three[0]).when(weekday == 4, three[1]).otherwise(three[2])


def _hour(hour: Column, five: tuple) -> Column:
    return F.when(hour < 6, five[0]).when(hour < 10, five[1]).when(hour < 16, five[2]).when(hour < 20, five[3]).otherwise(five[4])


def multipliers(month: Column, weekday: Column, hour: Column) -> dict[str, Column]:
    """Season, day (Monday 0) and hour combined: each factor's product over the tables that know it."""
    season, week, day = ({k: f(c, v) for k, v in table.items()} for f, c, table in ((_season, month, V.SEASONS), (_day, weekday, V.WEEK), (_hour, hour, V.HOURS)))
    out = {k: season[k] for k in ("ev_range", "bike_adoption", "walk_adoption", "charging_time", "grid_heating_load")}
    out["freight_demand"] = season["freight_demand"] * week["freight_demand"] * day["freight_demand"]
    out["tourism_demand"] = season["tourism_demand"] * week["tourism_demand"]
    out["car_demand"] = day["car_demand"] * season["car_demand"]
    out["bus_demand"] = day["bus_demand"] * season["bus_demand"]
    return out


# The factors and thresholds from here to the end of the module.


def icy(temperature: Column, rain: Column) -> Column:
    return (temperature <= 2.0) & (rain > 0.1)


def speed_factor(mode: Column, temperature: Column, rain: Column, snow: Column, ice: Column, sight: Column) -> Column:
    """What weather leaves of a mode's speed, 0.2 at least."""
    wheels = mode.isin("bike", "ebike")
    factors = [
        F.when(temperature < 0, F.when(wheels, 0.5).otherwise(0.7)).otherwise(1.0),
        F.when(rain > 0, F.when(mode.isin("bike", "ebike", "walk"), 0.85).otherwise(0.9)).otherwise(1.0),
        F.when(snow > 0, F.when(wheels, 0.3).when(mode == "walk", 0.6).otherwise(0.5)).otherwise(1.0),
        F.when(ice, 0.6).otherwise(1.0),
        F.when(sight < 1000, 0.7).otherwise(1.0),
    ]
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return F.greatest(out, F.lit(0.2))


def available(mode: Column, snow: Column, ice: Column) -> Column:
    """Bicycles stay in deep snow and on ice."""
    return ~(mode.isin("bike", "ebike") & ((snow > 10) | ice))


def range_steps(temperature: Column) -> Column:
    """Share of an electric range left, by steps of temperature."""
    return F.when(temperature >= 20, 1.0).when(temperature >= 10, 0.95).when(temperature >= 0, 0.85).when(temperature >= -5, 0.75).otherwise(0.65)


def range_slope(temperature: Column) -> Column:
    """Share of an electric range left, falling ever faster with the cold."""
    t = temperature
    return F.when(t >= 20, 1.0).when(t >= 10, 1.0 - (20 - t) * 0.01).when(t >= 0, 0.9 - (10 - t) * 0.015).when(t >= -10, 0.75 - (0 - t) * 0.025).otherwise(0.5)


def preferences(month: Column, temperature: Column, rain: Column, snow: Column) -> dict[str, Column]:
    """Factors on the cost of modes by month and weather; less is better liked."""
    winter, summer = month.isin(12, 1, 2), month.isin(6, 7, 8)
    by = lambda cold, warm: F.when(winter, cold).when(summer, warm).otherwise(1.0)
    given = lambda condition, factor: F.when(condition, factor).otherwise(1.0)
    return {
        "walk": by(1.2, 0.8) * given(rain > 0, 1.2) * given(snow > 0, 1.5),
        "bike": by(1.5, 0.7) * given(rain > 0, 1.3) * given(snow > 0, 2.0) * given(temperature < 0, 1.4),
        "bus": by(0.8, 1.0),
        "car": by(1.0, 1.1) * given(snow > 0, 1.2),
        "ev": given(temperature < 0, 1.1),
    }
