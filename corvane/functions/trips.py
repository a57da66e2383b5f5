"""Trips and road edges: minutes, prices, emissions over a vehicle's life and the weights that routes are chosen by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions import values as V
from corvane.functions.cost import gradient_factor
from corvane.functions.values import lookup


def straight_km(km: Column, mode: Column) -> Column:
    """Length of the way for a straight line, by the mode's network."""
    network = lookup(mode, {m: v[0] for m, v in V.MODES.items()}, "drive")
    return km * lookup(network, V.ROUTE_FACTOR, 1.1)


def _ends_alone(mode: Column, points: Column) -> Column:
    return mode.isin(*V.DETOUR) & (points <= 3)


def minutes(km: Column, mode: Column, points: Column) -> Column:
    """Travel time: ways known by their ends alone get a detour and boarding, trams their wait."""
    base = km / lookup(mode, V.TRIP_SPEED, 0.1)
    out = F.when(_ends_alone(mode, points), base * lookup(mode, V.DETOUR, 1.15) + lookup(mode, V.BOARDING, 20.0)).otherwise(base)
    return out + F.when(mode == "tram", V.TRAM_MINUTES).otherwise(0.0)


def price(km: Column, mode: Column, points: Column) -> Column:
    far = F.when(_ends_alone(mode, points), km * lookup(mode, V.DETOUR, 1.15)).otherwise(km)
    return lookup(mode, {m: p[0] for m, p in V.TRIP_PRICE.items()}, 1.0) + lookup(mode, {m: p[1] for m, p in V.TRIP_PRICE.items()}, 0.0) * far


def grams(km: Column, mode: Column) -> Column:
    return km * lookup(mode, V.TRIP_GRAMS, 100)


def comfort(mode: Column) -> Column:
    return lookup(mode, V.COMFORT, 0.5)


def risk(mode: Column) -> Column:
    return lookup(mode, V.RISK, 0.2)


def lifecycle(km: Column, mode: Column, grid: float = V.GRID_KG) -> dict[str, Column]:
    """kg of CO2e of building, burning and making the energy, their sum, and grams of pollutants of a trip."""
    battery = lookup(mode, V.BATTERY, 0.0) * V.BATTERY_KG
    built = F.when(mode.isin(*V.NOT_BUILT), 0.0).otherwise((lookup(mode, V.BUILT, 10000) + battery) / lookup(mode, V.LIFE, 250000) * km)
    # What no table names is driven like a car.
    drive = F.when(mode.isin(*V.DIESEL, *V.ELECTRIC, *V.HYDROGEN, *V.PASSENGER_KG), mode).otherwise("car")
    used = km / 100 * lookup(drive, V.BURNT, 7.0)
    none = mode.isin(*V.NO_ENERGY)
    burnt = F.when(none, 0.0).when(drive.isin(*V.DIESEL), used * V.DIESEL_KG).when(drive.isin(*V.PASSENGER_KG), km * lookup(drive, V.PASSENGER_KG, 0.0)).otherwise(0.0)
    made = F.when(none, 0.0).when(drive.isin(*V.DIESEL), used * V.DIESEL_MADE_KG).when(drive.isin(*V.ELECTRIC), used * grid).when(drive.isin(*V.HYDROGEN), used * V.HYDROGEN_KG).otherwise(0.0)
    dust, oxides, monoxide = (km * lookup(mode, {m: p[i] for m, p in V.POLLUTANTS.items()}, 0.0) for i in range(3))
    return {"co2e_kg": built + (burnt + made), "manufacturing_co2e_kg": built, "energy_co2e_kg": burnt, "upstream_co2e_kg": made, "pm25_g": dust, "nox_g": oxides, "co_g": monoxide}


def carbon_price(year: int) -> float:
    """Pounds for a tonne in a year: straight lines between the years of the table, level beyond them."""
    known = V.CARBON_PRICE
    if year <= known[0][0]:
        return float(known[0][1])
    for (y0, p0), (y1, p1) in zip(known, known[1:], strict=False):
        if year <= y1:
            return p0 + (year - y0) / (y1 - y0) * (p1 - p0)
    return float(known[-1][1])


def edge_weights(metres: Column, mode: Column, road: Column, slope: Column, toll: Column, year: int = 2025, energy: float = 0.12, tax: float = 0.0) -> dict[str, Column]:
    """Weights of a road edge: minutes, danger, grams by slope, pounds, and pounds for the carbon of its life."""
    km, speed = metres / 1000.0, F.greatest(lookup(mode, V.TRIP_SPEED, 0.5) * 1000, F.lit(1.0))
    rate = lookup(mode, {m: v[1] for m, v in V.MODES.items()}, 100)
    steep = gradient_factor(slope, 3.0)
    danger = F.when(mode.isin(*V.ACTIVE), lookup(road, V.ROAD_RISK, 1.0)).otherwise(1.0)
    return {
        "time_weight": metres / speed,
        "safety_weight": metres * danger,
        "emission_weight": F.when(rate == 0, metres / speed).otherwise(rate * km * steep),
        "monetary_weight": km * energy + km * (rate / 1000.0) * tax + km * toll,
        "decarbonisation_weight": (rate / 1000.0 * km * steep + lookup(mode, V.EMBODIED, 0.030) * km) * (carbon_price(year) / 1000.0),
    }
