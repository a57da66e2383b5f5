"""Fixed values of the study: parameters by mode, season, hour and weather, each table in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Network, grams of CO2e a km, km an hour, whether a mode is routed, and the range in km of what has one.
MODES = {
    "walk": ("walk", 0, 5, True, None),
    "bike": ("bike", 0, 15, True, None),
    "e_scooter": ("bike", 0, 20, True, 10),
    "cargo_bike": ("bike", 0, 18, True, None),
    "car": ("drive", 170, 50, True, None),
    "ev": ("drive", 0, 50, True, 350),
    "bus": ("drive", 82, 30, True, None),
    "tram": ("tram", 35, 25, True, None),
    "taxi_ev": ("drive", 0, 45, True, 300),
    "taxi_diesel": ("drive", 160, 45, True, None),
    "van_electric": ("drive", 0, 50, True, 200),
    "van_diesel": ("drive", 150, 50, True, None),
    "truck_electric": ("drive", 0, 60, True, 250),
    "truck_diesel": ("drive", 200, 60, True, None),
    "hgv_electric": ("drive", 0, 55, True, 300),
    "hgv_diesel": ("drive", 900, 55, True, None),
    "hgv_hydrogen": ("drive", 0, 55, True, 600),
    "local_train": ("rail", 41, 80, True, None),
    "intercity_train": ("rail", 41, 150, True, None),
    "freight_rail": ("rail", 35, 80, True, None),
    "ferry_diesel": ("ferry", 115, 30, True, None),
    "ferry_electric": ("ferry", 0, 25, True, None),
    "flight_domestic": ("air", 255, 700, False, None),
    "flight_electric": ("air", 0, 400, False, None),
}
#: How much longer than the straight line a network's ways are; others 1.1.
ROUTE_FACTOR = {"rail": 1.15, "tram": 1.08, "ferry": 1.05, "air": 1.02}

#: Fixed values of trips by mode: km a minute; others 0.1.
TRIP_SPEED = {
    "walk": 0.083, "bike": 0.25, "cargo_bike": 0.20, "e_scooter": 0.33, "bus": 0.33, "car": 0.5, "ev": 0.5, "taxi_ev": 0.45, "taxi_diesel": 0.45,
    "van_electric": 0.58, "van_diesel": 0.58, "truck_electric": 0.50, "truck_diesel": 0.50, "hgv_electric": 0.42, "hgv_diesel": 0.42, "hgv_hydrogen": 0.42,
    "tram": 0.42, "local_train": 1.0, "intercity_train": 2.0, "freight_rail": 0.83, "ferry_diesel": 0.58, "ferry_electric": 0.50, "flight_domestic": 7.5, "flight_electric": 5.83,
}
#: Grams of CO2e a km of a trip; others 100.
TRIP_GRAMS = {
    "walk": 0, "bike": 0, "cargo_bike": 0, "e_scooter": 0, "ev": 0, "taxi_ev": 0, "van_electric": 0, "truck_electric": 0, "hgv_electric": 0,
    "tram": 30, "local_train": 35, "intercity_train": 25, "freight_rail": 35, "ferry_electric": 40, "flight_electric": 50,
    "bus": 80, "car": 180, "taxi_diesel": 160, "van_diesel": 250, "truck_diesel": 400, "hgv_diesel": 800, "hgv_hydrogen": 100, "ferry_diesel": 120, "flight_domestic": 250,
}
#: Price of setting out and of a km; others 1.0 and 0.0.
TRIP_PRICE = {
    "walk": (0.0, 0.0), "bike": (0.0, 0.0), "bus": (2.5, 0.10), "car": (1.0, 0.40), "ev": (1.0, 0.22), "taxi_ev": (1.0, 0.22), "taxi_diesel": (1.0, 0.35),
    "cargo_bike": (0.5, 0.05), "van_electric": (2.0, 0.20), "van_diesel": (2.0, 0.35), "truck_electric": (5.0, 0.40), "truck_diesel": (5.0, 0.60),
    "hgv_electric": (10.0, 0.80), "hgv_diesel": (10.0, 1.20), "hgv_hydrogen": (10.0, 1.00), "tram": (2.0, 0.08), "local_train": (3.0, 0.12),
    "intercity_train": (10.0, 0.15), "freight_rail": (8.0, 0.06), "ferry_diesel": (15.0, 0.25), "ferry_electric": (12.0, 0.20),
    "flight_domestic": (50.0, 0.20), "flight_electric": (60.0, 0.15), "e_scooter": (1.0, 0.25),
}
#: Comfort, 0 to 1; others 0.5.
COMFORT = {
    "walk": 0.5, "bike": 0.6, "bus": 0.7, "car": 0.8, "ev": 0.85, "taxi_ev": 0.8, "taxi_diesel": 0.8, "van_electric": 0.75, "van_diesel": 0.75,
    "truck_electric": 0.70, "truck_diesel": 0.70, "hgv_electric": 0.65, "hgv_diesel": 0.65, "cargo_bike": 0.55, "tram": 0.75, "local_train": 0.72,
    "intercity_train": 0.82, "freight_rail": 0.55, "ferry_diesel": 0.65, "ferry_electric": 0.70, "flight_domestic": 0.70, "flight_electric": 0.72, "e_scooter": 0.55,
}
#: Risk, 0 to 1; others 0.2.
RISK = {
    "walk": 0.2, "bike": 0.3, "bus": 0.15, "car": 0.25, "ev": 0.20, "taxi_ev": 0.25, "taxi_diesel": 0.25, "van_electric": 0.25, "van_diesel": 0.25,
    "truck_electric": 0.30, "truck_diesel": 0.30, "hgv_electric": 0.35, "hgv_diesel": 0.35, "cargo_bike": 0.35, "tram": 0.12, "local_train": 0.10,
    "intercity_train": 0.08, "freight_rail": 0.15, "ferry_diesel": 0.18, "ferry_electric": 0.16, "flight_domestic": 0.12, "flight_electric": 0.14, "e_scooter": 0.35,
}
#: Fixed values of trips that are known by their ends alone: detour and minutes of boarding.
DETOUR = {"local_train": 1.25, "intercity_train": 1.18, "freight_rail": 1.20, "ferry_diesel": 1.05, "ferry_electric": 1.05, "flight_domestic": 1.02, "flight_electric": 1.02}
BOARDING = {"local_train": 20.0, "intercity_train": 25.0, "freight_rail": 30.0, "ferry_diesel": 35.0, "ferry_electric": 35.0, "flight_domestic": 75.0, "flight_electric": 75.0}
TRAM_MINUTES = 9.0

#: Fixed values of a vehicle's life: kg of CO2e to build it (others 10000), battery in kWh, life in km (others 250000).
BUILT = {"car": 10000, "ev": 15000, "van_diesel": 15000, "van_electric": 22000, "truck_diesel": 50000, "truck_electric": 75000, "hgv_diesel": 120000, "hgv_electric": 180000, "hgv_hydrogen": 150000, "bike": 100, "ebike": 200, "cargo_bike": 300, "bus": 80000}
BATTERY = {"ev": 60.0, "van_electric": 75.0, "truck_electric": 300.0, "hgv_electric": 500.0, "ebike": 0.5, "cargo_bike": 1.0}
LIFE = {"car": 250000, "ev": 250000, "van_diesel": 300000, "van_electric": 300000, "truck_diesel": 500000, "truck_electric": 500000, "hgv_diesel": 800000, "hgv_electric": 800000, "hgv_hydrogen": 800000, "bike": 20000, "ebike": 20000, "cargo_bike": 30000, "bus": 600000}
#: Litres, kWh or kg of hydrogen for 100 km (others 7).
BURNT = {"car": 7.0, "van_diesel": 10.0, "truck_diesel": 25.0, "hgv_diesel": 35.0, "ev": 18.0, "van_electric": 25.0, "truck_electric": 80.0, "hgv_electric": 120.0, "hgv_hydrogen": 8.0, "bus": 30.0, "ebike": 1.0, "cargo_bike": 1.5}
#: Kg of CO2e of a kWh of battery, of a litre of diesel burnt and made, of a kWh from the grid, of a kg of hydrogen.
BATTERY_KG, DIESEL_KG, DIESEL_MADE_KG, GRID_KG, HYDROGEN_KG = 75.0, 2.68, 0.5, 0.233, 10.0
#: Modes by what drives them, and kg of CO2e of a passenger's km; other modes count as cars.
DIESEL, ELECTRIC, HYDROGEN = ("car", "van_diesel", "truck_diesel", "hgv_diesel", "bus"), ("ev", "van_electric", "truck_electric", "hgv_electric", "ebike", "cargo_bike"), ("hgv_hydrogen",)
PASSENGER_KG = {"tram": 0.05, "local_train": 0.035, "intercity_train": 0.035}
#: Modes without a share in building, and without energy.
NOT_BUILT, NO_ENERGY = ("walk", "bus", "tram", "local_train", "intercity_train"), ("walk", "bike")
#: Grams of fine dust, nitrogen oxides and carbon monoxide a km (others 0).
POLLUTANTS = {
    "car": (0.005, 0.06, 0.5), "van_diesel": (0.01, 0.15, 0.8), "truck_diesel": (0.03, 0.5, 2.0), "hgv_diesel": (0.05, 0.8, 3.0), "bus": (0.02, 0.4, 1.5),
    "ev": (0.001, 0.005, 0.01), "van_electric": (0.001, 0.005, 0.01), "truck_electric": (0.002, 0.01, 0.02), "hgv_electric": (0.003, 0.015, 0.03),
    "walk": (0.0, 0.0, 0.0), "bike": (0.0, 0.0, 0.0), "ebike": (0.0, 0.0, 0.0), "cargo_bike": (0.0, 0.0, 0.0),
}
#: Years of life lost and pounds for a tonne of fine dust and of nitrogen oxides.
YEARS_LOST, HEALTH_COST = (100.0, 20.0), (70000, 15000)

#: Risk of a road to those on foot or two wheels (others 1).
ROAD_RISK = {
    "motorway": 100.0, "motorway_link": 100.0, "trunk": 50.0, "trunk_link": 50.0, "primary": 5.0, "primary_link": 5.0, "secondary": 2.0, "secondary_link": 2.0,
    "residential": 0.8, "living_street": 0.8, "cycleway": 0.7, "path": 0.7, "footway": 0.7,
}
ACTIVE = ("walk", "bike", "cargo_bike", "e_scooter")
#: Pounds for a tonne of CO2e by year, and kg of CO2e built into a km (others 0.03).
CARBON_PRICE = ((2025, 80), (2030, 120), (2035, 180), (2040, 240), (2050, 300))
EMBODIED = {
    "car": 0.060, "ev": 0.085, "bus": 0.020, "tram": 0.015, "van_diesel": 0.040, "van_electric": 0.055, "truck_diesel": 0.035, "truck_electric": 0.045, "hgv_diesel": 0.025,
    "hgv_electric": 0.035, "hgv_hydrogen": 0.030, "walk": 0.0, "bike": 0.001, "e_scooter": 0.002, "cargo_bike": 0.002, "local_train": 0.010, "intercity_train": 0.008, "freight_rail": 0.012,
}

#: Factors of winter, spring, summer and autumn.
SEASONS = {
    "tourism_demand": (0.6, 0.9, 1.8, 1.0), "freight_demand": (1.3, 1.0, 0.9, 1.1), "ev_range": (0.75, 0.90, 1.0, 0.85), "bike_adoption": (0.3, 0.8, 1.3, 0.6), "walk_adoption": (0.5, 0.9, 1.2, 0.7),
    "bus_demand": (1.2, 1.0, 0.9, 1.1), "car_demand": (1.1, 1.0, 0.95, 1.05), "charging_time": (1.25, 1.05, 1.0, 1.15), "grid_heating_load": (1.4, 1.1, 0.6, 1.2),
}
#: Factors of Saturday and Sunday, Friday, and the other days.
WEEK = {"freight_demand": (0.5, 1.1, 1.2), "commute_demand": (0.3, 1.0, 1.0), "leisure_demand": (1.8, 1.3, 0.7), "tourism_demand": (1.5, 1.2, 0.9)}
#: Factors of the hours from 0, 6, 10, 16 and 20 on.
HOURS = {
    "car_demand": (0.2, 1.5, 1.0, 1.6, 0.6), "bus_demand": (0.1, 1.8, 0.9, 1.7, 0.4), "freight_demand": (0.8, 1.3, 1.5, 0.9, 0.5), "bike_demand": (0.05, 1.2, 1.0, 0.8, 0.2),
    "walk_demand": (0.1, 1.1, 1.2, 1.0, 0.4), "grid_load": (0.4, 1.2, 1.0, 1.5, 0.8),
}


def lookup(key: Column, values: dict, default) -> Column:
    """What a table holds for a key, else ``default``."""
    held = F.create_map(*(x for k, v in values.items() for x in (F.lit(k), F.lit(v))))
    return F.coalesce(F.try_element_at(held, key), F.lit(default))
