"""Which modes a trip may use at all, from what it carries, who makes it and how far it goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Modes by context, what distance adds, farthest distances in km and the part of them that counts, modes without a vehicle and for freight, and what is left if nothing is.
DEFAULT = ("walk", "bike", "bus", "car", "local_train", "tram")
TAXI = ("taxi_ev", "taxi_diesel", "ev", "car")
MICRO, MICRO_FAR, MICRO_KM = ("cargo_bike", "bike", "ebike"), ("cargo_bike", "van_electric", "van_diesel"), 20.0
BY_VEHICLE = {
    "heavy_freight": ("hgv_diesel", "hgv_electric", "hgv_hydrogen", "truck_diesel", "truck_electric"),
    "medium_freight": ("truck_electric", "truck_diesel", "van_diesel", "van_electric"),
    "commercial": ("van_electric", "van_diesel", "cargo_bike"),
    "transit": ("local_train", "intercity_train", "tram", "bus", "ferry_diesel", "ferry_electric", "walk", "bike", "e_scooter", "ev", "car"),
}
EMERGENCY, ENCUMBERED = ("car", "ev", "bus"), ("car", "ev", "bus", "tram")
FAR, FAR_KM = ("intercity_train", "flight_domestic"), 80.0
MIDDLE, MIDDLE_KM = ("local_train", "tram"), 30.0
WATER, SCOOTER_KM = ("ferry_diesel", "ferry_electric"), 15.0
FARTHEST_KM = {
    "walk": 3.0, "bike": 10.0, "cargo_bike": 20.0, "e_scooter": 30.0, "bus": 100.0, "tram": 25.0, "car": 500.0, "ev": 350.0, "taxi_ev": 400.0, "taxi_diesel": 600.0, "local_train": 150.0, "intercity_train": 800.0, "freight_rail": 800.0,
    "ferry_diesel": 200.0, "ferry_electric": 50.0, "flight_domestic": 1000.0, "flight_electric": 500.0, "van_electric": 200.0, "van_diesel": 500.0, "truck_electric": 250.0, "truck_diesel": 600.0, "hgv_electric": 300.0, "hgv_diesel": 800.0, "hgv_hydrogen": 600.0,
}
MARGIN, CARGO_BIKE_MARGIN = 0.65, 0.9
ON_FOOT = ("walk", "bike", "e_scooter")
FREIGHT = ("van_electric", "van_diesel", "truck_electric", "truck_diesel", "hgv_electric", "hgv_diesel", "hgv_hydrogen", "taxi_ev", "taxi_diesel")
LEFT = {"heavy_freight": ("hgv_diesel",), "medium_freight": ("truck_diesel",), "commercial": ("van_diesel",), "transit": ("bus", "car"), "micro_mobility": ("van_diesel", "van_electric")}
LEFT_BY_KM = ((200.0, ("car", "bus", "intercity_train")), (50.0, ("car", "bus", "local_train")), (None, ("car", "bike", "walk")))


def _list(modes: tuple[str, ...]) -> Column:
    return F.array(*(F.lit(m) for m in modes))


def eligible_modes(trips: DataFrame) -> DataFrame:
    """``trips`` with ``modes``: what each may use, in order of preference, never empty.

    Columns: km, vehicle_type (null: personal), vehicle_required, cargo_capacity, priority, operator_type, luggage, wheelchair, coastal, island, allowed (array of a persona's own modes: they take the place
    of what the context offers; null or empty: none). Nulls switch a condition off, a null km counts as 0. Each mode is there once, where it comes first.

    The steps: what the context offers; what the distance adds (unless a vehicle is needed); only modes whose farthest distance, with a margin, is beyond the trip's; without those on foot if a vehicle
    is needed; without freight modes for persons; and if nothing is left, what then remains by context and distance.
    """
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    km, kind = F.coalesce(F.col("km").cast("double"), F.lit(0.0)), F.coalesce("vehicle_type", F.lit("personal"))
    own = F.coalesce(F.size("allowed") > 0, F.lit(False))
    context = F.when(F.col("operator_type") == "taxi", _list(TAXI)).when(kind == "micro_mobility", F.when(km > MICRO_KM, _list(MICRO_FAR)).otherwise(_list(MICRO)))
    for vehicle, modes in BY_VEHICLE.items():
        context = context.when(kind == vehicle, _list(modes))
    context = context.when(F.col("priority") == "emergency", _list(EMERGENCY)).when(on("luggage") | on("wheelchair"), _list(ENCUMBERED)).otherwise(_list(DEFAULT))
    none = F.slice(_list(DEFAULT), 1, 0)
    far = F.when(km > FAR_KM, _list(FAR)).when(km > MIDDLE_KM, _list(MIDDLE)).otherwise(none)
    water = F.when(on("coastal") | on("island"), _list(WATER)).otherwise(none)
    scooter = F.when((km < SCOOTER_KM) & ~on("cargo_capacity"), _list(("e_scooter",))).otherwise(none)
    more = F.when((km > 0) & ~on("vehicle_required"), F.concat(far, water, scooter)).otherwise(none)
    reach = F.create_map(*(F.lit(x) for m, most in FARTHEST_KM.items() for x in (m, most * (CARGO_BIKE_MARGIN if m == "cargo_bike" else MARGIN))))
    # Plain columns, so that no step repeats the one before inside its own expression.
    out = trips.withColumn("__km", km).withColumn("__kind", kind).withColumn("__own", own)
    out = out.withColumn("modes", F.array_distinct(F.when(own, F.col("allowed")).otherwise(F.concat(context, more))))
    out = out.withColumn("modes", F.filter("modes", lambda m: (F.col("__km") <= 0) | F.coalesce(F.col("__km") < F.try_element_at(reach, m), F.lit(True))))
    out = out.withColumn("modes", F.filter("modes", lambda m: ~on("vehicle_required") | ~m.isin(*ON_FOOT)))
    out = out.withColumn("modes", F.filter("modes", lambda m: F.col("__own") | (F.col("__kind") != "personal") | on("vehicle_required") | ~m.isin(*FREIGHT)))
    left = F.when(F.lit(False), none)
    for vehicle, modes in LEFT.items():
        left = left.when(F.col("__kind") == vehicle, _list(modes))
    for beyond, modes in LEFT_BY_KM:
        left = left.otherwise(_list(modes)) if beyond is None else left.when(F.col("__km") > beyond, _list(modes))
    return out.withColumn("modes", F.when(F.size("modes") > 0, F.col("modes")).otherwise(left)).drop("__km", "__kind", "__own")
