"""What a way of travelling costs a person, all wishes and circumstances considered, and which one is taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.joins import any_of

#: Weights of wishes that are not stated, and what minutes, money, grams and a detour in km are held against.
WISHES = {"time": 0.5, "cost": 0.3, "comfort": 0.2, "risk": 0.2, "eco": 0.5, "reliability": 0.5, "range_anxiety": 0.5}
FULL_MINUTES, FULL_MONEY, FULL_GRAMS, DETOUR_KM = 60.0, 5.0, 500.0, 30.0
#: Farthest distances of electric modes in km, what their purchase adds a km, and minutes before departure of modes with a schedule.
RANGE_KM = {"ev": 350.0, "van_electric": 200.0, "cargo_bike": 50.0, "truck_electric": 250.0, "hgv_electric": 300.0, "hgv_hydrogen": 600.0, "e_scooter": 30.0, "ferry_electric": 50.0, "flight_electric": 500.0, "taxi_ev": 300.0}
CAPITAL_KM = {"ev": 0.089, "taxi_ev": 0.089, "van_electric": 0.110, "truck_electric": 0.145, "hgv_electric": 0.200, "hgv_hydrogen": 0.180}
BOARDING = {"local_train": 20.0, "intercity_train": 25.0, "freight_rail": 30.0, "ferry_diesel": 35.0, "ferry_electric": 35.0, "flight_domestic": 75.0, "flight_electric": 75.0}
RAIL_WORDS = ("rail", "train", "intercity", "scenic", "transit", "tram", "metro", "subway", "tube")
BUSINESS = ("commercial", "medium_freight", "heavy_freight", "micro_mobility")
FREIGHT = ("van_electric", "van_diesel", "cargo_bike", "truck_electric", "truck_diesel", "hgv_electric", "hgv_diesel", "hgv_hydrogen")
TRUNK = ("tram", "local_train", "intercity_train", "ferry_diesel", "ferry_electric")
HABIT = 0.12


def decision_costs(options: DataFrame) -> DataFrame:
    """``options`` with ``cost``: what each costs the person who might take it. Random noise is left out.

    Columns: mode, minutes, money, comfort, risk (both 0 to 1), grams, km, wishes (map of weights), vehicle_type, priority, job, boarding_min, charger (whether one is known near the way), charger_free, wait_min, kwh_price,
    detour_km, grid_stress, legs, habit (chance of staying with the mode), preference (of the persona for the mode), factor (of a scenario). A null takes the usual value: personal, normal, no job,
    the mode's boarding time, no charger, not free, 30 minutes, 0.15, no detour, no stress, one leg, no habit, no preference, 1.
    """
    c = F.col
    wish = lambda name: F.coalesce(F.try_element_at("wishes", F.lit(name)), F.lit(WISHES[name]))
    or_ = lambda name, value: F.coalesce(c(name), F.lit(value))
    lookup = lambda table: F.try_element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v))), c("mode"))
    # What is used more than once is a column of its own, step by step: one expression of all would be too large to be compiled.
    kept = [F.col(x) for x in options.columns]
    named = options.select(
        *kept, *(wish(x).alias(f"__{x}") for x in WISHES), or_("vehicle_type", "personal").alias("__kind"), or_("priority", "normal").alias("__priority"), or_("km", 0.0).alias("__km"), or_("grid_stress", 1.0).alias("__stress"), or_("detour_km", 0.0).alias("__detour"),
        lookup(RANGE_KM).alias("__reach"), lookup(CAPITAL_KM).alias("__capital"), lookup(BOARDING).alias("__boarding"), F.coalesce(c("charger"), F.lit(False)).alias("__known"), F.coalesce(c("charger_free"), F.lit(False)).alias("__free"),
    )
    w = {x: c(f"__{x}") for x in WISHES}
    kind, priority, km, stress, reach, capital, boarding, known = (c(f"__{x}") for x in ("kind", "priority", "km", "stress", "reach", "capital", "boarding", "known"))
    told = named.withColumns({"__urgent": priority == "emergency", "__business": (priority == "commercial") | kind.isin(*BUSINESS), "__electric": reach.isNotNull(), "__charges": reach.isNotNull() & known, "__waits": reach.isNotNull() & known & ~c("__free")})
    urgent, business, electric, charges, waits = (c(f"__{x}") for x in ("urgent", "business", "electric", "charges", "waits"))

    # Minutes and money, with what charging adds and a stressed grid stretches.
    time: Column = F.least(F.lit(1.0), c("minutes") / FULL_MINUTES) + F.when(waits, or_("wait_min", 30.0) / 60.0 * w["time"]).otherwise(0.0)
    detour = c("__detour")
    time = time + F.when(charges & (detour > 0.5), detour / DETOUR_KM).otherwise(0.0)
    money: Column = F.least(F.lit(1.0), c("money") / FULL_MONEY) + F.when(charges, km * 0.2 * or_("kwh_price", 0.15) / FULL_MONEY * w["cost"]).otherwise(0.0)
    stretched = F.when(electric & (stress > 1.0), stress).otherwise(1.0)

    used = km / reach
    worry = F.when(electric & (used > 0.9), w["range_anxiety"] * 2.0).when(electric & (used > 0.7), w["range_anxiety"] * 0.5).otherwise(0.0)
    worry = worry + F.when(waits & (w["time"] > 0.7), 0.3).otherwise(0.0) + F.when(electric & ~known, 1.0).otherwise(0.0)
    worry = worry + F.when(capital.isNotNull(), F.greatest(F.lit(0.0), 0.60 - w["eco"]) * 0.8).otherwise(0.0)
    on_rails = any_of([F.contains(F.lower(or_("job", "")), F.lit(x)) for x in RAIL_WORDS])
    missed = F.when(boarding.isNotNull() & ~on_rails & (kind != "transit"), w["reliability"] * (F.coalesce(F.nullif(c("boarding_min"), F.lit(0.0)), boarding) / 60.0) * 0.5).otherwise(0.0)
    felt = told.withColumns({"__t": time * stretched, "__m": money * stretched, "__worry": worry, "__missed": missed})

    money = F.when(capital.isNotNull(), F.least(c("__m") + capital * km * (0.5 + w["cost"]) / FULL_MONEY, F.lit(3.0))).otherwise(c("__m"))
    by_time = F.when(urgent, 1.0).when(business, 0.7).otherwise(w["time"])
    by_money = F.when(urgent, 0.0).when(business, 0.2).otherwise(w["cost"])
    by_risk = F.when(urgent, 0.0).otherwise(w["risk"])
    total = by_time * c("__t") + by_money * money + w["comfort"] * (1.0 - c("comfort")) + by_risk * c("risk") + w["eco"] * F.least(F.lit(1.0), c("grams") / FULL_GRAMS) + c("__worry") + c("__missed")

    suits = F.when(~(business & c("mode").isin(*FREIGHT)), 1.0).when((kind == "micro_mobility") & (c("mode") == "cargo_bike"), 0.6).when(kind.isin("heavy_freight", "medium_freight"), 0.65).otherwise(0.7)
    trunk = F.when((kind == "transit") & c("mode").isin(*TRUNK) & (or_("legs", 1) >= 3), 0.75).otherwise(1.0)
    liked = F.least(F.greatest(c("preference"), F.lit(0.0)), F.lit(1.0))
    liking = F.when(c("preference").isNull(), 1.0).otherwise(F.least(F.greatest(1.40 - 0.65 * liked, F.lit(0.75)), F.lit(1.40)))
    priced = felt.withColumns({"__total": total, "__suits": suits, "__trunk": trunk, "__liking": liking})
    return priced.select(*kept, (c("__total") * c("__suits") * c("__trunk") * (1.0 - HABIT * or_("habit", 0.0)) * or_("factor", 1.0) * c("__liking")).alias("cost"))


def cheapest(options: DataFrame, who: str, order: list[str]) -> DataFrame:
    """who, mode, cost (the least), options (their number): the mode of the option of each ``who`` that comes first by ``order``, in one pass over ``options`` (who, mode, cost and the columns of ``order``)."""
    return options.groupBy(who).agg(F.min_by("mode", F.struct(*order)).alias("mode"), F.min("cost").alias("cost"), F.count("*").alias("options"))
