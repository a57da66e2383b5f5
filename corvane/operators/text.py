"""Rules over text fields: keyword archetypes, plan extraction, payloads, schemas, fuel and mode inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def archetype(text: Column, words: dict[str, list[str]], default: str) -> Column:
    """The kind whose words occur most often, letter case aside (of ties the first listed); ``default`` if none does."""
    low = F.lower(text)
    hits = lambda w: (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)
    scores = [F.struct(sum((hits(w) for w in ws[1:]), hits(ws[0])).alias("n"), F.lit(-i).alias("i"), F.lit(kind).alias("kind")) for i, (kind, ws) in enumerate(words.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["kind"]).otherwise(default)


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """The name of the first (pattern, name) that the text matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(F.coalesce(F.lower(text).rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


#: Patterns in a route's description, long name and colour that tell its fuel; the first that is found counts.
FUELS = [
    ("electric", "electric"), ("battery", "electric"), ("bev", "electric"), ("zero.emission", "electric"), ("zero emission", "electric"), ("zev", "electric"), ("trolley", "electric"),
    ("hydrogen", "hydrogen"), ("fuel.cell", "hydrogen"), ("fcev", "hydrogen"), ("diesel", "diesel"), ("petrol", "diesel"), ("hybrid", "hybrid"),
]
#: Route types of transit feeds and the mode of each; others are buses.
ROUTE_MODES = {
    0: "tram", 1: "local_train", 2: "intercity_train", 3: "bus", 4: "ferry_diesel", 5: "cable_car", 6: "gondola", 7: "funicular", 11: "trolleybus", 12: "monorail",
    **dict.fromkeys(range(100, 103), "intercity_train"), **dict.fromkeys(range(103, 111), "local_train"), **dict.fromkeys(range(200, 203), "bus"),
    400: "tram", 401: "local_train", 402: "local_train", 403: "local_train", 404: "tram", 405: "local_train",
    **dict.fromkeys(range(700, 717), "bus"), 800: "tram", **dict.fromkeys(range(900, 907), "tram"), **dict.fromkeys(range(1000, 1013), "ferry_diesel"), 1100: "flight_domestic",
}
#: Route types that are electric whatever their name says, and those that are if it says nothing.
ELECTRIC_TYPES, RAIL_TYPES = (0, 1, 5, 6, 7, 11, 12, *range(400, 406), 800, *range(900, 907)), (2, 100, 101, 102, 103, 106, 109)


def route_mode(route_type: Column, fuel: Column | None = None) -> Column:
    """The mode of a route type; a ferry whose fuel is electricity is an electric one."""
    known = F.create_map(*(x for k, v in ROUTE_MODES.items() for x in (F.lit(k), F.lit(v))))
    mode = F.coalesce(F.try_element_at(known, route_type), F.lit("bus"))
    return mode if fuel is None else F.when((mode == "ferry_diesel") & (fuel == "electric"), "ferry_electric").otherwise(mode)


def route_fuel(words: Column, route_type: Column, known: Column | None = None) -> Column:
    """What is ``known``, else electricity by type, else the first fuel found in the words, else electricity for rail and diesel for all others."""
    named = first_match(words, FUELS, "")
    out = F.when(F.coalesce(route_type.isin(*ELECTRIC_TYPES), F.lit(False)), "electric").when(named != "", named).when(F.coalesce(route_type.isin(*RAIL_TYPES), F.lit(False)), "electric").otherwise("diesel")
    return out if known is None else F.coalesce(known, out)


#: Words that tell what a belief is about, in order; the first that is found counts, also inside other words.
BELIEFS = [
    ("ev|electric|battery", "ev_is_viable"), ("transit|public transport|bus|train", "public_transport_reliable"), ("congestion|traffic|jam", "congestion_likely"), ("cost|afford|price|expensive", "cost_pressure_high"),
    ("climate|carbon|emission|environment", "climate_urgency"), ("range|anxiety|mileage", "range_anxiety"), ("charger|charging|infrastructure", "charger_availability"),
]
#: Words in a job's name that tell its kind, in order.
JOBS = [
    ("commute|commuter", "passenger_commute"), ("freight|logistics|delivery|hgv|truck|van", "freight"), ("ferry|island|roro", "port_operations"), ("air|flight|aviation", "aviation"),
    ("rail|train", "rail_operations"), ("nhs|patient|clinical|ambulance", "nhs_operations"), ("port|terminal|drayage|barge", "port_operations"),
]


def belief_key(words: Column) -> Column:
    """What a belief is about; null if nothing tells."""
    return F.nullif(first_match(words, BELIEFS, ""), F.lit(""))


def job_kind(job: Column) -> Column:
    """The kind of a job by its name, letter case as it stands."""
    out = F.lit("passenger_errand")
    for pattern, name in reversed(JOBS):
        out = F.when(F.coalesce(job.rlike(pattern), F.lit(False)), name).otherwise(out)
    return out


def ev_threshold(base: Column, job: Column, kind: Column) -> Column:
    """The share of peers that a job's people want to see in electric cars before they believe."""
    out = F.when(kind.isin("freight", "heavy_freight", "multimodal_freight"), F.least(F.lit(0.9), base + 0.1)).otherwise(base)
    out = F.when(job.rlike("ambulance|emergency|clinical_waste"), F.least(F.lit(0.95), out + 0.15)).otherwise(out)
    return F.round(F.when(job.rlike("leisure|scenic|tourist"), F.greatest(F.lit(0.2), out - 0.1)).otherwise(out), 2)


def clock_minutes(text: Column) -> Column:
    """Minutes since midnight of H:MM, or of a bare hour; null for anything else."""
    parts = F.split(F.when(text.rlike("^[0-9]+$"), F.concat(text, F.lit(":00"))).otherwise(text), ":")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(0)).try_cast("int") * 60 + F.get(parts, F.lit(1)).try_cast("int"))


def duration(minutes: Column) -> Column:
    """A span of time in words: hours, days, weeks (of 7 days), months (30) or years (365), to a tenth."""
    days = minutes / 1440
    said = lambda x, unit: F.format_string(f"%.1f {unit}", x)
    return F.when(days < 1, said(minutes / 60, "hours")).when(days < 7, said(days, "days")).when(days < 30, said(days / 7, "weeks")).when(days < 365, said(days / 30, "months")).otherwise(said(days / 365, "years"))


def missing_keys(payload: Column, kind: Column, required: dict[str, list[str]]) -> Column:
    """Names that a JSON payload lacks or holds as null, by the kind of its event; unknown kinds lack nothing."""
    out = F.array().cast("array<string>")
    for name, keys in required.items():
        out = F.when(kind == name, F.array_compact(F.array(*(F.when(F.get_json_object(payload, f"$.{k}").isNull(), k) for k in keys)))).otherwise(out)
    return out


def keyword_counts(rows: DataFrame, key: str, text: str, words: list[str]) -> DataFrame:
    """Total occurrences of each word (letter case aside) by key, tall."""
    low = F.lower(text)
    hits = [F.sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("long")).alias(w) for w in words]
    return rows.groupBy(key).agg(*hits).unpivot([key], words, "word", "n")
