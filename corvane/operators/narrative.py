"""What a story says about a person: wishes, modes that follow from them, and the plan behind a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.joins import any_of

#: Wishes, what they are without a word for them, the words that speak of one and how strong it is then.
NEUTRAL = 0.5
WISHES = ("eco", "time", "cost", "comfort", "safety", "reliability", "flexibility")
WORDS = {
    "eco": (("carbon", "emission", "environment", "sustainable", "green", "eco", "climate", "decarboni"), 0.8),
    "time": (("time", "quick", "fast", "urgent", "schedule", "deadline"), 0.7),
    "cost": (("cost", "budget", "afford", "cheap", "expensive", "money"), 0.7),
    "comfort": (("comfort", "convenient", "easy", "stress-free"), 0.7),
    "safety": (("safe", "secure", "risk", "danger", "children"), 0.8),
    "reliability": (("reliable", "dependable", "consistent", "on time"), 0.8),
}
FREIGHT_LEAST = {"reliability": 0.8, "cost": 0.7}
COMPLIANCE_WORDS, COMPLIANCE = ("compliance", "regulation"), 0.9
#: How a strong wish moves the liking of modes; later ones have the last word.
MODES = ("walk", "bike", "ebike", "bus", "train", "car_petrol", "car_diesel", "ev", "taxi")
STRONG = 0.7
LIKINGS = (
    ("eco", {"walk": 0.8, "bike": 0.9, "bus": 0.7, "train": 0.7, "car_petrol": 0.2, "car_diesel": 0.1}),
    ("time", {"car_petrol": 0.7, "ev": 0.8, "taxi": 0.9, "walk": 0.3}),
    ("cost", {"walk": 0.9, "bike": 0.8, "bus": 0.6, "car_petrol": 0.2, "taxi": 0.1}),
)
#: Flexibility that fixes a schedule, jobs that save money.
RIGID, THRIFTY = ("none", "very_low", "low"), ("freight", "delivery", "gig_delivery", "taxi_service")


def _speaks(text: Column, words: tuple[str, ...]) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def wishes(text: Column, persona_type: Column) -> Column:
    """A map of wishes (0 to 1) that a story's words tell; letter case is ignored. An empty or null story tells none, not even what freight asks for."""
    low, told = F.lower(text), F.coalesce(F.length(text) > 0, F.lit(False))
    freight = told & F.coalesce(persona_type == "freight", F.lit(False))
    parts = []
    for name in WISHES:
        words, strength = WORDS.get(name, ((), NEUTRAL))
        value = F.when(told & _speaks(low, words), strength).otherwise(NEUTRAL) if words else F.lit(NEUTRAL)
        if name in FREIGHT_LEAST:
            value = F.when(freight, F.greatest(value, F.lit(FREIGHT_LEAST[name]))).otherwise(value)
        parts += [F.lit(name), value]
    found = F.create_map(*parts)
    return F.when(freight & _speaks(low, COMPLIANCE_WORDS), F.map_concat(found, F.create_map(F.lit("compliance"), F.lit(COMPLIANCE)))).otherwise(found)


def likings(held: Column) -> Column:
    """A map of how much each mode is liked (0 to 1) by who has these wishes."""
    strong = {name: F.coalesce(F.try_element_at(held, F.lit(name)), F.lit(NEUTRAL)) > STRONG for name, _ in LIKINGS}
    parts = []
    for mode in MODES:
        value = F.lit(NEUTRAL)
        for name, moved in LIKINGS:
            if mode in moved:
                value = F.when(strong[name], moved[mode]).otherwise(value)
        parts += [F.lit(mode), value]
    return F.create_map(*parts)


def plans(jobs: DataFrame) -> DataFrame:
    """``jobs`` with schedule_fixed, recurring, plan_type, objective, critical, flexible and time_sensitive.

    Columns: job, job_type, flexibility (of its time window; null: no window), repeats, frequency (null: 5/week), stops, urgency (null: medium). A job of more than one stop is multi_stop, one that repeats daily
    or weekly by its frequency or name. Freight and taxis save money, commuters time; critical jobs save time whatever else, can't move and must be reliable, urgent ones (high) save time and mind it.
    """
    c = F.col
    kind, urgency, frequency = F.coalesce("job_type", F.lit("general")), F.coalesce("urgency", F.lit("medium")), F.coalesce("frequency", F.lit("5/week"))
    repeats = F.coalesce(c("repeats"), F.lit(False))
    daily = F.contains(frequency, F.lit("5/week")) | F.coalesce(F.contains(F.lower("job"), F.lit("daily")), F.lit(False))
    aim = F.when(urgency.isin("critical", "high"), "minimize_time").when(kind.isin(*THRIFTY), "minimize_cost").when(F.contains(kind, F.lit("commute")), "minimize_time")
    return jobs.withColumns({
        "schedule_fixed": F.coalesce(c("flexibility").isin(*RIGID), F.lit(False)),
        "recurring": F.when(repeats & daily, "daily").when(repeats & F.contains(frequency, F.lit("weekly")), "weekly"),
        "plan_type": F.when(F.coalesce(c("stops"), F.lit(1)) > 1, "multi_stop").otherwise("point_to_point"),
        "objective": aim, "critical": urgency == "critical", "flexible": urgency != "critical", "time_sensitive": urgency == "high",
    })


def congestion_summary(events: DataFrame, group: str) -> DataFrame:
    """By ``group``: events, mean, median and greatest delay, affected in all and a mean for each event (events: delay, affected)."""
    return events.groupBy(group).agg(F.count("*").alias("events"), F.avg("delay").alias("mean"), F.median("delay").alias("median"), F.max("delay").alias("peak"), F.sum("affected").alias("affected"), F.avg("affected").alias("mean_affected"))
