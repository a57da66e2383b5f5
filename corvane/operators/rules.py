"""Rules that are rows: which personas may do which jobs, by listed conditions and by an ordered cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.joins import any_of
from corvane.operators.graph import kept

#: Letters of the pieces by which values and the texts that contain them meet; most fields that rules may name.
GRAM, MOST_FIELDS = 3, 1000

#: Words and names of the cascade of personas and jobs.
HEALTH_WORDS = ("nhs", "clinical", "patient", "ambulance", "nursing", "gp_", "surgery", "health", "ward")
HEALTH_CORE = ("fleet_manager_healthcare", "paramedic", "community_health_worker", "nhs_ward_manager", "clinical_waste_driver", "nhs_supply_chain")
HEALTH_CONTRACTED, HEALTH_CONTRACTS = ("shift_worker", "delivery_driver"), ("passenger_commute", "service", "delivery")
HEALTH_GOODS, HEALTH_COMMUTERS = ("supply", "waste"), ("disabled_commuter", "frequent_driver")
FREIGHT_JOBS, FREIGHT_OPERATORS = ("freight", "multimodal_freight", "rail_freight"), ("logistics", "retail")
FREIGHT_CORE = ("freight_operator", "rail_freight_operator", "port_terminal_operator", "air_freight_operator", "fleet_manager_logistics", "fleet_manager_retail")
DELIVERY_JOBS = ("delivery", "gig_delivery")
DELIVERY_CORE = ("delivery_driver", "fleet_manager_logistics", "budget_student", "shift_worker", "eco_warrior", "freight_operator")
CARE_JOBS, CARE_WORDS = ("school_run_then_work", "shopping_trip"), ("cruise", "island_ferry")
PASSENGER_JOBS = ("passenger_commute", "passenger_errand", "passenger_transit", "passenger_leisure", "business_travel", "passenger_special")
BUSINESS_CORE = ("business_commuter", "business_traveler", "air_freight_operator")
TOURIST_WORDS = ("scenic", "tourist_", "exploration", "cruise")
TOURIST_CORE = ("tourist", "tourist_visitor", "long_distance_commuter", "business_traveler", "eco_warrior", "retired_commuter", "elderly_non_driver", "accessibility_user")
RAIL_WORDS, RAIL_BLOCKED = ("rail", "train", "commuter_rail", "intercity_train", "multi_modal"), ("elderly_non_driver", "shift_worker")
TRADES_CORE = ("island_tradesperson", "rural_technician", "specialist_engineer", "emergency_trade_worker", "freight_operator", "delivery_driver")
TAXI_JOBS, TAXI_OPERATORS, TAXI_WORDS = ("taxi_service", "passenger_transport", "private_hire"), ("taxi", "private_hire", "ride_hail"), ("taxi", "ride_hail", "private_hire", "cab")
TAXI_CORE = ("taxi_driver", "ride_hail_driver", "delivery_driver", "frequent_driver", "shift_worker", "fleet_manager_logistics", "fleet_manager_retail")


def grams(text: Column, n: int) -> Column:
    """The distinct pieces of ``n`` letters of a text."""
    return F.array_distinct(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - n, F.lit(0))), lambda i: i + n <= F.length(text)), lambda i: F.substring(text, i + 1, F.lit(n))))


def containing(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """field, value, part: which ``parts`` (field, part) occur in which ``texts`` (field, value), both distinct, by an inverted index.

    A part is looked up by the rarest of its pieces of ``GRAM`` letters; a shorter one by itself among pieces of its length; an empty one is in every text of its field.
    """
    none = parts.filter("part = ''").join(texts, "field").select("field", "value", "part")
    found = none
    for n in range(1, GRAM + 1):
        mine = parts.filter(F.length("part") >= n if n == GRAM else F.length("part") == n)
        index = texts.select("field", "value", F.explode(grams(F.col("value"), n)).alias("gram"))
        # Of pieces that no text has nothing comes.
        rarity = index.groupBy("field", "gram").agg(F.count("*").alias("texts"))
        asked = mine.select("field", "part", F.explode(grams(F.col("part"), n)).alias("gram")).join(rarity, ["field", "gram"], "left")
        least = asked.groupBy("field", "part").agg(F.min(F.struct(F.coalesce("texts", F.lit(0)).alias("texts"), "gram")).alias("least")).select("field", "part", F.col("least.gram").alias("gram"))
        found = found.unionByName(index.join(least, ["field", "gram"]).filter(F.contains("value", "part")).select("field", "value", "part"))
    return found


def whitelist(jobs: DataFrame, personas: DataFrame, rules: DataFrame) -> DataFrame:
    """job, personas: who may do each of ``jobs`` (job, parameters, top: maps of text by field), in the order of the first rule that says so.

    ``rules``: rule (their order), persona, field, operator (equals, not_equals, contains; null: equals), value. A rule without field and operator holds for all jobs, one of
    another operator for none, one of a persona that is not in ``personas`` (persona) neither. A job's value of a field is that of its parameters, where that is
    missing or empty that of the job itself, else empty; letter case is ignored.

    Rules meet the distinct values of fields, not jobs: equality by a hash join, ``contains`` by an index of pieces. Of like rules of a persona the first stands for all; of those
    that exclude a value, the first and the first that excludes another one.
    """
    known = rules.join(personas.select("persona").distinct(), "persona", "left_semi")
    always = known.filter("field IS NULL AND operator IS NULL").groupBy("persona").agg(F.min("rule").alias("rule")).agg(F.collect_list(F.struct("rule", "persona")).alias("always"))
    conditions = known.filter("field IS NOT NULL OR operator IS NOT NULL")
    conditions = conditions.select("rule", "persona", F.coalesce("field", F.lit("")).alias("field"), F.coalesce("operator", F.lit("equals")).alias("operator"), F.lower(F.coalesce("value", F.lit(""))).alias("part"))
    conditions = kept(conditions.groupBy("persona", "field", "operator", "part").agg(F.min("rule").alias("rule")))
    fields = [r["field"] for r in conditions.select("field").distinct().limit(MOST_FIELDS + 1).collect()]
    if len(fields) > MOST_FIELDS:
        raise ValueError(f"rules name more than {MOST_FIELDS} fields")
    value = lambda f: F.lower(F.coalesce(F.nullif(F.try_element_at("parameters", F.lit(f)), F.lit("")), F.try_element_at("top", F.lit(f)), F.lit("")))
    listed = F.array(*(F.struct(F.lit(f).alias("field"), value(f).alias("value")) for f in fields)) if fields else F.expr("cast(array() AS array<struct<field: string, value: string>>)")
    held = kept(jobs.select("job", F.inline(listed)).repartition("job"))
    values = kept(held.select("field", "value").distinct())
    of = lambda operator: conditions.filter(F.col("operator") == operator)
    same = of("equals").withColumnRenamed("part", "value").join(values, ["field", "value"]).select("rule", "persona", "field", "value")
    unlike = of("not_equals").select("field", "persona", "part", "rule")
    lead = unlike.groupBy("field", "persona").agg(F.min(F.struct("rule", "part")).alias("lead"))
    second = unlike.join(lead, ["field", "persona"]).filter("part <> lead.part").groupBy("field", "persona").agg(F.min(F.struct("rule", "part")).alias("lead"))
    other = lead.unionByName(second).select("field", "persona", "lead.rule", "lead.part").join(values, "field").filter("part <> value").select("rule", "persona", "field", "value")
    inside = of("contains").join(containing(values, of("contains").select("field", "part").distinct()), ["field", "part"]).select("rule", "persona", "field", "value")
    hits = same.unionByName(other).unionByName(inside).groupBy("field", "value", "persona").agg(F.min("rule").alias("rule"))
    # A value's personas go to a job in one list.
    hits = hits.groupBy("field", "value").agg(F.collect_list(F.struct("rule", "persona")).alias("who"))
    mine = held.join(hits, ["field", "value"]).groupBy("job").agg(F.flatten(F.collect_list("who")).alias("mine"))
    # One row, the rules that hold for all.
    out = jobs.select("job").distinct().join(mine, "job", "left").crossJoin(F.broadcast(always))
    ordered = F.sort_array(F.concat(F.coalesce("mine", F.expr("slice(always, 1, 0)")), F.col("always")))
    return out.select("job", F.array_distinct(F.transform(ordered, lambda x: x["persona"])).alias("personas"))


def cascade() -> list[tuple[Column, Column]]:
    """When each stage decides, and what: the first that applies has the last word.

    Columns: persona, persona_type, job, job_type, operator_type, vehicle_type, all in lower case.
    """
    c = F.col
    named = lambda words: any_of([F.contains("job", F.lit(w)) for w in words])
    who = lambda names: c("persona").isin(*names)
    passenger, freight = c("persona_type") == "passenger", c("persona_type") == "freight"
    health = who(HEALTH_CORE) | (who(HEALTH_CONTRACTED) & c("job_type").isin(*HEALTH_CONTRACTS)) | (freight & named(HEALTH_GOODS)) | (who(HEALTH_COMMUTERS) & named(("commute",)))
    heavy = who(FREIGHT_CORE) | (who(("delivery_driver",)) & ~F.contains("vehicle_type", F.lit("heavy"))) | (who(("eco_warrior",)) & named(("barge",))) | (who(("shift_worker",)) & named(("offshore",)))
    delivery = F.when(F.contains("job_type", F.lit("passenger")) | named(("scooter",)), passenger & ~who(("elderly_non_driver",))).otherwise(who(DELIVERY_CORE))
    care = F.when(freight & ~F.contains("persona", F.lit("operator")), False).otherwise((who(("port_terminal_operator",)) & named(("cruise",))) | passenger)
    transit = (
        F.when(freight, c("job_type") == "passenger_commute")
        .when(c("job_type") == "business_travel", who(BUSINESS_CORE))
        .when((c("job_type") == "passenger_special") | named(TOURIST_WORDS), who(TOURIST_CORE))
        .when(named(RAIL_WORDS), passenger & ~who(RAIL_BLOCKED))
        .otherwise(True)
    )
    return [
        ((c("operator_type") == "healthcare") | named(HEALTH_WORDS), health),
        (c("job_type").isin(*FREIGHT_JOBS) | c("operator_type").isin(*FREIGHT_OPERATORS), heavy),
        (c("job_type").isin(*DELIVERY_JOBS) | named(("last_mile",)), delivery),
        (c("job").isin(*CARE_JOBS) | named(CARE_WORDS), care),
        (c("job_type").isin(*PASSENGER_JOBS), transit),
        (c("job_type") == "service", who(TRADES_CORE)),
        (c("job_type").isin(*TAXI_JOBS) | c("operator_type").isin(*TAXI_OPERATORS) | named(TAXI_WORDS), who(TAXI_CORE)),
    ]


def compatible(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """``pairs`` (persona, persona_type, job, job_type, operator_type, vehicle_type) with ``stage`` and ``compatible``.

    A pair in ``listed`` (job, personas) fits at stage 0; else the first stage of the :func:`cascade` that applies decides, and where none does the pair doesn't fit and has no stage.
    A missing persona_type counts as passenger, a missing job_type as general, other missing texts as empty.
    """
    default = {"persona_type": "passenger", "job_type": "general", "operator_type": "", "vehicle_type": ""}
    plain = pairs.withColumns({c: F.coalesce(F.lower(c) if c != "vehicle_type" else F.col(c), F.lit(v)) for c, v in default.items()})
    allowed = listed.select("job", F.explode("personas").alias("persona")).distinct().withColumn("__listed", F.lit(True))
    stages = cascade()
    stage = F.when(F.col("__listed"), 0)
    fits = F.when(F.col("__listed"), True)
    for i, (when, verdict) in enumerate(stages, 1):
        stage, fits = stage.when(when, i), fits.when(when, verdict)
    met = plain.join(allowed, ["job", "persona"], "left").withColumns({"stage": stage, "compatible": F.coalesce(fits, F.lit(False))})
    return met.select(*pairs.columns, "stage", "compatible")
