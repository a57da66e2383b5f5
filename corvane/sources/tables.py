"""Stop registers, profiles, scenarios and event files as DataFrames, and tables written out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Other names under which stop registers have a column.
ALIASES = {"atcocode": ("atco_code", "stopid"), "commonname": ("common_name", "name"), "longitude": ("lon", "lng"), "latitude": ("lat",), "stoptype": ("stop_type", "type"), "nptglocalitycode": ("locality_code", "locality")}
ACTIVE = ("active", "act", "1", "true")


def stop_register(spark: SparkSession, path: str, kinds: list[str] | None = None, localities: str | None = None) -> DataFrame:
    """Active stops with coordinates: stop_id, name (with its locality's name unless it has it), kind, lon, lat."""
    raw = spark.read.csv(path, header=True)
    raw = raw.toDF(*(c.lstrip("﻿").strip().lower() for c in raw.columns))
    column = lambda name: next((F.col(c) for c in (name, *ALIASES.get(name, ())) if c in raw.columns), F.lit(None).cast("string"))
    out = raw.select(
        column("atcocode").alias("stop_id"), F.coalesce(column("commonname"), F.lit("")).alias("name"), column("stoptype").alias("kind"), column("longitude").try_cast("double").alias("lon"),
        column("latitude").try_cast("double").alias("lat"), column("nptglocalitycode").alias("locality"), F.coalesce(F.lower(column("status")), F.lit("active")).alias("status"),
    )
    out = out.filter(F.col("status").isin(*ACTIVE) & F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~((F.col("lon") == 0) & (F.col("lat") == 0)))
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if localities:
        names = spark.read.csv(localities, header=True)
        names = names.toDF(*(c.lstrip("﻿").strip().lower() for c in names.columns)).groupBy(F.col("nptglocalitycode").alias("locality")).agg(F.max("localityname").alias("place"))
        out = out.join(names, "locality", "left")
        out = out.withColumn("name", F.when(F.col("place").isNotNull() & ~F.contains(F.lower("name"), F.lower("place")), F.concat_ws(", ", "name", "place")).otherwise(F.col("name")))
    return out.select("stop_id", "name", "kind", "lon", "lat")


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text."""
    return spark.read.csv(path, header=True)


SCENARIO = T.StructType(
    [T.StructField("name", T.StringType()), T.StructField("description", T.StringType()), T.StructField("policies", T.ArrayType(T.StructType([T.StructField("parameter", T.StringType()), T.StructField("value", T.StringType()), T.StructField("target", T.StringType()), T.StructField("mode", T.StringType())])))]
)


def scenarios(spark: SparkSession, text: str) -> DataFrame:
    """Scenarios of a YAML text of one or more documents; those without a name are left out."""
    import yaml

    rows = []
    for doc in yaml.safe_load_all(text):
        if isinstance(doc, dict) and doc.get("name"):
            policies = [{k: None if p.get(k) is None else str(p[k]) for k in ("parameter", "value", "target", "mode")} for p in doc.get("policies") or []]
            rows.append((str(doc["name"]), doc.get("description"), policies))
    return spark.createDataFrame(rows, SCENARIO)


def by_target(found: DataFrame, target: str) -> DataFrame:
    """Scenarios with a policy of that target."""
    return found.filter(F.exists("policies", lambda p: p["target"] == target))


#: What a library's personas and jobs have without saying so.
DESIRES = ("eco", "time", "cost", "comfort", "safety", "reliability", "flexibility")
DESIRE, VARIANCE, PERSONA_TYPE = 0.5, 0.1, "passenger"
JOB_PARAMETERS = {"urgency": "medium", "recurring": "True", "vehicle_type": "unknown"}
#: Fixed value: part of a constraint's limit from which on it warns.
WARNING = 0.8


def _texts(values: dict | None) -> dict[str, str]:
    return {str(k): str(v) for k, v in (values or {}).items() if v is not None and not isinstance(v, (dict, list))}


def combined_scenarios(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Tables of a YAML text of combined scenarios, a document each (name and base_scenarios are needed, others are left out).

    bases: scenario, place, base; rules: scenario, place, condition, action, parameters (map of text), priority (0), cooldown (0);
    constraints: scenario, kind, limit, warning (0.8); loops: scenario, name, loop_type, strength (1), variables.
    """
    import yaml

    bases, rules, limits, loops = [], [], [], []
    for doc in yaml.safe_load_all(text):
        if not isinstance(doc, dict) or not doc.get("name") or "base_scenarios" not in doc:
            continue
        name = str(doc["name"])
        bases += [(name, i, str(b)) for i, b in enumerate(doc["base_scenarios"] or [])]
        rules += [(name, i, str(r["condition"]), str(r["action"]), _texts(r.get("parameters")), int(r.get("priority", 0)), int(r.get("cooldown_steps", 0))) for i, r in enumerate(doc.get("interaction_rules") or [])]
        limits += [(name, str(c["type"]), float(c["limit"]), float(c.get("warning_threshold", WARNING))) for c in doc.get("constraints") or []]
        loops += [(name, str(x["name"]), str(x["loop_type"]), float(x.get("strength", 1.0)), [str(v) for v in x.get("variables") or []]) for x in doc.get("feedback_loops") or []]
    made = spark.createDataFrame
    return {
        "bases": made(bases, "scenario string, place int, base string"),
        "rules": made(rules, "scenario string, place int, condition string, action string, parameters map<string, string>, priority int, cooldown int"),
        "constraints": made(limits, "scenario string, kind string, limit double, warning double"),
        "loops": made(loops, "scenario string, name string, loop_type string, strength double, variables array<string>"),
    }


def merged_policies(bases: DataFrame, found: DataFrame) -> DataFrame:
    """scenario, parameter, target, mode, value: the policies of a combined scenario's bases (see :func:`combined_scenarios`) among ``found`` (see :func:`scenarios`); of those for the same thing the last one holds. Unknown bases add nothing."""
    each = bases.join(found.select(F.col("name").alias("base"), F.posexplode("policies").alias("k", "p")), "base").select("scenario", "place", "k", "p.*")
    last = each.groupBy("scenario", "parameter", "target", "mode").agg(F.max_by("value", F.struct("place", "k")).alias("value"))
    return last.select("scenario", "parameter", "target", "mode", "value")


def story_library(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Tables of a library of stories in YAML (personas, job_stories, compatibility_rules), with what it leaves unsaid filled in.

    personas: persona, persona_type, narrative, desires (map), desire_variance; jobs: job, parameters, top (maps of text); rules: rule, persona, field, operator, value. They are what
    ``operators.rules.whitelist`` takes. Entries that are no mappings are left out; a rule without a condition has no field, operator and value.
    """
    import yaml

    doc = yaml.safe_load(text) or {}
    people, jobs, rules = [], [], []
    for name, p in (doc.get("personas") or {}).items():
        if isinstance(p, dict):
            desires = dict.fromkeys(DESIRES, DESIRE) | {str(k): float(v) for k, v in (p.get("desires") or {}).items()}
            people.append((str(name), str(p.get("persona_type", PERSONA_TYPE)), p.get("narrative"), desires, float(p.get("desire_variance", VARIANCE))))
    for name, j in (doc.get("job_stories") or {}).items():
        if isinstance(j, dict):
            jobs.append((str(name), JOB_PARAMETERS | _texts(j.get("parameters")), _texts(j)))
    for i, r in enumerate(doc.get("compatibility_rules") or []):
        if isinstance(r, dict):
            c = r.get("condition")
            part = (None, None, None) if c is None else (str(c.get("field", "")), str(c.get("operator", "equals")), str(c.get("value", "")))
            rules.append((i, str(r.get("persona")), *part))
    made = spark.createDataFrame
    return {
        "personas": made(people, "persona string, persona_type string, narrative string, desires map<string, double>, desire_variance double"),
        "jobs": made(jobs, "job string, parameters map<string, string>, top map<string, string>"),
        "rules": made(rules, "rule int, persona string, field string, operator string, value string"),
    }


def write_log(frames: list[DataFrame], path: str) -> None:
    """Step logs of differing columns as one CSV: step first, the others sorted, blank where a log lacks one."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    columns = [c for c in ("step",) if c in out.columns] + sorted(c for c in out.columns if c != "step")
    out.select(columns).write.csv(path, header=True, mode="overwrite")


def tall_report(rows: DataFrame, units: dict[str, str]) -> DataFrame:
    """One row of figures as metric, value, unit."""
    parts = [F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(u).alias("unit")) for m, u in units.items()]
    return rows.select(F.inline(F.array(*parts)))
