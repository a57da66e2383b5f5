"""Policies: returns, ranking, direct impact, constraints, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.cost import net_present_value


def returns(policies: DataFrame, days: int = 7, agent_revenue: float = 50.0, carbon_price: float = 25.0) -> DataFrame:
    """Cost, yearly gain, benefit-cost ratio, payback (days, infinite without gain) and value of each policy.

    ``policies``: policy, implementation, opex (a year), saved_kg, agents.
    """
    total = F.col("implementation") + F.col("opex") * days / 365
    revenue = F.when(F.lower("policy").contains("charger"), F.col("agents") * agent_revenue).otherwise(0.0)
    gain = revenue + F.col("saved_kg") / 1000 * carbon_price
    out = policies.withColumn("total_cost", total).withColumn("gain", gain)
    yearly = F.col("gain") * 365 / days
    return out.select(
        "policy", "total_cost", "gain", F.coalesce(F.try_divide("gain", "total_cost"), F.lit(0.0)).alias("bcr"),
        F.coalesce(F.try_divide(F.col("total_cost") * days, F.when(F.col("gain") > 0, F.col("gain"))), F.lit(float("inf"))).alias("payback_days"),
        net_present_value(yearly, F.col("total_cost")).alias("npv"),
    )


def ranked(policies: DataFrame, metrics: list[str]) -> DataFrame:
    """The place of each policy by each metric, greatest first; missing values count as 0."""
    out = policies.select("policy", *(F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics))
    for m in metrics:
        least = out.groupBy(m).agg(F.count("*").alias("__n"))
        above = least.select(m, F.coalesce(F.sum("__n").over(Window.orderBy(F.desc(m)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__above"))
        out = out.join(above, m).withColumn(f"{m}_rank", F.col("__above") + 1).drop("__above")
    return out.select("policy", *(f"{m}_rank" for m in metrics))


def checked(rows: DataFrame, value: str, limit: float) -> DataFrame:
    """``state`` of a constraint: violation at the limit, warning from 80 % of it on, else ok."""
    return rows.withColumn("state", F.when(F.col(value) >= limit, "violation").when(F.col(value) >= 0.8 * limit, "warning").otherwise("ok"))


#: Names that a rule's condition may use, and what stands for those that a state lacks.
RULE_DEFAULTS = {
    "grid_load": 0, "grid_capacity": 1000, "grid_utilization": 0, "charger_utilization": 0, "occupied_chargers": 0, "total_chargers": 1, "ev_adoption": 0, "ev_count": 0, "freight_ev_count": 0, "total_agents": 1, "avg_charging_cost": 0, "step": 0, "time_of_day": 8,
}
RULE_NAMES = (*RULE_DEFAULTS, "emissions", "congestion", "hour", "day", "budget", "agents", "bus_share", "car_share")


def condition(text: str, rows: DataFrame) -> Column:
    """A rule's condition over known names as a column; false where it is null or names what is neither known nor among the columns."""
    import re

    words = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'|\"[^\"]*\"", "", text))) - {"and", "or", "not", "true", "false", "True", "False"}
    lacking = words - set(rows.columns)
    if not words <= set(RULE_NAMES) or not lacking <= set(RULE_DEFAULTS):
        return F.lit(False)
    for name in lacking:
        text = re.sub(rf"\b{name}\b", str(RULE_DEFAULTS[name]), text)
    return F.coalesce(F.expr(re.sub(r"\bTrue\b", "true", re.sub(r"\bFalse\b", "false", text))), F.lit(False))


def _after(wait: int):
    """Add a step to those kept if it comes ``wait`` steps after the last of them."""
    return lambda kept, x: F.when(F.coalesce(x - F.try_element_at(kept, F.lit(-1)) >= wait, F.lit(True)), F.concat(kept, F.array(x))).otherwise(kept)


def fired(states: DataFrame, rules: list[dict], key: str = "run", step: str = "step") -> DataFrame:
    """key, step, rule: when each rule (name, condition, cooldown) fires: its condition holds and the cooldown is over.

    A firing depends on the one before, so each key and rule is a fold over its true steps in order.
    """
    parts = None
    for rule in rules:
        true = states.filter(condition(rule["condition"], states)).groupBy(key).agg(F.sort_array(F.collect_list(F.col(step).cast("long"))).alias("__s"))
        wait = max(1, int(rule.get("cooldown", 0)))
        start = F.array().cast("array<bigint>")
        fold = F.aggregate("__s", start, _after(wait))
        part = true.select(key, F.explode(fold).alias(step), F.lit(rule["name"]).alias("rule"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def actions(states: DataFrame, rules: list[dict], key: str = "run", step: str = "step") -> DataFrame:
    """key, step, place (from 1), rule, action: what is done at each step, rules of higher priority first, equal ones as listed.

    ``rules``: name, condition, action, cooldown, priority (0 if missing); see :func:`fired`.
    """
    about = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r["name"]), F.struct(F.lit(-int(r.get("priority", 0))).alias("after"), F.lit(i).alias("listed"), F.lit(r["action"]).alias("action")))))
    done = fired(states, rules, key, step).withColumn("__about", about[F.col("rule")])
    # One step of one run: as many rows as rules at most.
    place = F.row_number().over(Window.partitionBy(key, step).orderBy("__about.after", "__about.listed"))
    return done.select(key, step, place.alias("place"), "rule", F.col("__about.action").alias("action"))


#: Electric modes of freight.
FREIGHT_EVS = ("van_electric", "truck_electric", "hgv_electric")


def state_vector(agents: DataFrame, infrastructure: DataFrame, base_cost: float, key: str = "run", step: str = "step") -> DataFrame:
    """What rules look at, by run and step: of agents (run, step, mode) and infrastructure (run, step, time_of_day, grid_load, grid_capacity, grid_utilization, charger_utilization, occupied_chargers, total_chargers, price).

    What a step lacks of infrastructure is as in ``RULE_DEFAULTS``, a price 1 (times ``base_cost``); ev_adoption is the share of private electric cars.
    """
    counts = agents.groupBy(key, step).agg(F.count("*").alias("total_agents"), F.count_if(F.col("mode") == "ev").alias("ev_count"), F.count_if(F.col("mode").isin(*FREIGHT_EVS)).alias("freight_ev_count"))
    known = counts.join(infrastructure, [key, step], "left")
    built = ("time_of_day", "grid_load", "grid_capacity", "grid_utilization", "charger_utilization", "occupied_chargers", "total_chargers")
    return known.select(
        key, step, (F.col("ev_count") / F.greatest("total_agents", F.lit(1))).alias("ev_adoption"), "ev_count", "freight_ev_count", "total_agents",
        *(F.coalesce(F.col(c), F.lit(RULE_DEFAULTS[c])).alias(c) for c in built), (base_cost * F.coalesce("price", F.lit(1.0))).alias("avg_charging_cost"),
    )


def transition_probabilities(moves: DataFrame, source: str, target: str) -> DataFrame:
    """source, target, p: shares of where moves from each source go."""
    n = moves.groupBy(source, target).agg(F.count("*").alias("n"))
    return n.select(source, target, (F.col("n") / F.sum("n").over(Window.partitionBy(source))).alias("p"))


def stationary(probabilities: DataFrame, source: str, target: str, tolerance: float = 1e-9, rounds: int = 40) -> DataFrame:
    """mode, p in the long run from an even start: the matrix of moves is squared until that changes no p by ``tolerance``; raises if ``rounds`` don't reach it.

    Half of each step stays where it is, so that modes which follow each other in turn settle too; a mode without
    moves keeps what it has. The table has a row for each pair of modes, few by nature.
    """
    from corvane.operators.graph import kept

    moves = probabilities.select(F.col(source).alias("a"), F.col(target).alias("b"), "p")
    modes = kept(moves.select(F.col("a").alias("mode")).union(moves.select("b")).distinct())
    still = modes.join(moves.select(F.col("a").alias("mode")).distinct(), "mode", "left_anti").withColumn("p", F.lit(0.5))
    stay = modes.withColumn("p", F.lit(0.5)).unionByName(still).select(F.col("mode").alias("a"), F.col("mode").alias("b"), "p")
    matrix = kept(moves.withColumn("p", F.col("p") / 2).unionByName(stay).groupBy("a", "b").agg(F.sum("p").alias("p")))
    before = modes.withColumn("before", F.lit(0.0))
    for _ in range(rounds):
        right = matrix.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("p").alias("q"))
        matrix = kept(matrix.join(right, "b").groupBy("a", F.col("c").alias("b")).agg(F.sum(F.col("p") * F.col("q")).alias("p")))
        shares = matrix.groupBy(F.col("b").alias("mode")).agg((F.sum("p") / F.countDistinct("a")).alias("p"), F.countDistinct("a").alias("n"))
        # Every mode counts as a start, also those that never lead here.
        now = kept(shares.crossJoin(modes.agg(F.count("*").alias("all"))).select("mode", (F.col("p") * F.col("n") / F.col("all")).alias("p")))
        if now.join(before, "mode").agg(F.max(F.abs(F.col("p") - F.col("before")))).first()[0] < tolerance:
            return now
        before = now.withColumnRenamed("p", "before")
    raise RuntimeError(f"no long-run shares to {tolerance} after {rounds} squarings")
