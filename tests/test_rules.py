"""Rules as rows and nearest rows against loops."""

import math
import random

import pytest

from corvane.operators import joins, rules

JOBS = "job string, parameters map<string, string>, top map<string, string>"
RULES = "rule int, persona string, field string, operator string, value string"


def allowed(spark, jobs, personas, listed):
    found = rules.whitelist(spark.createDataFrame(jobs, JOBS), spark.createDataFrame([(p,) for p in personas], "persona string"), spark.createDataFrame(listed, RULES))
    return {r.job: r.personas for r in found.collect()}


def looped(jobs, personas, listed):
    out = {j: [] for j, _, _ in jobs}
    for _, persona, field, operator, value in sorted(listed, key=lambda r: r[0]):
        if persona not in personas:
            continue
        for j, params, top in jobs:
            held = (params.get(field) or top.get(field) or "").lower()
            part = (value or "").lower()
            fits = (field is None and operator is None) or {"equals": held == part, "not_equals": held != part, "contains": part in held}.get(operator or "equals", False)
            if fits and persona not in out[j]:
                out[j].append(persona)
    return out


def test_rules_of_every_kind(spark):
    jobs = [("shift_transit", {"vehicle_type": "Bus"}, {}), ("cargo_vessel_run", {"vehicle_type": "vessel"}, {}), ("supertanker", {"vehicle_type": "heavy_vessel"}, {"job_type": "freight"})]
    people = ["dock_worker", "freight_captain"]
    one = lambda *rule: allowed(spark, jobs, people, [(1, *rule)])
    assert one("dock_worker", "vehicle_type", "equals", "bus") == {"shift_transit": ["dock_worker"], "cargo_vessel_run": [], "supertanker": []}
    assert one("dock_worker", "vehicle_type", "not_equals", "vessel") == {"shift_transit": ["dock_worker"], "cargo_vessel_run": [], "supertanker": ["dock_worker"]}
    assert one("GHOST", "vehicle_type", "equals", "bus") == {j: [] for j, _, _ in jobs}
    assert one("dock_worker", None, None, None) == {j: ["dock_worker"] for j, _, _ in jobs}
    assert one("freight_captain", "vehicle_type", "contains", "VESSEL") == {"shift_transit": [], "cargo_vessel_run": ["freight_captain"], "supertanker": ["freight_captain"]}
    assert one("freight_captain", "job_type", "starts", "f") == {j: [] for j, _, _ in jobs}
    assert allowed(spark, [], people, []) == {}


def test_random_rules_equal_a_loop(spark):
    rng = random.Random(3)
    word = lambda most: "".join(rng.choice("abAB") for _ in range(rng.randint(0, most)))
    jobs = [(f"j{i}", {f: word(7) for f in "xy" if rng.random() < 0.7}, {f: word(7) for f in "xz" if rng.random() < 0.7}) for i in range(40)]
    listed = [(i, rng.choice("pqrs"), rng.choice(["x", "y", "z", "none"]), rng.choice(["equals", "not_equals", "contains", "contains", None, "other"]), rng.choice([word(4), None])) for i in range(40)] + [(17, "t", None, None, None), (18, "t", "x", "equals", "ab")]
    assert allowed(spark, jobs, set("pqrt"), listed) == looped(jobs, set("pqrt"), listed)


def test_listed_pairs_come_before_the_cascade(spark):
    pairs = [("tourist", "passenger", "parcel", "delivery", "", ""), ("eco_warrior", None, "parcel", "delivery", None, None), ("tourist", None, "x", None, None, None), ("delivery_driver", "freight", "x", "FREIGHT", "", "heavy_truck"), ("shift_worker", "passenger", "night_train", "passenger_transit", "", "")]
    frame = spark.createDataFrame(pairs, "persona string, persona_type string, job string, job_type string, operator_type string, vehicle_type string")
    listed = spark.createDataFrame([("parcel", ["tourist", "tourist"])], "job string, personas array<string>")
    got = {(r.persona, r.job): (r.stage, r.compatible) for r in rules.compatible(frame, listed).collect()}
    assert got == {("tourist", "parcel"): (0, True), ("eco_warrior", "parcel"): (3, True), ("tourist", "x"): (None, False), ("delivery_driver", "x"): (2, False), ("shift_worker", "night_train"): (5, False)}


def km(a, b):
    (x, y), (u, v) = a, b
    h = math.sin(math.radians(v - y) / 2) ** 2 + math.cos(math.radians(y)) * math.cos(math.radians(v)) * math.sin(math.radians(u - x) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize(("k", "most"), [(1, None), (3, None), (2, 700.0)])
def test_nearest_rows_all_over_the_globe(spark, k, most):
    rng = random.Random(k)
    place = lambda: rng.choice([(rng.uniform(-180, 180), rng.uniform(-90, 90)), (rng.choice([-179.99, 179.99]), rng.uniform(-5, 5)), (rng.uniform(-180, 180), rng.choice([-89.9, 89.9])), (-3.2 + rng.uniform(0, 0.1), 55.9)])
    left = [(i, *place()) for i in range(70)] + [(70, None, 1.0), (71, 0.0, 90.0)]
    right = [(i, *place()) for i in range(50)] + [(50, *left[0][1:]), (51, *left[0][1:]), (52, 1.0, None)]
    more = {} if most is None else {"farthest_km": most}
    got = {}
    schema = "id int, lon double, lat double"
    for r in joins.nearest(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), k, first_km=50.0, fits="a.id <> b.id", **more).collect():
        got[r.id, r.rank] = (r.other, pytest.approx(r.km, abs=1e-6))
    want = {}
    for i, *a in left:
        if a[0] is not None:
            near = sorted((round(km(a, b), 7), o) for o, *b in right if b[1] is not None and o != i and (most is None or km(a, b) <= most))
            want |= {(i, n): (o, d) for n, (d, o) in enumerate(near[:k], 1)}
    assert got == want
    assert joins.nearest(spark.createDataFrame(left, schema), spark.createDataFrame([], schema), k).count() == 0


def test_like_rules_of_a_persona_meet_no_job_twice(spark, monkeypatch):
    jobs = [(f"j{i}", {"kind": f"k{i}"}, {}) for i in range(5)]
    listed = [(n, f"p{n % 2}", "kind", "not_equals", f"K{n // 2 % 3}") for n in range(90)] + [(200 - n, "p2", None, None, None) for n in range(40)] + [(300 + n, "p3", "kind", "equals", "k1") for n in range(40)]
    joined, kind = [], type(spark.range(0))
    real = kind.join
    monkeypatch.setattr(kind, "join", lambda self, other, *a, **k: joined.append(out := real(self, other, *a, **k)) or out)
    assert allowed(spark, jobs, [f"p{i}" for i in range(4)], listed) == looped(jobs, [f"p{i}" for i in range(4)], listed)
    # The first join keeps the rules of known personas.
    pairs = [d for d in joined[1:] if {"persona", "value"} <= set(d.columns)]
    assert pairs and all(d.count() <= 20 for d in pairs)
