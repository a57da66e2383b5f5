import zipfile
from datetime import date

import pytest

from corvane.sources import feed, tables

FILES = {
    "calendar.txt": "﻿service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20240101,20241231\nwe,0,0,0,0,0,1,1,20240101,20241231\nbad,1,1,1,1,1,1,1,x,y\n",
    "calendar_dates.txt": "service_id,date,exception_type\nwe,20240103,1\n",
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon,parent_station\np,Parent,55.95,-3.19,\nc,Child,0,0,p\no,Orphan,0,0,\nz,Far,10,10,\n",
    "stop_times.txt": "trip_id,stop_id,arrival_time,departure_time,stop_sequence\nt1,p,07:00:00,07:00:00,1\nt1,c,07:05:00,,2\nt2,p,07:20:00,07:20:00,1\nt2,c,bad,,2\nt3,p,25:10:00,25:10:00,1\nt4,o,07:00:00,07:00:00,1\n",
    "trips.txt": "trip_id,route_id,service_id,shape_id\nt1,r1,wk,s1\nt2,r1,wk,s1\nt3,r2,we,\nt4,r3,wk,\n",
    "routes.txt": "route_id,route_short_name,route_long_name,route_type\nr1,1,Electric line,3\nr2,T,Tram,0\nr3,X,Gone,3\n",
    "shapes.txt": "shape_id,shape_pt_sequence,shape_pt_lat,shape_pt_lon\ns1,1,55.9,-3.2\nq,1,1,1\n",
}


@pytest.fixture(params=["folder", "zip"])
def path(request, tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).write_text(body)
    if request.param == "folder":
        return str(tmp_path)
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        for name in FILES:
            z.write(tmp_path / name, f"inner/{name}")
    return str(tmp_path / "feed.zip")


def test_feed(spark, path):
    found = feed.load(spark, path, day=date(2024, 1, 3), box=(-5, 50, 0, 60))
    assert {r.stop_id: (r.lon, r.lat) for r in found["stops"].collect()} == {"p": (-3.19, 55.95), "c": (-3.19, 55.95)}
    assert {r.trip_id for r in found["trips"].collect()} == {"t1", "t2", "t3"}
    assert {r.route_id: (r.mode, r.fuel) for r in found["routes"].collect()} == {"r1": ("bus", "electric"), "r2": ("tram", "electric")}
    assert {r.shape_id for r in found["shapes"].collect()} == {"s1"}
    assert {(r.route_id, r.stop_id): r.headway for r in feed.headways(found).collect()}["r1", "p"] == 1200
    edge = feed.edges(found).collect()
    assert [(r.u, r.v, r.seconds, r.trips) for r in edge] == [("p", "c", 300.0, 1)]


def test_missing_files_are_empty(spark, tmp_path):
    (tmp_path / "stops.txt").write_text("stop_id,stop_lat,stop_lon\na,1,1\n")
    found = feed.load(spark, str(tmp_path))
    assert found["stops"].count() == 1 and found["trips"].count() == 0


def test_stop_register(spark, tmp_path):
    (tmp_path / "s.csv").write_text("ATCOCode,CommonName,StopType,Status,Longitude,Latitude,NptgLocalityCode\n1,High St,BCT,active,-3,55,L\n2,Leith Walk,BCT,del,-3,55,L\n3,Edinburgh Park,RSE,1,-3,55,L\n4,Bad,BCT,active,0,0,L\n")
    (tmp_path / "l.csv").write_text("NptgLocalityCode,LocalityName\nL,Edinburgh\n")
    got = {r.stop_id: r.name for r in tables.stop_register(spark, str(tmp_path / "s.csv"), localities=str(tmp_path / "l.csv")).collect()}
    assert got == {"1": "High St, Edinburgh", "3": "Edinburgh Park"}


def test_scenarios(spark):
    found = tables.scenarios(spark, "name: a\npolicies:\n - {parameter: x, value: 1, target: infrastructure}\n---\ndescription: none\n---\nname: b\n")
    assert sorted(r.name for r in found.collect()) == ["a", "b"]
    assert [r.name for r in tables.by_target(found, "infrastructure").collect()] == ["a"]


def test_log_and_report(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "step int, mode string"), spark.createDataFrame([(2, 0.5)], "step int, km double")
    tables.write_log([a, b], str(tmp_path / "log"))
    got = tables.profiles(spark, str(tmp_path / "log"))
    assert got.columns == ["step", "km", "mode"] and got.count() == 2
    assert tables.tall_report(b, {"km": "km", "step": ""}).count() == 2


def test_feed_values(spark, tmp_path):
    for name, body in FILES.items():
        (tmp_path / name).write_text(body)
    (tmp_path / "routes.txt").write_text("route_id,route_desc,route_long_name,route_type\nr1,battery bus,Line,3\nr2,,Electric boat,4\n")
    (tmp_path / "calendar_dates.txt").write_text("service_id,date,exception_type\nwe,20240103,2\nwe,20240103,1\nwk,20240103,1\nwk,20240103,2\n")
    every = feed.load(spark, str(tmp_path))
    assert {r.route_id: (r.mode, r.fuel) for r in every["routes"].collect()} == {"r1": ("bus", "electric"), "r2": ("ferry_electric", "electric")}
    known = feed.load(spark, str(tmp_path), fuels={"r2": "hydrogen"})["routes"].collect()
    assert {r.route_id: (r.mode, r.fuel) for r in known} == {"r1": ("bus", "electric"), "r2": ("ferry_diesel", "hydrogen")}
    # The last exception of a service counts: the weekend runs, the week does not.
    assert {r.trip_id for r in feed.load(spark, str(tmp_path), day=date(2024, 1, 3))["trips"].collect()} == {"t3"}
    assert {(r.kind, r.name): r.n for r in feed.summary(every).collect()}["rows", "trips"] == every["trips"].count()
    assert {(r.route_id, r.u, r.v): (r.seconds, r.trips) for r in feed.pair_times(every).collect()}["r1", "p", "c"] == (300.0, 1)


def test_combined_scenarios(spark):
    found = tables.scenarios(spark, "name: a\npolicies:\n - {parameter: x, value: 1, target: grid}\n - {parameter: y, value: 5, target: grid}\n---\nname: b\npolicies:\n - {parameter: x, value: 2, target: grid}\n")
    text = "name: both\nbase_scenarios: [a, b, missing]\ninteraction_rules:\n - {condition: 'step > 1', action: add_chargers, priority: 3, parameters: {n: 5}}\n - {condition: 'step > 2', action: stop}\nconstraints:\n - {type: budget, limit: 100}\nfeedback_loops:\n - {name: l, description: d, variables: [p, q], loop_type: reinforcing}\n---\ndescription: none\n---\nname: other\n"
    got = tables.combined_scenarios(spark, text)
    assert [(r.condition, r.parameters, r.priority, r.cooldown) for r in got["rules"].orderBy("place").collect()] == [("step > 1", {"n": "5"}, 3, 0), ("step > 2", {}, 0, 0)]
    assert [tuple(r) for r in got["constraints"].collect()] == [("both", "budget", 100.0, 0.8)]
    assert [(r.loop_type, r.strength, r.variables) for r in got["loops"].collect()] == [("reinforcing", 1.0, ["p", "q"])]
    assert {(r.scenario, r.parameter): r.value for r in tables.merged_policies(got["bases"], found).collect()} == {("both", "x"): "2", ("both", "y"): "5"}


LIBRARY = """
personas:
  docker: {narrative: likes ships, desires: {time: 0.9}}
  captain: {persona_type: freight}
  broken: 5
job_stories:
  shift: {job_type: service, parameters: {vehicle_type: bus}}
  voyage: {job_type: freight, parameters: {vehicle_type: Vessel, urgency: high}}
  plain: {job_type: freight}
compatibility_rules:
  - {persona: captain, condition: {field: job_type, operator: equals, value: freight}}
  - {persona: docker, condition: {field: vehicle_type, operator: not_equals, value: vessel}}
  - {persona: ghost}
  - {persona: captain}
"""


def test_story_library_and_its_whitelist(spark):
    from corvane.operators.rules import whitelist

    got = tables.story_library(spark, LIBRARY)
    people = {r.persona: r for r in got["personas"].collect()}
    assert set(people) == {"docker", "captain"} and people["docker"].desires["time"] == 0.9 and people["docker"].desires["eco"] == 0.5
    assert people["captain"].persona_type == "freight" and people["docker"].persona_type == "passenger" and people["docker"].desire_variance == 0.1
    jobs = {r.job: r for r in got["jobs"].collect()}
    assert jobs["plain"].parameters == {"urgency": "medium", "recurring": "True", "vehicle_type": "unknown"} and jobs["voyage"].parameters["urgency"] == "high"
    assert {r.job: r.personas for r in whitelist(got["jobs"], got["personas"], got["rules"]).collect()} == {"shift": ["docker", "captain"], "voyage": ["captain"], "plain": ["captain", "docker"]}


def test_feed_checks(spark):
    stops = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0)], "stop_id string, lon double, lat double")
    links = lambda *h: spark.createDataFrame([("bus", x) for x in h], "mode string, headway int")
    got = lambda s, e: {r.name: (r.state, r.n) for r in feed.checked({"stops": s}, e).collect()}
    assert got(stops, links(600, 10, 9000)) == {"stops at 0, 0": ("fail", 1), "short headways": ("warn", 1), "mode bus": ("ok", 3)}
    assert got(stops.filter("stop_id = 'b'"), links(600, 9000)) == {"stops at 0, 0": ("ok", 0), "long headways": ("warn", 1), "mode bus": ("ok", 2)}
    assert got(stops.limit(0), links(600)) == {"stops at 0, 0": ("ok", 0), "headways": ("ok", 1), "mode bus": ("ok", 1)}
    assert got(stops.limit(0), links()) == {"stops at 0, 0": ("ok", 0), "no headways": ("warn", 0)}


def test_running_times_halve_in_the_order_of_trips(spark):
    trips = spark.createDataFrame([(f"t{i}", "r", -i) for i in range(5)], "trip_id string, route_id string, place int")
    took = {"t0": 100, "t1": 300, "t2": -5, "t3": 80, "t4": 500}
    times = spark.createDataFrame([(t, s, x, x, q) for t, d in took.items() for s, x, q in (("a", 0, 1), ("b", d, 2))], "trip_id string, stop_id string, arrival int, departure int, seq int")
    for order, names in (("trip_id", sorted(took)), ("place", sorted(took, reverse=True))):
        want = None
        for t in names:
            x = took[t] if took[t] >= 0 else 60
            want = x if want is None else (want + x) / 2
        (r,) = feed.running_pair_times({"stop_times": times, "trips": trips}, order).collect()
        assert (r.u, r.v, r.trips) == ("a", "b", 5) and r.seconds == pytest.approx(want)
