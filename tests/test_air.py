"""Scans, dispersion and limits against loops."""

import math
import random

import pytest

from corvane.operators import air, scans


@pytest.mark.parametrize("block", [2, 64])
def test_recurrences_equal_a_loop(spark, monkeypatch, block):
    monkeypatch.setattr(scans, "BLOCK", block)
    rng = random.Random(block)
    rows, want = [], {}
    for key, n in (("a", 1), ("b", 65), ("c", 200), (None, 3)):
        x = 0.0
        for place in range(n):
            # Factors of 0 and below 0, too.
            a, b = rng.choice([0.0, -0.2, 0.9, 1.0, 0.5]), rng.uniform(-1, 1)
            x = a * x + b
            want[key, place] = x
            if key is not None:
                rows.append((key, place, a, b))
    rng.shuffle(rows)
    got = scans.linear_scan(spark.createDataFrame(rows, "key string, place long, a double, b double"), ["key"], "place", "a", "b", "x").collect()
    assert len(got) == len(rows)
    assert all(r.x == pytest.approx(want[r.key, r.place], abs=1e-9) for r in got)
    assert scans.linear_scan(spark.createDataFrame([], "key string, place long, a double, b double"), ["key"], "place", "a", "b", "x").count() == 0


def looped(emissions, wind, radius=2.0, resolution=1.0):
    """Current levels and sums by cell after each step."""
    now, total, measured, out = {}, {}, {}, {}
    for step in sorted(wind):
        for s, lon, lat, *amounts in emissions:
            if s != step or lon is None:
                continue
            x, y = int(lon / resolution), int(lat / resolution)
            for dx in range(-5, 6):
                for dy in range(-5, 6):
                    far = math.hypot(dx, dy) * resolution
                    if far <= radius:
                        cell = (x + dx, y + dy)
                        share = math.exp(-far * far / (2 * (radius / 2) ** 2))
                        now[cell] = [o + (a or 0) * share for o, a in zip(now.get(cell, [0, 0, 0]), amounts, strict=True)]
                        measured[cell] = measured.get(cell, 0) + 1
        for cell in now:
            now[cell] = [v * (1 - (0.1 + (wind[step] or 0) / 100)) for v in now[cell]]
            total[cell] = [t + v for t, v in zip(total.get(cell, [0, 0, 0]), now[cell], strict=True)]
            out[step, *cell] = (*now[cell], *total[cell])
    return out, measured


def test_levels_equal_a_loop(spark):
    rng = random.Random(1)
    emissions = [(rng.randrange(12), rng.uniform(-4, 4), rng.uniform(-4, 4), rng.choice([None, 50.0]), rng.uniform(0, 900), 9000.0) for _ in range(40)] + [(3, None, 1.0, 1.0, 1.0, 1.0)]
    wind = {s: rng.choice([None, 0.0, 10.0, 55.0, 95.0]) for s in range(15)}
    e = spark.createDataFrame(emissions, "step int, lon double, lat double, pm25 double, nox double, co double")
    w = spark.createDataFrame(list(wind.items()), "step int, kmh double")
    want, measured = looped(emissions, wind)
    reached = air.spread(e)
    at = air.levels(reached, w)
    got = {(r.step, r.cell_x, r.cell_y): r for r in at.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert [got[k][c] for c in ("pm25", "nox", "co", "pm25_total", "nox_total", "co_total")] == pytest.approx(v, abs=1e-6)
    counts = {}
    for r in reached.collect():
        counts[r.cell_x, r.cell_y] = counts.get((r.cell_x, r.cell_y), 0) + r.measured
    assert counts == measured
    over = {(s, x, y, p) for (s, x, y), v in want.items() for p, i, limit in (("pm25", 0, 15.0), ("nox", 1, 200.0)) if v[i] > limit}
    assert {(r.step, r.cell_x, r.cell_y, r.pollutant) for r in air.exceedances(at, "hourly").collect()} == over and over
    assert {(r.step, r.cell_x, r.cell_y) for r in air.exceedances(at, "daily").collect()} == {k for k, v in want.items() if v[2] > 4000}
    assert air.exceedances(at, "annual").count() == 0
    last = at.filter("step = 14")
    assert {(r.cell_x, r.cell_y) for r in air.air_hotspots(last, "co", 0.01).collect()} == {k[1:] for k, v in want.items() if k[0] == 14 and v[2] > 40}
    people = [(x, y, 10.0) for x in range(-6, 7) for y in range(-6, 7)]
    for p, i, limit in (("pm25", 0, 15.0), ("nox", 1, 200.0)):
        for step in (0, 5, 14):
            r = air.exposure(spark.createDataFrame(people, "cell_x long, cell_y long, people double"), at.filter(f"step = {step}"), p).first()
            held = [want.get((step, x, y), (0, 0, 0))[i] for x, y, _ in people]
            exposed = sum(10.0 for v in held if v > limit)
            assert (r.population, r.exposed) == (1690.0, exposed) and r.weighted == pytest.approx(sum(10.0 * v / limit for v in held if v > limit))
    r = air.exposure(spark.createDataFrame([], "cell_x long, cell_y long, people double"), last, "nox").first()
    assert tuple(r) == (0.0, 0.0, 0.0, 0.0, 0.0)
