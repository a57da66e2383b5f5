"""Graph queries on all rows of the tables against brute force."""

import heapq
import inspect
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import catalog
from corvane.operators import graph
from oracle import DATA


def test_components_of_all_trades_equal_brute_force(spark):
    pairs = duckdb.sql(f"select distinct l_partkey * 2, l_suppkey * 2 + 1 from '{DATA}/lineitem.parquet'").fetchall()
    above = {}

    def top(x):
        while above.setdefault(x, x) != x:
            x = above[x]
        return x

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        above[b] = a
    got = {r.node: r.component for r in catalog.QUERIES["connected_components"](spark, DATA).collect()}
    assert got == {x: top(x) for x in above}


def follows():
    rows = duckdb.sql(f"select cast(ts as date), user_id from '{DATA}/events.parquet' order by cast(ts as date), ts, event_id").fetchall()
    return {(a, b) for (day, a), (next_day, b) in zip(rows, rows[1:]) if day == next_day and a != b}


def least_costs(edges, cost):
    start = min(a for a, _ in edges)
    best, heap = {}, [(0, start)]
    while heap:
        d, x = heapq.heappop(heap)
        if x not in best:
            best[x] = d
            for a, b in edges:
                if a == x:
                    heapq.heappush(heap, (d + cost(a, b), b))
    return best


def test_paths_over_all_hours_equal_brute_force(spark):
    edges = follows()
    assert {r.node: r.hops for r in catalog.QUERIES["breadth_first_hops"](spark, DATA).collect()} == least_costs(edges, lambda a, b: 1)
    assert {r.node: r.cost for r in catalog.QUERIES["shortest_paths"](spark, DATA).collect()} == least_costs(edges, lambda a, b: 1 + (a * 31 + b * 17) % 23)


def test_triangles_over_all_hours_equal_brute_force(spark):
    near = {}
    for a, b in follows():
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {x: (len(n), sum(q in near[p] for p, q in combinations(n, 2))) for x, n in near.items()}
    got = {r.node: (r.degree, r.triangles) for r in catalog.QUERIES["clustering"](spark, DATA).collect()}
    assert got == want
    assert {r.node for r in catalog.QUERIES["eigenvector_centrality"](spark, DATA).select("node").collect()} == set(near)


def test_paths_have_no_bound_of_rounds():
    # A path of more than 1,000 edges takes minutes to walk here.
    for f in (graph.hops, graph.shortest_paths):
        assert list(inspect.signature(f).parameters) == ["edges", "sources"]


def test_eigenvector_converges_or_raises(spark):
    path = np.diag(np.ones(7), 1) + np.diag(np.ones(7), -1)
    want = np.abs(np.linalg.eigh(path)[1][:, -1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    got = {r.node: r.score for r in graph.eigenvector_centrality(edges).collect()}
    assert [got[i] for i in range(8)] == pytest.approx(want / want.max(), abs=1e-5)
    with pytest.raises(RuntimeError):
        graph.eigenvector_centrality(edges, rounds=2)


def test_journeys_from_every_stop_equal_brute_force(spark):
    stops = duckdb.sql(f"select s_suppkey, s_nationkey % 5, s_acctbal from '{DATA}/supplier.parquet' order by 1").fetchall()
    routes = {}
    for key, route, balance in stops:
        at = routes.setdefault(route, [])
        at.append((key, at[-1][1] + int(60 + abs(balance - at[-1][2])) if at else 0, balance))
    keys, want = {k for k, *_ in stops}, {}
    for origin in keys:
        best = marked = {origin: 0.0}
        for turn in range(3):
            offers = {}
            for at in routes.values():
                for i, (u, t, _) in enumerate(at):
                    for v, later, _ in at[i + 1 :] if u in marked else ():
                        there = marked[u] + 300 + 600 * (turn > 0) + later - t
                        for stop, seconds in ((v, there), (v + 1, there + 300)):
                            if stop in keys:
                                offers[stop] = min(seconds, offers.get(stop, seconds))
            marked = {k: s for k, s in offers.items() if s < best.get(k, float("inf"))}
            best = best | marked
        want |= {(origin, k): s for k, s in best.items()}
    got = {(r.origin, r.stop): r.seconds for r in catalog.QUERIES["transit_journeys"](spark, DATA).collect()}
    assert got == pytest.approx(want)


def test_hops_over_many_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROUNDS", 3)
    edges = [(i, i + 1) for i in range(11)] + [(5, 2), (3, 40), (40, 41), (11, 0)]
    got = {r.node: r.hops for r in graph.hops(spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame([(0,), (0,)], "node int")).collect()}
    assert got == {i: i for i in range(12)} | {40: 4, 41: 5}


def test_following_rows_over_partitions(spark):
    from corvane.operators import stats

    rows = [(k, i * 7 % 100, i, None if i % 9 == 0 else i) for k in "ab" for i in range(100)] + [("c", 1, 1, 5)]
    got = stats.following(spark.createDataFrame(rows, "key string, t int, n int, v int").repartition(5), "key", ["t", "n"], "v").collect()
    want = {}
    for k in "abc":
        mine = sorted(r for r in rows if r[0] == k)
        want |= {(k, r[2]): n[3] if n else None for r, n in zip(mine, [*mine[1:], None])}
    assert {(r.key, r.n): r.next for r in got} == want and len(got) == len(rows)


def test_degrees_count_each_two_nodes_once(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 3), (3, 1)], "src long, dst long")
    assert {r.node: r.degree for r in graph.degrees(edges).collect()} == {1: 2, 2: 1, 3: 1}


def test_clustering_builds_no_pair_of_neighbours(spark):
    # Each of 1500 nodes with each of 1500 others: 3.4 billion pairs of neighbours, no triangle but those of the last three edges.
    two = spark.range(1500).select(F.col("id").alias("src")).crossJoin(spark.range(1500, 3000).select(F.col("id").alias("dst")))
    three = spark.createDataFrame([(5000, 5001), (5001, 5002), (5002, 5000)], "src long, dst long")
    got = {r.node: (r.degree, r.triangles, r.clustering) for r in graph.clustering(two.union(three)).collect()}
    assert got == {i: (1500, 0, 0.0) for i in range(3000)} | {i: (2, 1, 1.0) for i in (5000, 5001, 5002)}
