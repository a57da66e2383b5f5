"""Graphs as tables of edges: components, roots, distances, shortest paths, triangles, centrality.

Loops write each round to the folder of ``spark.checkpoint.dir``, so that plans stay short and a
lost executor costs no earlier round.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Rounds of a search whose nodes lie in tables of their own before they become one.
ROUNDS = 16


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in reliable storage that all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-corvane-"))
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Each edge (src, dst) once in either direction, without loops."""
    e = edges.filter("src <> dst").select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that edges lead to, by hanging neighbours on the least one until nothing moves."""
    links = kept(edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a < b").distinct())
    state = None
    while True:
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = kept(both.filter("v > u").join(least, "u").select("v", "m").filter("v <> m").distinct())
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        links = kept(large.join(least, "v").select(F.col("least").alias("a"), F.explode(F.array("v", "m")).alias("b")).filter("a < b").distinct())
    stars = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
    return stars.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def roots(parents: DataFrame) -> DataFrame:
    """node, root: where ``parents`` (node, parent) lead, by pointer jumping; nodes of a cycle end at its least node.

    A null parent or one that is no node ends a path.
    """
    known = parents.filter("parent IS NOT NULL AND parent <> node").groupBy("node").agg(F.min("parent").alias("root"))
    at = kept(known.withColumn("least", F.least("node", "root")))
    before = None
    while True:
        further = at.select(F.col("node").alias("root"), F.col("root").alias("next"), F.col("least").alias("next_least"))
        joined = at.join(further, "root", "left")
        at = kept(joined.select("node", F.coalesce("next", "root").alias("root"), F.least("least", "next_least").alias("least"), F.col("next").isNotNull().alias("moves")))
        # Each round ends some path while any has an end, and spreads a cycle's least node until all have it.
        now = tuple(at.agg(F.count_if("moves"), F.sum(F.xxhash64("least").cast("decimal(38,0)"))).first())
        at = at.drop("moves")
        if not now[0] or now == before:
            break
        before = now
    in_cycle = at.join(at.select(F.col("node").alias("root")), "root", "left_semi").select("node", F.col("least").alias("root"))
    ends = at.join(at.select(F.col("node").alias("root")), "root", "left_anti").select("node", "root")
    tops = parents.select("node").distinct().join(at.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"))
    return ends.unionByName(in_cycle).unionByName(tops)


def cascades(adoptions: DataFrame, least: int = 3) -> DataFrame:
    """Adoptions (node, step, parent: who it was taken from) that lead back to one origin, for origins with ``least`` followers.

    origin, adopters (without the origin), first_step, duration, velocity (adopters a step, 0 within one step), farthest, mean_hops.
    A parent that is no node ends a chain; its node is then an origin.
    """
    known = kept(adoptions.join(adoptions.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi").select("node", "parent").filter("node <> parent"))
    of = kept(roots(known.unionByName(adoptions.select("node", F.lit(None).cast(adoptions.schema["parent"].dataType).alias("parent")).join(known.select("node"), "node", "left_anti"))))
    reverse = known.select(F.col("parent").alias("src"), F.col("node").alias("dst"))
    away = hops(reverse, of.filter("node = root").select("node"))
    each = adoptions.select("node", "step").join(of, "node").join(away, "node").filter("hops > 0")
    out = each.groupBy(F.col("root").alias("origin")).agg(F.count("*").alias("adopters"), F.min("step").alias("first_step"), (F.max("step") - F.min("step")).alias("duration"), F.max("hops").alias("farthest"), F.avg("hops").alias("mean_hops"))
    return out.filter(F.col("adopters") >= least).withColumn("velocity", F.coalesce(F.try_divide("adopters", F.nullif("duration", F.lit(0))), F.lit(0.0)))


def hops(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, hops from the nearest of ``sources`` (node), along directed edges (src, dst): breadth first, until no node is new."""
    parts = [kept(sources.select("node").distinct().withColumn("hops", F.lit(0)))]
    depth = 0
    while True:
        depth += 1
        seen = parts[0]
        for part in parts[1:]:
            seen = seen.unionByName(part)
        new = edges.join(parts[-1].filter(F.col("hops") == depth - 1).select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = kept(new.withColumn("hops", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        # What is known is only written anew once in so many rounds.
        parts = [*parts, frontier] if len(parts) < ROUNDS else [kept(seen.unionByName(frontier))]


def shortest_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """node, cost, via (the node before it; of equal paths the least): relaxation from ``sources`` over edges (src, dst, cost >= 0), until no cost falls."""
    best = kept(sources.select("node").distinct().select("node", F.lit(0.0).alias("cost"), F.lit(None).cast(edges.schema["src"].dataType).alias("via")))
    frontier = best
    while True:
        reached = edges.join(frontier.select(F.col("node").alias("src"), F.col("cost").alias("sofar")), "src")
        offers = reached.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct((F.col("sofar") + F.col("cost")).alias("cost"), F.col("src").alias("via"))).alias("offer"))
        old = best.select("node", F.col("cost").alias("old"))
        better = offers.join(old, "node", "left").filter("old IS NULL OR offer.cost < old")
        frontier = kept(better.select("node", F.col("offer.cost").alias("cost"), F.col("offer.via").alias("via")))
        if frontier.isEmpty():
            break
        best = kept(best.join(frontier.select("node"), "node", "left_anti").unionByName(frontier))
    return best


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: how many others a node has an edge with, in either direction; each two nodes are kept once."""
    return _ends(_joined(edges))


def _joined(edges: DataFrame) -> DataFrame:
    """a, b: each two nodes that an edge joins, the lesser first."""
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def _ends(two: DataFrame) -> DataFrame:
    return two.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def clustering(edges: DataFrame) -> DataFrame:
    """node, degree, triangles, clustering coefficient; edges are directed from lower to higher degree, so hubs stay cheap.

    What both ends of an edge lead to closes a triangle: an edge takes the list of one end to that of the other, and no pair of neighbours is built.
    """
    two = kept(_joined(edges))
    degree = kept(_ends(two))
    d1, d2 = degree.select(F.col("node").alias("a"), F.col("degree").alias("d1")), degree.select(F.col("node").alias("b"), F.col("degree").alias("d2"))
    ahead = F.col("d1") <= F.col("d2")
    up = two.join(d1, "a").join(d2, "b").select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("dst"))
    # Nobody leads to more than sqrt(2 * edges) others.
    near = kept(up.groupBy("src").agg(F.collect_list("dst").alias("near")))
    met = near.select("src", F.explode("near").alias("dst")).join(near.select(F.col("src").alias("dst"), F.col("near").alias("far")), "dst").join(near, "src")
    met = met.select("src", "dst", F.array_intersect("near", "far").alias("both")).filter(F.size("both") > 0)
    ends = F.array(*(F.struct(F.col(c).alias("node"), F.size("both").cast("long").alias("n")) for c in ("src", "dst")))
    gains = F.concat(ends, F.transform("both", lambda x: F.struct(x.alias("node"), F.lit(1).cast("long").alias("n"))))
    counts = met.select(F.inline(gains)).groupBy("node").agg(F.sum("n").alias("triangles"))
    out = degree.join(counts, "node", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.withColumn("clustering", F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)))


def eigenvector_centrality(edges: DataFrame, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """node, score: power iteration on the undirected graph, scores scaled to a greatest of 1.

    Ends when a round changes the scores by less than ``tolerance`` in the mean; raises if ``rounds`` don't reach that.
    """
    both = kept(undirected(edges))
    score = both.select(F.col("src").alias("node")).distinct().withColumn("score", F.lit(1.0))
    for _ in range(rounds):
        spread = both.join(score.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("score").alias("raw"))
        # Adding the own score keeps bipartite graphs from swinging.
        spread = spread.join(score, "node").select("node", (F.col("raw") + F.col("score")).alias("raw"), F.col("score").alias("before"))
        top = spread.agg(F.max("raw").alias("top"))
        now = kept(spread.crossJoin(top).select("node", (F.col("raw") / F.col("top")).alias("score"), "before"))
        change = now.agg(F.avg(F.abs(F.col("score") - F.col("before")))).first()[0]
        score = now.select("node", "score")
        if change is None or change < tolerance:
            return score
    raise RuntimeError(f"eigenvector centrality has not converged to {tolerance} in {rounds} rounds")


def peer_share(edges: DataFrame, modes: DataFrame) -> DataFrame:
    """node, mode, share of neighbours that have the mode; ``modes``: node, mode."""
    near = undirected(edges).join(modes.select(F.col("node").alias("dst"), "mode"), "dst")
    per = near.groupBy("src", "mode").agg(F.count("*").alias("n"))
    total = near.groupBy("src").agg(F.count("*").alias("total"))
    return per.join(total, "src").select(F.col("src").alias("node"), "mode", (F.col("n") / F.col("total")).alias("share"))
