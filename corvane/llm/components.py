"""Connected components of a table of links, by stars that shrink to their least member."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import drop, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """For each id in ``links`` (a, b): id, component (the least id that links lead to).

    Each round hangs the neighbours of every id on its least neighbour, first the larger ones, then
    the smaller ones, until nothing changes; the rounds grow with the logarithm of the longest path.
    An id with very many links is only ever a key of sums and of a join that Spark can split.
    Links of an id to itself and repeated links do nothing; null ids are left out; no links give no rows.
    """
    pairs = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct()
    pairs = written(pairs, "links")
    before = None
    while (now := _state(pairs)) != before:
        before = now
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select("v", "m").filter("v <> m").distinct()
        large = written(large, "large")
        drop(pairs)
        least = large.groupBy("v").agg(F.min("m").alias("least"))
        small = large.join(least, "v").select(F.col("least").alias("a"), F.explode(F.array("v", "m")).alias("b")).filter("a < b").distinct()
        pairs = written(small, "small")
        drop(large)
    return pairs.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("component")).unionByName(pairs.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
