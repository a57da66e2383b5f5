"""Linear recurrences x' = a x + b whose factor changes from place to place, as scans of pairs that compose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import kept

#: Places that are composed within one array.
BLOCK = 64


def linear_scan(rows: DataFrame, keys: list[str], place: str, a: str, b: str, out: str) -> DataFrame:
    """``rows`` with ``out``: x at each place (0, 1, 2 ... within a key, none missing), where x = a * (x before) + b, from 0.

    Places are cut into blocks. A step is the pair (a, b), and (c, d) after (a, b) is (a c, b c + d): each block composes its
    own pairs and is a pair itself, so blocks are scanned the same way, ``BLOCK`` times fewer in each turn. A key of any length is
    spread over its blocks; only ``BLOCK`` places are ever in one array. Rows of a key that share a place are an error of
    the caller; an empty table stays empty.
    """
    held = rows.withColumn("__block", F.floor(F.col(place) / BLOCK))
    first = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    then = lambda done, step: F.struct((done["a"] * step["a"]).alias("a"), (done["b"] * step["a"] + step["b"]).alias("b"))
    steps = F.sort_array(F.collect_list(F.struct(F.col(place).cast("long").alias("place"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))))
    # What all steps up to each place make together, the whole block's at the end.
    grown = F.aggregate("steps", F.array(first), lambda done, step: F.concat(done, F.array(then(F.element_at(done, -1), step))))
    blocks = kept(held.groupBy(*keys, "__block").agg(steps.alias("steps")).withColumn("made", grown))
    if blocks.filter("__block > 0").isEmpty():
        before = blocks.select(*keys, "__block", F.lit(0.0).alias("__before"))
    else:
        whole = blocks.select(*keys, F.col("__block").alias("__at"), F.element_at("made", -1).alias("__p")).select(*keys, "__at", F.col("__p.a").alias("__a"), F.col("__p.b").alias("__b"))
        ends = linear_scan(whole, keys, "__at", "__a", "__b", "__x").select(*keys, (F.col("__at") + 1).alias("__block"), F.col("__x").alias("__before"))
        before = blocks.select(*keys, "__block").join(ends, [*keys, "__block"], "left").select(*keys, "__block", F.coalesce("__before", F.lit(0.0)).alias("__before"))
    values = F.transform("steps", lambda step, i: F.struct(step["place"].alias("__place"), (F.get("made", i + 1)["a"] * F.col("__before") + F.get("made", i + 1)["b"]).alias(out)))
    found = blocks.join(before, [*keys, "__block"]).select(*keys, F.inline(values))
    return rows.join(found.withColumnRenamed("__place", place), [*keys, place])
