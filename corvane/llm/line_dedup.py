"""Lines that many sites share, found by the spread of each line over sites.

Each line is hashed (128 bits); per hash a HyperLogLog sketch of the sites is aggregated, before
and after the shuffle alike, so a line on every page of a site costs one row a task. Lines
whose estimate is near the threshold get an exact count of distinct sites. A line on enough
sites is boilerplate and stays only in the document of least id that has it.

DataFrame functions alone do the work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import hot_join, written

#: Sites from which on a line is boilerplate; estimates within this factor of it are counted exactly.
SITES, NEAR = 10, 2.0
#: Boilerplate lines (24 bytes each) that are sent to all tasks; more of them meet the lines by a shuffle.
BROADCAST = 200_000
#: Logarithm of the registers of a sketch: a standard error of 1.04 / sqrt(2**10), 3 %.
REGISTERS = 10


def remove_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """``docs`` (doc_id, text, ``site`` and any other columns) with boilerplate lines taken out of text.

    Lines end at line feeds and are compared without spaces, tabs and carriage returns at their ends;
    blank ones stay and don't count. A line on at least ``sites`` distinct sites stays in the document
    of least doc_id alone, wherever it stands there. Added: n_lines (not blank), n_removed; columns of
    these names are replaced, all others stay as they are.

    Null text stays null with 0 lines, empty text stays empty. A null site counts as none. Rows without
    doc_id never are the first. Repeated rows are treated alike. An empty table gives an empty result.
    """
    others = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    order = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    row = F.struct(*others)
    base = docs.select(F.xxhash64("doc_id", site, "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key2"), row.alias("row"), F.split("text", "\n").alias("lines"))
    lines = docs.select(F.xxhash64("doc_id", site, "text").alias("key"), F.xxhash64(F.lit(1), "text", "doc_id").alias("key2"), "doc_id", F.col(site).alias("site"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(" \t\r"))).filter("line <> ''")
    lines = lines.select("key", "key2", "doc_id", "site", "place", F.xxhash64("line").alias("high"), F.xxhash64(F.lit(1), "line").alias("low"))
    spread = (
        lines.groupBy("high", "low")
        .agg(F.hll_sketch_agg("site", REGISTERS).alias("sketch"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
        .filter(F.col("n") >= sites)
        .select("high", "low", "first", "n", F.hll_sketch_estimate("sketch").alias("estimate"))
        .filter(F.col("estimate") * NEAR >= sites)
    )
    sure = spread.filter(F.col("estimate") > sites * NEAR).select("high", "low", "first", "n")
    near = spread.filter(F.col("estimate") <= sites * NEAR).select("high", "low", "first", "n")
    exact = (
        lines.select("high", "low", "site")
        .join(near, ["high", "low"])
        .groupBy("high", "low")
        .agg(F.countDistinct("site").alias("sites"), F.first("first").alias("first"), F.first("n").alias("n"))
        .filter(F.col("sites") >= sites)
        .select("high", "low", "first", "n")
    )
    boilerplate = written(sure.unionByName(exact), "boilerplate")
    if boilerplate.count() <= BROADCAST:
        marked = lines.join(F.broadcast(boilerplate), ["high", "low"])
    else:
        marked = hot_join(lines, boilerplate, ["high", "low"], "n", lines.count())
    gone = marked.filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = gone.groupBy("key", "key2").agg(F.sort_array(F.collect_set("place")).alias("gone"))
    # What lies between two lines that go stays as a slice; lines and gone are columns here, not expressions to repeat.
    bounds = F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("after"), F.concat("gone", F.array(F.size("lines"))).alias("before"))
    kept = F.flatten(F.transform(bounds, lambda b: F.slice("lines", b["after"] + 2, b["before"] - b["after"] - 1)))
    text = F.when(F.col("gone").isNull(), F.array_join("lines", "\n")).otherwise(F.array_join(kept, "\n"))
    filled = F.size(F.filter("lines", lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    out = base.join(gone, ["key", "key2"], "left").select(
        "row", text.alias("text"), F.coalesce(F.when(F.col("lines").isNull(), 0).otherwise(filled), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed")
    )
    return out.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in order), "n_lines", F.greatest("n_removed", F.lit(0).cast("long")).alias("n_removed"))
