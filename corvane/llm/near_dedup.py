"""Near duplicates by SuperMinHash: signatures, banding, verification on full sets, components.

Texts with the same set of shingles are one class, which its least id stands for; copies are
never paired. Classes that agree in a band share a bucket. A bucket is not expanded into all
pairs: first every class is held against the bucket's most central one (that shares most bands
with others), and those that pass are joined. What is then still in different components of one
bucket is compared by its rarest shingles: two sets that link must share one among the first
few in a common order from rare to frequent, and what a copy has of its own comes first there.
This finds every further link, and inside a component a further link changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.minhash import overlapping, shingled, signed
from corvane.llm.scratch import drop, hot_join, mapped, small_batches, written

#: 30 bands of 5 miss a pair of similarity 0.8 with probability 7e-6, one of 0.85 with 3e-8.
BANDS, WIDTH = 30, 5


#: Partners that are held against one copy of a central text.
PARTNERS = 256


def _verified(pairs: DataFrame, texts: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """Links (a, b) among ``pairs`` (central, other), each once. A central text goes once to each ``PARTNERS`` of its partners, so a text with very many is spread over tasks."""
    once = pairs.groupBy(F.least("central", "other").alias("x"), F.greatest("central", "other").alias("y")).agg(F.min("central").alias("a"))
    once = written(once.select("a", (F.col("x") + F.col("y") - F.col("a")).alias("b")), "pairs")
    salts = written(once.groupBy("a").agg(F.count("*").alias("c")), "centrals")
    dealt = hot_join(once, salts, ["a"], "c", once.count()).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / PARTNERS)).alias("salt"))
    held = texts.select("id", "text")
    partners = dealt.join(held.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", "text")
    central = salts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("c") / PARTNERS) - 1)).alias("salt")).join(held.withColumnRenamed("id", "a"), "a")
    rows = partners.unionByName(central.select("a", "salt", F.lit(None).cast("long").alias("b"), "text"))
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.asc_nulls_first("b")).select("a", "b", "text")
    return mapped(rows, lambda x: overlapping(x, k, part, whole), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _shared_ids(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of the texts that one doc_id carries."""
    each = sets.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "low", "high")
    several = each.groupBy("doc_id").agg(F.min(F.struct("low", "high")).alias("x"), F.max(F.struct("low", "high")).alias("y")).filter("x <> y")
    of = each.join(several.select("doc_id"), "doc_id").join(classes.select("low", "high", "id"), ["low", "high"])
    return of.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).filter("a <> b").distinct()


def _rare_pairs(sets: DataFrame, k: int, part: int, whole: int) -> DataFrame:
    """Pairs (a, b) of ``sets`` (id, n, component, text) of different components that can link: a prefix filter.

    Sets of n and m shingles link only with a common part of ``need`` at least, so only if one of the first
    n - need + 1 of the one, from rare to frequent, is among the first m - need + 1 of the other.
    """
    each = mapped(sets.select("id", "n", "component", "text"), lambda x: shingled(x, k), "id long, n long, component long, shingle long")
    each = written(each, "shingles")
    frequent = each.groupBy("shingle").agg(F.count("*").alias("df"), F.min("component").alias("low"), F.max("component").alias("high"))
    frequent = written(frequent.select("shingle", "df", (F.col("low") != F.col("high")).alias("shared")), "frequent")
    # A text's shingles are put in order by Spark, which can spill, and only the prefix stays.
    order = Window.partitionBy("id").orderBy("df", "shingle")
    ranked = hot_join(each, frequent, ["shingle"], "df", each.count()).withColumn("place", F.row_number().over(order) - 1)
    longest = F.col("n") - F.ceil(F.col("n") * part / whole) + 1
    ranked = written(ranked.filter((F.col("place") < longest) & F.col("shared")).select("id", "n", "component", "place", "shingle"), "prefixes")
    drop(frequent)
    drop(each)
    # The smaller set of a pair, of equal ones that of the lesser id, needs a shorter prefix, as its partner has as many
    # shingles at least: texts of one template below the threshold have only rare ones there, which nothing meets.
    smaller = ranked.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 2 * part / (whole + part)))
    a, b = smaller.alias("a"), ranked.alias("b")
    need = F.ceil((F.col("a.n") + F.col("b.n")) * part / (whole + part))
    fits = (F.col("a.place") <= F.col("a.n") - need) & (F.col("b.place") <= F.col("b.n") - need)
    ordered = (F.col("a.n") < F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.id") < F.col("b.id")))
    found = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & ordered & (F.col("a.component") != F.col("b.component")) & fits)
    return found.select(F.col("a.id").alias("central"), F.col("b.id").alias("other"))


def near_duplicates(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100, bands: int = BANDS, width: int = WIDTH) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a text's set holds its distinct shingles of
    ``k`` words, or its whole sequence if that is shorter. Two texts link when whole * common >=
    part * together. component_id is the least doc_id that links lead to, kept is doc_id = component_id.

    Null, empty and blank texts have no set, link with nothing and are kept. A row without doc_id links
    with nothing: component_id is null and it is kept. Rows that share a doc_id count as one document
    with all their texts; repeated rows hence stay or go together. An empty table gives an empty result;
    further columns are ignored.
    """
    base = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = written(mapped(base, lambda x: signed(x, k, bands, width), "doc_id long, n long, low long, high long, bands array<long>"), "sets")
    classes = sets.filter("n > 0 AND doc_id IS NOT NULL").groupBy("low", "high").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    total = classes.count() * bands
    members = classes.select("id", "n", F.explode(F.array_distinct("bands")).alias("bucket"))
    shared = written(members.groupBy("bucket").agg(F.count("*").alias("c")).filter("c > 1"), "shared")
    members = written(hot_join(members, shared, ["bucket"], "c", total), "members")
    drop(shared)
    central = members.groupBy("id").agg(F.sum("c").alias("weight"))
    first = members.join(central, "id").groupBy("bucket").agg(F.min(F.struct((-F.col("weight")).alias("w"), "id", "n")).alias("first"), F.first("c").alias("rows")).select("bucket", "rows", F.col("first.id").alias("first"), F.col("first.n").alias("first_n"))
    first = written(first, "first")
    # A common part can't reach the threshold where one set is too large for the other.
    alike = F.least("n", "first_n") * whole >= F.greatest("n", "first_n") * part
    texts = written(base.withColumnRenamed("doc_id", "id").join(central.select("id"), "id", "left_semi"), "texts")
    pairs = hot_join(members, first, ["bucket"], "rows", total).filter("id <> first").filter(alike).select(F.col("first").alias("central"), F.col("id").alias("other"))
    links = written(_verified(pairs, texts, k, part, whole), "links")
    links = links.unionByName(written(_shared_ids(sets, classes), "links"))
    joined = components(links)
    placed = members.filter("c > 2").join(joined, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("bucket")
    apart = placed.join(mixed, "bucket").groupBy("id").agg(F.first("n").alias("n"), F.first("component").alias("component"))
    more = written(_verified(_rare_pairs(texts.join(apart, "id"), k, part, whole), texts, k, part, whole), "links")
    joined = components(links.unionByName(more))
    of = classes.join(joined, "id", "left").select("low", "high", F.coalesce("component", "id").alias("component_id"))
    out = sets.drop("bands").join(of, ["low", "high"], "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
