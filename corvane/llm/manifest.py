"""A Merkle manifest of a dataset: a digest for every row, a tree for every group, one tree over the groups.

Leaves of a group are numbered by range partitions and the counts of the partitions before, so a
group that holds most rows is spread like any other. ``FAN`` ** ``LEVELS`` consecutive nodes make a
block, an array of fixed size that ``sequence``, ``slice``, ``transform`` and ``aggregate`` collapse
``LEVELS`` levels at once; the blocks' roots are the nodes of the next turn, until every group has
one. Then the proofs come down the same blocks: a block's steps to its root, and what lies above it.
No node is ever with more than its block in a task, and nothing but the last root reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.scratch import drop, written

#: Children of a node, and levels that a block collapses at once.
FAN, LEVELS = 3, 5
BLOCK = FAN**LEVELS

_DEPTH = "CASE " + " ".join(f"WHEN total > {FAN**n} THEN {n + 1}" for n in reversed(range(LEVELS))) + " ELSE 0 END"
_LEVELS = f"""aggregate(slice(sequence(1, {LEVELS}), 1, depth), cast(array(transform(held, x -> x.hash)) AS array<array<string>>), (below, turn) ->
    concat(below, array(transform(sequence(0, (size(element_at(below, -1)) - 1) DIV {FAN}), i -> sha2(array_join(slice(element_at(below, -1), cast({FAN} * i + 1 AS int), {FAN}), ''), 256)))))"""
#: Where a node of the block stands at level ``up``, and the first of its run there.
_AT = f"(i DIV element_at(array({', '.join(str(FAN**n) for n in range(LEVELS))}), up))"
_RUN = f"({_AT} DIV {FAN} * {FAN})"
_STEPS = f"""transform(slice(sequence(1, {LEVELS}), 1, depth), up -> struct(
    array_join(slice(levels[up - 1], cast({_RUN} + 1 AS int), cast({_AT} - {_RUN} AS int)), '') AS left,
    array_join(slice(levels[up - 1], cast({_AT} + 2 AS int), cast({_RUN} + {FAN - 1} - {_AT} AS int)), '') AS right))"""


def digest(*values: Column | str) -> Column:
    """SHA-256 in lowercase hex of the values one after the other: ``-`` for null, else the bytes of its text in UTF-8, ``:`` and the text."""
    texts = [(F.col(v) if isinstance(v, str) else v).cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def folded(leaf: str, proof: str) -> str:
    """SQL for the root that a leaf and its proof (steps of ``left`` and ``right`` siblings, upwards) lead to."""
    return f"aggregate({proof}, {leaf}, (node, step) -> sha2(concat(step.left, node, step.right), 256))"


def proof_digest(proof: str) -> str:
    """SQL for the SHA-256 of all siblings of a proof, upwards and from left to right."""
    return f"sha2(array_join(transform({proof}, step -> concat(step.left, step.right)), ''), 256)"


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (tree, hash, ...) with place (from 0, by ``order`` within the tree) and total (rows of the tree)."""
    # Partition and place in it are both in the number; what is written keeps them when an executor is lost.
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", at)
    rows = written(rows.withColumn("part", F.shiftright("at", 33)), "numbered")
    parts = rows.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count("*").alias("c"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("c").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("c").over(tree).alias("total"))
    return rows.join(parts, ["tree", "part"]).withColumn("place", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _grown(nodes: DataFrame, name: str) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of each turn over ``nodes`` (tree, place, total, hash, ...), and the root of each tree (tree, hash)."""
    turns = []
    while True:
        kept = [c for c in nodes.columns if c not in ("tree", "total")]
        kept = ["place", *(c for c in kept if c != "place")]
        blocks = nodes.groupBy("tree", F.floor(F.col("place") / BLOCK).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct(*kept))).alias("held"))
        blocks = written(blocks.withColumn("depth", F.expr(_DEPTH).cast("int")).withColumn("levels", F.expr(_LEVELS)), name)
        turns.append(blocks)
        nodes = blocks.select("tree", F.col("block").alias("place"), F.when(F.col("total") > BLOCK, F.ceil(F.col("total") / BLOCK)).otherwise(1).alias("total"), F.expr("element_at(levels, -1)[0]").alias("hash"))
        if (blocks.agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return turns, nodes.select("tree", "hash")


def _led(turns: list[DataFrame], above: DataFrame, result: str) -> DataFrame:
    """Rows of the lowest turn; ``above`` (tree, subroot, proof) is what lies above each tree's root, ``result`` a struct made of ``held`` and ``proof``."""
    above = above.withColumn("place", F.lit(0).cast("long"))
    for turn in reversed(turns):
        lowest = turn is turns[0]
        met = turn.join(above.withColumnRenamed("place", "block"), ["tree", "block"])
        each = f"transform(held, (held, i) -> struct(held, concat({_STEPS}, proof) AS proof))"
        if lowest:
            return met.select("tree", "subroot", F.expr(f"inline(transform({each}, x -> {result}))"))
        above = met.select("tree", "subroot", F.expr(f"inline(transform({each}, x -> struct(x.held.place AS place, x.proof AS proof)))"))
    return above


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", order: str = "doc_id", offered: Column | None = None, with_proof: bool = True) -> DataFrame:
    """Per row of ``docs``: ``order``, leaf, subroot, root, proof, proof_sha256, folded_root, verified.

    A leaf is the :func:`digest` of ``fields``. Within a group leaves ascend by ``order``; while several nodes remain, every
    3 consecutive ones (the last run may be shorter, even one) become the digest of their hex digests. What remains is the
    group's subroot; subroots in the order of their groups (null first, then bytewise in UTF-8) give the root likewise.
    proof (if ``with_proof``) holds the siblings ``left`` and ``right`` at each level up to the root, proof_sha256 is of all
    of them. folded_root is what the proof makes of ``offered``, a digest of what is held against the manifest (null: the
    leaf itself); verified is folded_root = root.

    Null and empty texts are leaves like any other. Rows without ``order`` come first; rows that share one are ordered by their leaves, so
    repeated rows are neighbours with proofs of their own. A lone leaf is its own subroot, a lone subroot the root. An empty table gives an
    empty result; further columns are ignored.
    """
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-")).alias("tree"),
        F.col(order).alias("row"),
        digest(*fields).alias("hash"),
        (F.lit(None).cast("string") if offered is None else offered).alias("offered"),
    )
    leaves = written(leaves, "leaves")
    numbered = _numbered(leaves, ["row", "hash"])
    turns, subroots = _grown(numbered, "blocks")
    drop(leaves)
    drop(numbered)
    groups = _numbered(subroots.select(F.lit("").alias("tree"), "hash", F.col("tree").alias("group")), ["group"])
    over, top = _grown(groups, "blocks")
    root = top.first()
    nothing = "cast(array() AS array<struct<left: string, right: string>>)"
    top = top.select("tree", F.col("hash").alias("subroot"), F.expr(nothing).alias("proof"))
    above = _led(over, top, "struct(x.held.group AS group, x.held.hash AS hash, x.proof AS proof)")
    above = written(above.select(F.col("group").alias("tree"), F.col("hash").alias("subroot"), "proof"), "proofs")
    held = f"x.held.row AS row, x.held.hash AS leaf, {proof_digest('x.proof')} AS proof_sha256, {folded('coalesce(x.held.offered, x.held.hash)', 'x.proof')} AS folded_root"
    out = _led(turns, above, f"struct({held}{', x.proof AS proof' if with_proof else ''})")
    root = F.lit(root["hash"] if root else None).cast("string")
    return out.select(F.col("row").alias(order), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"), *["proof"] * with_proof)
