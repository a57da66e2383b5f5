"""Near duplicates among vectors: a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. After one rotation, the same for all
vectors of a length, the coordinates are split into blocks and the allowed squared distance is
dealt to the blocks in proportion to their size: two vectors within the whole distance are
within its share in one block at least. Each block is a range join of its own.

The range join deals a block's coordinates, without the vectors, to cells. A label of up to
``TILE`` vectors is one cell; a larger one is split at medians, and a vector within reach of a
split from its left side visits the right side too, so that each pair meets in one cell. A
cell that still holds more than ``TILE`` (copies that no split parts) is dealt to pairs of
buckets. Inside a task the rows are split further into leaves, and only rows in reach of a
leaf's box are held against it.

Rows that have a candidate in a cell are then joined with their vectors and meet there again.
A pair counts in the first block that it is within the share of, if the cosine of the given
components in double precision says so. A cell gives for each vector the number of its links
and one member of its group, never the pairs, so a large group of near copies costs a row for
each of its vectors.

Vectors that are equal to the last bit are one class; its copies are counted, not paired.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.components import components
from corvane.llm.scratch import small_batches, written
from corvane.llm.words import mix

#: Coordinates of a block.
BLOCK = 8
#: Vectors of a cell or a bucket, and rows of a leaf within a task.
TILE, LEAF = 16_384, 32
#: Vectors, of all labels that need splits, by which the splits are chosen. All vectors are dealt by them.
SAMPLE = 65_536
#: Block coordinates travel in single precision; their squared distances are right to this much.
SLACK = 1e-6

_KEY = ["label", "size", "part", "cell", "one", "two"]


@lru_cache(maxsize=8)
def rotation(size: int) -> np.ndarray:
    """An orthogonal matrix that depends on the size alone."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(size)).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def budgets(size: int, cosine: float) -> list[float]:
    """The share of each block in the allowed squared distance."""
    return [(2 - 2 * cosine) * min(BLOCK, size - low) / size + 1e-9 for low in range(0, size, BLOCK)]


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _turned(v: np.ndarray) -> np.ndarray:
    return unit(v) @ rotation(v.shape[1])


def splits(near: np.ndarray, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each level the coordinate and the median by which each of its nodes is split; a node without rows sends all to the left."""
    node, out = np.zeros(len(near), dtype=np.int64), []
    for level in range(depth):
        which, value = np.zeros(1 << level, dtype=np.int64), np.full(1 << level, np.inf)
        for n in np.unique(node):
            mine = near[node == n]
            which[n] = np.argmax(mine.var(axis=0))
            value[n] = np.median(mine[:, which[n]])
        out.append((which, value))
        node = 2 * node + (near[np.arange(len(near)), which[node]] > value[node])
    return out


def descend(near: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is a guest there: every row has one home, and visits homes to the right that are in reach."""
    row, node, guest = np.arange(len(near)), np.zeros(len(near), dtype=np.int64), np.zeros(len(near), dtype=bool)
    for which, value in tree:
        x, t = near[row, which[node]], value[node]
        left, right = np.where(guest, x - reach <= t, x <= t), np.where(guest, x + reach >= t, x > t)
        visits = ~guest & left & (x + reach >= t)
        row, node, guest = (
            np.concatenate([row[left], row[right], row[visits]]),
            np.concatenate([2 * node[left], 2 * node[right] + 1, 2 * node[visits] + 1]),
            np.concatenate([guest[left], guest[right], np.ones(visits.sum(), dtype=bool)]),
        )
    return row, node, guest


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the rows that have it and their vectors."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        yield rows, np.asarray(column.take(pa.array(rows)).flatten(), dtype=np.float64).reshape(len(rows), size)


def _placed(batches: Iterator[pa.RecordBatch], cosine: float, trees: dict, crowded: dict, counting: bool) -> Iterator[pa.RecordBatch]:
    """A row for each block and cell of each vector; with ``counting`` the cells alone."""
    for batch in batches:
        ids, labels = batch.column("id").to_numpy(), batch.column("label")
        for rows, v in _vectors(batch.column("vector")):
            size = v.shape[1]
            turned = _turned(v).astype(np.float32)
            names = np.array(labels.take(pa.array(rows)).to_pylist(), dtype=object) if trees else np.zeros(len(rows))
            for name in dict.fromkeys(names.tolist()):
                mine = np.flatnonzero(names == name)
                for part, budget in enumerate(budgets(size, cosine)):
                    near = turned[mine, part * BLOCK : (part + 1) * BLOCK]
                    at, cell, guest = descend(near.astype(np.float64), trees.get((name, size), {}).get(part, []), (budget + SLACK) ** 0.5)
                    one = two = np.zeros(len(at), dtype=np.int64)
                    second = np.zeros(len(at), dtype=bool)
                    shared = np.array([crowded.get((name, size, part, c), 1) for c in cell.tolist()]) if crowded else np.ones(1)
                    if shared.max(initial=1) > 1:
                        # Bucket b of k meets every bucket: as the first of the pair up to itself, as the second after it.
                        bucket = (mix(ids[rows[mine[at]]].astype(np.uint64)) % shared.astype(np.uint64)).astype(np.int64)
                        copy = np.repeat(np.arange(len(at)), shared)
                        other = np.arange(len(copy)) - np.repeat(np.cumsum(shared) - shared, shared)
                        at, cell, guest, bucket = at[copy], cell[copy], guest[copy], bucket[copy]
                        one, two, second = np.minimum(bucket, other), np.maximum(bucket, other), bucket > other
                    where, n = mine[at], len(at)
                    arrays = [labels.take(pa.array(rows[where])), pa.array(np.full(n, size, np.int32)), pa.array(np.full(n, part, np.int32)), pa.array(cell)]
                    columns = _KEY[:4]
                    if not counting:
                        width = near.shape[1] * 4
                        flat = pa.py_buffer(np.ascontiguousarray(near[at]))
                        nears = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), flat])
                        arrays += [pa.array(one.astype(np.int32)), pa.array(two.astype(np.int32)), pa.array(second), pa.array(guest), pa.array(ids[rows[where]].astype(np.int64)), nears]
                        columns = [*_KEY, "second", "guest", "id", "near"]
                    yield pa.RecordBatch.from_arrays(arrays, names=columns)


def _leaves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows, and where its leaves begin and end: halves at the median of the widest coordinate."""
    order, todo, cuts = np.arange(len(x)), [(0, len(x))], []
    while todo:
        low, high = todo.pop()
        if high - low <= LEAF:
            cuts.append(low)
            continue
        mine, middle = order[low:high], (high - low) // 2
        part = x[mine]
        order[low:high] = mine[np.argpartition(part[:, np.argmax(part.var(axis=0))], middle)]
        todo += [(low + middle, high), (low, low + middle)]
    return order, np.array([*cuts, len(x)])


def within_reach(x: np.ndarray, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each leaf's rows, and the rows of it and of later leaves that its box is in reach of; every pair within the budget meets once."""
    order, cuts = _leaves(x)
    if not len(order):
        return
    held = x[order]
    lows, highs = np.minimum.reduceat(held, cuts[:-1]), np.maximum.reduceat(held, cuts[:-1])
    sizes, leaf = np.diff(cuts), np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for k in range(len(sizes)):
        gap = np.maximum(np.maximum(lows[k:] - highs[k], lows[k] - highs[k:]), 0)
        near = (gap * gap).sum(axis=1) <= budget
        others = cuts[k] + np.flatnonzero(np.repeat(near, sizes[k:]))
        gap = np.maximum(np.maximum(held[others] - highs[k], lows[k] - held[others]), 0)
        others = others[((gap * gap).sum(axis=1) <= budget) | (leaf[others] == k)]
        yield order[cuts[k] : cuts[k + 1]], order[others]


def _allowed(rows: np.ndarray, others: np.ndarray, guest: np.ndarray, second: np.ndarray, apart: bool) -> np.ndarray:
    """Pairs that count here: of two guests none, of two buckets only mixed pairs, inside a leaf each pair once."""
    out = ~(guest[rows][:, None] & guest[others])
    if apart:
        out &= second[rows][:, None] != second[others]
    # The leaf's own rows come first among the others, in the same order.
    out[:, : len(rows)] &= np.triu(np.ones((len(rows), len(rows)), dtype=bool), 1)
    return out


def _flags(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    first = table.slice(0, 1).to_pylist()[0]
    return (*(table.column(c).to_numpy() for c in ("guest", "second")), first["one"] != first["two"])


def _marked(table: pa.Table, cosine: float) -> pa.Table:
    """The rows of a cell that have a candidate in it."""
    first = table.slice(0, 1).to_pylist()[0]
    budget = budgets(first["size"], cosine)[first["part"]] + SLACK
    x = np.frombuffer(b"".join(table.column("near").to_pylist()), dtype=np.float32).reshape(table.num_rows, -1).astype(np.float64)
    guest, second, apart = _flags(table)
    square, found = (x * x).sum(axis=1), np.zeros(len(x), dtype=bool)
    for rows, others in within_reach(x, budget):
        close = square[rows][:, None] + square[others] - 2 * (x[rows] @ x[others].T) <= budget
        close &= _allowed(rows, others, guest, second, apart)
        found[rows] |= close.any(axis=1)
        found[others] |= close.any(axis=0)
    return table.drop_columns(["near"]).filter(pa.array(found))


def _linked(table: pa.Table, cosine: float) -> pa.Table:
    """id, others (copies of vectors linked in this block first), root (least id of the local group) for the rows of a cell."""
    first = table.slice(0, 1).to_pylist()[0]
    size, part = first["size"], first["part"]
    shares = budgets(size, cosine)
    guest, second, apart = _flags(table)
    # Rows in the order of their ids, so that a least place is a least id.
    ids = table.column("id").to_numpy()
    order = np.argsort(ids)
    ids, guest, second = ids[order], guest[order], second[order]
    copies = table.column("copies").to_numpy()[order]
    v = np.asarray(table.column("vector").combine_chunks().flatten(), dtype=np.float64).reshape(-1, size)[order]
    norm, u, turned = np.sqrt((v * v).sum(axis=1)), unit(v), _turned(v)
    others_of, parent = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))

    def within(a: np.ndarray, b: np.ndarray, q: int) -> np.ndarray:
        gap = turned[a, q * BLOCK : (q + 1) * BLOCK] - turned[b, q * BLOCK : (q + 1) * BLOCK]
        return (gap * gap).sum(axis=1) <= shares[q]

    for rows, others in within_reach(turned[:, part * BLOCK : (part + 1) * BLOCK], shares[part] + SLACK):
        dot = u[rows] @ u[others].T
        i, j = np.nonzero((dot >= cosine - 1e-9) & _allowed(rows, others, guest, second, apart))
        a, b, dot = rows[i], others[j], dot[i, j]
        for q in range(part + 1):
            keep = within(a, b, q) == (q == part)
            a, b, dot = a[keep], b[keep], dot[keep]
        unsure = np.flatnonzero(dot < cosine + 1e-9)
        if len(unsure):
            p, q = a[unsure], b[unsure]
            keep = np.ones(len(a), dtype=bool)
            keep[unsure] = (v[p] * v[q]).sum(axis=1) / (norm[p] * norm[q]) >= cosine
            a, b = a[keep], b[keep]
        if not len(a):
            continue
        np.add.at(others_of, a, copies[b])
        np.add.at(others_of, b, copies[a])
        # Each group of the leaf's rows hangs on its least root.
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        for linked in np.split(b, np.flatnonzero(np.diff(a)) + 1):
            root = _roots(parent, linked)
            parent[root] = root.min()
        for row, linked in zip(a[np.flatnonzero(np.diff(a, prepend=-1))], np.split(b, np.flatnonzero(np.diff(a)) + 1), strict=True):
            root = _roots(parent, np.array([row, linked[0]]))
            parent[root] = root.min()
        parent = _roots(parent, np.arange(len(parent)))
    used = np.flatnonzero(others_of)
    return pa.table({"id": ids[used], "others": others_of[used], "root": ids[_roots(parent, used)]})


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    while not np.array_equal(up := parent[of], of):
        of = up
    return of


def _trees(classes: DataFrame, cosine: float, tile: int, sample: int) -> dict:
    """Splits of each block for each (label, size) of more than ``tile`` classes: at most one of these for every ``tile`` classes."""
    large = [r for r in classes.groupBy("label", F.size("vector").alias("size")).count().filter(F.col("count") > tile).collect()]
    if not large:
        return {}
    share = min(1.0, sample / sum(r["count"] for r in large))
    names = classes.sparkSession.createDataFrame([(r["label"], r["size"]) for r in large], classes.select("label", F.size("vector").alias("size")).schema)
    chosen = classes.withColumn("size", F.size("vector")).join(names, ["label", "size"], "left_semi")
    chosen = chosen.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("label", "vector").toArrow()
    held: dict = {}
    for rows, v in _vectors(chosen.column("vector").combine_chunks()):
        names = np.array(chosen.column("label").take(pa.array(rows)).to_pylist(), dtype=object)
        for name in dict.fromkeys(names.tolist()):
            held[name, v.shape[1]] = _turned(v[names == name]).astype(np.float32).astype(np.float64)
    out = {}
    for r in large:
        size, depth = r["size"], int(np.ceil(np.log2(4 * r["count"] / tile)))
        turned = held.get((r["label"], size), np.zeros((0, size)))
        out[r["label"], size] = {part: splits(turned[:, part * BLOCK : (part + 1) * BLOCK], depth) for part in range(len(budgets(size, cosine)))}
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.98, tile: int = TILE, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, their lengths are equal and their cosine, in
    double precision, is at least ``cosine``. n_links: other vectors linked directly; component_id: the least
    vec_id that links lead to; kept: vec_id = component_id.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link
    with nothing. A null vec_id links with nothing, keeps a null component and is kept. Rows that repeat a
    vec_id count as so many vectors. An empty table gives an empty result; further columns are ignored.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    base = small_batches(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(f"array<{kind}>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(sound & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), F.lit(False))
    # -0.0 and 0.0 are one value here. Rows find their class by 128 bits of the vector.
    base = base.withColumn("vector", F.transform("vector", lambda x: (x + F.lit(0.0)).cast(kind)))
    base = base.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    same = ["label", "h1", "h2"]
    # Classes have numbers of their own, as two may share their least vec_id; they are fixed once written.
    classes = base.filter(usable).groupBy(*same, "vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    label = classes.schema["label"].dataType.simpleString()
    key = f"label {label}, size int, part int, cell long"
    plain, trees = classes.select("id", "label", "vector"), _trees(classes, cosine, tile, sample)
    crowded = {}
    if trees:
        cells = plain.mapInArrow(lambda x: _placed(x, cosine, trees, {}, True), key).groupBy(*_KEY[:4]).count().filter(F.col("count") > tile)
        crowded = {tuple(r)[:4]: -(-r["count"] // tile) for r in cells.collect()}
    key += ", one int, two int, second boolean, guest boolean, id long"
    placed = plain.mapInArrow(lambda x: _placed(x, cosine, trees, crowded, False), f"{key}, near binary")
    marked = placed.groupBy(*_KEY).applyInArrow(lambda t: _marked(t, cosine), key)
    met = marked.join(classes.select("id", "copies", "vector"), "id").groupBy(*_KEY).applyInArrow(lambda t: _linked(t, cosine), "id long, others long, root long")
    met = written(met, "met")
    others = met.groupBy("id").agg(F.sum("others").alias("others"))
    links = met.filter("id <> root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct()
    joined = written(components(links).join(classes.select("id", "least"), "id"), "joined")
    lowest = joined.groupBy("component").agg(F.min("least").alias("lowest"))
    joined = joined.join(lowest, "component").select("id", "lowest")
    of = (
        classes.join(others, "id", "left")
        .join(joined, "id", "left")
        .select(*same, (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("lowest", "least").alias("component_id"))
    )
    linked = base.filter(usable).join(of, same).select("vec_id", "n_links", "component_id")
    alone = base.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))
