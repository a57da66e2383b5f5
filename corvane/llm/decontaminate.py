"""Benchmark passages in texts, found by greedy string tiling.

Seeds are runs of ``SEED`` words. A text is held against an item if it has one of the item's
rarer seeds: tiles that cover ``COVERED`` of an item have at least a fifth of that many of its
seeds, so the most frequent ones, fewer than that, need no look-up. Then running Karp-Rabin
hashes find the longest common run of unmarked words, all runs of that length are marked in
the order of the text, and so on with the next shorter length while ``SEED`` words remain. The tiles never
overlap, on either side, and may lie in any order: a passage with its sentences reordered is
covered all the same. An item is in a text if its tiles cover ``COVERED`` of its words. Places are
kept by hash on either side and never paired, so memory grows with the text plus the item.

An item shorter than a seed is in a text that has all its words in a row.

The items are a stated query set: they are taken in blocks of bounded size, each sent to all
tasks, and every text is held against every block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import mapped, small_batches
from corvane.llm.words import spans_hash, words

#: Words of a seed and of the shortest tile; part of an item's words that makes a text contaminated.
SEED, COVERED = 5, 0.8
#: A block of items holds about so many items and bytes of text at most.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20

_BITS = 22
_U = np.uint64
_PRIME, _BASE, _LOW31, _LOW30 = _U(2**61 - 1), 1_390_672_895_218_362_741, _U(2**31 - 1), _U(2**30 - 1)


@dataclass
class Items:
    """A block of items: words and seeds of each in order, and which items to try for a seed, in the order of the seeds' hashes."""

    ids: list
    words: list[np.ndarray]
    seeds: list[np.ndarray]
    tried: np.ndarray
    item: np.ndarray
    filter: np.ndarray
    #: By length the hashes, in order, and numbers of the items that are shorter than a seed.
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def _seeds(h: np.ndarray, size: int = SEED) -> np.ndarray:
    at = np.arange(max(0, len(h) - size + 1))
    return spans_hash(h, at, at + size)


def index(ids: list, texts: list[str | None], covered: float = COVERED) -> Items:
    found = [w.hashes(lower=True)[w.rows[i] : w.rows[i + 1]] for w in words(pa.array(texts, pa.string())) for i in range(w.last - w.first)]
    seeds = [_seeds(own) for own in found]
    every = np.unique(np.concatenate([np.zeros(0, np.uint64), *seeds]))
    count = np.zeros(len(every), dtype=np.int64)
    for own in seeds:
        count[np.searchsorted(every, np.unique(own))] += 1
    tried, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i, (own, all_words) in enumerate(zip(seeds, found, strict=True)):
        if len(own):
            needed = max(1, int(np.ceil(covered * len(all_words) / SEED - 1e-9)))
            rare = own[np.lexsort((own, count[np.searchsorted(every, own)]))][: max(1, len(own) - needed + 1)]
            tried.append(np.unique(rare))
            item.append(np.full(len(tried[-1]), i))
    tried, item = np.concatenate(tried), np.concatenate(item)
    order = np.argsort(tried, kind="stable")
    seen = np.zeros(1 << _BITS, dtype=bool)
    seen[every >> np.uint64(64 - _BITS)] = True
    short = {}
    for size in range(1, SEED):
        which = np.array([i for i, own in enumerate(found) if len(own) == size], dtype=np.int64)
        if len(which):
            hashes = np.array([_seeds(found[i], size)[0] for i in which], dtype=np.uint64)
            by = np.argsort(hashes, kind="stable")
            short[size] = hashes[by], which[by]
    return Items(ids, found, seeds, tried[order], item[order], seen, short)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1, from products of 31 bits."""
    a_high, a_low, b_high, b_low = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = a_low * b_high + a_high * b_low
    return _reduced((a_high * b_high << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + a_low * b_low)


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _PRIME) + (x >> _U(61))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _powers(n: int) -> np.ndarray:
    out, step = np.ones(1, dtype=np.uint64), np.array([_BASE], dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, _times(out, step)])
        step = _times(step, step)
    return out[:n]


class Rolled:
    """Running Karp-Rabin hashes of a sequence of 64-bit words: polynomials over the field of 2**61 - 1 elements.

    Two different runs of n words agree for at most n of its 2**61 bases.
    """

    def __init__(self, h: np.ndarray, power: np.ndarray):
        """``power``: as many powers of the base as the longest sequence that runs are compared with has words, and one more."""
        term = _times(_reduced(h), power[: len(h)])
        self.power, self.sums = power, np.zeros(len(h) + 1, dtype=np.uint64)
        # Sums of both halves of the terms stay below 2**64 for up to 2**32 words.
        high, low = _reduced(np.cumsum(term >> _U(32))), _reduced(np.cumsum(term & _U(0xFFFFFFFF)))
        self.sums[1:] = _reduced(_times(high, np.full(1, 1 << 32, dtype=np.uint64)) + low)

    def runs(self, at: np.ndarray, size: int) -> np.ndarray:
        return _times(_reduced(self.sums[at + size] + (_PRIME - self.sums[at])), self.power[len(self.power) - 1 - at])

    def free(self, free: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all runs of ``size`` free words."""
        marked = np.concatenate([[0], np.cumsum(~free)])
        at = np.flatnonzero(marked[size:] == marked[:-size])
        return at, self.runs(at, size)


def tiles(text: np.ndarray, item: np.ndarray, free: np.ndarray | None = None, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in text, place in item, length) of each tile; words that are not ``free`` take no part.

    Of equally long matches the first in the text, then in the item, is marked first.
    """
    in_text = np.ones(len(text), dtype=bool) if free is None else free.copy()
    in_item = np.ones(len(item), dtype=bool)
    power = _powers(max(len(text), len(item)) + 1)
    rolled_text, rolled_item = Rolled(text, power), Rolled(item, power)
    out: list[tuple[int, int, int]] = []

    def common(size: int) -> bool:
        return bool(np.isin(rolled_item.free(in_item, size)[1], rolled_text.free(in_text, size)[1]).any())

    most = min(len(text), len(item))
    while most >= shortest and common(shortest):
        low, high = (most, most) if common(most) else (shortest, most - 1)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        where, hashes = rolled_item.free(in_item, low)
        places: dict[int, list[int]] = {}
        for p, h in zip(where[::-1].tolist(), hashes[::-1].tolist(), strict=True):
            places.setdefault(h, []).append(p)
        where, hashes = rolled_text.free(in_text, low)
        shared = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
        end = 0
        for t, h in zip(where[shared].tolist(), hashes[shared].tolist(), strict=True):
            if t < end:
                continue
            # What is marked stays marked: a place of the item that is not free is done with.
            while places[h] and not in_item[places[h][-1] : places[h][-1] + low].all():
                places[h].pop()
            if places[h]:
                p, end = places[h].pop(), t + low
                out.append((t, p, low))
                in_item[p : p + low] = in_text[t:end] = False
        most = low - 1
    return out


def _tiled(h: np.ndarray, places: np.ndarray, item: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles of an item in a text whose words that belong to its seeds begin at ``places``; all other words are left out."""
    inside = np.zeros(len(h) + 1, dtype=bool)
    inside[np.unique(places[:, None] + np.arange(SEED))] = True
    held = inside.copy()
    held[1:] |= inside[:-1]  # one word that takes no part keeps stretches apart
    at = np.flatnonzero(held[:-1])
    return tiles(h[at], item, inside[at])


def _matches(column: pa.Array, items: Items, covered: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item, coverage, tiles, words of the item) of each item that a text of the column covers."""
    for w in words(column):
        h, row = w.hashes(lower=True), w.row_of()
        for size, (hashes, which) in items.short.items():
            at = np.arange(max(0, len(h) - size + 1))
            at = at[row[at] == row[at + size - 1]] if len(at) else at
            rolled = spans_hash(h, at, at + size)
            low, high = (np.searchsorted(hashes, rolled, side=s) for s in ("left", "right"))
            hit = np.flatnonzero(high > low)
            for r, a, b in dict.fromkeys(zip(row[at[hit]].tolist(), low[hit].tolist(), high[hit].tolist(), strict=True)):
                yield from ((w.first + r, int(i), 1.0, 1, size) for i in which[a:b])
        if len(h) < SEED or not len(items.tried):
            continue
        rolled = _seeds(h)
        at = np.flatnonzero(items.filter[rolled >> np.uint64(64 - _BITS)])
        at = at[row[at] == row[at + SEED - 1]]
        # Seeds by row and hash, so that a row's are a sorted stretch.
        at = at[np.lexsort((rolled[at], row[at]))]
        seeds, of = rolled[at], row[at]
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (seeds[1:] != seeds[:-1]) | (of[1:] != of[:-1])
        low, high = (np.searchsorted(items.tried, seeds[fresh], side=s) for s in ("left", "right"))
        count = high - low
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        pairs = np.unique(np.stack([np.repeat(of[fresh], count), items.item[which]]), axis=1)
        for r, i in pairs.T.tolist():
            a, b = np.searchsorted(of, [r, r + 1])
            own, all_words = items.seeds[i], items.words[i]
            hit = np.minimum(np.searchsorted(seeds[a:b], own), b - a - 1)
            present = np.flatnonzero(seeds[a:b][hit] == own)
            if len(np.unique(present[:, None] + np.arange(SEED))) < covered * len(all_words):
                continue  # no tiling can cover more than all seeds together
            first, last = w.rows[r], w.rows[r + 1]
            found = _tiled(h[first:last], at[a:b][np.isin(seeds[a:b], own)] - first, all_words)
            coverage = sum(t[2] for t in found) / len(all_words)
            if coverage >= covered:
                yield w.first + r, i, coverage, len(found), len(all_words)


def _blocks(benchmark: DataFrame, covered: float) -> Iterator[Items]:
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    for i in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id", "text").toArrow()
        yield index(block.column("item_id").to_pylist(), block.column("text").to_pylist(), covered)


def _paired(batches: Iterator[pa.RecordBatch], items: Items, covered: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        rows = [(ids[r], items.ids[i], coverage, n, size) for r, i, coverage, n, size in _matches(batch.column("text"), items, covered)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """doc_id, item_id, coverage, n_tiles, item_words for each row of ``docs`` and item that it covers.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Items of fewer than ``SEED`` words must
    occur whole; items without words match nothing; equal items are one. Null or empty texts match nothing, null ids stay
    null, repeated rows give a row each, an empty table on either side gives no rows, further columns are
    ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = (docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    text = "doc_id {}, item_id {}, coverage double, n_tiles long, item_words long".format(*kinds)
    schema = to_arrow_schema(_parse_datatype_string(text))
    texts, out = small_batches(docs).select("doc_id", "text"), None
    for items in _blocks(benchmark, covered):
        part = mapped(texts, lambda x, items=items: _paired(x, items, covered, schema), text)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that cover no item; see :func:`contaminated`."""
    small_batches(docs)
    for items in _blocks(benchmark, covered):

        def clean(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[m[0] for m in _matches(batch.column("text"), items, covered)]] = False
                yield batch.filter(pa.array(keep))

        docs = mapped(docs, clean, docs.schema)
    return docs
