"""Removal of long repeated word sequences, found by recompression.

Each text is a string of word names. A round joins every run of one symbol, and every
pair whose left symbol is of the round's left half and whose right symbol is of its right
half, into a new symbol. A name is a 64-bit hash of the parts and the round, so that it is
the same in every text of the corpus without a dictionary. Which symbols join depends only
on the symbols themselves; equal substrings hence get equal symbols but for a few at their
two ends. For a window of ``window`` words the symbols that the window alone determines are
what is left after dropping the outermost symbol at each side in each round. In the last
round that leaves several, the inner one of least hash, named together with its two
neighbours, is the window's anchor. Equal windows have equal anchors. Consecutive windows with one anchor make a block of at most ``window`` windows.

Spark then counts anchor names over the corpus. A name seen once clears its windows. Where
all blocks of a name are equal, their windows repeat. Only for the other names are single
windows compared, one block of each distinct text standing for its copies, so that a passage
in a third of all texts costs a row for each place and never pairs of places.

A name and the hash of its block are compared together; both come from 64-bit hashes of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import drop, hot_join, mapped, small_batches, written
from corvane.llm.words import Words, mix, spans_hash, words

_U = np.uint64
#: Rounds of recompression; a window keeps the last round that leaves it LEAST symbols.
ROUNDS, LEAST = 3, 4

_BLOCKS = "h1 long, h2 int, start int, n int, name long, block long"


def _round(names: np.ndarray, row: np.ndarray, turn: int) -> np.ndarray:
    """Number of the new symbol of each symbol: x..x y..y is one if x is left and y right, and so is x..x."""
    left = mix(names ^ _U(0xA24BAED4963EE407 * (turn + 1) % 2**64)) >> _U(63) == 0
    joined = np.empty(len(names), dtype=bool)
    joined[0] = False
    same = names[1:] == names[:-1]
    joined[1:] = (same | (left[:-1] & ~left[1:])) & (row[1:] == row[:-1])
    return np.cumsum(~joined) - 1


def anchors(h: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start of ``window`` words: whether a window starts there, its anchor's name and place."""
    n = len(h)
    count = max(0, n - window + 1)
    valid = row[:count] == row[window - 1 :] if count else np.zeros(0, bool)
    low = np.arange(count, dtype=np.int64)
    high = low + window
    anchor = np.zeros(count, dtype=np.uint64)
    place = np.full(count, -1, dtype=np.int64)
    level_names, level_row, level_first = h, row, np.arange(n, dtype=np.int64)
    pending = np.flatnonzero(valid)
    low, high = low[pending], high[pending]
    for turn in range(ROUNDS + 1):
        stays = np.zeros(len(low), dtype=bool)
        if turn < ROUNDS:
            new = _round(level_names, level_row, turn)
            low_up, high_up = new[low] + 1, new[high - 1]
            stays = high_up - low_up >= LEAST
        ends = ~stays
        if ends.any():
            inner = np.arange(1, len(level_names) - 1)
            named = spans_hash(level_names, inner - 1, inner + 2) ^ _U(turn)
            at = _least(mix(level_names ^ _U(0x5851F42D4C957F2D)), low[ends] + 1, high[ends] - 1)
            where = pending[ends]
            anchor[where] = named[at - 1]
            place[where] = level_first[at] * (ROUNDS + 1) + turn
        if not stays.any():
            break
        pending, low, high = pending[stays], low_up[stays], high_up[stays]
        begins = np.flatnonzero(np.diff(new, prepend=-1))
        level_names = spans_hash(level_names, begins, np.append(begins[1:], len(new))) ^ _U(turn + 1)
        level_row, level_first = level_row[begins], level_first[begins]
    return valid, anchor, place


def _least(key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Position of the least key in each [low, high), the first of equal ones."""
    best = np.arange(len(key))
    out = np.empty(len(low), dtype=np.int64)
    size = (high - low).astype(np.int64)
    width = 1
    while True:
        mine = (size >= width) & (size < 2 * width)
        if mine.any():
            p, q = best[low[mine]], best[high[mine] - width]
            out[mine] = np.where(key[q] < key[p], q, p)
        if not (size >= 2 * width).any():
            return out
        if len(best) <= width:
            return out
        p, q = best[:-width], best[width:]
        best = np.where(key[q] < key[p], q, p)
        width *= 2


def _blocks(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
        for w in words(batch.column("text")):
            if len(w.starts) < window:
                continue
            h, row = w.hashes(), w.row_of()
            valid, name, place = anchors(h, row, window)
            at = np.flatnonzero(valid)
            if not len(at):
                continue
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
            begin = np.flatnonzero(fresh)
            first, n = at[begin], np.diff(np.append(begin, len(at)))
            block = spans_hash(h, first, first + n + window - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[w.first + row[first]]), pa.array(h2[w.first + row[first]]), pa.array((first - w.rows[row[first]]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(name[first].view(np.int64)), pa.array(block.view(np.int64))],
                names=["h1", "h2", "start", "n", "name", "block"],
            )


def _windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The hash of every window of the wanted blocks of each text."""
    for batch in batches:
        wanted = batch.column("wanted")
        lengths = np.diff(wanted.offsets.to_numpy())
        flat = wanted.flatten()
        part = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("start", "n", "name", "block")}
        of = np.concatenate([[0], np.cumsum(lengths)])
        for w in words(batch.column("text")):
            mine = slice(of[w.first], of[w.last])
            base = np.repeat(w.rows[:-1], lengths[w.first : w.last])
            n = part["n"][mine].astype(np.int64)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(base + part["start"][mine], n) + offset
            if not len(at):
                continue
            hashed = spans_hash(w.hashes(), at, at + window)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part["name"][mine], n)), pa.array(np.repeat(part["block"][mine], n)), pa.array(offset.astype(np.int32)), pa.array(hashed.view(np.int64))], names=["name", "block", "offset", "hash"])


def _removed(w: Words, places: pa.Array, window: int) -> np.ndarray:
    """Whether each word of these rows lies in a window that ``places`` (start, mask of the windows from there on) of its row name."""
    change = np.zeros(len(w.starts) + 1, dtype=np.int64)
    held = places.fill_null([])
    flat = held.flatten()
    row = np.repeat(np.arange(len(held)), held.value_lengths().to_numpy())
    place, bit = np.nonzero(np.unpackbits(flat.field("mask").to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    at = w.rows[row[place]] + flat.field("start").to_numpy()[place] + bit
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch], window: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, digests, texts = [], [], [], []
        for w in words(batch.column("text")):
            gone, held = _removed(w, batch.column("places").slice(w.first, w.last - w.first), window), w.buffer.tobytes()
            for i in range(w.last - w.first):
                a, b = int(w.rows[i]), int(w.rows[i + 1])
                removed = int(gone[a:b].sum())
                text = held[w.bounds[i] : w.bounds[i + 1]]
                if removed:
                    # Stretches of kept words, each with whatever separates them.
                    edges = np.flatnonzero(np.diff(np.concatenate([[True], gone[a:b], [True]]))) + a
                    text = b" ".join([held[w.starts[x] : w.ends[y - 1]] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                kept = b" ".join(text.split())
                n_words.append(b - a)
                n_removed.append(removed)
                digests.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode())
        arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(arrays + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its words without those of any window seen elsewhere too.

    A window is ``window`` (3 to 64) consecutive words of one text. Every occurrence is removed,
    also within one text; windows are judged on the input. Columns: doc_id, n_words, n_removed,
    kept_sha256 (of the kept words joined by one space), and kept_text if ``with_text``.

    Null text counts as no words; a text under ``window`` words loses nothing; an empty table
    gives an empty result; repeated rows repeat each other; further columns are ignored. Rows
    are told apart by 96 bits of hashes of both columns, so null or repeated ids do no harm.
    """
    if not 3 <= window <= 64:
        raise ValueError("window must be between 3 and 64 words")
    small_batches(docs)
    base = docs.select(F.xxhash64("doc_id", "text").alias("h1"), F.hash("text", "doc_id").alias("h2"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = written(mapped(base.select("h1", "h2", "text"), lambda x: _blocks(x, window), _BLOCKS), "blocks")
    names = (
        blocks.groupBy("name")
        .agg(F.count("*").alias("c"), F.min("block").alias("low"), F.max("block").alias("high"))
        .filter("c > 1")
        .select("name", "c", (F.col("low") == F.col("high")).alias("equal"))
    )
    names = written(names, "names")
    joined = hot_join(blocks, names, ["name"], "c", blocks.count())
    # Blocks that repeat whole need no name any more.
    shared = written(joined.select("h1", "h2", "start", "n", "equal", *(F.when(~F.col("equal"), F.col(c)).alias(c) for c in ("name", "block"))), "shared")
    drop(names)
    drop(blocks)
    whole = F.when(F.col("n") >= 64, F.lit(-1).cast("long")).otherwise(F.expr("shiftleft(1L, n) - 1L"))
    # Keys are structs: a hot name is then dealt anew by its blocks instead of staying in the task of its name.
    kinds = (
        shared.filter("NOT equal")
        .groupBy(F.struct("name", "block").alias("id"))
        .agg(F.count("*").alias("c"), F.min(F.struct("h1", "h2", "start", "n")).alias("at"))
    )
    kinds = written(kinds.select("id.name", "id.block", "c", "at.*"), "kinds")
    wanted = kinds.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "n", "name", "block")).alias("wanted"))
    # With doc_id, which it does not need, this exchange of the texts is the same as the last one below and is made once.
    windows = mapped(base.join(wanted, ["h1", "h2"]).select("doc_id", "text", "wanted"), lambda x: _windows(x, window), "name long, block long, offset int, hash long")
    again = windows.groupBy("name", "hash").agg(F.min("block").alias("low"), F.max("block").alias("high")).filter("low <> high").select("name", "hash")
    masks = (
        windows.join(again, ["name", "hash"])
        .groupBy(F.struct("name", "block").alias("id"))
        .agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask"))
        .select("id.name", "id.block", "mask")
    )
    copied = kinds.filter("c > 1").select("name", "block", whole.alias("all"))
    masks = copied.join(masks, ["name", "block"], "full").select("name", "block", F.coalesce("all", "mask").alias("mask"))
    places = shared.filter("equal").select("h1", "h2", "start", whole.alias("mask")).unionByName(
        shared.filter("NOT equal").join(masks, ["name", "block"]).select("h1", "h2", "start", "mask")
    )
    # Repeated rows find each place once for each of them.
    places = places.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "mask")).alias("places"))
    out = base.join(places, ["h1", "h2"], "left").select("doc_id", "text", "places")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return mapped(out, lambda x: _kept(x, window, with_text), schema)
