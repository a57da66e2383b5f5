"""SuperMinHash signatures and exact overlaps of word shingles, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corvane.llm.words import Words, mix, spans_hash, words

_U = np.uint64
#: Bytes of text whose signatures are made at once.
SIGNED_BYTES = 512 << 10
_LOW48 = _U((1 << 48) - 1)
_FREE = _U(2**64 - 1)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every ``k`` consecutive words in lower case; a shorter row is one shingle, an empty one none."""
    h = w.hashes(lower=True)
    n = np.diff(w.rows)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(w.rows[:-1], count)
    return row, spans_hash(h, start, start + np.minimum(k, np.repeat(n, count)))


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, hash), as row, hash and a key of both, in the order of the key."""
    key, at = np.unique(h ^ mix(row.astype(np.uint64) + _U(1)), return_index=True)
    return row[at], h[at], key


def super_minhash(row: np.ndarray, h: np.ndarray, rows: int, size: int) -> np.ndarray:
    """Signatures of ``size`` values for the sets of hashes of each row; rows without hashes keep free values.

    Element ``x`` offers in turn ``j`` the value ``j + u_j(x)`` to the place that its own random
    permutation has at ``j``. Values of turn ``j`` are below ``j + 1``; so once every place of a row is
    taken no later turn can change it, and the row stops. Long texts stop after one or two turns.
    """
    out = np.full(rows * size, _FREE, dtype=np.uint64)
    if not len(h):
        return out.reshape(rows, size)
    order = permuted = None
    for turn in range(size):
        draw = mix(h + _U((turn + 1) * 0x9E3779B97F4A7C15 % 2**64))
        pick = ((draw >> _U(48)) * _U(size - turn) >> _U(16)).astype(np.int64) + turn
        if turn == 0:
            place = pick
        else:
            place = permuted[order, pick].astype(np.int64)
            permuted[order, pick] = permuted[order, turn]
        np.minimum.at(out, row * size + place, (draw & _LOW48) | _U(turn << 48))
        open_rows = (out.reshape(rows, size) == _FREE).any(axis=1)
        stay = open_rows[row]
        kept = int(stay.sum())
        if not kept:
            break
        if turn == 0:
            row, h, first = row[stay], h[stay], pick[stay]
            order = np.arange(kept)
            permuted = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.uint16), (kept, 1))
            permuted[order, first] = 0
        elif kept < 0.6 * len(h):
            row, h, permuted = row[stay], h[stay], permuted[stay]
            order = np.arange(kept)
    return out.reshape(rows, size)


def signed(batches: Iterator[pa.RecordBatch], k: int, bands: int, width: int) -> Iterator[pa.RecordBatch]:
    """doc_id, n (distinct shingles), low and high (128 bits of the set), bands (a hash of each band of the signature)."""
    for batch in batches:
        ids = batch.column("doc_id")
        for w in words(batch.column("text"), SIGNED_BYTES):
            rows = w.last - w.first
            row, h, _ = distinct(*shingles(w, k))
            n = np.bincount(row, minlength=rows)
            low, high = np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            np.add.at(low, row, mix(h ^ _U(0x1F83D9ABFB41BD6B)))
            np.add.at(high, row, mix(h ^ _U(0x5BE0CD19137E2179)))
            values = super_minhash(row, h, rows, bands * width)
            at = np.arange(0, rows * bands * width, width)
            banded = spans_hash(values.ravel(), at, at + width).reshape(rows, bands) ^ mix(np.arange(1, bands + 1, dtype=np.uint64))
            offsets = pa.array(np.arange(0, rows * bands + 1, bands, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(banded.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids.slice(w.first, rows), pa.array(n.astype(np.int64)), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), lists], names=["doc_id", "n", "low", "high", "bands"])


def overlapping(batches: Iterator[pa.RecordBatch], k: int, part: int, whole: int) -> Iterator[pa.RecordBatch]:
    """The rows (a, b) of which the sets of both texts have whole * common >= part * together.

    Rows (a, b, text) come in order: each a with its own text (several, if rows that share the id differ) and no b, then its partners b with theirs.
    """
    own: list[np.ndarray] = []
    of, fresh_own = None, False
    for batch in batches:
        a = batch.column("a").to_pylist()
        first, keep = batch.column("b").is_null().to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, dtype=bool)
        for w in words(batch.column("text")):
            row, h = shingles(w, k)
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            fresh = np.ones(len(h), dtype=bool)
            fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            row, h = row[fresh], h[fresh]
            cuts = np.searchsorted(row, np.arange(w.last - w.first + 1)).tolist()
            for i, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False), w.first):
                mine = h[low:high]
                if first[i]:
                    if a[i] != of or not fresh_own:
                        own, of, fresh_own = [], a[i], True
                    if len(mine) and not any(np.array_equal(x, mine) for x in own):
                        own.append(mine.copy())
                    continue
                fresh_own = False
                for x in own if of == a[i] else ():
                    common = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, mine), len(x) - 1)] == mine))
                    if common > 0 and whole * common >= part * (len(x) + len(mine) - common):
                        keep[i] = True
                        break
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def shingled(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """id, n, component and each distinct shingle of its text."""
    for batch in batches:
        for w in words(batch.column("text")):
            row, h, _ = distinct(*shingles(w, k))
            at = pa.array(row + w.first)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("n").take(at), batch.column("component").take(at), pa.array(h.view(np.int64))], names=["id", "n", "component", "shingle"])
