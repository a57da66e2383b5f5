"""Packing of token streams into training sequences of several lengths.

Documents are routed by what remains of them after whole longest windows have been cut off:
the remainder belongs to the smallest tier that holds it. Windows of the longest tier are
opened by its own pieces, their gaps filled from shorter tiers, the largest fitting piece
first; a gap that no whole piece fits is closed by cutting one. What shorter tiers have left
is packed the same way into their own shorter windows. A window is emitted when full, so
every sequence but the last of a partition is exactly as long as its tier, and tiers are
powers of two, which need no padding.

Every task packs the rows of its own input partition as they stream by: nothing is shuffled,
at most ``HELD`` tokens wait at once, and a task that is run again gives the same rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from corvane.llm.scratch import mapped, small_batches
from corvane.llm.tokens import encoder

TIERS = (256, 512, 1024, 2048)
#: Tokens that wait before a round of packing.
HELD = 1_000_000
#: Sequences of a step group; groups of a partition get like numbers of tokens.
STEP = 64

_SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


@dataclass(order=True, slots=True)
class Piece:
    """``length`` ids of a document from its id ``low`` on, in ``ids`` after ``skip`` of them; orders by length, then arrival."""

    length: int
    number: int
    doc: object = field(compare=False)
    total: int = field(compare=False)
    low: int = field(compare=False)
    skip: int = field(compare=False)
    ids: bytes = field(compare=False)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        first = Piece(n, self.number, self.doc, self.total, self.low, self.skip, self.ids)
        return first, Piece(self.length - n, self.number, self.doc, self.total, self.low + n, self.skip + n, self.ids)

    def crc32(self) -> int:
        return zlib.crc32(memoryview(self.ids)[4 * self.skip : 4 * (self.skip + self.length)])


class Packer:
    def __init__(self, tiers: tuple[int, ...] = TIERS, held: int = HELD):
        if any(t < 1 or t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
            raise ValueError("tiers must be rising powers of two")
        self.tiers, self.held = tiers, held
        self.waiting: list[list[Piece]] = [[] for _ in tiers]
        self.amounts = [0] * len(tiers)
        self.number = 0

    def add(self, doc: object, ids: bytes) -> Iterator[tuple[int, list[Piece]]]:
        """Yields the sequences that this document completes: (tier, pieces)."""
        n, longest, low = len(ids) // 4, self.tiers[-1], 0
        self.number += 1
        while n - low >= longest:
            yield longest, [Piece(longest, self.number, doc, n, low, low, ids)]
            low += longest
        if n > low:
            # What waits holds its own ids alone, not those of a long document's whole windows.
            self._wait(Piece(n - low, self.number, doc, n, low, 0, ids[4 * low :]))
        if sum(self.amounts) >= self.held:
            yield from self.pack()

    def _wait(self, piece: Piece) -> None:
        tier = next(i for i, t in enumerate(self.tiers) if piece.length <= t)
        insort(self.waiting[tier], piece)
        self.amounts[tier] += piece.length

    def _pop(self, tier: int, at: int) -> Piece:
        piece = self.waiting[tier].pop(at)
        self.amounts[tier] -= piece.length
        return piece

    def _take(self, gap: int, upto: int) -> Piece | None:
        """The largest waiting piece of the tiers up to ``upto`` that fits; else the shortest, cut."""
        for tier in range(upto, -1, -1):
            if at := bisect_right(self.waiting[tier], gap, key=lambda p: p.length):
                return self._pop(tier, at - 1)
        for tier in range(upto + 1):
            if self.waiting[tier]:
                first, rest = self._pop(tier, 0).cut(gap)
                self._wait(rest)
                return first
        return None

    def pack(self) -> Iterator[tuple[int, list[Piece]]]:
        """Empty the tiers from the longest down; what can't fill a window of its tier waits on."""
        for tier in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[tier]
            while self.waiting[tier] and sum(self.amounts[: tier + 1]) >= size:
                piece = self._pop(tier, -1)
                window, gap = [piece], size - piece.length
                while gap:
                    piece = self._take(gap, tier)
                    assert piece is not None
                    window.append(piece)
                    gap -= piece.length
                yield size, window

    def finish(self) -> Iterator[tuple[int, list[Piece]]]:
        """Pack, then the rest end to end in longest windows, of which the last may have a gap."""
        yield from self.pack()
        window, gap = [], self.tiers[-1]
        for piece in (p for t in reversed(self.waiting) for p in reversed(t)):
            while piece is not None:
                part, piece = piece.cut(gap) if piece.length > gap else (piece, None)
                window.append(part)
                gap -= part.length
                if not gap:
                    yield self.tiers[-1], window
                    window, gap = [], self.tiers[-1]
        if window:
            yield self.tiers[-1], window
        self.waiting, self.amounts = [[] for _ in self.tiers], [0] * len(self.tiers)


class Steps:
    """Deals sequences to step groups: of the open groups each gets as many of every tier, give or take one."""

    def __init__(self, size: int):
        self.size, self.seen, self.count = size, {}, 0

    def of(self, tier: int) -> int:
        """A tier's sequences are dealt in turn, so that tokens of groups differ by one sequence a tier at most."""
        block, self.count = self.count // (self.size * 8), self.count + 1
        turn = self.seen[tier, block] = self.seen.get((tier, block), -1) + 1
        self.seen = {k: v for k, v in self.seen.items() if k[1] == block}
        return block * 8 + turn % 8


def _packed(batches: Iterator[pa.RecordBatch], path: str | None, tiers: tuple[int, ...], end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoded, packer, steps = encoder(path).encoded, Packer(tiers), Steps(STEP)
    partition = TaskContext.get().partitionId()
    last, serial = end.to_bytes(4, "little"), 0
    rows: list[tuple] = []

    def emit(sequences) -> None:
        nonlocal serial
        for tier, pieces in sequences:
            group, offset = (partition << 32) + steps.of(tier), 0
            for p in pieces:
                rows.append((p.doc, p.low, p.length, p.crc32(), p.total, (partition << 32) + serial, offset, tier, group))
                offset += p.length
            serial += 1

    def flushed() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in batches:
        docs = iter(batch.column("doc_id").to_pylist())
        for part in encoded(batch.column("text")):
            for ids in part:
                emit(packer.add(next(docs), ids + last))
                if len(rows) >= 10_000:
                    yield flushed()
    emit(packer.finish())
    if rows:
        yield flushed()


def pack(docs: DataFrame, path: str | None = None, tiers: tuple[int, ...] = TIERS, end: int = 1) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text), its ids and then the id ``end``, into sequences.

    One row per piece: doc_id, start (ids of the document before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (place in the sequence), tier (length of the sequence, padding included),
    step_group (groups have like mixes of tiers). Each id lies in exactly one piece. A partition
    has at most one sequence that needs padding.

    Null or empty text: the one id ``end``. Very long texts fill windows of their own. Repeated rows
    are packed each; an empty table gives no rows; further columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = _SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(_parse_datatype_string(text))
    return mapped(small_batches(docs).select("doc_id", "text"), lambda x: _packed(x, path, tuple(tiers), end, schema), text)
