"""Words of many texts at once, as NumPy arrays over the UTF-8 bytes of an Arrow column.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Those separators are single bytes in
UTF-8, so the split is done on bytes. Hashes are 64-bit and depend on the bytes alone:
they are the same in every task, run and cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Keeps the first 0 to 8 bytes of a little-endian block.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_PLACE, _SIZE, _RIGHT = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), _U(0xC2B2AE3D27D4EB4F)
#: Bytes of text handled at once; a longer single text is handled alone.
CHUNK_BYTES = 2 << 20
#: Words hashed at once.
STRETCH = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (in place where it can)."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each slice ``values[start:end]`` of 64-bit values, order and length included.

    Runs of 1, 2, 4 ... values are named by scrambling the names of their halves; a slice is named by the longest of these runs
    at either end of it. No step is linear, so that no pattern of values cancels: two different slices agree with a chance of about 2**-63.
    """
    size = ends - starts
    out, most = np.zeros(len(starts), dtype=np.uint64), int(size.max(initial=0))
    level, width = values, 1
    while width <= most:
        mine = np.flatnonzero((size >= width) & (size < 2 * width))
        if len(mine) == len(out):
            out = _joined(level[starts], level[ends - width])
        elif len(mine):
            out[mine] = _joined(level[starts[mine]], level[ends[mine] - width])
        if 2 * width <= most:
            level = _joined(level[:-width], level[width:])
        width *= 2
    out += size.astype(np.uint64) * _SIZE
    return mix(out)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    turned = right << _U(31)
    turned |= right >> _U(33)
    turned *= _RIGHT
    turned += left
    return mix(turned)


def bytes_hash(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span of a buffer that has 8 more bytes at its end.

    Blocks of 8 bytes are scrambled with their place in the span before they are added up. Spans of up to 8 bytes and of one
    length never share a hash, others with a chance of about 2**-63, whatever their letters.
    """
    size = ends - starts
    at_any_byte = np.ndarray(len(buffer) - 7, dtype="<u8", buffer=buffer, strides=(1,))
    out = mix(at_any_byte[starts] & _FIRST[np.minimum(size, 8)])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] - 1) >> 3
        first = np.cumsum(more) - more
        place = np.arange(1, more.sum() + 1) - np.repeat(first, more)
        block = at_any_byte[np.repeat(starts[long], more) + 8 * place]
        block &= _FIRST[np.minimum(np.repeat(size[long], more) - 8 * place, 8)]
        block = mix(block) + place.astype(np.uint64) * _PLACE
        out[long] += np.add.reduceat(mix(block), first)
    out += size.astype(np.uint64) * _SIZE
    return mix(out)


@dataclass
class Words:
    """Words of the rows ``first`` .. ``last`` - 1 of a batch."""

    first: int
    last: int
    buffer: np.ndarray  #: bytes of these rows
    starts: np.ndarray  #: byte offset of each word in buffer
    ends: np.ndarray
    rows: np.ndarray  #: first word of each row, and the number of words at the end
    bounds: np.ndarray  #: first byte of each row, and the number of bytes at the end

    def padded(self, lower: bool = False) -> np.ndarray:
        """The bytes, A-Z in lower case if ``lower``, and 8 more."""
        out = np.zeros(len(self.buffer) + 8, dtype=np.uint8)
        out[:-8] = _LOWER[self.buffer] if lower else self.buffer
        return out

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A hash of each word, in stretches of ``STRETCH`` words so that long texts take little memory."""
        buffer, out = self.padded(lower), np.empty(len(self.starts), dtype=np.uint64)
        for first in range(0, len(out), STRETCH):
            part = slice(first, first + STRETCH)
            out[part] = bytes_hash(buffer, self.starts[part], self.ends[part])
        return out

    def row_of(self) -> np.ndarray:
        """The row (from ``first``) of each word."""
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each."""
    first, n = 0, len(at) - 1
    while first < n:
        last = int(np.searchsorted(at, at[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def words(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, separator: np.ndarray = _SEPARATOR) -> Iterator[Words]:
    """Words of slices of about ``limit`` bytes; ``separator`` tells for each byte, of ASCII alone, whether it keeps words apart."""
    data, at = utf8(column)
    for first, last in chunks(at, limit):
        buffer = data[at[first] : at[last]]
        bounds = at[first : last + 1] - at[first]
        inside = ~separator[buffer]
        starting, ending = inside.copy(), inside.copy()
        starting[1:] &= ~inside[:-1]
        ending[:-1] &= ~inside[1:]
        cuts = bounds[(bounds > 0) & (bounds < len(buffer))]
        starting[cuts] |= inside[cuts]
        ending[cuts - 1] |= inside[cuts - 1]
        starts, ends = np.flatnonzero(starting), np.flatnonzero(ending) + 1
        yield Words(first, last, buffer, starts, ends, np.searchsorted(starts, bounds), bounds)
