"""Tokens of whole texts by a word-end BPE vocabulary, with a shortcut for whole tokens.

Offline, every vocabulary string that ends a word is encoded alone: those that give exactly
their own id are proven whole tokens. A text is then cut at its separators; a piece of it
that is a whole token counts as one without merging. Only the other pre-tokens go through the
library's merges, many at once and once for each distinct piece that a worker meets.

This is exact because the vocabulary's splitting pattern never crosses white space, and
because on characters below U+0180 its normalizer only lower-cases and folds white space. Pieces
with other characters or with control characters that count as white space are encoded, each
alone, by the library; so are whole texts with strings of special tokens.

A worker knows pieces by a 64-bit hash of their bytes, which no pattern of letters cancels: of 10**10 distinct
pieces held against ``REMEMBERED`` known ones a false match has a chance of 1e-3 in all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from corvane.llm.scratch import mapped, small_batches
from corvane.llm.words import Words, utf8, words

VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 1_000_000
#: Pieces that the library merges at once.
MERGED = 4096

_UNUSUAL = regex.compile("[^\x00-\x1b\x20-ſ]")
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the public vocabulary lies on the machine that asks (each worker asks for itself)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else the next from U+0100."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def whole_tokens(tokenizer: Tokenizer) -> dict[str, int]:
    """Strings that, alone, are encoded as one token, with its id: each is tried."""
    letters = byte_letters()
    strings = []
    for token in tokenizer.get_vocab():
        if token.endswith("</w>") and all(c in letters for c in token[:-4]):
            try:
                strings.append(bytes(letters[c] for c in token[:-4]).decode())
            except UnicodeDecodeError:
                continue
    found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return {s: e.ids[0] for s, e in zip(strings, found, strict=True) if len(e.ids) == 1 and _PRETOKEN.fullmatch(s)}


class Encoder:
    """Encodes and counts; one for each worker process and vocabulary.

    What is known of a piece (a word between separators, A-Z in lower case) lies in arrays under its 64-bit hash:
    where its ids begin in ``flat`` and how many they are. That is about 40 bytes a piece.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        #: The merges alone, for pre-tokens written in byte letters.
        self.merges = Tokenizer(self.tokenizer.model)
        self.letter = {b: c for c, b in byte_letters().items()}
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = whole_tokens(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        """Know the whole tokens alone."""
        self.hashes, self.begins, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, dtype="<u4"), 0
        column = pa.array(list(self.whole))
        hashes = np.concatenate([w.hashes(lower=True) for w in words(column)])
        order = np.argsort(hashes)
        self._remember(hashes[order], [[i] for i in np.array(list(self.whole.values()))[order].tolist()])

    def _remember(self, hashes: np.ndarray, ids: list[list[int]]) -> None:
        """Add pieces, in the order of their hashes."""
        sizes = np.array([len(i) for i in ids], dtype=np.int32)
        total = int(sizes.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), dtype="<u4")])
        self.flat[self.used : self.used + total] = np.fromiter((i for own in ids for i in own), dtype="<u4", count=total)
        begins = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begins, self.sizes = (np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.begins, begins), (self.sizes, sizes)))
        self.used += total

    def _letters(self, pretoken: str) -> str:
        return pretoken if pretoken.isascii() and pretoken.isprintable() else "".join([self.letter[b] for b in pretoken.encode()])

    def _learn(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: whole tokens are looked up, other pre-tokens merged, pieces with unusual characters left to the library."""
        out: list = [None] * len(pieces)
        split: list[tuple[int, list[str]]] = []
        unusual: list[int] = []
        strings = [p.decode("utf-8", "replace") for p in pieces]
        for i, s in enumerate(strings):
            if _UNUSUAL.search(s):
                unusual.append(i)
                continue
            low = s.lower()
            found = [low] if low.isalpha() else _PRETOKEN.findall(low)
            if len(found) == 1 and found[0] in self.whole:
                out[i] = [self.whole[found[0]]]
            else:
                split.append((i, found))
        rest = list({t for _, found in split for t in found if t not in self.whole})
        learnt = {}
        for i in range(0, len(rest), MERGED):
            part = rest[i : i + MERGED]
            learnt |= {t: e.ids for t, e in zip(part, self.merges.encode_batch_fast([self._letters(t) for t in part], add_special_tokens=False), strict=True)}
        for i, found in split:
            own: list[int] = []
            for t in found:
                own += learnt[t] if t in learnt else [self.whole[t]]
            out[i] = own
        if unusual:
            for i, e in zip(unusual, self.tokenizer.encode_batch_fast([strings[i] for i in unusual], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def _known(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in ``flat``, and how many they are."""
        h, first, back = np.unique(w.hashes(lower=True), return_index=True, return_inverse=True)
        if len(self.hashes) + len(h) > len(self.whole) + REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        new = np.flatnonzero(self.hashes[at] != h)
        if len(new):
            held = w.buffer.tobytes()
            which = first[new]
            self._remember(h[new], self._learn([held[a:b] for a, b in zip(w.starts[which].tolist(), w.ends[which].tolist(), strict=True)]))
            at = np.searchsorted(self.hashes, h)
        return self.begins[at][back], self.sizes[at][back]

    def _special(self, w: Words) -> list[int]:
        """Rows with a string of a special token, which may hold or join words: the library encodes them whole."""
        bounds = np.concatenate([w.bounds, [len(w.buffer) + 1]])
        found: set[int] = set()
        held = w.buffer.tobytes() if self.special else b""
        for s in self.special:
            at = held.find(s)
            while at >= 0:
                found.add(int(np.searchsorted(bounds, at, side="right")) - 1)
                at = held.find(s, at + 1)
        return sorted(found)

    def _whole_row(self, w: Words, row: int) -> list[int]:
        return self.tokenizer.encode(w.buffer[w.bounds[row] : w.bounds[row + 1]].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids

    def counts(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Number of tokens of each text, slice by slice."""
        for w in words(column):
            ends = np.concatenate([[0], np.cumsum(self._known(w)[1], dtype=np.int64)])
            out = ends[w.rows[1:]] - ends[w.rows[:-1]]
            for row in self._special(w):
                out[row] = len(self._whole_row(w, row))
            yield out

    def encoded(self, column: pa.Array) -> Iterator[list[bytes]]:
        """Ids of each text as little-endian unsigned 32-bit numbers, slice by slice."""
        for w in words(column):
            begins, sizes = self._known(w)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            ids = self.flat[np.repeat(begins - ends[:-1], sizes) + np.arange(ends[-1])]
            cuts = ends[w.rows].tolist()
            out = [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            for row in self._special(w):
                out[row] = np.array(self._whole_row(w, row), dtype="<u4").tobytes()
            yield out

    def count(self, texts: list[str | None]) -> list[int]:
        return [int(n) for part in self.counts(pa.array(texts, pa.string())) for n in part]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [ids for part in self.encoded(pa.array(texts, pa.string())) for ids in part]


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path or vocabulary_path())


def _counted(batches: Iterator[pa.RecordBatch], path: str | None, limit: int) -> Iterator[pa.RecordBatch]:
    counts = encoder(path).counts
    for batch in batches:
        n_bytes = np.diff(utf8(batch.column("text"))[1])
        n_tokens = np.concatenate([np.zeros(0, np.int64), *counts(batch.column("text"))])
        arrays = [batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_tokens > limit)]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    ``path``: the vocabulary file, the same on every machine; by default the public one.
    Null or empty text: 0 bytes, 0 tokens. Rows are counted each on its own, without a shuffle:
    repeated rows and null ids stay as they are, an empty table gives an empty result, further
    columns are ignored.
    """
    return mapped(small_batches(docs).select("doc_id", "text"), lambda x: _counted(x, path, limit), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
