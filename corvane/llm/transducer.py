"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

What follows a text can change the tokens before its end only so far back. Rules apply in order of rank,
so a change moves left by a rule (u, v) only if v begins where the change has come to, and it moves by
the length of u; the next rule on its way has a higher rank and a right part that begins with u (u itself or what rules made of it). The
longest such chain, summed over the lengths of its left parts, is the lookahead that suffices for the merge list: :func:`sufficient_lookahead`
finds it in one pass over the rules. Tokens that end so many bytes before the end of what has been
read are final, and what follows a token's end is encoded as if it stood alone. So a run of any length goes through a window of fixed size.

Pre-tokens are cut from the text window by window too: all but the last few characters' are final, and a
run of one class that fills a window is passed on to the merges as it comes. Tokens leave as windows end: each is hashed, counted and
decoded at once. The decoder keeps the bytes of a character that is not yet complete, three at most.

The state is hence of constant size whatever the length of a text: a window of text, a window of bytes, and the pieces that a worker
remembers (``REMEMBERED`` of them).
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from corvane.llm.scratch import small_batches
from corvane.llm.tokens import byte_letters, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
#: Pieces that a worker remembers; beyond it the memory starts anew. Longer pieces than this many characters are not remembered.
REMEMBERED, LONG = 200_000, 64
#: Characters of short texts whose pieces are merged together.
GROUP = 1 << 20
#: Characters of text cut into pre-tokens at once, and characters at a window's end of which the pre-tokens may still change.
WINDOW, OPEN = 1 << 16, 4

_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same on ASCII.
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_RUNS = [regex.compile(p) for p in (r"\p{L}*", r"\p{N}*", r"[^\s\p{L}\p{N}]*", r"\s*")]


def sufficient_lookahead(rules: list[tuple[str, str]]) -> int:
    """How many symbols before the end of a text its tokens may still change, whatever follows.

    ``rules`` are in order of rank, their parts single symbols or what earlier rules made (else ValueError).
    """
    reach: dict[str, int] = {}
    first: dict[str, str] = {}
    most = 0
    for u, v in rules:
        if any(len(x) > 1 and x not in first for x in (u, v)) or u + v in first:
            raise ValueError("the merge list is not proper")
        before, x = 0, v
        while True:
            before = max(before, reach.get(x, 0))
            if x not in first:
                break
            x = first[x]
        reach[u] = max(reach.get(u, 0), before + len(u))
        most = max(most, reach[u])
        first[u + v] = u
    return most


class Merges:
    """The merge list over bytes."""

    def __init__(self, rules: list[tuple[str, str]], vocabulary: dict[str, int]):
        letters = byte_letters()
        self.lookahead = sufficient_lookahead(rules)
        self.window = 4 * max(self.lookahead, max(len(u) + len(v) for u, v in rules))
        self.single = [0] * 256
        for letter, byte in letters.items():
            self.single[byte] = vocabulary[letter]
        #: By the ids of both parts: rank, and the id of what they make.
        self.rule = {(vocabulary[u], vocabulary[v]): (rank, vocabulary[u + v]) for rank, (u, v) in enumerate(rules)}
        #: The same in arrays: keys in order with their ranks, and by rank what a rule makes.
        keys = np.array([left << 16 | right for left, right in self.rule], dtype=np.int64)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        self.made = np.array([made for _, made in self.rule.values()], dtype=np.int64)
        self.bytes: dict[int, bytes] = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if all(c in letters for c in token)}

    def merged(self, data: bytes) -> list[int]:
        """Tokens of a few bytes."""
        if len(data) > LONG:
            return self._merged_by_heap(data)
        ids, rule = [self.single[b] for b in data], self.rule.get
        ranks = [rule(p) for p in zip(ids, ids[1:], strict=False)]
        while True:
            best = min((r for r in ranks if r), default=None)
            if best is None:
                return ids
            at = ranks.index(best)
            ids[at : at + 2] = [best[1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rule((ids[at - 1], ids[at]))
            if at < len(ranks):
                ranks[at] = rule((ids[at], ids[at + 1]))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 16 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], len(self.keys))

    def merged_together(self, pieces: list[bytes]) -> list[list[int]]:
        """Tokens of each of many pieces: in every turn all pieces apply their next rule."""
        out: list[list[int]] = [[]] * len(pieces)
        number = np.flatnonzero([len(p) > 0 for p in pieces])
        size, none = np.array([len(pieces[i]) for i in number], dtype=np.int64), len(self.keys)
        ids = np.array(self.single)[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full(len(ids), none)
        rank[:-1] = self._rank(ids[:-1], ids[1:])
        rank[np.cumsum(size) - 1] = none
        while len(number):
            least = np.minimum.reduceat(rank, np.cumsum(size) - size)
            done = least == none
            if done.any():
                gone = np.repeat(done, size)
                flat, cuts = ids[gone].tolist(), np.concatenate([[0], np.cumsum(size[done])]).tolist()
                for i, a, b in zip(number[done].tolist(), cuts, cuts[1:], strict=False):
                    out[i] = flat[a:b]
                ids, rank, size, number, least = ids[~gone], rank[~gone], size[~done], number[~done], least[~done]
                if not len(number):
                    break
            # The first place of each piece where its rule of least rank applies.
            hit = np.flatnonzero(rank == np.repeat(least, size))
            of = np.repeat(np.arange(len(size)), size)[hit]
            hit = hit[np.diff(of, prepend=-1) > 0]
            ids[hit] = self.made[least]
            stays = np.ones(len(ids), dtype=bool)
            stays[hit + 1] = False
            ids, rank, size = ids[stays], rank[stays], size - 1
            hit -= np.arange(len(hit))
            ends = np.cumsum(size)
            rank[hit] = none
            for at in (hit[hit < ends - 1], hit[hit > ends - size] - 1):
                rank[at] = self._rank(ids[at], ids[at + 1])
        return out

    def _merged_by_heap(self, data: bytes) -> list[int]:
        ids, rule, n = [self.single[b] for b in data], self.rule.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, at, ids[at + 1]) for at in range(n - 1) if (r := rule((ids[at], ids[at + 1])))]
        heapify(heap)
        while heap:
            (rank, made), at, right = heappop(heap)
            to = after[at]
            # Ids of parts that are no more are -1; a place may hold another token by now.
            if to >= n or ids[at] < 0 or ids[to] != right or rule((ids[at], right)) != (rank, made):
                continue
            ids[at], ids[to] = made, -1
            after[at] = after[to]
            if after[at] < n:
                before[after[at]] = at
                if r := rule((made, ids[after[at]])):
                    heappush(heap, (r, at, ids[after[at]]))
            if before[at] >= 0 and (r := rule((ids[before[at]], made))):
                heappush(heap, (r, before[at], made))
        return [i for i in ids if i >= 0]


class Run:
    """The tokens of one pre-token that comes in parts, as soon as nothing that follows can change them."""

    def __init__(self, merges: Merges):
        self.merges, self.waiting = merges, b""

    def feed(self, data: bytes) -> list[int]:
        m, out = self.merges, []
        self.waiting += data
        start = 0
        while len(self.waiting) - start >= m.window:
            final = start + m.window - m.lookahead
            for i in m.merged(self.waiting[start : start + m.window]):
                if start + len(m.bytes[i]) > final:
                    break
                start += len(m.bytes[i])
                out.append(i)
        self.waiting = self.waiting[start:]
        return out

    def finish(self) -> list[int]:
        out, self.waiting = self.merges.merged(self.waiting), b""
        return out


class Encoder:
    """Encodes texts window by window; one for each worker process and vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        split, model = held["pre_tokenizer"], held["model"]
        if held["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or model["type"] != "BPE" or model["ignore_merges"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(rules, model["vocab"])
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in held["added_tokens"]):
            raise ValueError("added tokens must stand for their own text alone")
        self.specials = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        most = max(max(self.merges.bytes), *self.special.values()) + 1
        self.bytes = [self.merges.bytes.get(i, b"") for i in range(most)]
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.names = [str(i) for i in range(most)]
        self.known: dict[str, list[int]] = {}

    def learn(self, pieces: list[str]) -> None:
        """Remember the pieces that are not known and not long."""
        new = [p for p in set(pieces) if p not in self.known and len(p) <= LONG]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = [p for p in set(pieces) if len(p) <= LONG]
        self.known.update(zip(new, self.merges.merged_together([p.encode() for p in new]), strict=True))

    def ids(self, pieces: list[str]) -> list[int]:
        """Tokens of pieces that are known or long."""
        found = list(map(self.known.get, pieces))
        if None in found:
            for i, piece in enumerate(pieces):
                if found[i] is None:
                    run = Run(self.merges)
                    found[i] = run.feed(piece.encode()) + run.finish()
        return list(chain.from_iterable(found))

    def _pieces(self, pieces: list[str]) -> list[int]:
        self.learn(pieces)
        return self.ids(pieces)

    def cut(self, text: str) -> list[str]:
        return (_ASCII_PIECES if text.isascii() else _PIECES).findall(text)

    def short(self, text: str) -> bool:
        """Whether a text is cut in one window and holds no special token."""
        return len(text) <= WINDOW and not (self.specials and self.specials.search(text))

    def plain(self, text: str, low: int, high: int, window: int = WINDOW) -> Iterator[list[int]]:
        """Tokens of ``text[low:high]``, which holds no special token."""
        held, at = "", low
        while at < high or held:
            part = text[at : min(high, at + window)]
            at, held = at + len(part), held + part
            pieces = self.cut(held)
            if at >= high:
                yield self._pieces(pieces)
                return
            left = len(held)
            while pieces and len(held) - left < OPEN:
                left -= len(pieces.pop())
            yield self._pieces(pieces)
            held = held[left:]
            if len(held) >= window:
                # One piece fills the window: its class goes on.
                held, at = yield from self._run(held, text, at, high, window)

    def _run(self, held: str, text: str, at: int, high: int, window: int) -> Iterator[list[int]]:
        """The piece that ``held`` begins with, as far as its class reaches; what is held then, and how far the text is read."""
        first = 1 if held[0] == " " and _RUNS[3].match(held, 1).end() == 1 else 0
        kind = next(k for k in _RUNS if k.match(held, first).end() > first)
        run, spaces, end = Run(self.merges), kind is _RUNS[3], kind.match(held, first).end()
        while end == len(held) and at < high:
            # Of white space the last one may belong to what follows.
            yield run.feed(held[: end - spaces].encode())
            part = text[at : min(high, at + window)]
            at, held = at + len(part), held[end - spaces :] + part
            end = kind.match(held).end()
        # Where other text follows, white space leaves its last character to it.
        end -= spaces and end < len(held)
        yield run.feed(held[:end].encode()) + run.finish()
        return held[end:], at

    def encoded(self, text: str, window: int = WINDOW) -> Iterator[list[int]]:
        """The tokens of a text, in parts that are final."""
        low = 0
        for found in self.specials.finditer(text) if self.specials else ():
            yield from self.plain(text, low, found.start(), window)
            yield [self.special[found[0]]]
            low = found.end()
        yield from self.plain(text, low, len(text), window)


class Decoder:
    """Text of bytes that come in parts: keeps the bytes of a character that is not complete."""

    def __init__(self):
        self.waiting = b""

    def feed(self, data: bytes) -> str:
        data = self.waiting + data
        cut = len(data)
        for back in range(1, min(4, len(data) + 1)):
            byte = data[-back]
            if byte < 0x80:
                break
            if byte >= 0xC0:
                if back < (2 if byte < 0xE0 else 3 if byte < 0xF0 else 4):
                    cut -= back
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        out, self.waiting = self.waiting.decode("utf-8", "replace"), b""
        return out


@lru_cache(maxsize=4)
def encoder(path: str | None = None) -> Encoder:
    return Encoder(path or vocabulary_path(VOCABULARY))


def round_trip(e: Encoder, parts: Iterable[list[int]], keep: Callable[[list[int], str], None] | None = None) -> tuple[int, str, str]:
    """Of tokens that come in parts: their number, SHA-256 of the ids in decimal joined by commas, SHA-256 of what they decode to; ``keep`` gets each part."""
    n, ids_hash, text_hash, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder()
    for ids in parts:
        if ids:
            ids_hash.update(("," * bool(n) + ",".join([e.names[i] for i in ids])).encode())
            n += len(ids)
            part = decoder.feed(b"".join([e.bytes[i] for i in ids]))
            text_hash.update(part.encode())
            if keep:
                keep(ids, part)
    part = decoder.finish()
    text_hash.update(part.encode())
    if keep:
        keep([], part)
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def token_parts(e: Encoder, texts: Iterable[str]) -> Iterator[Iterable[list[int]]]:
    """The tokens of each text, in parts. Short texts are cut ahead in groups, so that their new pieces are merged together."""
    group: list[tuple[str, list[str] | None]] = []
    size = 0
    for text in texts:
        group.append((text, e.cut(text) if e.short(text) else None))
        size += min(len(text), WINDOW)
        if size >= GROUP:
            yield from _group(e, group)
            group, size = [], 0
    yield from _group(e, group)


def _group(e: Encoder, group: list[tuple[str, list[str] | None]]) -> Iterator[Iterable[list[int]]]:
    e.learn([p for _, pieces in group for p in pieces or ()])
    for text, pieces in group:
        if pieces is None:
            yield e.encoded(text)
            # A long text's own pieces may have made the worker forget those of the group.
            e.learn([p for _, held in group for p in held or ()])
        else:
            yield [e.ids(pieces)]


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None, whole: bool) -> Iterator[pa.RecordBatch]:
    e = encoder(path)
    for batch in batches:
        rows, ids, texts = [], [], []
        for parts in token_parts(e, (text.as_py() or "" for text in batch.column("text"))):
            own: list[np.ndarray] = []
            decoded: list[str] = []
            rows.append(round_trip(e, parts, (lambda i, t, own=own, decoded=decoded: (own.append(np.array(i, np.int32)), decoded.append(t))) if whole else None))
            if whole:
                ids.append(np.concatenate([np.zeros(0, np.int32), *own]))
                texts.append("".join(decoded))
        n, ids_hash, text_hash = zip(*rows, strict=True) if rows else ((), (), ())
        arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
        arrays += [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] * whole
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * whole)


def encode(docs: DataFrame, path: str | None = None, whole: bool = False) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids_sha256, decoded_sha256, and if ``whole`` ids and decoded.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the text that the ids decode to, in UTF-8. Strings of special tokens in a text are
    those tokens. ``path``: a byte-level BPE file, the same on every machine; by default the public one.

    Null or empty text: no tokens, the digests of nothing. Rows are encoded each on its own, without a shuffle: repeated
    rows and null ids stay as they are, an empty table gives an empty result, further columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * whole
    return small_batches(docs).select("doc_id", "text").mapInArrow(lambda x: _encoded(x, path, whole), schema)
