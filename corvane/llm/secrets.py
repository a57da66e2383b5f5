"""Secrets in texts: fixed patterns, and a battery of randomness tests for strings of no known form.

The battery takes every run of at least ``SHORTEST`` letters of the usual encodings, infers the
smallest encoding that holds it, and tests that its letters are drawn evenly and independently:
chi-squared over groups of the alphabet, the runs test about the alphabet's middle, and serial
correlation. Fisher's sum of the three is small for random strings. How small it gets for
text depends on length and encoding; ``secrets_null`` holds that null for both, fitted offline on
strings made of words and numbers, so that it is the same for every corpus. It gives each string the
probability that text looks as random, and Benjamini and Hochberg's rule accepts strings in each
class of lengths so that at most ``RATE`` of them are expected to be text. Strings of lower-case
letters alone are judged like all others.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import small_batches, written
from corvane.llm.secrets_null import LEVELS, NULL
from corvane.llm.words import chunks, utf8

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
_KEYWORDS = ("passw", "secret", "token", "api")

SHORTEST, RATE = 20, 0.01
#: Lower bounds of the classes of lengths.
LENGTHS = (20, 24, 28, 32, 40, 48, 64, 96)
#: Fisher sums are counted in steps of 1 / STEPS up to TOP.
STEPS, TOP = 4, 60

_RUN = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % SHORTEST)
_LETTERS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "lower26": "abcdefghijklmnopqrstuvwxyz",
    "upper26": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "upper36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_ENCODINGS = tuple(_LETTERS)
_HELD = tuple((k, frozenset(letters)) for k, letters in _LETTERS.items())
_GROUPS = ("aeiou", "tnshrdlc", "bfgjkmpqvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789", "+/-_")
_GROUP = np.full(128, len(_GROUPS), dtype=np.int64)
for _i, _g in enumerate(_GROUPS):
    _GROUP[[ord(c) for c in _g]] = _i
_erfc = np.frompyfunc(math.erfc, 1, 1)


def _runs_of(mask: np.ndarray, size: int) -> np.ndarray:
    """Places where ``size`` true values begin."""
    width = 1
    while 2 * width <= size and len(mask) > width:
        mask, width = mask[:-width] & mask[width:], 2 * width
    rest = size - width
    return np.flatnonzero(mask[:-rest] & mask[rest:]) if 0 < rest < len(mask) else np.flatnonzero(mask) if not rest else np.zeros(0, np.int64)


def _class_of(letters: str) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[ord(c) for c in letters]] = True
    return table


_ANY, _HEXADECIMAL = _class_of("".join(_GROUPS)), _class_of(_LETTERS["hex"])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start, then kind as listed in KINDS."""
    found = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return found


def hex_spans(text: str) -> list[tuple[int, int, str]]:
    return [(*m.span(), "hex") for m in HEX.finditer(text) if len(m[0]) >= 32]


def _normal(z: np.ndarray) -> np.ndarray:
    """Two-sided probability of |z|."""
    return _erfc(np.abs(z) / math.sqrt(2)).astype(float)


def encoding(string: str) -> str:
    """The smallest encoding that holds a string; base64url for a mixture that none holds."""
    kinds = set(string)
    return next((k for k, letters in _HELD if kinds <= letters), "base64url")


def fisher(strings: list[str]) -> np.ndarray:
    """Fisher's sum of the three tests for each string (padding left out): small where the string looks random."""
    out = np.empty(len(strings))
    by: dict[str, list[int]] = {}
    for i, s in enumerate(strings):
        by.setdefault(encoding(s), []).append(i)
    for kind, which in by.items():
        letters = _LETTERS[kind]
        place = np.full(128, len(letters) // 2, dtype=np.int64)
        place[[ord(c) for c in letters]] = np.arange(len(letters))
        codes = [np.frombuffer(strings[i].encode(), np.uint8) for i in which]
        n = np.array([len(c) for c in codes])
        flat, of = np.concatenate(codes), np.repeat(np.arange(len(n)), n)
        width = len(_GROUPS) + 1
        seen = np.bincount(of * width + _GROUP[flat], minlength=len(n) * width).reshape(len(n), width)[:, : len(_GROUPS)]
        part = np.bincount(_GROUP[[ord(c) for c in letters]], minlength=width)[: len(_GROUPS)] / len(letters)
        held = part > 0
        expected = n[:, None] * part[held]
        chi = ((seen[:, held] - expected) ** 2 / expected).sum(axis=1)
        df = max(1, int(held.sum()) - 1)
        # Wilson and Hilferty's normal form of chi-squared; only an excess counts.
        z = (np.cbrt(chi / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
        p_even = np.clip(_erfc(z / math.sqrt(2)).astype(float) / 2, 1e-30, 1)
        x = place[flat].astype(float)
        upper = x >= len(letters) / 2
        n1 = np.bincount(of, weights=upper)
        n2 = n - n1
        inner = of[1:] == of[:-1]
        changes = np.bincount(of[1:], weights=inner & (upper[1:] != upper[:-1]), minlength=len(n)) + 1
        mean = 2 * n1 * n2 / n + 1
        var = np.maximum((mean - 1) * (mean - 2) / np.maximum(n - 1, 1), 1e-9)
        p_runs = np.clip(_normal((changes - mean) / np.sqrt(var)), 1e-30, 1)
        dev = x - (np.bincount(of, weights=x) / n)[of]
        square = np.maximum(np.bincount(of, weights=dev**2), 1e-9)
        lagged = np.bincount(of[1:], weights=np.where(inner, dev[1:] * dev[:-1], 0), minlength=len(n)) / square
        p_serial = np.clip(_normal((lagged + 1 / n) * np.sqrt(n)), 1e-30, 1)
        out[which] = -2 * (np.log(p_even) + np.log(p_runs) + np.log(p_serial))
    return out


def _scanned(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        data, at = utf8(column)
        base, runs = [], []
        for first, last in chunks(at):
            buffer, bounds = data[at[first] : at[last]], at[first : last + 1] - at[first]
            with_hex, with_run = (np.unique(np.searchsorted(bounds, _runs_of(kind[buffer], size), side="right") - 1) for kind, size in ((_HEXADECIMAL, 32), (_ANY, SHORTEST)))
            with_hex, with_run = set(with_hex.tolist()), set(with_run.tolist())
            waiting: list[tuple[int, int, int, str]] = []
            for i, text in enumerate(column.slice(first, last - first).to_pylist()):
                found = base_spans(text) if text else []
                if i in with_hex:
                    found += hex_spans(text)
                found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                base.append(found)
                runs.append([])
                if i in with_run:
                    waiting += [(len(runs) - 1, *m.span(), m[0].rstrip("=")) for m in _RUN.finditer(text)]
            if waiting:
                for (row, start, end, string), total in zip(waiting, fisher([w[3] for w in waiting]), strict=True):
                    kind = int(np.searchsorted(LENGTHS, len(string), side="right")) - 1
                    runs[row].append({"start": start, "end": end, "length_class": kind, "step": int(min(total, TOP) * STEPS), "encoding": _ENCODINGS.index(encoding(string))})
        counts = [[sum(k == kind for *_, k in found) for found in base] for kind in KINDS[:3]]
        digests = [hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in found).encode()).hexdigest() for found in base]
        spans = [[{"start": s, "end": e, "kind": KINDS.index(k)} for s, e, k in found] for found in base]
        arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, schema.field("base").type), pa.array(runs, schema.field("runs").type)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def find_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    ``spans``: kind:start:end of the fixed patterns and of random strings (kind ``random``), by start, then kind,
    comma-joined; code points, end exclusive. A random string may lie in the span of a fixed pattern: a value or key
    that the battery bears out. base_sha256 is of the fixed ones alone.

    Null or empty text: no spans, the digest of the empty string. Whole texts are read, however long. Repeated
    rows give equal rows and count each among the strings of their class; null ids stay null; an empty table gives
    an empty result; further columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    text = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "base array<struct<start: int, end: int, kind: int>>, runs array<struct<start: int, end: int, length_class: int, step: int, encoding: int>>"
    )
    schema = to_arrow_schema(_parse_datatype_string(text))
    scanned = written(small_batches(docs).select("doc_id", "text").mapInArrow(lambda x: _scanned(x, schema), text), "scanned")
    # At most len(LENGTHS) * len(_ENCODINGS) * (TOP * STEPS + 1) rows of counts, whatever the corpus.
    counts = scanned.select(F.explode("runs").alias("r")).groupBy("r.length_class", "r.encoding", "r.step").agg(F.count("*").alias("strings")).collect()
    limits = F.array(*(F.lit(limit) for kind in range(len(LENGTHS)) for limit in _limits(counts, kind, rate)))
    random = F.filter("runs", lambda x: x["step"] <= F.element_at(limits, x["length_class"] * len(_ENCODINGS) + x["encoding"] + 1))
    added = F.transform(random, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(3).alias("kind")))
    name = F.array(*(F.lit(k) for k in KINDS))
    every = F.array_sort(F.transform(F.concat("base", added), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    spans = F.array_join(F.transform(every, lambda x: F.concat_ws(":", F.element_at(name, x["kind"] + 1), x["start"], x["end"])), ",")
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(random).cast("long").alias("n_random"))


def _limits(counts: list, kind: int, rate: float) -> list[int]:
    """For each encoding the largest step that a class of lengths accepts (-1: none), by Benjamini and Hochberg's rule.

    Each level of LEVELS takes the strings that text equals with that probability at most; the largest level counts
    at which ``level`` times all strings of the class stays below ``rate`` of those taken.
    """
    at: dict[tuple[int, int], int] = defaultdict(int)
    for c in counts:
        if c["length_class"] == kind:
            at[c["encoding"], c["step"]] += c["strings"]
    steps, total = [NULL[e][kind] for e in _ENCODINGS], sum(at.values())
    best = [-1] * len(_ENCODINGS)
    for i, level in enumerate(LEVELS):
        taken = sum(n for (e, step), n in at.items() if step <= steps[e][i])
        if taken and level * total <= rate * taken:
            best = [s[i] for s in steps]
    return best
