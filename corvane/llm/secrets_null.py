"""How random text looks to ``secrets.fisher``: the null of the randomness battery, by encoding and class of lengths.

NULL[encoding][class] holds for each level of LEVELS the largest step (of 1 / secrets.STEPS) that at most that
share of strings made of words and numbers reaches, -1 for none. It was fitted offline by ``fit`` on ``DRAWS``
strings of each kind and each of five sources: the English of ``pydoc_data.topics`` (Python 3.13), and
the invented English, French, German and Spanish words of the documents of sf0.1. Of the five the
one that looks most random counts. ``python -m corvane.llm.secrets_null FOLDER`` prints it anew.
"""

from __future__ import annotations

import random
import re
from functools import cache

DRAWS = 40_000
#: Probabilities of text, from 3e-5 to 0.1 in quarters of a power of ten.
LEVELS = tuple(10 ** (k / 4 - 4.5) for k in range(15))


def _number(rng: random.Random) -> str:
    """A year, a date, a time of the day or a count."""
    return rng.choice((f"{rng.randint(1970, 2035)}", f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02}{rng.randint(1, 28):02}", f"{rng.randint(0, 23):02}{rng.randint(0, 59):02}{rng.randint(0, 59):02}", f"{int(10 ** rng.uniform(0, 5))}"))


def _text(encoding: str, words: list[str], size: int, rng: random.Random) -> str:
    """Words and numbers in the letters of an encoding, cut to ``size``."""
    numbers = 0.0 if encoding in ("lower26", "upper26") else 0.7 if encoding in ("hex", "HEX") else rng.choice((0.0, 0.1, 0.3)) if encoding in ("base62", "base64", "base64url") else rng.choice((0.1, 0.3))
    join = {"base64": ("/",), "base64url": ("-", "_", "-/")}.get(encoding, ("",))
    join = rng.choice(join)
    style = rng.choice((str.lower, str.title)) if encoding in ("base64", "base64url") else str.title if encoding == "base62" else str.upper if encoding in ("HEX", "upper26", "base32", "upper36") else str.lower
    parts, n = [], 0
    while n < size:
        part = _number(rng) if rng.random() < numbers else style(rng.choice(words))
        if encoding == "base32":
            part = "".join(c for c in part if c not in "0189")
        parts.append(part + (rng.choice(join) if join else ""))
        n += len(parts[-1])
    return "".join(parts)[:size]


def draws(encoding: str, kind: int, words: list[str], n: int, seed: int) -> list[str]:
    """``n`` strings of words and numbers whose smallest encoding is the given one, with lengths of one class."""
    from corvane.llm import secrets

    rng, out = random.Random(f"{encoding} {kind} {seed}"), []
    low, high = secrets.LENGTHS[kind], (*secrets.LENGTHS, 201)[kind + 1] - 1
    few = [w for w in words if set(w) <= set("abcdef")] or ["a", "be", "add"]
    while len(out) < n:
        s = _text(encoding, few if encoding in ("hex", "HEX") else words, rng.randint(low, high), rng)
        if secrets.encoding(s) == encoding:
            out.append(s)
    return out


def steps(encoding: str, kind: int, words: list[str], n: int = DRAWS, seed: int = 0) -> tuple[int, ...]:
    """For each level the largest step that at most that share of ``n`` drawn strings reaches."""
    import numpy as np

    from corvane.llm import secrets

    held = draws(encoding, kind, words, n, seed)
    sums = np.concatenate([secrets.fisher(held[i : i + 10_000]) for i in range(0, n, 10_000)])
    below = np.cumsum(np.bincount((np.minimum(sums, secrets.TOP) * secrets.STEPS).astype(int), minlength=secrets.TOP * secrets.STEPS + 1))
    return tuple(int(np.searchsorted((below + 1) / (n + 1), level, side="right")) - 1 for level in LEVELS)


@cache
def sources(folder: str) -> list[list[str]]:
    """The words, as often as they occur, of Python's topics and of each language of the documents in a folder."""
    from pydoc_data.topics import topics

    import pyarrow.parquet as pq

    texts = {"topics": list(topics.values())}
    for row in pq.read_table(f"{folder}/documents.parquet", columns=["lang", "text"]).to_pylist():
        texts.setdefault(row["lang"], []).append(row["text"] or "")
    return [re.findall(r"\b[a-z]{2,}\b", " ".join(texts[k][:3000]).lower())[:300_000] for k in sorted(texts)]


def _cell(job: tuple) -> tuple[int, ...]:
    encoding, kind, folder = job
    return tuple(min(s) for s in zip(*(steps(encoding, kind, words, seed=i) for i, words in enumerate(sources(folder))), strict=True))


def fit(folder: str) -> dict[str, list[tuple[int, ...]]]:
    from concurrent.futures import ProcessPoolExecutor

    from corvane.llm import secrets

    jobs = [(e, k, folder) for e in secrets._ENCODINGS for k in range(len(secrets.LENGTHS))]
    with ProcessPoolExecutor() as pool:
        found = list(pool.map(_cell, jobs))
    return {e: [f for f, job in zip(found, jobs, strict=True) if job[0] == e] for e in secrets._ENCODINGS}


NULL: dict[str, list[tuple[int, ...]]] = {
    "hex": [
        (0, 2, 3, 5, 5, 6, 7, 9, 10, 12, 14, 17, 21, 25, 29),
        (2, 3, 4, 5, 7, 7, 9, 11, 13, 16, 19, 22, 26, 31, 35),
        (4, 4, 5, 7, 9, 10, 12, 14, 17, 20, 23, 27, 31, 36, 42),
        (2, 7, 8, 11, 13, 15, 17, 20, 23, 26, 30, 34, 39, 45, 51),
        (11, 11, 13, 16, 19, 21, 25, 28, 32, 35, 40, 45, 50, 57, 64),
        (19, 19, 23, 26, 28, 33, 38, 42, 45, 50, 55, 61, 67, 74, 82),
        (21, 34, 35, 43, 51, 57, 61, 67, 71, 77, 84, 91, 99, 107, 117),
        (85, 94, 96, 98, 103, 110, 114, 122, 130, 140, 150, 159, 171, 185, 202),
    ],
    "HEX": [
        (0, 2, 3, 3, 4, 5, 6, 7, 9, 11, 13, 16, 19, 24, 30),
        (2, 3, 4, 4, 6, 6, 8, 10, 12, 14, 18, 21, 25, 30, 36),
        (2, 2, 4, 6, 7, 8, 10, 13, 16, 19, 23, 27, 31, 37, 43),
        (5, 7, 10, 11, 12, 14, 16, 19, 22, 26, 30, 35, 40, 46, 53),
        (5, 13, 14, 16, 17, 21, 24, 27, 31, 35, 40, 45, 52, 58, 66),
        (9, 17, 21, 23, 26, 32, 35, 40, 44, 48, 54, 60, 67, 75, 84),
        (29, 40, 43, 45, 49, 55, 60, 66, 73, 77, 84, 91, 99, 108, 118),
        (74, 79, 84, 92, 96, 104, 112, 121, 129, 138, 145, 156, 168, 182, 200),
    ],
    "lower26": [
        (2, 4, 6, 7, 8, 10, 11, 13, 15, 17, 20, 23, 26, 31, 35),
        (3, 7, 9, 9, 11, 13, 15, 18, 20, 22, 25, 28, 32, 36, 42),
        (7, 9, 11, 12, 15, 16, 18, 20, 24, 27, 30, 34, 38, 42, 48),
        (10, 14, 14, 17, 21, 23, 26, 29, 31, 34, 37, 42, 46, 51, 57),
        (18, 22, 23, 26, 27, 33, 35, 38, 42, 45, 49, 53, 58, 63, 70),
        (30, 31, 33, 37, 40, 44, 48, 51, 55, 58, 63, 69, 74, 80, 87),
        (55, 56, 57, 61, 64, 68, 72, 76, 81, 85, 91, 97, 104, 112, 120),
        (95, 98, 99, 103, 109, 116, 122, 128, 134, 141, 149, 157, 167, 178, 191),
    ],
    "upper26": [
        (0, 0, 0, 0, 1, 2, 2, 3, 4, 6, 8, 10, 12, 16, 20),
        (0, 0, 0, 1, 1, 3, 3, 4, 6, 7, 9, 12, 15, 19, 24),
        (0, 1, 1, 2, 2, 4, 5, 6, 8, 9, 11, 14, 18, 22, 27),
        (0, 0, 1, 3, 3, 4, 6, 8, 9, 12, 15, 18, 22, 26, 32),
        (0, 1, 2, 4, 6, 8, 9, 11, 14, 16, 19, 23, 27, 32, 38),
        (4, 5, 8, 8, 9, 11, 14, 16, 19, 23, 26, 30, 35, 41, 48),
        (10, 12, 14, 17, 18, 22, 25, 28, 33, 36, 41, 46, 52, 59, 66),
        (29, 33, 36, 37, 42, 46, 52, 57, 63, 68, 74, 81, 89, 97, 106),
    ],
    "base32": [
        (0, 1, 1, 1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 16, 20),
        (0, 1, 2, 3, 3, 4, 5, 6, 7, 9, 11, 13, 16, 19, 24),
        (2, 2, 2, 3, 4, 4, 6, 7, 9, 11, 13, 15, 18, 22, 27),
        (1, 3, 4, 5, 5, 7, 8, 10, 11, 13, 16, 19, 22, 27, 33),
        (2, 3, 5, 7, 8, 9, 12, 13, 16, 18, 21, 25, 29, 34, 40),
        (-1, 7, 8, 11, 13, 15, 17, 19, 22, 25, 29, 33, 38, 44, 52),
        (18, 19, 20, 21, 23, 25, 29, 32, 36, 40, 45, 50, 57, 65, 75),
        (30, 33, 41, 44, 46, 51, 56, 62, 69, 76, 84, 93, 103, 115, 129),
    ],
    "lower36": [
        (1, 5, 6, 7, 10, 11, 14, 16, 19, 21, 25, 28, 32, 37, 43),
        (10, 12, 14, 15, 15, 18, 19, 22, 25, 28, 31, 35, 40, 45, 52),
        (11, 15, 16, 18, 20, 22, 25, 28, 31, 35, 39, 43, 48, 53, 60),
        (20, 22, 23, 26, 28, 31, 34, 37, 40, 44, 48, 53, 59, 66, 74),
        (29, 31, 32, 33, 37, 43, 47, 51, 55, 59, 64, 69, 75, 83, 91),
        (40, 41, 46, 52, 55, 59, 62, 67, 73, 78, 84, 90, 97, 106, 116),
        (72, 73, 76, 77, 85, 90, 96, 102, 107, 115, 122, 131, 141, 151, 164),
        (113, 125, 139, 147, 153, 160, 167, 175, 185, 194, 206, 220, 235, 239, 239),
    ],
    "upper36": [
        (3, 3, 4, 4, 6, 7, 9, 10, 12, 13, 15, 18, 22, 26, 31),
        (3, 4, 5, 7, 8, 11, 12, 13, 15, 17, 20, 23, 26, 30, 36),
        (6, 7, 8, 10, 11, 14, 15, 16, 19, 21, 24, 27, 31, 35, 41),
        (9, 9, 11, 12, 14, 16, 19, 21, 23, 26, 29, 33, 38, 43, 49),
        (7, 14, 17, 18, 20, 23, 26, 28, 30, 34, 38, 43, 48, 53, 61),
        (18, 23, 26, 28, 30, 31, 34, 38, 41, 45, 50, 56, 62, 68, 77),
        (28, 40, 41, 43, 46, 49, 54, 59, 64, 69, 75, 81, 89, 98, 109),
        (69, 71, 72, 83, 87, 95, 100, 106, 114, 123, 131, 142, 154, 168, 186),
    ],
    "base62": [
        (5, 12, 15, 17, 19, 22, 25, 30, 34, 39, 44, 50, 56, 64, 72),
        (18, 18, 20, 25, 28, 30, 34, 38, 44, 50, 56, 63, 71, 80, 90),
        (20, 25, 30, 32, 34, 38, 42, 46, 52, 58, 66, 75, 84, 95, 106),
        (24, 36, 39, 45, 46, 50, 55, 62, 68, 75, 83, 92, 103, 115, 129),
        (55, 57, 58, 61, 70, 73, 79, 84, 90, 98, 109, 119, 131, 144, 160),
        (70, 79, 85, 87, 96, 100, 107, 114, 123, 134, 144, 155, 169, 186, 205),
        (116, 123, 134, 138, 140, 152, 168, 174, 186, 198, 212, 226, 239, 239, 239),
        (218, 229, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239),
    ],
    "base64": [
        (25, 25, 27, 32, 33, 35, 37, 40, 42, 46, 50, 55, 62, 70, 81),
        (35, 36, 37, 38, 40, 42, 45, 48, 52, 56, 60, 66, 74, 84, 96),
        (37, 39, 44, 48, 50, 54, 56, 59, 63, 68, 73, 79, 86, 98, 112),
        (49, 50, 54, 57, 61, 66, 69, 74, 79, 84, 90, 98, 106, 117, 133),
        (64, 77, 81, 85, 89, 93, 97, 101, 106, 111, 118, 126, 136, 148, 164),
        (100, 102, 108, 112, 117, 123, 126, 132, 139, 145, 153, 162, 174, 188, 208),
        (149, 155, 164, 168, 171, 177, 183, 191, 198, 207, 219, 231, 239, 239, 239),
        (239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239),
    ],
    "base64url": [
        (26, 30, 31, 31, 34, 36, 38, 40, 43, 46, 51, 57, 63, 71, 82),
        (32, 35, 36, 39, 40, 42, 46, 50, 54, 57, 62, 67, 75, 85, 98),
        (42, 43, 46, 47, 49, 53, 57, 61, 65, 69, 74, 80, 88, 99, 114),
        (48, 50, 58, 63, 64, 69, 71, 75, 80, 86, 91, 99, 108, 120, 135),
        (65, 74, 80, 84, 88, 93, 98, 102, 108, 113, 120, 128, 137, 150, 167),
        (104, 105, 112, 115, 120, 126, 130, 135, 142, 149, 157, 166, 177, 191, 211),
        (150, 158, 163, 174, 177, 182, 190, 196, 202, 210, 221, 233, 239, 239, 239),
        (239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239, 239),
    ],
}


if __name__ == "__main__":
    import sys

    for name, rows in fit(sys.argv[1]).items():
        print(f'    "{name}": [')
        for row in rows:
            print(f"        {row},")
        print("    ],")
