"""Words and runs whose letters follow the Thue-Morse sequence, on which sums of powers cancel."""

import numpy as np
import pyarrow as pa
import pytest
from test_brute_force import brute_leaks
from test_dedup import brute_near, brute_repeats, ordered

from corvane.llm import decontaminate, tokens
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.substring_dedup import remove_repeats
from corvane.llm.words import bytes_hash, spans_hash, words

SIZES = [1024, 2048]


def swapped(n, a="x", b="e"):
    """Both sequences of ``n`` (a power of two) elements."""
    one, other = [a], [b]
    while len(one) < n:
        one, other = one + other, other + one
    return one, other


def texts(n):
    one, other = ("".join(s) for s in swapped(n))
    tail = [f"w{i}" for i in range(34)]
    return [" ".join([one, *tail]), " ".join([other, *tail]), " ".join(tail), *(" ".join(s) for s in swapped(n, "ab", "c"))]


@pytest.mark.parametrize("n", SIZES)
def test_hashes_differ(n):
    for a, b in (swapped(n), swapped(n, "ab", "c")):
        held = [w.hashes() for w in words(pa.array(["".join(a) + " " + "".join(b)]))][0]
        assert held[0] != held[1]
        rows = [w.hashes() for w in words(pa.array([" ".join(a)]))][0], [w.hashes() for w in words(pa.array([" ".join(b)]))][0]
        at = np.zeros(1, np.int64)
        assert spans_hash(rows[0], at, at + n) != spans_hash(rows[1], at, at + n)
        power = decontaminate._powers(n + 1)
        assert decontaminate.Rolled(rows[0], power).runs(at, n) != decontaminate.Rolled(rows[1], power).runs(at, n)


def test_hashes_of_spans_depend_on_the_span_alone():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    starts = rng.integers(0, 300, 4000)
    ends = starts + rng.integers(1, 100, 4000)
    buffer = np.concatenate([values.astype(np.uint8), np.zeros(8, np.uint8)])
    for found in (spans_hash(values, starts, ends), bytes_hash(buffer, starts, ends)):
        by = {}
        for s, e, h in zip(starts.tolist(), ends.tolist(), found.tolist(), strict=True):
            assert by.setdefault(tuple(values[s:e].tolist()), h) == h
        assert len(set(by.values())) == len(by)


def test_running_hashes_are_polynomials_over_the_field():
    rng, prime = np.random.default_rng(5), 2**61 - 1
    values = rng.integers(0, 2**64 - 1, 70, dtype=np.uint64, endpoint=True)
    power = decontaminate._powers(100)
    assert power.tolist() == [pow(decontaminate._BASE, i, prime) for i in range(100)]
    got = decontaminate.Rolled(values, power).runs(np.arange(60), 11).tolist()
    assert got == [sum(int(v) * pow(decontaminate._BASE, i + 99 - at + at, prime) for i, v in enumerate(values[at : at + 11])) % prime for at in range(60)]


@pytest.mark.parametrize("n", SIZES)
def test_tokens(n):
    e = tokens.encoder()
    one, other = ("".join(s) for s in swapped(n))
    held = [one, other, f"{other} {one}", *texts(n)]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in held]
    assert e.count(held) == [len(w) for w in want]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(held)] == want


@pytest.mark.parametrize("n", SIZES)
def test_repeats(spark, n):
    rows = list(enumerate(texts(n)))
    for width in (35, 64):
        assert ordered(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), width).collect()) == brute_repeats(rows, width)


@pytest.mark.parametrize("n", SIZES)
def test_near_duplicates(spark, n):
    rows = list(enumerate(texts(n)))
    for k in (3, 35, n):
        assert ordered(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, 85).collect()) == brute_near(rows, k, 85)


@pytest.mark.parametrize("n", SIZES)
def test_leaks(spark, n):
    one, other = ("".join(s) for s in swapped(n))
    items = [(0, f"{one} one two three four five"), (1, f"{other} one two three four five"), (2, one), (3, " ".join(swapped(64, "ab", "c")[0]))]
    docs = [(0, f"{other} one two three four five"), (1, " ".join(swapped(64, "ab", "c")[1])), (2, f"so {one} it is")]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), covered=0.9)
    assert ordered((r.doc_id, r.item_id, r.n_tiles) for r in got.collect()) == brute_leaks(docs, items, 0.9)
