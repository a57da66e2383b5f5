"""Ranked search against scores of all documents, and against SQL."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest

from corvane.llm import queries
from corvane.llm.ranked_search import Best, Corpus, Shard, search, weight

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute_search(docs, items, k):
    held = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for i, text in sorted({x for x in items if x[1] is not None}, key=str):
        scored = []
        for d, c in held:
            m = 75 + (25 * sum(c.values()) * n_docs) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def got(spark, docs, items, k, **more):
    frames = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, n long, score int"), spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    return sorted(map(tuple, search(*frames, k, **more).collect()), key=str)


@pytest.mark.parametrize("shard", [1, 7, 2048])
def test_small_alphabets_with_ties_and_gaps(spark, shard):
    rng = random.Random(shard)
    text = lambda most: " ".join(rng.choice(["a", "B", "b-c", "dé", "É", "x9", "日本 a", "the", "THE"][: rng.randint(1, 9)]) for _ in range(rng.randint(0, most)))
    docs = [(i if i % 11 else None, text(40)) for i in range(150)] + [(5, None), (6, ""), (7, " .,\n"), (8, "a " * 50_000), (9, "a"), (9, "a"), (-3, "a")]
    items = [(i, text(12)) for i in range(25)] + [(30, None), (31, ""), (32, "the"), (32, "the"), (32, "x9 é"), (None, "b c"), (33, "absent words"), (34, "a a a b")]
    want = brute_search(docs, items, 5)
    assert got(spark, docs, items, 5, shard=shard) == want and len(want) > 100


def test_nothing(spark):
    assert got(spark, [], [], 20) == [] == got(spark, [(1, "a")], [], 20) == got(spark, [], [(1, "a")], 20) == got(spark, [(1, None)], [(1, "a")], 20)


def test_query_equals_sql_and_brute_force(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
        df = queries.op11_ranked_search(spark, folder)
        rel = con.sql(queries.ORACLE_SQL["op11_ranked_search"])
        rows = sorted(map(tuple, df.collect()), key=str)
        assert rel.columns == df.columns and rows == sorted(rel.fetchall(), key=str)
    docs, items = (con.sql(f"select {c}, text from {t}").fetchall() for c, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert rows == brute_search(docs, items, 20)


def test_lists_that_are_not_essential_are_only_probed():
    rng, sizes = np.random.default_rng(0), [4000, 3000, 20, 10]
    lists = [np.sort(rng.choice(5000, s, replace=False)) for s in sizes]
    pairs = sorted((d, t) for t, ds in enumerate(lists) for d in ds.tolist())
    n = np.full(5000, 100)
    corpus = Corpus(5000, 500_000, np.array([weight(5000, s) for s in sizes]))
    shard = Shard(n, np.bincount([d for d, _ in pairs], minlength=5000), np.array([t for _, t in pairs]), np.ones(len(pairs), np.int64), corpus)
    own, times = np.arange(4), np.ones(4, np.int64)
    everything = shard.search(own, times, 1)
    best = Best.none()
    best.add(everything[1], np.zeros(len(everything[0]), bool), everything[0], 20)
    again = shard.search(own, times, best.least(20))
    assert set(best.doc.tolist()) <= set(again[0].tolist()) and everything[2] == sum(sizes) and again[2] < 200


def test_lengths_beyond_64_bits():
    corpus = Corpus(10**12, 10**15, np.zeros(1, np.int64))
    assert corpus.normed(np.array([10**7, 3])).tolist() == [75 + 25 * x * 10**12 // 10**15 for x in (10**7, 3)]
