"""Line, substring, near and vector deduplication against brute force, with nulls, ties and repeated rows."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pytest

from corvane.llm import queries
from corvane.llm.embedding_dedup import near_vectors
from corvane.llm.line_dedup import remove_boilerplate
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.substring_dedup import remove_repeats

DATA = "/root/testdata/sf0.001"


def ordered(rows):
    return sorted(map(tuple, rows), key=str)


def brute_repeats(rows, width):
    seen, split = collections.Counter(), []
    for i, t in rows:
        w = (t or "").encode().split()
        split.append((i, w))
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        out.append((i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("width", [3, 9])
def test_repeats_in_small_alphabets(spark, width):
    rng = random.Random(width)
    letters = ["a", "b", "c dd", "e"]
    rows = [(i, " ".join(rng.choice(letters[: 2 + i % 3]) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(None, None), (7, ""), (None, "a b " * 30), (1000, "x " * 300), (1001, "x\ty\x0b" * 60), (5, rows[5][1])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    assert ordered(remove_repeats(frame, width).collect()) == brute_repeats(rows, width)


def test_repeats_in_documents(spark):
    rows = duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    assert ordered(queries.op2_substring_dedup(spark, DATA).collect()) == brute_repeats(rows, 35)


def test_repeats_of_nothing(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lines_equal_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert ordered(queries.op1_line_dedup(spark, DATA).collect()) == ordered(con.sql(queries.ORACLE_SQL["op1_line_dedup"]).fetchall())


def test_lines_with_gaps_and_clashing_columns(spark):
    rows = [(i, "menu \nown %d\n\nmenu" % i, f"s{i}", 5) for i in range(12)] + [(50, None, "s1", 5), (51, "", None, 5), (None, "menu", None, 5), (3, "menu \nown 3\n\nmenu", "s3", 5)]
    got = remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int"), sites=10)
    assert got.columns == ["doc_id", "text", "source", "n_lines", "n_removed"]
    by = collections.defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.text, r.n_lines, r.n_removed))
    assert by[0] == [("menu \nown 0\n\nmenu", 3, 0)] and by[5] == [("own 5\n", 3, 2)] and by[3] == [("own 3\n", 3, 2)] * 2
    assert by[50] == [(None, 0, 0)] and by[51] == [("", 0, 0)] and by[None] == [("", 1, 1)]


def test_lines_told_by_the_sketch_alone_and_by_exact_counts(spark):
    """Lines on 100 sites are sure, on 9 to 11 counted exactly, on 2 left out; a line of one site many times never goes."""
    spread = {"wide": 100, "eleven": 11, "ten": 10, "nine": 9, "two": 2}
    rows = [(i, "\n".join([*(w for w, n in spread.items() if i < n), f"own {i}"]), f"site {i}", i) for i in range(100)]
    rows += [(1000 + i, "often", "site 0", i) for i in range(50)] + [(2000, "often\n" * 20_000 + "wide", "site 1", 0)]
    got = remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string, high int"), sites=10)
    assert got.columns == ["doc_id", "text", "source", "high", "n_lines", "n_removed"]
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len(rows) and by[0].n_removed == 0 and by[0].text.startswith("wide\neleven")
    assert by[5].text == "nine\nown 5" and by[10].text == "own 10" and by[1].text == "nine\ntwo\nown 1" and by[99].n_removed == 1
    assert by[1049].text == "often" and by[2000].n_removed == 1 and by[2000].n_lines == 20_001
    assert remove_boilerplate(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_near(rows, k, part):
    sets, parent = {}, {}
    for i, t in rows:
        w = (t or "").translate(_LOWER).encode().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= part * (len(sets[a]) + len(sets[b]) - common):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def test_near_duplicates_with_a_large_group(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(130):
        w = list(base) if i < 100 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 9) if i < 100 else 0):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t"), (203, "A b"), (204, "a  B"), (205, rows[3][1])]
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()))
    assert got == brute_near(rows, 3, 85)


def test_near_duplicates_where_buckets_mix_texts_of_all_lengths(spark):
    """One-row bands put texts of little in common into one bucket, so that the prefix filter has to find the links."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(60)]
        for i in range(25):
            w = list(base)
            for _ in range(rng.choice((0, 1, 2, 3, 8, 15))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            at = rng.randint(0, 6)
            rows.append((family * 100 + i, " ".join(w[at : len(w) - rng.randint(0, 6)] + [rng.choice(vocabulary) for _ in range(rng.randint(0, 8))])))
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80, 100, bands=60, width=1).collect()))
    assert got == brute_near(rows, 2, 80)


def brute_vectors(rows, least):
    parent, degree, by = {r[0]: r[0] for r in rows}, [0] * len(rows), collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, v, label) in enumerate(rows):
        if label is not None and a is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by[label, len(v)].append(i)
    for mine in by.values():
        x = np.array([rows[i][1] for i in mine], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        for p, q in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            i, j = mine[p], mine[q]
            degree[i] += 1
            degree[j] += 1
            a, b = find(rows[i][0]), find(rows[j][0])
            parent[max(a, b)] = min(a, b)
    return ordered((r[0], degree[i], find(r[0]), find(r[0]) == r[0]) if r[0] is not None else (None, 0, None, True) for i, r in enumerate(rows))


@pytest.mark.parametrize("size", [1, 9, 20])
def test_vectors(spark, size):
    rng = np.random.default_rng(size)
    base = rng.standard_normal((20, size))
    rows = [(i, [float(x) for x in base[rng.integers(20)] + rng.standard_normal(size) * 0.15], int(rng.integers(2)) if i % 9 else None) for i in range(150)]
    odd = [None, [], [0.0] * size, [float("nan")] * size, [None] * size, [float("inf")] * size, rows[1][1]]
    rows += [(900 + i, v, rows[1][2]) for i, v in enumerate(odd)] + [(None, rows[1][1], 1)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert ordered(got.collect()) == brute_vectors(rows, 0.98)


def test_texts_of_one_id_link_their_classes(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, a), (7, a), (7, b), (9, b), (11, c)]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3, 3, True), (7, 3, False), (9, 3, False), (11, 11, True)}


def test_near_vectors_of_one_id_link(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.01], 0), (8, [0.0, 1.0], 0), (4, [1.0, 0.02], 0), (4, [-1.0, 0.0], 0)]
    got = sorted(tuple(r) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(4, 0, 4, True), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (8, 0, 8, True)]


def test_near_duplicates_of_ids_with_several_texts(spark):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = [[word() for _ in range(60)] for _ in range(6)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    for i, t in enumerate(texts):
        rows += [(10 + i, " ".join([*t[:-1], word()])), (20 + i // 2, " ".join([word(), *t[1:]]))]
    rows += [(20, rows[0][1]), (40, "alone here")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    ids = sorted({i for i, _ in rows})
    sets = [(i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or {tuple(w)}) for i, t in rows for w in [t.split()]]
    top = {i: i for i in ids}
    for _ in ids:
        for a, x in sets:
            for b, y in sets:
                if a == b or 100 * len(x & y) >= 85 * len(x | y):
                    top[a] = top[b] = min(top[a], top[b])
    assert {(r.doc_id, r.component_id) for r in got} == set(top.items())


def test_a_text_with_very_many_partners(spark, monkeypatch):
    from corvane.llm import near_dedup

    monkeypatch.setattr(near_dedup, "PARTNERS", 7)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base[: i % 80], f"own{i}", *base[i % 80 + 1 :]])) for i in range(160)] + [(1000 + i, f"other {i} text") for i in range(30)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert sorted(tuple(r) for r in got) == brute_near(rows, 3, 85)
