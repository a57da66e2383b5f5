"""The manifest against a tree built node by node, and against SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from test_dedup import ordered

from corvane.llm import manifest, queries

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def grown(nodes):
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, p in enumerate(at):
            run = p // 3 * 3
            proofs[k].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
            at[k] = p // 3
        nodes = [h("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        bare = zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[0] is not None and r[4] is not None
        by.setdefault(r[1], []).append((r[0], leaf(*r), leaf(*r[:4], r[4].replace("\n", "")) if bare else leaf(*r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = grown([x[1] for x in by[s]])
    root, over = grown([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, over, strict=True):
        for (i, own, offered), proof in zip(by[s], trees[s][1], strict=True):
            node = offered
            for a, b in proof + above:
                node = h(a + node + b)
            out.append((i, own, trees[s][0], root, h("".join(a + b for a, b in proof + above)), node, node == root))
    return ordered(out)


def given(rows, spark, monkeypatch):
    frame = spark.createDataFrame([(*r, "x", 1, True) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, hash string, place int, verified boolean")
    monkeypatch.setattr(queries, "table", lambda *_: frame)
    return ordered(queries.op13_merkle_manifest(spark, "").collect())


def row(rng, i, source):
    return (i, source, rng.choice(["en", None]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "é\n\nü", "plain", "10:"]))


@pytest.mark.parametrize("sizes", [[1], [2], [3], [4], [1, 1, 1, 1], [1, 3, 9, 10, 27, 28], [81, 82, 243, 244, 5], [730, 2, 1]])
def test_trees_of_all_shapes(spark, monkeypatch, sizes):
    rng = random.Random(sum(sizes))
    rows = [row(rng, k * 1000 + i, f"s{k}" if k else None) for k, n in enumerate(sizes) for i in range(n)]
    rng.shuffle(rows)
    assert given(rows, spark, monkeypatch) == brute_manifest(rows)


def test_blocks_of_blocks(spark, monkeypatch):
    rng = random.Random(1)
    rows = [row(rng, i, "hot") for i in range(243 * 243 + 2)] + [row(rng, i, s) for i, s in enumerate(["Z", "a", "é", "", "\U0001f600", "￿"])]
    assert given(rows, spark, monkeypatch) == brute_manifest(rows)


def test_more_groups_than_a_block_holds(spark, monkeypatch):
    rng = random.Random(2)
    rows = [row(rng, i, f"site {i % 700}") for i in range(1500)]
    assert given(rows, spark, monkeypatch) == brute_manifest(rows)


def test_odd_leaves(spark, monkeypatch):
    rows = [(None, None, None, None, None), (None, "s", None, None, "x\ny"), (1, "s", "en", 3, "a\nb"), (1, "s", "en", 3, "a\nb"), (1, "s", "en", 3, "other"), (2, "s", None, None, "long\n" * 300_000), (-5, "s", None, 1, "")]
    assert given(rows, spark, monkeypatch) == brute_manifest(rows)
    assert given([], spark, monkeypatch) == []


def test_proofs_lead_to_the_root_and_no_other_leaf_does(spark):
    rng = random.Random(3)
    frame = spark.createDataFrame([row(rng, i, f"s{i % 3}") for i in range(60)], "doc_id long, source string, lang string, n_chars long, text string")
    rows = manifest.manifest(frame).collect()
    for r in rows:
        node, other = r.leaf, h("other")
        for left, right in r.proof:
            node, other = h(left + node + right), h(left + other + right)
        assert node == r.root == r.folded_root and r.verified and other != r.root
    assert manifest.manifest(frame, offered=F.lit(h("other"))).filter("verified").count() == 0


def test_query_equals_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet'")
    rows = con.sql(f"select {', '.join(FIELDS)} from documents").fetchall()
    df = queries.op13_merkle_manifest(spark, folder)
    got = ordered(df.collect())
    rel = con.sql(queries.ORACLE_SQL["op13_merkle_manifest"])
    assert rel.columns == df.columns
    assert got == ordered(rel.fetchall()) == brute_manifest(rows)
    assert 0 < sum(r[-1] for r in got) < len(got)
