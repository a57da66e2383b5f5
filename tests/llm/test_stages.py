"""Stages with clashing columns, benchmark items that are null, blank or tied, the field's decoding and training, and shared folders."""

import itertools
import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from test_brute_force import CLASH
from test_dedup import ordered

from corvane.llm import html_text, scratch

OWN = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, "\n".join(["site menu", " ".join(rng.choices(words, k=40)), f"own {i}"]), "en", f"s{i % 12}", 5) for i in range(40)]
    rows += [(100, "site menu", "en", "s1", 9), (None, None, None, None, None), (101, rows[3][1], "en", "s2", 1), (102, "only item words here now", "en", "s3", 2)]
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    items = [(1, None), (2, " \n"), (3, "only item words here now"), (3, "only item words here now"), (None, "only item words here now")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, OWN)
    clash = docs.selectExpr("*", *(f"{n} + doc_id AS {c}" for n, c in (x.split(" ") for x in CLASH.split(", "))))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, got = stage(spark, docs, str(tmp_path)), stage(spark, clash, str(tmp_path))
        assert got.columns == clash.columns
        assert ordered(got.select(docs.columns).collect()) == ordered(plain.collect())
        # The caller's own values, not the operator's.
        assert got.filter("doc_id IS NOT NULL AND (n_lines <> doc_id + 1 OR n_removed <> doc_id + 1 OR kept <> doc_id + 1)").count() == 0
        if name == "line_dedup":
            assert {r.doc_id for r in got.collect()} == {r[0] for r in rows} - {100}
            assert stage(spark, docs.drop("n_chars"), str(tmp_path)).columns == ["doc_id", "text", "lang", "source"]
        if name == "benchmark_decontamination":
            assert 102 not in {r.doc_id for r in got.collect()}


def sequences(n):
    return itertools.product((0, 1), repeat=n)


def scored(field, page, labels):
    unary = sum(field.weights.get(f, 0.0) for own, y in zip(page, labels) if y for f in own)
    return unary + sum(field.pairs[a][b] for a, b in zip(labels, labels[1:]))


def test_decoding_equals_the_best_of_all_label_sequences():
    rng = random.Random(6)
    names = [f"f{i}" for i in range(8)]
    for _ in range(150):
        field = html_text.Field({f: rng.uniform(-2, 2) for f in names}, [[rng.uniform(-2, 2) for _ in range(2)] for _ in range(2)])
        page = [rng.sample(names, rng.randint(0, 4)) for _ in range(rng.randint(1, 9))]
        best = max(scored(field, page, y) for y in sequences(len(page)))
        assert scored(field, page, field.decode(page)) == pytest.approx(best)
    assert field.decode([]) == []


def test_training_ends_where_the_likelihood_s_slope_is_nothing():
    pages = [("<nav><a>menu</a></nav><p>First words of it.</p><p>More.</p>", [0, 1, 1]), ("<p>Here it is.</p><footer>copyright</footer>", [1, 0]), ("<ul><li>one</li></ul><p>Text goes on.</p><p>short</p>", [0, 1, 0])]
    shrink = 0.3
    field = html_text.train(pages, turns=6000, shrink=shrink)
    held = [(html_text.features(html_text.blocks(p)), y) for p, y in pages]
    names = sorted(field.weights)

    def likelihood(values):
        f = html_text.Field(dict(zip(names, values[:-4])), [list(values[-4:-2]), list(values[-2:])])
        total = -shrink / 2 * sum(v * v for v in values)
        for page, y in held:
            total += scored(f, page, y) - math.log(sum(math.exp(scored(f, page, z)) for z in sequences(len(page))))
        return total

    at = np.array([*(field.weights[f] for f in names), *(v for row in field.pairs for v in row)])
    for i in range(len(at)):
        step = np.zeros(len(at))
        step[i] = 1e-5
        assert abs(likelihood(at + step) - likelihood(at - step)) / 2e-5 < 1e-3


def test_a_cluster_needs_a_shared_folder():
    def session(master, folder):
        conf = SimpleNamespace(get=lambda key, *_: folder)
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: conf), conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None))

    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            scratch.folder(session(master, None))
        assert scratch.folder(session(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch.folder(session("local[4]", None))
