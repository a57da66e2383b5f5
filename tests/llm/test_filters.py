"""Tokens, packing, secrets, pages, toxicity, benchmark leaks and the pipeline."""

import hashlib
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np

from corvane.llm import decontaminate, html_text, packing, page_samples, queries, secrets, tokens, toxicity

DATA = "/root/testdata/sf0.001"


def documents():
    return duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id").fetchall()


def test_tokens_equal_the_library():
    e = tokens.encoder()
    odd = ["", " ", "it's I'M 123", "x<|endoftext|>y", "ΣΑΣ σας", "é É", "a b\x1cc", "日本語 text", "AB\x00\x01"] + [f"a{chr(c)}b {chr(c) * 3}" for c in range(0x180)]
    texts = odd + [t for _, t in documents()[:60]]
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.count(texts) == [len(w) for w in want]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == want
    assert e.count([None, ""]) == [0, 0]


def test_packing_round_trip(spark):
    rows = queries.op3_packing(spark, DATA).collect()
    e = tokens.encoder()
    ids = {d: e.encode([t])[0] + b"\1\0\0\0" for d, t in documents()}
    pieces, places = {}, {}
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 and r.doc_tokens * 4 == len(ids[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans, whole in [(p, len(ids[d]) // 4) for d, p in pieces.items()] + [(p, None) for p in places.values()]:
        end = 0
        for start, n in sorted(spans):
            assert start == end
            end += n
        assert whole in (None, end) and (whole or end <= 2048)
    assert set(pieces) == set(ids)
    padded = sum(sum(n for _, n in p) not in (256, 512, 1024, 2048) for p in places.values())
    assert padded <= 1


def test_packer_keeps_every_token_in_any_order():
    rng = random.Random(2)
    p = packing.Packer(held=5000)
    sizes = [rng.choice((0, 1, 5, 255, 256, 700, 1025, 2048, 5000)) for _ in range(200)]
    out = [s for i, n in enumerate(sizes) for s in p.add(i, b"\0\0\0\0" * n)] + list(p.finish())
    assert sum(x.length for _, s in out for x in s) == sum(sizes)
    assert all(sum(x.length for x in s) == tier for tier, s in out[:-1])


def test_secrets_of_the_contract(spark):
    text = 'password = "hunter22x", AKIA' + "A1" * 8 + " x " + "0f" * 16 + " token: abc KEY"
    rows = [(1, text), (2, None), (3, ""), (1, text)]
    got = secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    one = next(r for r in got if r.doc_id == 1)
    assert (one.n_assign, one.n_access, one.n_hex) == (1, 1, 1)
    assert hashlib.sha256(one.spans.encode()).hexdigest() == one.base_sha256
    assert {r.base_sha256 for r in got if r.doc_id != 1} == {hashlib.sha256(b"").hexdigest()} and len(got) == 4


def test_random_strings_are_found_and_words_are_not(spark):
    rng = random.Random(9)
    letters = secrets._LETTERS["base62"]
    words = ["".join(rng.choice(("th", "er", "on", "an", "re", "ing")) for _ in range(rng.randint(10, 14))) for _ in range(3000)]
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    rows = [(i, " ".join(words[i * 10 : i * 10 + 10]) + (f" {keys[i]} end" if i < 60 else "")) for i in range(300)]
    got = {r.doc_id: r.n_random for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[i] for i in range(60)) >= 50 and sum(got[i] for i in range(60, 300)) == 0


def test_pages(spark):
    field = html_text.train(page_samples.sample_pages(300))
    held = page_samples.sample_pages(150, seed=11)
    right = sum(a == b for p, labels in held for a, b in zip(field.decode(html_text.features(html_text.blocks(p))), labels, strict=True))
    assert right / sum(len(labels) for _, labels in held) > 0.97
    rows = [(1, "u", None), (2, "u", ""), (3, None, "plain  text here."), (None, "u", "<article><p>A &amp; b.</p>\n<p>C  d.<script>x('</p>')</script></article><footer>no</footer>")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_main_text(frame).collect()}
    assert got[1] == got[2] == "" and got[None] == "A & b.\nC d."


def test_article_of_given_pages(spark):
    import html

    pages = dict(duckdb.sql(f"select page_id, html from '{DATA}/pages.parquet'").fetchall())
    for r in queries.op7_html_extraction(spark, DATA).collect():
        article = pages[r.page_id].split("<article>", 1)[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op8_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("doc_id", "held_out", "predicted", "toxic").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.97


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b."), (None, None)], "doc_id long, text string")
    got = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert [(r.score, r.predicted) for r in got] == [(0, 0)] * 2


def test_leaks_also_out_of_order(spark):
    rng = random.Random(4)
    passage = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)]
    swapped = passage[20:] + ["zzz"] + passage[:20]
    rows = [(1, "x " + " ".join(passage).upper() + " y"), (2, " ".join(swapped)), (3, " ".join(passage[:25])), (4, None), (5, ""), (1, " ".join(passage))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(passage)), (8, "too short"), (7, None)], "item_id long, text string")
    got = decontaminate.contaminated(docs, items).collect()
    assert sorted((r.doc_id, r.n_tiles) for r in got if r.item_id == 9) == [(1, 1), (1, 1), (2, 2)]
    assert sorted(r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()) == [3, 4, 5]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_tiles_do_not_overlap():
    text, item = np.array([1, 2, 3, 4, 5, 6, 7, 8, 9, 1, 2, 3, 4, 5], np.uint64), np.array([1, 2, 3, 4, 5, 6, 7, 8, 9], np.uint64)
    assert decontaminate.tiles(text, item) == [(0, 0, 9)]


def test_pipeline(spark):
    import corpus_pipeline

    docs = before = spark.read.parquet(f"{DATA}/documents.parquet")
    from corvane.llm.scratch import written

    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
    assert docs.count() > 0
    assert not Path("/root/testdata/sf0.001/spark").exists()


def test_random_strings_are_found_without_long_words(spark):
    rng = random.Random(12)
    prose = "the quick brown fox jumps over the lazy dog while nobody looks".split()
    keys = ["".join(rng.choice(secrets._LETTERS[kind]) for _ in range(size)) for kind, size in (("base62", 40), ("lower26", 96), ("base64url", 64)) for _ in range(20)]
    rows = [(i, " ".join(rng.choices(prose, k=30)) + (f" {keys[i]} end" if i < 60 else "")) for i in range(300)]
    names = ["getUserNameFromTheDatabase", "internationalizationandlocalization", "usr/share/doc/python/library/html", "a_rather_long_name_of_a_function"]
    rows += [(300 + i, f"see {name} for more") for i, name in enumerate(names)]
    got = {r.doc_id: r.n_random for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(sum(got[i] for i in range(low, low + 20)) >= 17 for low in (0, 20, 40)) and sum(got[i] for i in range(60, 304)) == 0
    few = spark.createDataFrame(rows[:1] + rows[60:90], "doc_id long, text string")
    assert secrets.find_secrets(few).agg({"n_random": "sum"}).first()[0] == 1


def test_closed_svg_and_math_keep_the_text_beside_and_in_them():
    page = '<p>One <svg viewBox="0 0 1 1"/> two.</p><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then <math/> so.</p><p>Three <svg><title>no</title><path/></svg> four.</p><svg/>'
    assert [b.text for b in html_text.blocks(page)] == ["One two.", "If x=2 then so.", "Three four."]
