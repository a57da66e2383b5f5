"""Operators and pipeline stages against plain Python, and rows that are null, empty, repeated, long or clash."""

import collections
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_dedup import _LOWER, brute_near, brute_repeats, brute_vectors, ordered

from corvane.llm import decontaminate, embedding_dedup, packing, queries, secrets, tokens, toxicity
from corvane.llm.html_text import extract_main_text
from corvane.llm.line_dedup import remove_boilerplate
from corvane.llm.near_dedup import near_duplicates
from corvane.llm.substring_dedup import remove_repeats

DATA = "/root/testdata/sf0.001"


def table(name, columns, folder=DATA):
    return duckdb.sql(f"select {columns} from '{folder}/{name}.parquet'").fetchall()


def split(text):
    return (text or "").translate(_LOWER).encode().split()


def brute_tiles(text, item, shortest=5):
    """Longest common run first, earliest in the text, then in the item."""
    free_t, free_p, out = [True] * len(text), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for t in range(len(text)):
            for p in range(len(item)):
                n = 0
                while t + n < len(text) and p + n < len(item) and free_t[t + n] and free_p[p + n] and text[t + n] == item[p + n]:
                    n += 1
                best = max(best, (t, p, n), key=lambda m: m[2])
        if best[2] < shortest:
            return out
        out.append(best)
        for k in range(best[2]):
            free_t[best[0] + k] = free_p[best[1] + k] = False


def brute_leaks(docs, items, covered=0.8):
    """(doc_id, item_id, tiles) of covered items."""
    out, held = [], {(i, t) for i, t in items if t is not None}
    for d, text in docs:
        w = split(text)
        runs = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        for i, t in held:
            m = split(t)
            if 0 < len(m) < 5:
                out += [(d, i, 1)] * (tuple(m) in runs[len(m)])
            elif any(tuple(m[k : k + 5]) in runs[5] for k in range(len(m) - 4)):
                found = brute_tiles(w, m)
                out += [(d, i, len(found))] * (sum(f[2] for f in found) >= covered * len(m))
    return ordered(out)


def test_leaks_of_repetitive_and_short_texts(spark):
    rng = random.Random(3)
    text = lambda most: " ".join(rng.choice(("a", "b", "C", "dd")[: rng.randint(1, 4)]) for _ in range(rng.randint(0, most)))
    docs = [(i if i % 7 else None, text(60)) for i in range(60)] + [(1, None), (2, ""), (3, "x " * 3000)]
    items = [(i, text(25)) for i in range(40)] + [(50, None), (51, ""), (52, "x"), (53, "X x x x x x"), (54, "B c dd"), (54, "B c dd"), (None, "a b a b a b")]
    got = decontaminate.contaminated(spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, n_tiles int"), spark.createDataFrame([(*i, 1.0) for i in items], "item_id long, text string, coverage double"))
    want = brute_leaks(docs, items)
    assert ordered((r.doc_id, r.item_id, r.n_tiles) for r in got.collect()) == want and len(want) > 20


def test_leaks_of_a_repeated_word_take_little():
    found = list(decontaminate._matches(pa.array(["a " * 20_000]), decontaminate.index([1], ["a " * 200]), 0.8))
    assert found == [(0, 0, 1.0, 1, 200)]


def test_repeats_among_many_null_ids(spark):
    n = 100_000
    docs = spark.range(n).selectExpr("cast(null as long) doc_id", "concat_ws(' ', transform(sequence(0, 11), x -> concat('w', id, '_', x))) text")
    docs = docs.unionByName(docs.filter("startswith(text, 'w77_')").select("doc_id", "text")).unionByName(spark.createDataFrame([(None, "z " * 50)], "doc_id long, text string"))
    got = remove_repeats(docs, 10).groupBy("n_removed").count().collect()
    assert {r.n_removed: r["count"] for r in got} == {0: n - 1, 12: 2, 50: 1}


def test_vectors_with_a_large_near_group_in_small_cells(spark):
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in (centre * 3 + rng.standard_normal(16) * 0.25 if i % 3 == 0 else rng.standard_normal(16))], i % 2) for i in range(2000)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    want = brute_vectors(rows, 0.98)
    assert max(r[1] for r in want) > 300
    for tile in (100_000, 150):
        assert ordered(embedding_dedup.near_vectors(frame, tile=tile, sample=600).collect()) == want


def test_token_counts_of_the_query_equal_the_library(spark):
    e = tokens.encoder()
    docs = table("documents", "doc_id, text", "/root/testdata/sf0.01")
    want = {d: (len((t or "").encode()), len(e.tokenizer.encode(t or "", add_special_tokens=False))) for d, t in docs}
    got = queries.op9_token_counts(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want and all(r.over_limit == (r.n_tokens > 2048) for r in got)


def test_tokens_of_unusual_characters_equal_the_library():
    e, rng = tokens.encoder(), random.Random(1)
    texts = ["“quoted” — don’t €5 x̂ é́", "ΣΑΣ σας ΑΣ. Σ", "a b　c d", "x<|endoftext|>y", "\x1c a \x1f", "a\x85b", " ́", "ﬁ İstanbul ǅ"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(1, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x2000, 0x2100)])) for _ in range(60)) for _ in range(400)]
    assert [np.frombuffer(b, "<u4").tolist() for b in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def check_packed(rows, docs):
    """Every id of every document once, sequences gapless and full but for the last of a partition."""
    e = tokens.encoder()
    ids = collections.Counter(np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, t in docs)
    pieces, places = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append(r)
    for d, text in docs:
        own = np.array(e.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        mine = [r for r in pieces[d] if r.doc_tokens * 4 == len(own) and zlib.crc32(own[4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32]
        assert {x for r in mine for x in range(r.start, r.start + r.length)} == set(range(len(own) // 4))
    assert sum(r.length for r in rows) == sum(len(i) // 4 * n for i, n in ids.items())
    short = 0
    for held in places.values():
        held.sort(key=lambda r: r.offset)
        assert all(a.offset + a.length == b.offset for a, b in zip(held, held[1:], strict=False)) and held[0].offset == 0
        assert len({(r.tier, r.step_group) for r in held}) == 1
        total = sum(r.length for r in held)
        assert total <= held[0].tier
        short += total < held[0].tier
    return places, short


def test_packing_fills_tiers_and_balances_groups(spark):
    docs = table("documents", "doc_id, text", "/root/testdata/sf0.01")
    rows = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    places, short = check_packed(rows, docs)
    assert short <= 1 and len({held[0].tier for held in places.values()}) > 1
    loads = collections.defaultdict(lambda: collections.Counter())
    for held in places.values():
        loads[held[0].step_group >> 3][held[0].step_group] += held[0].tier
    # Groups that are open together differ by one sequence of each tier at most.
    assert all(max(c.values()) - min(c.values()) <= sum(packing.TIERS) for c in list(loads.values()) if len(c) == 8)


def test_base_spans_equal_plain_patterns(spark):
    docs = table("documents", "doc_id, text", "/root/testdata/sf0.01") + [(None, None), (5, "passwd:'" + "x" * 9 + " AKIA" + "Z" * 12 + " " + "ab" * 20000)]
    plain = [
        (0, re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
        (1, re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
        (2, re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
    ]
    want = []
    for d, t in docs:
        found = sorted((m.start(), k, m.end()) for k, pattern, fits in plain for m in pattern.finditer(t or "") if fits(m))
        want.append((d, *(sum(f[1] == k for f in found) for k in range(3)), ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in found)))
    got = secrets.find_secrets(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_hex int")).collect()
    assert ordered((r.doc_id, r.n_assign, r.n_access, r.n_hex, ",".join(s for s in r.spans.split(",") if not s.startswith("random"))) for r in got) == ordered(want)


def test_planted_keys_of_every_encoding(spark):
    rng, rows = random.Random(5), []
    for i, (text,) in enumerate(table("documents", "text")):
        kind, size = list(secrets._LETTERS)[i % 10], (40, 48, 64)[i // 10 % 3]
        rows.append((i, f"{(text or '')[:500]} {''.join(rng.choice(secrets._LETTERS[kind]) for _ in range(size))} end", kind, size))
    found, spans = collections.Counter(), 0
    for r in secrets.find_secrets(spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")).collect():
        _, text, kind, size = rows[r.doc_id]
        at = len(text) - 4 - size
        found[kind] += f"random:{at}:{at + size}" in r.spans.split(",")
        spans += r.n_random
    # The keys alone, and at least half of every encoding's.
    assert spans == sum(found.values()) and all(found[k] >= 10 for k in secrets._LETTERS)


def naive_score(text, model):
    """The noisy-or of the sentences of a text, word by word."""
    clear = 1.0
    for w in toxicity.words(pa.array([text], pa.string())):
        kinds, number = toxicity.features(w), toxicity.sentences(w)
        held = collections.defaultdict(set)
        for i, s in enumerate(number.tolist()):
            held[s] |= {int(k[i]) for k in kinds if k[i] >= 0 and model.weights[k[i]]}
        for s in held.values():
            if s:
                clear *= 1 - 1 / (1 + math.exp(-(model.bias + sum(float(model.weights[f]) for f in s))))
    return 1 - clear


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.01"
    return toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def test_scores_are_the_noisy_or_of_sentences(spark, model):
    docs = table("documents", "doc_id, text") + [(-1, None), (-2, ""), (-3, " \n")]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs]), pa.array([False] * len(docs)), pa.array([t for _, t in docs])], names=["doc_id", "held_out", "text"])
    got = [s for b in toxicity._scored(iter([batch]), model) for s in b.column("score").to_pylist()]
    assert np.allclose(got, [naive_score(t, model) for _, t in docs], atol=1e-6) and max(got) > 0.5


ODD = [(1, "A line.\nshared words here", "s"), (1, "A line.\nshared words here", "s"), (None, None, None), (None, "", "s"), (2, None, "s"), (3, " \n\t ", "t"), (4, "long word " * 150_000, "t"), (5, "x" * 200_000, "t"), (None, "null id text", None)]
CALLS = {
    "lines": lambda d, o: remove_boilerplate(d),
    "repeats": lambda d, o: remove_repeats(d),
    "pack": lambda d, o: packing.pack(d),
    "secrets": lambda d, o: secrets.find_secrets(d),
    "near": lambda d, o: near_duplicates(d),
    "vectors": lambda d, o: embedding_dedup.near_vectors(d.selectExpr("doc_id vec_id", "CASE WHEN length(text) < 100 THEN array(cast(length(text) as double), 1.0D) END embedding", "source label", "1 n_links", "1 kept")),
    "pages": lambda d, o: extract_main_text(d.selectExpr("doc_id page_id", "source url", "text html", "1 text", "2 n_chars")),
    "toxic": lambda d, o: toxicity.score_toxicity(d, o.selectExpr("doc_id", "cast(doc_id % 2 as int) toxic", "1 score")),
    "tokens": lambda d, o: tokens.count_tokens(d),
    "leaks": lambda d, o: decontaminate.contaminated(d, o.selectExpr("doc_id item_id", "substring(text, 1, 40) text", "1 coverage")),
}
CLASH = "1 n_words, 1 n_removed, 1 n_lines, 1 key, 1 h1, 1 place, 1 name, 1 start, 1 length, 1 tier, 1 spans, 1 base, 1 runs, 1 id, 1 n, 1 low, 1 high, 1 bands, 1 component_id, 1 kept, 1 score, 1 held_out, 1 predicted, 1 n_bytes, 1 n_tokens, 1 coverage, 1 n_tiles"


@pytest.mark.parametrize("name", sorted(CALLS))
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, source string").selectExpr("*", *CLASH.split(", "))
    rows = CALLS[name](docs, docs).collect()
    by = "vec_id" if name == "vectors" else "page_id" if name == "pages" else "doc_id"
    if name not in ("pack", "leaks"):
        assert collections.Counter(r[by] for r in rows) == collections.Counter(d for d, *_ in ODD)
        one = [r for r in rows if r[by] == 1]
        assert one[0] == one[1]
    elif name == "pack":
        check_packed(rows, [(d, t) for d, t, _ in ODD])
    else:
        assert {(r.doc_id, r.item_id) for r in rows} >= {(1, 1), (4, 4)}
    empty = docs.limit(0)
    assert CALLS[name](empty, empty).collect() == [] and CALLS[name](empty, docs).collect() == []
    if name in ("toxic", "leaks"):
        assert len(CALLS[name](docs, empty).collect()) == (len(ODD) if name == "toxic" else 0)


def test_deep_and_long_pages(spark):
    page = "<div>" * 3000 + "<article>" + "<p>word</p>" * 20_000 + "</article>"
    got = extract_main_text(spark.createDataFrame([(1, "u", page), (1, "u", page)], "page_id long, url string, html string")).collect()
    assert got[0] == got[1] and got[0].text == "\n".join(["word"] * 20_000)


def test_pipeline_stages_keep_what_brute_force_keeps(spark):
    import corpus_pipeline

    from corvane.llm.scratch import written

    stages = dict(corpus_pipeline.STAGES)
    folder = "/root/testdata/sf0.01"
    small = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 4 = 0")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "no id here"), (-3, "twice"), (-3, "twice")], "doc_id long, text string")
    docs = small.unionByName(extra.selectExpr("doc_id", "text", "'en' lang", "'odd' source", "length(text) n_chars"), allowMissingColumns=True)
    rows = lambda d: [(r.doc_id, r.text, r.source) for r in d.collect()]
    before, kept = rows(docs), {}
    step = docs
    for name in ("toxicity", "line_dedup", "minhash_near_dedup", "benchmark_decontamination"):
        step = written(stages[name](spark, step, folder), name)
        assert step.columns == docs.columns
        kept[name] = rows(step)

    trained = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert ordered(kept["toxicity"]) == ordered(r for r in before if naive_score(r[1], trained) < 0.5)

    where, first = collections.defaultdict(set), {}
    for d, text, site in kept["toxicity"]:
        for line in (text or "").split("\n"):
            line = line.strip(" \t\r")
            where[line].add(site)
            if d is not None:
                first[line] = min(d, first.get(line, d))
    lines = []
    for d, text, site in kept["toxicity"]:
        held = (text or "").split("\n")
        gone = [bool(x.strip(" \t\r")) and len(where[x.strip(" \t\r")]) >= 10 and d != first.get(x.strip(" \t\r")) for x in held]
        if not (any(gone) and sum(gone) == sum(bool(x.strip(" \t\r")) for x in held)):
            lines.append((d, text if text is None else "\n".join(x for x, g in zip(held, gone, strict=True) if not g), site))
    assert ordered(kept["line_dedup"]) == ordered(lines)

    stays = {r[0] for r in brute_near([(d, t) for d, t, _ in lines if d is not None], 5, 80) if r[3]}
    assert ordered(kept["minhash_near_dedup"]) == ordered(r for r in lines if r[0] is None or r[0] in stays)

    leaks = {d for d, _, _ in brute_leaks([r[:2] for r in kept["minhash_near_dedup"]], table("benchmark", "item_id, text", folder))}
    assert ordered(kept["benchmark_decontamination"]) == ordered(r for r in kept["minhash_near_dedup"] if r[0] not in leaks)

    check_packed(stages["packing"](spark, step, folder).collect(), [r[:2] for r in kept["benchmark_decontamination"]])
    nothing = docs.limit(0)
    assert all(stage(spark, nothing, folder).count() == 0 for stage in stages.values())
