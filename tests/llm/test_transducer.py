"""The transducer against the library, against whole merges, and its lookahead against all continuations."""

import hashlib
import itertools
import random
import sys

import duckdb
import pytest
from tokenizers import Tokenizer

from corvane.llm import queries, transducer
from corvane.llm.transducer import Decoder, Merges, Run, encode, sufficient_lookahead


@pytest.fixture(scope="module")
def e():
    return transducer.encoder()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(transducer.vocabulary_path(transducer.VOCABULARY))
    t.no_truncation()
    t.no_padding()
    return t


def whole(rules, text):
    """Every rule in turn on the whole text, from left to right."""
    tokens = list(text)
    for u, v in rules:
        out = []
        for t in tokens:
            if out and out[-1] == u and t == v:
                out[-1] = u + v + "."  # made just now: takes no part in this rule again
            else:
                out.append(t)
        tokens = [t.rstrip(".") for t in out]
    return tokens


def random_rules(rng, letters, n):
    made, rules = list(letters), []
    while len(rules) < n:
        u, v = rng.choice(made), rng.choice(made)
        if u + v not in made and len(u + v) < 7:
            made.append(u + v)
            rules.append((u, v))
    return rules


def test_tokens_before_the_lookahead_never_change():
    rng, most = random.Random(0), 0
    for _ in range(300):
        rules = random_rules(rng, "ab", rng.randint(1, 9))
        look = sufficient_lookahead(rules)
        for _ in range(12):
            text = "".join(rng.choice("ab") for _ in range(rng.randint(look, look + 12)))
            ends = lambda t: set(itertools.accumulate(map(len, whole(rules, t))))
            final = {x for x in ends(text) if x <= len(text) - look}
            for more in ("a", "b", "ab", "ba", "aab", "bba", "abab", "aaaaaaa", "bbbbbbb"):
                after = ends(text + more)
                assert final == {x for x in after if x <= len(text) - look}
                most = max(most, len(text) - min(ends(text) ^ after, default=len(text)))
    assert most > 3


def test_lookahead_of_chains():
    assert sufficient_lookahead([]) == 0
    assert sufficient_lookahead([("a", "b")]) == 1
    # b c takes b from a b, which frees a for x a.
    assert sufficient_lookahead([("b", "c"), ("a", "b"), ("x", "a")]) == 3
    assert sufficient_lookahead([("x", "a"), ("a", "b"), ("b", "c")]) == 1
    for rules in ([("ab", "c")], [("a", "b"), ("a", "b")]):
        with pytest.raises(ValueError):
            sufficient_lookahead(rules)


def test_merges_in_all_three_ways(e):
    rng = random.Random(1)
    for _ in range(60):
        rules = random_rules(rng, "abc", 12)
        vocabulary = {t: i for i, t in enumerate([*sorted(transducer.byte_letters()), *(u + v for u, v in rules)])}
        m = Merges(rules, vocabulary)
        m.window = m.lookahead + 8
        name = {i: t for t, i in vocabulary.items()}
        texts = ["".join(rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 60))) for _ in range(20)]
        together = m.merged_together([t.encode() for t in texts])
        for text, ids in zip(texts, together, strict=True):
            want = whole(rules, text)
            run, parts = Run(m), []
            for at in range(0, len(text), 5):
                parts += run.feed(text[at : at + 5].encode())
                assert len(run.waiting) < m.window + 5
            for found in (m.merged(text.encode()), m._merged_by_heap(text.encode()), parts + run.finish(), ids):
                assert [name[i] for i in found] == want
    assert e.merges.merged_together([]) == [] and e.merges.merged_together([b"", b"a"]) == [[], e.merges.merged(b"a")]


def test_every_character_is_of_the_library_s_class(e, library):
    for low in range(0, sys.maxunicode + 1, 4096):
        held = [chr(c) for c in range(low, min(low + 4096, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}a1{c}1!{c}! {c} " for c in held)
        assert [i for ids in e.encoded(text) for i in ids] == library.encode(text, add_special_tokens=False).ids
        for c in held[:: 1 if low == 0 else 64]:
            assert [i for ids in e.encoded(c * 3) for i in ids] == library.encode(c * 3, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [8, 13, 64, 1 << 16])
def test_windows_of_any_size(e, library, window):
    rng = random.Random(window)
    parts = ["don't", "we'll", "'s", "'", " ", "  ", "\n", "\n\n\n", "\t", " x", "é", "日本", "12", " 34", "!!", " ?'", "<|endoftext|>", "<|endof", "word", "\x1c", "　", "\xa0", "\U0001f600", "a" * 40, " " * 30, "-" * 25, "7" * 30, " " + "ab" * 20]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert [i for ids in e.encoded(text, window) for i in ids] == library.encode(text, add_special_tokens=False).ids


def test_long_runs_in_a_constant_window(e, library):
    rng = random.Random(2)
    for text in ("a" * 100_000, " " * 70_000 + "x", "\n" * 70_000, "x" + "=-" * 50_000 + "'s", " " + "".join(rng.choice("acgt") for _ in range(150_000)) + "  ", "9" * 66_000 + "th", "日" * 30_000):
        most, out = 0, []
        for ids in e.encoded(text, 4096):
            out += ids
            most = max(most, len(ids))
        assert out == library.encode(text, add_special_tokens=False).ids and most <= 2 * 4096 + e.merges.window


def test_decoding_in_parts():
    rng = random.Random(3)
    samples = ["aé日\U0001f600߿ࠀ".encode() * 3, *(bytes(rng.choice(b"a\x80\xbf\xc3\xa9\xe6\x97\xa5\xf0\x9f\x98\xff\xc0\xed\xa0") for _ in range(30)) for _ in range(400))]
    for data in samples:
        for size in (1, 2, 3, 7):
            d = Decoder()
            got = "".join(d.feed(data[i : i + size]) for i in range(0, len(data), size))
            assert len(d.waiting) <= 3 and got + d.finish() == data.decode("utf-8", "replace")


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))


def test_query_equals_the_library(spark, library):
    folder = "/root/testdata/sf0.01"
    docs = duckdb.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall()
    got = queries.op12_bpe_round_trip(spark, folder)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted((d, *digests(library, t)) for d, t in docs)


def test_odd_rows_and_whole_results(spark, library, monkeypatch):
    monkeypatch.setattr(transducer, "REMEMBERED", 50)
    rows = [(None, None), (1, ""), (1, ""), (2, "x<|endoftext|>y  "), (3, "long word " * 30_000), (None, "y" * 200_000), (5, "many " + " ".join(f"w{i}" for i in range(500)))]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    got = encode(frame, whole=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got), key=str) == sorted(((d, *digests(library, t)) for d, t in rows), key=str)
    assert sorted(r.decoded for r in got) == sorted(t or "" for _, t in rows)
    assert sorted((list(r.ids) for r in got), key=len) == sorted((library.encode(t or "", add_special_tokens=False).ids for _, t in rows), key=len)
    assert encode(frame.limit(0)).collect() == []
