"""The best documents for each of a set of queries, by MaxScore in shards of postings.

One pass over the texts leaves, for each document, its length and how often it holds each term of the
queries. Sums over that table are the statistics of the whole corpus. Every task then takes the documents
of its partition in shards of ``SHARD``, turned into a list of postings for each term with the greatest
part that the term adds to a score there. For each query the lists of least bounds, which together can't reach the
score of the best ``k`` that the task has so far, are not essential: a document is a candidate only if an essential list has it, and is
looked up in the others, from the greatest bound down, only while it can still qualify. Bounds are exact,
so nothing is lost; equal scores stay candidates, as the lesser doc_id ranks first. The best ``k``
of all tasks are ranked by query.

The queries are a stated set: they are taken in blocks of bounded size, each sent to all tasks. A document's
postings stay together, so that no term, however frequent, is a key of any shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.scratch import small_batches, written
from corvane.llm.words import words

#: Documents of a shard.
SHARD = 2048
#: A block of queries holds about so many of them and bytes of text at most.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 16 << 20

_BITS = 22
_APART = np.ones(256, dtype=bool)
_APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_POSTINGS = "doc_id long, n long, terms array<int>, counts array<long>"


@dataclass
class Queries:
    """A block of queries: ids, each one's terms (places in ``terms``) with repeats counted, and the terms' hashes in order."""

    ids: list
    parts: list[tuple[np.ndarray, np.ndarray]]
    terms: np.ndarray
    filter: np.ndarray


def prepared(ids: list, texts: list[str]) -> Queries:
    found = [w.hashes(lower=True)[w.rows[i] : w.rows[i + 1]] for w in words(pa.array(texts, pa.string()), separator=_APART) for i in range(w.last - w.first)]
    terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
    parts = []
    for own in found:
        term, times = np.unique(own, return_counts=True)
        parts.append((np.searchsorted(terms, term), times))
    seen = np.zeros(1 << _BITS, dtype=bool)
    seen[terms >> np.uint64(64 - _BITS)] = True
    return Queries(ids, parts, terms, seen)


def _postings(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[pa.RecordBatch]:
    """For each document: n (its terms, with repeats), and which terms of the queries it holds how often."""
    for batch in batches:
        for w in words(batch.column("text"), separator=_APART):
            h, row, size = w.hashes(lower=True), w.row_of(), w.last - w.first
            maybe = np.flatnonzero(queries.filter[h >> np.uint64(64 - _BITS)])
            term = np.minimum(np.searchsorted(queries.terms, h[maybe]), max(0, len(queries.terms) - 1))
            hit = queries.terms[term] == h[maybe] if len(maybe) else np.zeros(0, bool)
            key, counts = np.unique(row[maybe[hit]] * len(queries.terms) + term[hit], return_counts=True)
            row, term = (key // len(queries.terms), key % len(queries.terms)) if len(key) else (key, key)
            offsets = pa.array(np.searchsorted(row, np.arange(size + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(term.astype(np.int32)), pa.array(counts.astype(np.int64)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(w.first, size), pa.array(np.diff(w.rows).astype(np.int64)), *lists], names=["doc_id", "n", "terms", "counts"])


def _holding(batches: Iterator[pa.RecordBatch], terms: int) -> Iterator[pa.RecordBatch]:
    """How many of the documents of a task hold each term."""
    held = np.zeros(terms, dtype=np.int64)
    for batch in batches:
        held += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=terms)
    term = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(term.astype(np.int32)), pa.array(held[term])], names=["term", "df"])


@dataclass
class Corpus:
    """Documents with a term, terms of all documents, and each term's weight."""

    documents: int
    length: int
    weights: np.ndarray

    def normed(self, n: np.ndarray) -> np.ndarray:
        """100 - 25 + (25 * n * documents) div length."""
        if len(n) and 25 * int(n.max()) * self.documents >= 2**63:
            return np.array([75 + 25 * int(x) * self.documents // self.length for x in n], dtype=np.int64)
        return 75 + 25 * n * self.documents // max(1, self.length)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Best:
    """The best documents for a query so far: score, whether the id is null, id; in order."""

    score: np.ndarray
    null: np.ndarray
    doc: np.ndarray

    @staticmethod
    def none() -> Best:
        return Best(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def least(self, k: int) -> int:
        """What a document must score at least to be among the best ``k``."""
        return int(self.score[k - 1]) if len(self.score) >= k else 1

    def add(self, score: np.ndarray, null: np.ndarray, doc: np.ndarray, k: int) -> None:
        score, null, doc = (np.concatenate(x) for x in ((self.score, score), (self.null, null), (self.doc, doc)))
        order = np.lexsort((doc, null, -score))[:k]
        self.score, self.null, self.doc = score[order], null[order], doc[order]


class Shard:
    """Postings of some documents by term: documents in order, what each adds to a score, and the most that one adds."""

    def __init__(self, n: np.ndarray, lengths: np.ndarray, terms: np.ndarray, counts: np.ndarray, corpus: Corpus):
        self.size = len(n)
        doc = np.repeat(np.arange(len(n)), lengths)
        order = np.argsort(terms, kind="stable")
        self.doc, term, counts = doc[order], terms[order], counts[order]
        self.adds = corpus.weights[term] * (1_000_000_000 * counts // (1000 * counts + 12 * corpus.normed(n)[self.doc]))
        held, first = np.unique(term, return_index=True)
        self.bound = np.zeros(len(corpus.weights), dtype=np.int64)
        self.low, self.high = np.zeros(len(corpus.weights), dtype=np.int64), np.zeros(len(corpus.weights), dtype=np.int64)
        if len(held):
            self.bound[held] = np.maximum.reduceat(self.adds, first)
            self.low[held], self.high[held] = first, np.append(first[1:], len(term))

    def search(self, terms: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents that score ``least`` (1 or more) at least, their scores, and how many postings were read or looked up."""
        bound = self.bound[terms] * times
        held = np.flatnonzero(bound)
        held = held[np.argsort(bound[held], kind="stable")]
        terms, times, reach = terms[held], times[held], np.cumsum(bound[held])
        # The first lists together stay below what is asked for.
        optional = int(np.searchsorted(reach, least, side="left"))
        score, touched = np.zeros(self.size, dtype=np.int64), 0
        for t, q in zip(terms[optional:].tolist(), times[optional:].tolist(), strict=True):
            part = slice(self.low[t], self.high[t])
            score[self.doc[part]] += q * self.adds[part]
            touched += part.stop - part.start
        found = np.flatnonzero(score)
        score = score[found]
        for i in range(optional - 1, -1, -1):
            stay = score + reach[i] >= least
            found, score = found[stay], score[stay]
            if not len(found):
                break
            part = slice(self.low[terms[i]], self.high[terms[i]])
            own = self.doc[part]
            at = np.minimum(np.searchsorted(own, found), len(own) - 1)
            score += np.where(own[at] == found, times[i] * self.adds[part][at], 0)
            touched += len(found)
        stay = score >= least
        return found[stay], score[stay], touched


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """null, doc_id, n, number of postings, terms and counts of ``size`` documents at a time."""
    waiting: list[tuple[np.ndarray, ...]] = []
    held = 0
    for batch in batches:
        for first in range(0, batch.num_rows, size):
            part = batch.slice(first, size)
            ids, terms = part.column("doc_id"), part.column("terms")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            lists = [x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, part.column("counts"))]
            waiting.append((null, ids.fill_null(0).to_numpy(), part.column("n").to_numpy(), np.diff(terms.offsets.to_numpy()), *lists))
            held += part.num_rows
            if held >= size:
                yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))
                waiting, held = [], 0
    if held:
        yield tuple(np.concatenate(x) for x in zip(*waiting, strict=True))


def _searched(batches: Iterator[pa.RecordBatch], queries: Queries, corpus: Corpus, k: int, size: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    best: dict[int, Best] = {}
    for null, doc, n, lengths, terms, counts in _shards(batches, size):
        shard = Shard(n, lengths, terms, counts, corpus)
        for i, (own, times) in enumerate(queries.parts):
            if len(own):
                mine = best.setdefault(i, Best.none())
                found, score, _ = shard.search(own, times, mine.least(k))
                if len(found):
                    mine.add(score, null[found], doc[found], k)
    for i, b in best.items():
        if len(b.score):
            m = len(b.score)
            yield pa.RecordBatch.from_arrays([pa.array([i] * m, pa.int32()), pa.array([queries.ids[i]] * m, schema.field("item_id").type), pa.array(b.doc, mask=b.null), pa.array(b.score)], schema=schema)


def _blocks(items: DataFrame) -> Iterator[Queries]:
    items = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    for i in range(parts):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).orderBy("item_id", "text").toArrow()
        yield prepared(block.column("item_id").to_pylist(), block.column("text").to_pylist())


def search(docs: DataFrame, items: DataFrame, k: int = 20, shard: int = SHARD) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: for each row of ``items`` (item_id, text) its ``k`` best rows of ``docs`` (doc_id, text).

    Terms are maximal runs of letters and digits of ASCII, A-Z in lower case, and of all other characters.
    N counts the documents with a term, L all terms of all documents, n those of one, df the documents that hold a term. A term weighs
    floor(1000 * ln((2 N + 2) / (2 df + 1))). A document scores for each term of the item, repeats
    included, weight * ((1000000000 tf) div (1000 tf + 12 m)) with m = 75 + (25 n N) div L. Documents that score 0 are
    left out; equal scores rank by doc_id, rows without one last.

    Null, empty and blank texts have no terms: such documents are found by nothing, such items find nothing. Rows of documents are ranked each
    on its own; equal items are one, different texts under one item_id are ranked each on their own. An empty table on
    either side gives no rows; further columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = items.schema["item_id"].dataType.simpleString()
    text = f"item int, item_id {kind}, doc_id long, score long"
    schema = to_arrow_schema(_parse_datatype_string(text))
    base, out = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for queries in _blocks(items):
        postings = written(base.mapInArrow(lambda x, q=queries: _postings(x, q), _POSTINGS), "postings")
        total = postings.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("length")).first()
        of = len(queries.terms)
        df = Counter({r["term"]: r["df"] for r in postings.select("terms").mapInArrow(lambda x, of=of: _holding(x, of), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()})
        corpus = Corpus(total["documents"], total["length"] or 0, np.array([weight(total["documents"], df[t]) for t in range(of)], dtype=np.int64))
        found = postings.mapInArrow(lambda x, q=queries, c=corpus: _searched(x, q, c, k, shard, schema), text)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out
