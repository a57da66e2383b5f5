"""Toxicity by multiple-instance learning: a text is a bag of sentences of which only the bag has a label.

A sentence has the probability sigma(bias + weights of its features); the text's is their
noisy-or, 1 - prod(1 - p). Only texts are labelled, so the gradient of the noisy-or shares a
text's label among its sentences by their own probabilities. Features are hashed words and
word beginnings that come with toxic texts more often than chance allows; sentences with none
of them take no part, so length alone makes no text toxic. The worst sentence is returned too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.scratch import mapped, small_batches, written
from corvane.llm.words import Words, bytes_hash, words

#: Features are numbered by this many bits of their hash.
BITS = 20
#: Labelled rows that training reads at most, of either label; the first by a hash of the id.
SAMPLE = 4000
#: Letters (bytes) of the word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 7)
#: A feature is kept if its G statistic against the label exceeds this and it occurs in so many texts.
LEAST_G, LEAST_TEXTS = 12.0, 4
#: Bytes of text that training works on at once.
PART = 1 << 18

_ENDS_SENTENCE = np.zeros(256, dtype=bool)
_ENDS_SENTENCE[list(b".!?")] = True
_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True


@dataclass
class Model:
    weights: np.ndarray  #: float32 of 2**BITS, 0 for features that are not kept
    bias: float


def sentences(w: Words) -> np.ndarray:
    """The number of the sentence of each word: one ends at . ! ? after a word, at a line break and at the text's end."""
    n = len(w.starts)
    fresh = np.zeros(n, dtype=bool)
    if n:
        lines = np.concatenate([[0], np.cumsum(w.buffer == 0x0A)])
        fresh[1:] = _ENDS_SENTENCE[w.buffer[w.ends[:-1] - 1]] | (lines[w.starts[1:]] > lines[w.ends[:-1]])
        firsts = w.rows[:-1]
        fresh[firsts[firsts < n]] = True
    return np.cumsum(fresh) - 1 if n else np.zeros(0, np.int64)


def features(w: Words) -> list[np.ndarray]:
    """For each kind of feature its number for each word, -1 where a word has none."""
    starts, ends = w.starts.copy(), w.ends.copy()
    for _ in range(3):
        starts += (ends - starts > 1) & _PUNCTUATION[w.buffer[starts]]
        ends -= (ends - starts > 1) & _PUNCTUATION[w.buffer[ends - 1]]
    lowered = w.padded(lower=True)
    out = [(bytes_hash(lowered, starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)]
    for size in BEGINNINGS:
        long = np.flatnonzero(ends - starts > size)
        numbers = np.full(len(starts), -1, dtype=np.int64)
        numbers[long] = (bytes_hash(lowered, starts[long], starts[long] + size) ^ np.uint64(size << (64 - BITS))) >> np.uint64(64 - BITS)
        out.append(numbers)
    return out


def features_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, sentence (in its row) and number of each feature of the texts, in parts of ``PART`` bytes."""
    for w in words(column, PART):
        row, sentence = w.row_of() + w.first, sentences(w)
        for numbers in features(w):
            use = np.flatnonzero(numbers >= 0)
            yield row[use], sentence[use] - (sentence[w.rows[row[use] - w.first]] if len(use) else 0), numbers[use]


def in_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of each feature, once for each text that has it."""
    found = [np.unique((row << BITS) | number) for row, _, number in features_of(column)]
    seen = np.unique(np.concatenate([np.zeros(0, np.int64), *found]))
    return seen >> BITS, seen & ((1 << BITS) - 1)


def in_sentences(column: pa.Array, kept: np.ndarray) -> np.ndarray:
    """Row, sentence and number of each feature among ``kept`` (true by number), once for each sentence that has it."""
    found = [np.stack([x[kept[number]] for x in (row, sentence, number)]) for row, sentence, number in features_of(column)]
    return np.unique(np.concatenate([np.zeros((3, 0), np.int64), *found], axis=1), axis=1)


def telling(pos: Column, neg: Column, n1: float, n0: float) -> Column:
    """Whether a feature in ``pos`` of n1 toxic and ``neg`` of n0 other texts tells the toxic ones: its G statistic and which way it leans."""
    total, n = pos + neg, n1 + n0
    cells = [(pos, total * n1 / n), (neg, total * n0 / n), (n1 - pos, (n - total) * n1 / n), (n0 - neg, (n - total) * n0 / n)]
    g = sum((F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0) for seen, expected in cells[1:]), F.when(pos > 0, 2 * pos * F.log(pos / cells[0][1])).otherwise(0.0))
    return (g > LEAST_G) & (pos / n1 > neg / n0) & (total >= LEAST_TEXTS)


def untrained() -> Model:
    return Model(np.zeros(1 << BITS, dtype=np.float32), -20.0)


def fitted(pairs: np.ndarray, y: np.ndarray, pos: np.ndarray, neg: np.ndarray, share: float, turns: int = 200) -> Model:
    """Weights for ``pairs`` (row, sentence, feature: distinct, in order) and the labels ``y`` of the rows."""
    if not pairs.size:
        return untrained()
    weights, n1, n0 = np.zeros(1 << BITS, dtype=np.float32), y.sum(), (1 - y).sum()
    fresh = np.ones(pairs.shape[1], dtype=bool)
    fresh[1:] = (pairs[0, 1:] != pairs[0, :-1]) | (pairs[1, 1:] != pairs[1, :-1])
    instance, of = np.cumsum(fresh) - 1, pairs[0, fresh]
    names, column = np.unique(pairs[2], return_inverse=True)
    # Rows weigh as in the whole table; AdaGrad with a little shrinkage.
    row_weight = np.where(y > 0, share / n1, (1 - share) / n0)
    log_odds = np.log((pos[names] + 0.5) / (n1 + 1)) - np.log((neg[names] + 0.5) / (n0 + 1))
    w, b = np.clip(log_odds, 0, 4) * 0.5, -3.0
    g_w, g_b = np.full(len(w), 1e-8), 1e-8
    for _ in range(turns):
        z = np.bincount(instance, weights=w[column], minlength=len(of)) + b
        p = 1 / (1 + np.exp(-z))
        clear = np.bincount(of, weights=np.logaddexp(0, z), minlength=len(y))
        score = np.clip(1 - np.exp(-clear), 1e-9, 1 - 1e-9)
        # d loss / d z of a sentence, through the noisy-or
        slope = (row_weight * np.where(y > 0, -(1 - score) / score, 1.0))[of] * p
        d_w = np.bincount(column, weights=slope[instance], minlength=len(w)) + 1e-6 * w
        d_b = slope.sum() + 1e-6 * b
        g_w += d_w**2
        g_b += d_b**2
        w -= 0.3 * d_w / np.sqrt(g_w)
        b -= 0.3 * d_b / np.sqrt(g_b)
    weights[names] = np.where(w == 0, 1e-6, w)
    return Model(weights, float(b))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for w in words(batch.column("text")):
            n, row, sentence = w.last - w.first, w.row_of(), sentences(w)
            z, has = np.zeros(len(row)), np.zeros(len(row), dtype=bool)
            seen = []
            for numbers in features(w):
                value = np.where(numbers >= 0, model.weights[numbers], 0)
                hit = np.flatnonzero(value)
                has[hit] = True
                seen.append((sentence[hit] << BITS) | numbers[hit])
            pairs = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)
            of, number = pairs >> BITS, pairs & ((1 << BITS) - 1)
            count = int(sentence[-1]) + 1 if len(sentence) else 0
            z = np.bincount(of, weights=model.weights[number], minlength=count) + model.bias
            taken = np.unique(of)
            first_word = np.searchsorted(sentence, taken)
            sentence_row = row[first_word]
            clear = np.bincount(sentence_row, weights=np.logaddexp(0, z[taken]), minlength=n)
            score = 1 - np.exp(-clear)
            worst: list[str | None] = [None] * n
            order = np.lexsort((-taken, z[taken], sentence_row))
            for i in order[np.flatnonzero(np.diff(sentence_row[order], append=-1))]:
                r = int(sentence_row[i])
                if score[r] >= 0.5:
                    last = int(np.searchsorted(sentence, taken[i], side="right")) - 1
                    worst[r] = w.buffer[w.starts[first_word[i]] : w.ends[last]].tobytes().decode("utf-8", "replace")
            part = batch.slice(w.first, n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(worst, pa.string())], names=["doc_id", "held_out", "score", "predicted", "worst_sentence"])


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def _texts_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, number = in_texts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array(number.astype(np.int32)), batch.column("toxic").take(pa.array(row))], names=["number", "toxic"])


def _sentences_with(batches: Iterator[pa.RecordBatch], kept: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The place of the row among ``ids``, sentence and number of each kept feature."""
    for batch in batches:
        row, sentence, number = in_sentences(batch.column("text"), kept)
        place = np.searchsorted(ids, batch.column("row").to_numpy())[row]
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (place, sentence, number)], names=["row", "sentence", "number"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled documents of either label whose crc32 of the id, modulo 5, is not 0.

    The texts stay on the executors: the driver gets the few features that tell and where they occur. Of several texts of one doc_id the least is read.
    """
    usable = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct().filter(~held_out())
    counts = {r["toxic"]: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return untrained()
    chosen = [usable.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for t in (0, 1)]
    # At most 2 * sample rows: a bounded table, so it may be broadcast.
    rows = small_batches(docs).select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "sample")
    of = rows.select("row", "toxic").orderBy("row").toArrow()
    ids, y = of.column("row").to_numpy(), of.column("toxic").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return untrained()
    seen = mapped(rows.select("toxic", "text"), _texts_with, "number int, toxic int").groupBy("number").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    seen = seen.filter(telling(F.col("pos"), F.col("neg"), float(y.sum()), float((1 - y).sum()))).toArrow()
    number, pos, neg, kept = seen.column("number").to_numpy(), np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS, dtype=bool)
    pos[number], neg[number], kept[number] = seen.column("pos").to_numpy(), seen.column("neg").to_numpy(), True
    pairs = mapped(rows.select("row", "text"), lambda x: _sentences_with(x, kept, ids), "row int, sentence int, number int").toArrow()
    pairs = np.stack([pairs.column(c).to_numpy() for c in ("row", "sentence", "number")])
    return fitted(pairs[:, np.lexsort(pairs[::-1])], y, pos, neg, counts[1] / (counts[0] + counts[1]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted (score >= 0.5), worst_sentence.

    Training reads a bounded sample of ``labels`` (doc_id, toxic) and the texts it names; a score depends on
    the text alone. held_out: crc32 of the id as text, modulo 5, is 0; such rows never train.
    Null, empty and blank texts score 0; labels that are null or other than 0 and 1 are not used; a null id is
    not held out; with labels of one kind or none every score is 0. Repeated rows score alike, an empty
    table gives an empty result, further columns are ignored. worst_sentence is null unless predicted is 1.
    """
    model = train(docs, labels, sample)
    small_batches(docs)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, worst_sentence string"
    return mapped(docs.select("doc_id", held_out().alias("held_out"), "text"), lambda x: _scored(x, model), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that are not predicted toxic; see :func:`score_toxicity`."""
    model = train(docs, labels, sample)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            none = pa.nulls(batch.num_rows, pa.int64())
            plain = pa.RecordBatch.from_arrays([none, pa.nulls(batch.num_rows, pa.bool_()), texts], names=["doc_id", "held_out", "text"])
            predicted = [p for part in _scored(iter([plain]), model) for p in part.column("predicted").to_pylist()]
            yield batch.filter(pa.array([not p for p in predicted], pa.bool_()))

    return mapped(small_batches(docs), clean, docs.schema)
