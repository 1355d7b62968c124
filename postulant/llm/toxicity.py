"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document is toxic if at least one of its sentences is. Each sentence has a
logistic score from its words; the document's score is the noisy-or of them,
1 - prod(1 - p), and the likelihood of document labels trains the words' weights
through it. So the model also tells which sentences offend (`locate`).

Words are runs of letters, lower-cased in ASCII; sentences end at . ! ? and line
ends. The model is fitted on at most `SAMPLE` labelled documents (those whose id
hashes lowest), kept on the driver as word hashes; everything else runs over all
rows. Words that fewer than `LEAST_DOCUMENTS` of the sample hold, or that toxic documents do
not hold clearly more often, are ignored: only they can make a sentence offend.

Defined results: null and empty texts have no sentence and score 0; a null id is
not held out and is scored; rows with a null
label or id teach nothing; repeated rows score alike; without labels of both kinds
every score is 0; empty tables give empty results; only the named columns are read,
so extra columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.llm.common import table, written
from postulant.llm.kernel import LETTERS, LOWER, prefix, slices, spans, words

SAMPLE = 5000
LEAST_DOCUMENTS = 4
LEAST_SURPLUS = 3.0  # standard deviations by which toxic documents hold a word more often than others
THRESHOLD = 0.7
ENDS = np.zeros(256, bool)
ENDS[[10, 33, 46, 63]] = True


class Model(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def read(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per run of rows: first row, end row, bytes, offsets, word hashes, each word's sentence, each sentence's row.

    Sentences are numbered within the run and hold one word at least.
    """
    for first, end, data, offsets in slices(texts):
        starts, ends, rows = words(LETTERS[data], offsets)
        hashes = spans(prefix(LOWER[data]), starts, ends)
        closed = np.concatenate([[0], np.cumsum(ENDS[data])])[starts]
        opens = np.ones(len(starts), bool)
        opens[1:] = (closed[1:] != closed[:-1]) | (rows[1:] != rows[:-1])
        yield first, end, data, offsets, hashes, np.cumsum(opens) - 1, rows[opens]


def fit(bags: list[tuple[int, np.ndarray, np.ndarray]], rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Model:
    """Fits weights to (label, word hashes, sentence of each word) per document by Adam on all of them at once."""
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -np.inf)
    labels = np.array([label for label, *_ in bags])
    if len(set(labels.tolist())) < 2:
        return none
    distinct = [np.unique(h) for _, h, _ in bags]
    known, place = np.unique(np.concatenate(distinct), return_inverse=True)
    found = np.bincount(place)
    marked = np.bincount(place, np.repeat(labels, [len(d) for d in distinct]))
    share = labels.mean()
    surplus = (marked - share * found) / np.sqrt(share * (1 - share) * found)
    known = known[(found >= LEAST_DOCUMENTS) & (surplus >= LEAST_SURPLUS)]
    if not len(known):
        return none
    counts = [int(s[-1]) + 1 if len(s) else 0 for _, _, s in bags]
    base = np.cumsum([0, *counts])
    sentence = np.concatenate([s + b for (_, _, s), b in zip(bags, base[:-1], strict=True)]).astype(np.int64)
    document = np.repeat(np.arange(len(bags)), counts)
    hashes = np.concatenate([h for _, h, _ in bags])
    word = np.searchsorted(known, hashes)
    word[word == len(known)] = 0
    hit = known[word] == hashes
    word, sentence = word[hit], sentence[hit]
    toxic = labels[document] == 1

    weights, bias = np.zeros(len(known)), -7.0
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sentence, weights[word], len(document))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        none_toxic = np.bincount(document, np.logaddexp(0, z), len(bags))  # -log of the chance that no sentence is
        pull = np.where(toxic, -1 / np.expm1(np.clip(none_toxic, 1e-9, 500))[document], 1.0) * p / len(bags)
        gradient = np.append(np.bincount(word, pull[sentence], len(known)) + decay * weights, pull.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        change = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights - change[:-1], bias - change[-1]
    return Model(known, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from `labels` (doc_id, toxic), without the rows held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    ids = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = written(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "sample")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, offsets, hashes, sentence, rows in read(batch.column(1)):
                of_word = rows[sentence] if len(sentence) else rows
                cut = np.searchsorted(of_word, np.arange(end - first + 1))
                parts = [(hashes[a:b], (sentence[a:b] - sentence[a]).astype(np.int32) if b > a else sentence[:0].astype(np.int32)) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(2).slice(first, end - first), pa.array([h.tobytes() for h, _ in parts]), pa.array([s.tobytes() for _, s in parts])],
                    ["toxic", "hashes", "sentences"],
                )

    rows = texts.select("doc_id", "text", "toxic").mapInArrow(bags, "toxic int, hashes binary, sentences binary").collect()
    order = sorted(rows, key=lambda r: (r.toxic, bytes(r.hashes)))
    return fit([(r.toxic, np.frombuffer(r.hashes, np.uint64), np.frombuffer(r.sentences, np.int32)) for r in order])


def _sentence_scores(model: Model, hashes: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
    if not len(model.words) or not n:
        return np.full(n, -np.inf)
    at = np.searchsorted(model.words, hashes)
    at[at == len(model.words)] = 0
    known = model.words[at] == hashes
    return model.bias + np.bincount(sentence[known], model.weights[at[known]], n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, _, _, hashes, sentence, rows in read(batch.column(1)):
                z = _sentence_scores(model, hashes, sentence, len(rows))
                none_toxic = np.bincount(rows, np.logaddexp(0, z), end - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(-np.expm1(-none_toxic))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def locate(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, score) of sentences that score `least` or more: code points, end exclusive, from first to last word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets, hashes, sentence, rows in read(batch.column(1)):
                z = _sentence_scores(model, hashes, sentence, len(rows))
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                bad = np.flatnonzero(p >= least)
                starts, ends, _ = words(LETTERS[data], offsets)
                leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                low, high = np.searchsorted(sentence, bad), np.searchsorted(sentence, bad, "right") - 1
                row = rows[bad]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)),
                        pa.array(leads[starts[low]] - leads[offsets[row]]),
                        pa.array(leads[ends[high]] - leads[offsets[row]]),
                        pa.array(p[bad]),
                    ],
                    ["doc_id", "start", "end", "score"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, end long, score double")


def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score(docs, train(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": toxicity}
SQL: dict[str, str] = {}
