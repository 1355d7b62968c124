"""Ranked lexical search over hashed max-sketches.

Each document folds into a sketch: two rows of w coordinates, w a power of two of at
least `SPARE` times its distinct terms. A term falls on one coordinate per row, and a
coordinate holds the greatest number of occurrences of its terms. The impact of a term
rises with its occurrences, so a document's length turns these maxima into maxima of
impacts, whatever the corpus statistics are; sketches of new documents can be appended.
A batch of queries looks all its terms up at once: the smaller of a term's two
coordinates is at least its true number, so the weighted sum bounds the score from above.

The best bounds of each query are rescored exactly from the texts, which gives a
threshold. Documents whose bound does not fall below it follow in descending slices of
bounds, each rescored exactly and raising the threshold, until none is left. So the
result is that of an exhaustive search; nothing is approximate.

Scores: weights w = floor(1000 * ln((2N+2) / (2 df + 1))), impacts
(10^9 tf) div (1000 tf + 12 m), with m = 100 - 25 + ((25 n N) div L). All sums are taken
in doubles where they are exact (below 2^53) and in 64-bit integers beyond.

Terms are compared as bytes where they are counted; hashes only choose coordinates.
A batch holds at most `BATCH_ITEMS` queries and about `BATCH_BYTES` of text, so what is
sent to tasks has a bound of its own; more queries take more batches.

Defined results: null texts, and texts without terms, match nothing; queries without
terms return no rows. Repeated rows are documents of their own and may rank several
times; among equal scores and ids they are interchangeable. Null ids rank behind others.
Repeated items are queries of their own. Only doc_id (item_id) and text are read, so
other columns cannot clash. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postulant.llm.common import small, table, written
from postulant.llm.kernel import LETTERS, LOWER, bytes_of, prefix, slices, spans, vocabulary

TERMS = LETTERS.copy()
TERMS[48:58] = True

BEST = 20
# Coordinates per distinct term, at least, in each of a sketch's two rows.
SPARE = 4
LEAST_WIDTH = 16
# Documents a query has rescored before it knows a threshold, as a multiple of the results wanted.
FIRST = 2
# Pairs of query and document rescored at once; beyond, slices of bounds follow one another.
SLICE = 2_000_000
BATCH_ITEMS = 1024
BATCH_BYTES = 1 << 20
# Cells of a matrix of documents and terms that a task holds at a time.
CELLS = 1 << 21
# The largest number of occurrences in a sketch; it stands for any larger one.
MOST = 255

INDEX = "doc_id long, n long, sketch binary"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return vocabulary(data, offsets, TERMS, LOWER)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


# ---- the index -----------------------------------------------------------------------------------------------


def fold(numbers: np.ndarray, borders: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all sketches of a slice, and where each begins, from the terms' numbers and their hashes."""
    rows = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    keys, counts = np.unique(rows * np.int64(max(len(hashes), 1)) + numbers, return_counts=True)
    rows, found = keys // max(len(hashes), 1), hashes[keys % max(len(hashes), 1)]
    distinct = np.bincount(rows, minlength=len(borders) - 1)
    widths = np.where(distinct > 0, np.maximum(LEAST_WIDTH, 1 << np.ceil(np.log2(np.maximum(SPARE * distinct, 1))).astype(np.int64)), 0)
    begins = np.concatenate([[0], np.cumsum(2 * widths)])
    out = np.zeros(int(begins[-1]), np.uint8)
    values = np.minimum(counts, MOST).astype(np.uint8)
    rising = np.argsort(values, kind="stable")  # of several values for one coordinate the last, largest one stays
    rows, found, values = rows[rising], found[rising], values[rising]
    for k, at in enumerate(coordinates(found, widths[rows])):
        out[begins[rows] + k * widths[rows] + at] = values
    return out, begins


def coordinates(hashes: np.ndarray, widths: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A term's coordinate in either row of a sketch of some width."""
    mask = np.asarray(widths, np.int64) - 1
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.int64) & mask, (hashes >> np.uint64(32)).astype(np.int64) & mask


def hashes_of(strings: pa.Array) -> np.ndarray:
    data, offsets = bytes_of(strings)
    return spans(prefix(data), offsets[:-1], offsets[1:]) if len(strings) else np.zeros(0, np.uint64)


def build(docs: DataFrame) -> DataFrame:
    """The index, written: doc_id, n (terms with repeats) and sketch of every document with a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                numbers, borders, distinct = terms_of(data, offsets)
                sketches, begins = fold(numbers, borders, hashes_of(distinct))
                binary = pa.Array.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(begins), pa.py_buffer(sketches)])
                made = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.array(np.diff(borders)), binary.cast(pa.binary())], ["doc_id", "n", "sketch"]
                )
                yield made.filter(pc.greater(made.column(1), 0))

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, INDEX), "sketches")


# ---- a batch of queries --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Batch:
    """Queries with their terms, and the weights that the corpus gives them."""

    items: list
    counts: list[Counter]
    terms: list[bytes]
    n_docs: int = 0
    n_terms: int = 0
    weights: np.ndarray | None = None

    def length_factor(self, n: np.ndarray) -> np.ndarray:
        return 100 - 25 + (25 * n * self.n_docs) // max(self.n_terms, 1)

    def totals(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Documents x queries: weighted sums of impacts from documents x terms numbers of occurrences."""
        rows, columns = np.nonzero(tf)
        m = self.length_factor(n)[rows]
        counted = tf[rows, columns].astype(np.int64)
        found = impacts(counted, m)
        if tf.dtype == np.uint8:
            found[counted == MOST] = 1_000_000  # more occurrences than a sketch tells; no impact is larger
        exact = float(self.weights.sum(axis=0).max(initial=0)) * 1e6 < 2**53
        dense = np.zeros(tf.shape, np.float64 if exact else np.int64)
        dense[rows, columns] = found
        return (dense @ self.weights.astype(dense.dtype)).astype(np.int64)


def batches_of(items: DataFrame) -> Iterator[Batch]:
    """Batches of the queries, each with a bounded number of items and of bytes; one at a time on the driver."""
    held, size = [], 0
    for row in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        text = (row["text"] or "").encode()
        if held and (len(held) >= BATCH_ITEMS or size + len(text) > BATCH_BYTES):
            yield _batch(held)
            held, size = [], 0
        held.append((row["item_id"], text))
        size += len(text)
    if held:
        yield _batch(held)


def _batch(held: list[tuple]) -> Batch:
    texts = [text for _, text in held]
    data = np.frombuffer(b"".join(texts), np.uint8)
    numbers, borders, distinct = terms_of(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    counts = [Counter(numbers[a:b].tolist()) for a, b in zip(borders[:-1], borders[1:], strict=True)]
    return Batch([item for item, _ in held], counts, distinct.to_pylist())


def _counted(batch: pa.RecordBatch, column: int, values: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, documents x terms occurrences, terms with repeats) of runs of a batch's rows."""
    for first, end, data, offsets in slices(batch.column(column)):
        numbers, borders, distinct = terms_of(data, offsets)
        place = pc.fill_null(pc.index_in(distinct, value_set=values), -1).to_numpy(zero_copy_only=False) if len(distinct) else np.zeros(0, np.int32)
        at = place[numbers] if len(numbers) else np.zeros(0, np.int32)
        rows = np.repeat(np.arange(end - first), np.diff(borders))
        step = max(1, CELLS // max(len(values), 1))
        for low in range(0, end - first, step):
            high = min(low + step, end - first)
            inside = slice(borders[low], borders[high])
            ours = at[inside] >= 0
            cells = (rows[inside][ours] - low) * np.int64(len(values)) + at[inside][ours]
            tf = np.bincount(cells, minlength=(high - low) * len(values)).reshape(high - low, len(values))
            yield first + low, first + high, tf, np.diff(borders[low : high + 1])


def weighted(batch: Batch, docs: DataFrame, index: DataFrame) -> Batch:
    """The batch with the corpus statistics and the weights of its terms; only terms that occur stay."""
    values = pa.array(batch.terms, pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(values), np.int64)
        for rows in batches:
            for _, _, tf, _ in _counted(rows, 0, values):
                held += np.count_nonzero(tf, axis=0)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used])], ["term", "df"])

    totals = index.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    df = {row["term"]: row["df"] for row in found}
    kept = sorted(df)
    weights = np.zeros((len(kept), len(batch.items)), np.int64)
    place = {term: i for i, term in enumerate(kept)}
    for q, counts in enumerate(batch.counts):
        for term, times in counts.items():
            if term in place:
                ratio = (2 * totals["docs"] + 2) / (2 * df[term] + 1)
                weights[place[term], q] = times * math.floor(1000 * math.log(ratio))
    return Batch(batch.items, batch.counts, [batch.terms[t] for t in kept], totals["docs"], totals["terms"] or 0, weights)


def _bounds(rows: pa.RecordBatch, batch: Batch, hashes: np.ndarray) -> Iterator[tuple[list, np.ndarray]]:
    """(doc_ids, documents x queries upper bounds) of pieces of an index batch, by sketch width."""
    raw, n = rows.column(2).cast(pa.large_binary()), rows.column(1).to_numpy()
    data, begins = bytes_of(raw)
    widths = np.diff(begins) // 2
    step = max(1, CELLS // max(len(hashes), 1))
    for width in np.unique(widths).tolist():
        first, second = coordinates(hashes, width)
        chosen = np.flatnonzero(widths == width)
        for low in range(0, len(chosen), step):
            part = chosen[low : low + step]
            at = begins[part][:, None]
            tf = np.minimum(data[at + first], data[at + width + second])
            yield part, batch.totals(tf, n[part])


def best_bounds(index: DataFrame, batch: Batch, most: int) -> DataFrame:
    """(query, doc_id, bound) of at least the `most` greatest positive bounds of each query within each task."""
    hashes = hashes_of(pa.array(batch.terms, pa.large_binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.zeros(len(batch.items), np.int64)
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []

        def compact() -> tuple[np.ndarray, np.ndarray, pa.Array]:
            q, bound = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            ids = pa.concat_arrays([x[2] for x in held])
            order = np.lexsort((-bound, q))
            place = np.arange(len(order)) - np.searchsorted(q[order], q[order], "left")
            order = order[place < most]
            last = np.bincount(q[order], minlength=len(floor))
            full = last == most
            floor[: len(last)][full] = bound[order][np.cumsum(last)[full] - 1]
            return q[order], bound[order], ids.take(pa.array(order))

        waiting = 0
        for rows in batches:
            for part, bounds in _bounds(rows, batch, hashes):
                at, q = np.nonzero(bounds > floor)
                held.append((q, bounds[at, q], rows.column(0).take(pa.array(part[at]))))
                waiting += len(q)
                if waiting > 4 * most * len(floor):
                    held, waiting = [compact()], 0
        if held:
            q, bound, ids = compact()
            yield pa.RecordBatch.from_arrays([pa.array(q), ids, pa.array(bound)], ["query", "doc_id", "bound"])

    return index.mapInArrow(run, "query long, doc_id long, bound long")


def open_bounds(index: DataFrame, batch: Batch, scores: np.ndarray, last_ids: np.ndarray) -> DataFrame:
    """(query, doc_id, bound) of all documents that can still enter a query's results.

    `scores` and `last_ids` are score and id of a query's last result so far; 0 and any id if it has too few.
    """
    hashes = hashes_of(pa.array(batch.terms, pa.large_binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids = rows.column(0)
            numbers = pc.fill_null(ids, np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            for part, bounds in _bounds(rows, batch, hashes):
                may = (bounds > scores) | ((bounds == scores) & (numbers[part][:, None] < last_ids) & (bounds > 0))
                at, q = np.nonzero(may)
                yield pa.RecordBatch.from_arrays([pa.array(q), ids.take(pa.array(part[at])), pa.array(bounds[at, q])], ["query", "doc_id", "bound"])

    return index.mapInArrow(run, "query long, doc_id long, bound long")


def rescored(docs: DataFrame, batch: Batch, pairs: DataFrame) -> DataFrame:
    """(query, doc_id, score) of every document that a pair names, from its text; positive scores only. Written."""
    values = pa.array(batch.terms, pa.large_binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            wanted = rows.column(2)
            for first, end, tf, n in _counted(rows, 1, values):
                own = wanted.slice(first, end - first)
                at = np.repeat(np.arange(end - first), pc.list_value_length(own).to_numpy(zero_copy_only=False))
                q = own.flatten().to_numpy(zero_copy_only=False)
                score = batch.totals(tf, n)[at, q]
                kept = np.flatnonzero(score > 0)
                ids = rows.column(0).slice(first, end - first).take(pa.array(at[kept]))
                yield pa.RecordBatch.from_arrays([pa.array(q[kept], pa.int64()), ids, pa.array(score[kept])], ["query", "doc_id", "score"])

    named = written(pairs.groupBy("doc_id").agg(F.collect_set("query").alias("queries")), "wanted")
    named = small(named.withColumnRenamed("doc_id", "wanted_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    joined = texts.join(named, F.col("doc_id").eqNullSafe(F.col("wanted_id"))).select("doc_id", "text", "queries")
    return written(joined.mapInArrow(run, "query long, doc_id long, score long"), "scores")


def ranked(scores: DataFrame, best: int) -> DataFrame:
    """The best rows of each query with their rank. One row per result and task enters the window (WindowGroupLimit)."""
    order = W.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def _thresholds(scores: DataFrame, batch: Batch, best: int) -> tuple[np.ndarray, np.ndarray]:
    floor, ids = np.zeros(len(batch.items), np.int64), np.zeros(len(batch.items), np.int64)
    for row in ranked(scores, best).where(F.col("rank") == best).collect():  # one row per query of the batch
        floor[row["query"]] = row["score"]
        ids[row["query"]] = np.iinfo(np.int64).max if row["doc_id"] is None else row["doc_id"]
    return floor, ids


def search(docs: DataFrame, items: DataFrame, index: DataFrame | None = None, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: the `best` documents of every item with a positive score."""
    spark = docs.sparkSession
    index = build(docs) if index is None else index
    results = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    for plain in batches_of(items):
        batch = weighted(plain, docs, index)
        if not batch.terms:
            continue
        leaders = written(best_bounds(index, batch, FIRST * best), "leaders")
        place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("bound"), F.col("doc_id").asc_nulls_last()))
        pairs = written(leaders.withColumn("place", place).where(F.col("place") <= FIRST * best).select("query", "doc_id").distinct(), "first")
        scores = rescored(docs, batch, pairs)
        floor, last = _thresholds(scores, batch, best)
        same = (F.col("query") == F.col("done_query")) & F.col("doc_id").eqNullSafe(F.col("done_id"))
        done = small(pairs.select(F.col("query").alias("done_query"), F.col("doc_id").alias("done_id")))
        # Rows with one id are rescored together, so they count as one.
        found = open_bounds(index, batch, floor, last).groupBy("query", "doc_id").agg(F.max("bound").alias("bound"))
        left = written(found.join(done, same, "left_anti"), "open")
        while (n := left.count()) > 0:
            limits = left.groupBy("query").agg(F.max("bound").alias("top")).collect()  # one row per query of the batch
            cut = {r["query"]: 0 if n <= SLICE else (int(floor[r["query"]]) + r["top"] + 1) // 2 for r in limits}
            edge = spark.createDataFrame([(int(q), int(c)) for q, c in cut.items()], "query long, cut long")
            taken = left.join(F.broadcast(edge), "query")  # at most BATCH_ITEMS rows
            now = taken.where(F.col("bound") >= F.col("cut")).select("query", "doc_id")
            scores = written(ranked(scores.union(rescored(docs, batch, now)), best).drop("rank"), "scores")
            floor, last = _thresholds(scores, batch, best)
            edges = [(q, int(floor[q]), int(last[q])) for q in range(len(batch.items))]
            raised = F.broadcast(spark.createDataFrame(edges, "query long, floor long, last long"))
            may = (F.col("bound") > F.col("floor")) | ((F.col("bound") == F.col("floor")) & (F.col("doc_id") < F.col("last")))
            rest = taken.where(F.col("bound") < F.col("cut")).drop("cut").join(raised, "query").where(may)
            left = written(rest.select("query", "doc_id", "bound"), "open")
        names = spark.createDataFrame(list(enumerate(batch.items)), f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        found = ranked(scores, best).join(F.broadcast(names), "query")  # at most BATCH_ITEMS rows
        results = results.union(written(found.select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "results"))
    return results


def lexical(spark: SparkSession, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {"op13_lexical": lexical}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERMS = f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = {
    "op13_lexical": f"""WITH found AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
occurring AS (SELECT doc_id, term, count(*) AS tf FROM found GROUP BY doc_id, term),
sized AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM occurring GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
weighed AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM occurring, corpus GROUP BY term, docs),
factors AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM sized, corpus),
wanted AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM wanted JOIN weighed USING (term) JOIN occurring USING (term) JOIN factors USING (doc_id) GROUP BY item_id, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scored WHERE score > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM placed WHERE place <= 20""",
}
