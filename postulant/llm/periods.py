"""Periodic runs of words: scale-tiled search, tiles solved by Z-functions, fragments stitched.

A run is a maximal stretch of words with smallest period q that is at least
`max(LEAST_WORDS, LEAST_POWER * q)` words long. Periods are searched by octave: for
the periods d to 2d-1 a document has an anchor at every multiple of d. Let E be the
positions x of a run with word x = word x+q; they are at least 3q in a row, so E
holds three anchors in a row, and a comparison of each word with the head of the
block before it finds them. Where three in a row agree, the part of the document
around them becomes a tile: a core, 6d words before it and 8d behind it. Tiles are
rows of their own and are dealt over all tasks, so a long document is no task of
its own. Within a tile, Z-functions that start at an anchor (forwards, and
backwards on the reversed words) give for every period of the octave how far E
reaches; every third anchor suffices. Each such interval is a fragment of E, cut at
most 6d words from its anchor. Fragments of one document and period that touch or
overlap are stitched after a shuffle by both. A fragment whose period block is
itself a power belongs to a run with a smaller period and is left out.

Work and memory are linear in the words per octave. Only documents with tiles are
shuffled; all others are finished where they were read.

Defined results: a null or blank text has no words and no runs. A null key is kept.
Repeated rows are documents of their own and give repeated rows. Other columns are
not read, so their names cannot clash. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import cmp_to_key, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from postulant.llm.common import table, written
from postulant.llm.kernel import SPACES, slices, vocabulary

LEAST_WORDS = 6
LEAST_POWER = 4
# Words of a tile's core in the low octaves; in high ones it is 24 times the octave's least period.
TILE = 4096
# Kinds of rows between the two steps: finished documents, documents with tiles, and tiles, which carry their octave.
FINISHED, OPEN = -2, -1

Run = tuple[int, int, int]  # start, length, period


def candidates(codes: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, period) with d <= period < 2d where three anchors in a row agree with the word one period on.

    Of the three, the anchor that is a multiple of 3d stands for them.
    """
    same = codes[d:] == np.repeat(codes[::d], d)[: len(codes) - d]
    n = max(len(same) - 2 * d, 0)
    at = np.flatnonzero(same[:n] & same[d : d + n] & same[2 * d :])
    return -(-(at // d) // 3) * 3 * d, d + at % d


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(octave, first word of the core, first word, words) of every tile that can hold a run."""
    n, d = len(codes), 1
    while LEAST_POWER * d <= n and n >= LEAST_WORDS:
        anchors, _ = candidates(codes, d)
        if len(anchors):
            core = 3 * d * max(8, TILE // (3 * d))
            for t in np.unique(anchors // core).tolist():
                begin = max(0, t * core - 6 * d)
                yield d, t * core, begin, codes[begin : (t + 1) * core + 8 * d]
        d *= 2


def z_function(s: list[int], upto: int) -> list[int]:
    """For each i < upto: the length of the longest common prefix of s and s[i:]."""
    n = len(s)
    z = [0] * upto
    left = right = 0
    for i in range(1, upto):
        if i < right:
            known = z[i - left]
            if known < right - i:
                z[i] = known
                continue
            j = right
        else:
            j = i
        while j < n and s[j] == s[j - i]:
            j += 1
        z[i] = j - i
        left, right = i, j
    return z


@lru_cache(maxsize=100_000)
def prime_factors(q: int) -> tuple[int, ...]:
    found, p = [], 2
    while p * p <= q:
        if q % p == 0:
            found.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return (*found, q) if q > 1 else tuple(found)


def fragments(codes: np.ndarray, d: int, core: int, begin: int) -> list[tuple[int, int, int]]:
    """(period, start, end) of the parts of E that the anchors in a tile's core reach, in words of the document."""
    anchors, periods = candidates(codes, d)
    width = 3 * d * max(8, TILE // (3 * d))
    inner = (anchors >= core - begin) & (anchors < core - begin + width)
    pairs = np.unique(np.stack([anchors[inner], periods[inner]]), axis=1)
    out, words = [], codes.tolist()
    cuts = np.flatnonzero(np.diff(pairs[0], prepend=-1, append=-1)) if pairs.size else []
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        c, wanted = int(pairs[0, low]), pairs[1, low:high].tolist()
        ahead = words[c : c + 8 * d]
        forward = z_function(ahead, min(2 * d, len(ahead)))
        wanted = [q for q in wanted if not any(forward[q // r] >= q - q // r for r in prime_factors(q))]
        if not wanted:
            continue
        behind = words[max(0, c - 6 * d) : c][::-1]
        beside = words[c : c + 2 * d][::-1]
        backward = z_function([*behind, -1, *beside, *behind], len(behind) + 1 + len(beside))
        for q in wanted:
            before, after = backward[len(behind) + 1 + len(beside) - q], forward[q]
            if before + after >= (LEAST_POWER - 1) * q:
                out.append((q, begin + c - before, begin + c + after))
    return out


Make = Callable[[list[bytes], list[Run]], tuple]


def analysed(docs: DataFrame, make: Make, columns: pa.Schema, alter: Callable[[int | None, list[bytes]], list[int] | None] | None = None) -> DataFrame:
    """doc_id and the columns that `make(words, runs)` returns, for every row of doc_id and text.

    `alter(doc_id, words)` may give the numbers of the words that the document is to consist of.
    """
    made = pa.struct(list(columns))
    between = pa.schema([
        ("row", pa.int64()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("core", pa.int64()), ("begin", pa.int64()),
        ("codes", pa.binary()), ("body", pa.binary()), ("made", made),
    ])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for first, end, data, offsets in slices(batch.column(2)):
                codes, borders, _ = vocabulary(data, offsets, ~SPACES)
                raw, rows = data.tobytes(), []
                numbers, ids = (batch.column(i).slice(first, end - first).to_pylist() for i in (0, 1))
                for k, (row, doc_id) in enumerate(zip(numbers, ids, strict=True)):
                    words = raw[offsets[k] : offsets[k + 1]].split()
                    own = codes[borders[k] : borders[k + 1]]
                    chosen = alter(doc_id, words) if alter else None
                    if chosen is not None:
                        words, own = [words[i] for i in chosen], own[chosen]
                    cut = [(row, None, d, core, begin, piece.astype(np.int32).tobytes(), None, None) for d, core, begin, piece in tiles(own)]
                    whole = (row, doc_id, OPEN, 0, 0, None, b" ".join(words), None) if cut else (row, doc_id, FINISHED, 0, 0, None, None, as_row(make(words, [])))
                    rows += [whole, *cut]
                    if sum(len(x[5] or b"") for x in cut) > 1 << 22:
                        yield as_batch(rows, between)
                        rows = []
                done = end
                if rows:
                    yield as_batch(rows, between)

    def as_row(values: tuple) -> dict:
        return dict(zip(columns.names, values, strict=True))

    def as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    found = pa.schema([("row", pa.int64()), ("period", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, d, core, begin, codes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = fragments(np.frombuffer(codes, np.int32), d, core, begin)
                if parts:
                    yield as_batch([(row, *part) for part in parts], found)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(1)):
                raw = data.tobytes()
                ids, runs = (batch.column(i).slice(first, end - first).to_pylist() for i in (0, 2))
                rows = []
                for k, (doc_id, own) in enumerate(zip(ids, runs, strict=True)):
                    ordered = [(r["start"], r["length"], r["period"]) for r in own or []]
                    rows.append((doc_id, as_row(make(raw[offsets[k] : offsets[k + 1]].split(), ordered))))
                yield as_batch(rows, pa.schema([("doc_id", pa.int64()), ("made", made)]))

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = written(numbered.mapInArrow(split, from_arrow_schema(between)), "tiles")
    cut = rows.where(F.col("kind") > 0).select("row", "kind", "core", "begin", "codes").repartition("row", "kind", "core")
    parts = cut.mapInArrow(solve, from_arrow_schema(found))
    ordered = W.partitionBy("row", "period").orderBy("low", "high")
    reach = F.max("high").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    opens = parts.withColumn("opens", F.when(F.col("low") <= reach, 0).otherwise(1))
    islands = opens.withColumn("island", F.sum("opens").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow)))
    whole = islands.groupBy("row", "period", "island").agg(F.min("low").alias("start"), F.max("high").alias("end"))
    runs = whole.select("row", "start", "period", (F.col("end") - F.col("start") + F.col("period")).alias("length"))
    runs = runs.where(F.col("length") >= F.greatest(F.lit(LEAST_WORDS), LEAST_POWER * F.col("period")))
    per_row = runs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    opened = rows.where(F.col("kind") == OPEN).select("row", "doc_id", "body").join(per_row, "row", "left").select("doc_id", "body", "runs")
    closed = rows.where(F.col("kind") == FINISHED).select("doc_id", "made")
    result = opened.mapInArrow(finish, from_arrow_schema(pa.schema([("doc_id", pa.int64()), ("made", made)])))
    return closed.unionByName(result).select("doc_id", "made.*")


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that lie in no run behind its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def strongest(runs: list[Run]) -> Run:
    """The run with the greatest exponent length / period, compared exactly; ties: smallest start, then period."""
    return min(runs, key=cmp_to_key(lambda x, y: y[1] * x[2] - x[1] * y[2] or x[0] - y[0] or x[2] - y[2]))


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs: array of (start, length, period) by start, then period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ("start", "length", "period")
    return analysed(docs, lambda words, runs: ([dict(zip(names, r, strict=True)) for r in runs],), pa.schema([("runs", pa.list_(run))]))


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id, text: the kept words joined by single spaces, n_dropped: words left out."""

    def make(words: list[bytes], runs: list[Run]) -> tuple:
        kept = kept_words(words, runs)
        return b" ".join(kept).decode("utf-8", "replace"), len(words) - len(kept)

    return analysed(docs, make, pa.schema([("text", pa.string()), ("n_dropped", pa.int64())]))


DIGESTS = pa.schema([
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
])


def digest(words: list[bytes], runs: list[Run]) -> tuple:
    start, length, period = strongest(runs) if runs else (None, None, None)
    listed = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    collapsed = hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest()
    return len(runs), start, length, period, 1000 * length // period if runs else None, hashlib.sha256(listed.encode()).hexdigest(), collapsed


def planted(doc_id: int | None, words: list[bytes]) -> list[int] | None:
    """The numbers of the words after the rewriting that the query asks for; null ids are not rewritten."""
    n = len(words)
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*range(a), *(a + i % p for i in range(n - a))]


def periods(spark: SparkSession, folder: str) -> DataFrame:
    return analysed(table(spark, folder, "documents"), digest, DIGESTS, planted)


QUERIES = {"op11_periods": periods}
SQL: dict[str, str] = {}
