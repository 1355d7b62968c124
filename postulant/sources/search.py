"""A search index: which files hold which groups of three characters.

A pattern search reads every text of a column. Most patterns contain plain words, and a
file without the words' trigrams cannot hold a match. The index names the files of each
trigram and column; a search reads the files that have all trigrams its pattern requires,
and files the index does not know yet. The pattern itself still decides on every row, so
the result is that of a full search; a pattern that requires no trigram is a full search.

Trigrams are of plain ASCII, in lower case as a case-blind pattern sees it, and are hashed
into a fixed number of slots, so a file has at most `SLOTS` entries per column. Rows of the
index are only appended; files that are gone from the table do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.operators.browse import matches
from postulant.schema import SEARCHABLE
from postulant.sources.files import few_rows, listed

SLOTS = 1 << 16
SLOTS_PER_FOLDER = 1 << 12
ENTRIES = "file string, slot int, column string, part int"
FILES = "file string"
# Bytes of text that a task works on at once.
SLICE = 1 << 20

# Characters that a case-blind search takes for a plain letter, beside the capitals (fixed values).
FOLDED = {"İ": "i", "ı": "i", "ſ": "s", "K": "k"}
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(FOLDED)
_TO = "abcdefghijklmnopqrstuvwxyz" + "".join(FOLDED.values())
# Characters with a meaning of their own in a pattern; all others stand for themselves.
SPECIAL = set("\\^$.|?*+()[]{}")


def fold(text: Column) -> Column:
    return F.translate(text, _FROM, _TO)


def required_words(pattern: str) -> list[str]:
    """Plain texts that every match of a pattern contains; fewer than there may be, never too many.

    Groups, alternatives, classes and escapes end a text; a character that may be missing
    (`?`, `*`, `{`) is no part of one. A pattern with a group or an alternative requires nothing,
    nor does one that may switch case-blindness or comments.
    """
    if any(c in pattern for c in "|()") or "\\Q" in pattern:
        return []
    found, run, i = [], "", 0
    while i < len(pattern):
        c = pattern[i]
        if c not in SPECIAL and c.isascii():
            run += c
        else:
            if c in "?*{":
                run = run[:-1]
            found.append(run)
            run = ""
            if c == "\\":
                if i + 1 < len(pattern) and pattern[i + 1] in SPECIAL:
                    run = pattern[i + 1]  # the character itself
                elif i + 1 < len(pattern) and pattern[i + 1] in "xucpPkN0":
                    return []  # names a character by what follows
                i += 1
            elif c in "[{":
                end = pattern.find("]" if c == "[" else "}", i + 2 if c == "[" else i)
                if c == "[" and any(x in pattern[i + 1 : end] for x in "[\\&"):
                    return []  # a class within a class, or an escape
                i = end if end >= 0 else len(pattern)
        i += 1
    return [word.translate(str.maketrans(_FROM, _TO)) for word in [*found, run] if len(word) >= 3]


def slots_of(words: Sequence[str]) -> list[int]:
    return sorted({zlib.crc32(word[i : i + 3].encode()) % SLOTS for word in words for i in range(len(word) - 2)})


_LOWER = np.arange(256, dtype=np.int32)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _slot_of_gram() -> np.ndarray:
    """The slot (crc32 modulo `SLOTS`) of every three ASCII characters, by their codes of 7 bits in a row."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, table >> 1 ^ np.uint32(0xEDB88320), table >> 1)
    grams = np.arange(1 << 21, dtype=np.uint32)
    crc = np.full(len(grams), 0xFFFFFFFF, np.uint32)
    for shift in (14, 7, 0):
        crc = table[(crc ^ grams >> shift & 127) & 255] ^ crc >> 8
    return (~crc % SLOTS).astype(np.int32)


def _mark(seen: np.ndarray, texts: pa.Array) -> None:
    """Mark the trigrams of texts, by the codes of their characters."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for special, plain in FOLDED.items():
        texts = pc.replace_substring(texts, special, plain)
    _, places, held = texts.buffers()
    if held is None:
        return
    borders = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(held, np.uint8)[: borders[-1]]
    for start in range(int(borders[0]), len(data) - 2, SLICE):
        codes = _LOWER[data[start : start + SLICE + 2]]
        plain = codes < 128
        whole = plain[:-2] & plain[1:-1] & plain[2:]
        for before in (1, 2):  # a trigram that begins there would cross a border
            crossing = borders[1:-1] - before - start
            whole[crossing[(crossing >= 0) & (crossing < len(whole))]] = False
        seen[(codes[:-2] << 14 | codes[1:-1] << 7 | codes[2:])[whole]] = True


def _entries(columns: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows of file and texts to the slots of each file's columns; a task holds one file's at a time."""

    def told(file: str, seen: np.ndarray) -> Iterator[pa.RecordBatch]:
        for column, marks in zip(columns, seen, strict=True):
            slots = np.unique(_slot_of_gram()[np.flatnonzero(marks)])
            named = [pa.array([name] * len(slots), pa.string()) for name in (file, column)]
            yield pa.RecordBatch.from_arrays([*named, pa.array(slots)], ["file", "column", "slot"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, np.zeros((len(columns), 1 << 21), bool)
        for batch in batches:
            runs, first = pc.run_end_encode(batch.column(0)), 0
            for file, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
                if file != current:
                    if current is not None:
                        yield from told(current, seen)
                    current = file
                    seen[:] = False
                for k in range(len(columns)):
                    _mark(seen[k], batch.column(k + 1).slice(first, end - first))
                first = end
        if current is not None:
            yield from told(current, seen)

    return collect


class TrigramIndex:
    def __init__(self, spark: SparkSession, root: str, columns: Sequence[str] = SEARCHABLE):
        self.spark = spark
        self.root = root
        self.columns = tuple(columns)

    def _read(self, what: str, schema: str) -> DataFrame:
        place = f"{self.root}/{what}"
        return self.spark.read.schema(schema).parquet(place) if listed(self.spark, place) else few_rows(self.spark, [], schema)

    def files(self) -> set[str]:
        """The indexed files; as many names as the driver lists anyway to plan a scan."""
        return {row["file"] for row in self._read("files", FILES).distinct().collect()}

    def add(self, df: DataFrame) -> list[str]:
        """Index the files of a table that are not yet indexed; their names."""
        known = self.files()
        new = [file for file in table_files(df) if file not in known]
        if not new:
            return []
        rows = df.where(F.col("_metadata.file_path").isin(new))
        # Tasks pass on each slot of a file once, so the shuffle follows the number of files, not of texts.
        texts = rows.select(F.col("_metadata.file_path").alias("file"), *[F.col(c).cast("string") for c in self.columns])
        entries = texts.mapInArrow(_entries(self.columns), "file string, column string, slot int").distinct()
        placed = entries.withColumn("part", F.floor(F.col("slot") / SLOTS_PER_FOLDER).cast("int"))
        # Sorted by slot, so that a search skips row groups within its folders.
        sorted_ = placed.repartition("column", "part").sortWithinPartitions("column", "part", "slot")
        sorted_.write.mode("append").partitionBy("column", "part").parquet(f"{self.root}/entries")
        # Written last: a file counts as indexed only when all its entries are there.
        few_rows(self.spark, [(f,) for f in new], FILES).coalesce(1).write.mode("append").parquet(f"{self.root}/files")
        return new

    def files_with(self, column: str, slots: Sequence[int]) -> set[str]:
        """Indexed files that have all the slots in a column."""
        parts = sorted({slot // SLOTS_PER_FOLDER for slot in slots})
        entries = self._read("entries", ENTRIES).where((F.col("column") == column) & F.col("part").isin(parts) & F.col("slot").isin(list(slots)))
        found = entries.groupBy("file").agg(F.count_distinct("slot").alias("n")).where(F.col("n") == len(slots))
        return {row["file"] for row in found.select("file").collect()}

    def search(self, df: DataFrame, column: str, pattern: str) -> DataFrame:
        """Rows of a table whose column matches a pattern, read from the files that may hold one."""
        wanted = matches(column, pattern)
        slots = slots_of(required_words(pattern))
        if not slots or column not in self.columns:
            return df.where(wanted)
        known, having = self.files(), self.files_with(column, slots)
        left = [file for file in table_files(df) if file not in known or file in having]
        return df.where(F.col("_metadata.file_path").isin(left) & wanted)


def table_files(df: DataFrame) -> list[str]:
    """Names of a table's files, as its rows tell them."""
    return [_as_told(file) for file in df.inputFiles()]


def _as_told(file: str) -> str:
    return "file:/" + file.removeprefix("file:///") if file.startswith("file:///") else file
