"""An index of the natural keys of stored applications, in buckets by hash.

Whether an application is already stored is asked for every imported mail. The index
answers it from the buckets of the asked keys alone: `depth=<d>/bucket=<prefix>` holds the
keys whose hash starts with these d hex digits. Every load appends its keys. A bucket of
many small files is merged; once buckets grow beyond `bucket_bytes` (with more than 256 buckets:
beyond 16 MB at least), all keys move at once to buckets of as many digits more as it takes. So what
a batch reads depends on its own keys, not on the table. When all entries are written anew, they go to a new folder
`depth=<d>.<version>`, and the old one is removed after that.

The index only points: an entry names a row that may since have been changed or deleted,
or that was never switched in because its load broke off. The store looks every hit up in
the table, so superfluous and repeated entries do no harm, and entries are written before
the rows they point to, so none is missing. That makes appends, merges and moves safe to
repeat at any point.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.operators.upsert import broadcast_if_small, fits_broadcast
from postulant.schema import NATURAL_KEY
from postulant.sources.files import exists, few_rows, listed, remove

ENTRIES = "job string, name string, id string, applied_month string, load_id string"
HEX_DIGITS = 16
# Every bucket is a folder to list and a file to write, which costs more than thousands of entries. So small buckets
# split into up to 256, and further only from this size on.
BUCKET_BYTES = 16 << 20
CHEAP_DIGITS = 2
# So many rows a bucket leave no bucket out, as hashes spread evenly.
ROWS_THAT_TOUCH = 64
# About the bytes of an entry, by which an empty index gets buckets that hold its first rows.
ENTRY_BYTES = 40


def _prefix(depth: int) -> Column:
    """The first hex digits of a key's hash."""
    return F.substring(F.lpad(F.hex(F.xxhash64(*NATURAL_KEY)), HEX_DIGITS, "0"), 1, depth)


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("job", "name", "id", "applied_month", "load_id").where("job <> '' AND name <> ''")


@dataclass(frozen=True)
class Held:
    """A folder of entries: digits of its buckets, and how often all entries were written anew before it."""

    depth: int
    version: int = 0

    @property
    def name(self) -> str:
        return f"depth={self.depth}" + (f".{self.version}" if self.version else "")


@dataclass(frozen=True)
class KeyIndex:
    spark: SparkSession
    root: str
    bucket_bytes: int = BUCKET_BYTES
    bucket_files: int = 8

    def _held(self) -> list[Held]:
        """Folders with all entries, the newest last; more than one only after a break."""
        named = [re.fullmatch(r"depth=(\d+)(?:\.(\d+))?", name) for name in listed(self.spark, self.root)]
        held = sorted((Held(int(m[1]), int(m[2] or 0)) for m in named if m), key=lambda h: (h.version, h.depth))
        return [h for h in held if exists(self.spark, f"{self._folder(h)}/_SUCCESS")]

    def _depths(self) -> list[int]:
        """Depths whose buckets are complete."""
        return [h.depth for h in self._held()]

    def _folder(self, held: Held) -> str:
        return f"{self.root}/{held.name}"

    def exists(self) -> bool:
        return bool(self._held())

    def empty(self) -> bool:
        held = self._held()
        return not held or not self._buckets(held[-1])

    def read(self) -> DataFrame:
        """All entries."""
        held = self._held()
        return self._all(held[-1]) if held else few_rows(self.spark, [], ENTRIES)

    def _all(self, held: Held) -> DataFrame:
        return self.spark.read.schema(f"{ENTRIES}, bucket string").parquet(self._folder(held)).drop("bucket")

    def _write(self, rows: DataFrame, held: Held, mode: str, buckets: int) -> None:
        # Rows of a bucket meet in one file. Its cost lies in the number of files, not in their bytes, by which AQE
        # would put all of them into one task; a stored key has one entry or few, so none fills a bucket.
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        placed = rows.withColumn("bucket", _prefix(held.depth)).repartition(max(min(tasks, buckets), 1), "bucket")
        placed.write.mode(mode).partitionBy("bucket").parquet(self._folder(held))

    def _anew(self, rows: DataFrame, depth: int) -> Held:
        """Let these rows be the index, in a new folder; the old ones go, each in one call."""
        old = self._held()
        made = Held(depth, old[-1].version + 1 if old else 0)
        self._write(rows, made, "overwrite", 16**depth)
        for held in old:
            remove(self.spark, self._folder(held))
        return made

    def rebuild(self, rows: DataFrame) -> None:
        """Index these rows anew, from scratch; entries of rows that are gone go too."""
        held = self._held()
        made = self._anew(_named(rows), held[-1].depth if held else 1)
        self._settle(made, self._buckets(made))

    def add(self, rows: DataFrame, n_rows: int = 0) -> None:
        """Append the entries of rows with job, name, id, applied_month and load_id; rows without a key have none.

        The buckets they touch are looked for, unless the number of rows is given and so large that they touch all.
        The first rows of an empty index, if too many for its buckets, go to smaller ones at once.
        """
        held = (self._held() or [Held(1)])[-1]
        depth = held.depth
        while depth < CHEAP_DIGITS and ENTRY_BYTES * n_rows > 16**depth * self._most(depth):
            depth += 1
        if depth > held.depth and self.empty():
            made = self._anew(_named(rows), depth)
            return self._settle(made, self._buckets(made))
        every = n_rows >= ROWS_THAT_TOUCH * 16**held.depth
        touched = [] if every else self._touched(rows, held.depth)
        self._write(_named(rows), held, "append", 16**held.depth if every else len(touched))
        self._settle(held, self._buckets(held) if every else touched)

    def _touched(self, rows: DataFrame, depth: int) -> list[str]:
        """The buckets of the rows' keys; at most as many as there are buckets."""
        return [row[0] for row in rows.where("job <> '' AND name <> ''").select(_prefix(depth)).distinct().collect()]

    def _buckets(self, held: Held) -> list[str]:
        return [name[7:] for name in listed(self.spark, self._folder(held)) if name.startswith("bucket=")]

    def _files(self, held: Held, buckets: Sequence[str]) -> dict[str, dict[str, int]]:
        """The files of some buckets with their lengths. Spark lists them, in many folders at a time."""
        found: dict[str, dict[str, int]] = {bucket: {} for bucket in buckets}
        if found:
            paths = [f"{self._folder(held)}/bucket={b}" for b in buckets]
            files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(paths)
            for path, length in files.select("path", "length").collect():
                found[path.split("/")[-2][7:]][path] = length
        return found

    def _most(self, depth: int) -> int:
        """Bytes that a bucket may have."""
        return self.bucket_bytes if depth < CHEAP_DIGITS else max(self.bucket_bytes, BUCKET_BYTES)

    def _settle(self, held: Held, touched: Sequence[str]) -> None:
        """Merge touched buckets of many files; move all keys deeper if the touched buckets are too large."""
        files = self._files(held, touched)
        size, depth = sum(sum(of.values()) for of in files.values()) / max(len(touched), 1), held.depth
        while depth < HEX_DIGITS and size > self._most(depth):
            size, depth = size / 16, depth + 1
        if depth > held.depth:
            # Hashes spread evenly, so the touched buckets stand for all.
            made = self._anew(self._all(held).distinct(), depth)
            return self._settle(made, self._buckets(made))
        crowded = {b: of for b, of in files.items() if len(of) > self.bucket_files}
        if crowded:
            self._replace(held, crowded, lambda rows: rows.distinct())

    def _replace(self, held: Held, files: dict[str, dict[str, int]], change: Callable[[DataFrame], DataFrame]) -> None:
        """Write the entries of some buckets anew. Most buckets: all entries, as that removes one folder and not each file."""
        if 2 * len(files) > 16**held.depth:
            self._anew(change(self._all(held)), held.depth)
            return
        self._write(change(self._in(held, list(files))), held, "append", len(files))
        for of in files.values():  # a break before this leaves entries twice or of rows that are gone, which does no harm
            for file in of:
                remove(self.spark, file)

    def discard(self, rows: DataFrame) -> None:
        """Drop the entries of removed rows (job, name, id). Only their buckets are rewritten, or all if they are most."""
        if not self.exists():
            return
        held = self._held()[-1]
        touched = {*self._touched(rows, held.depth)} & {*self._buckets(held)}
        if touched:
            gone = broadcast_if_small(rows.where("job <> '' AND name <> ''").select("id"))
            self._replace(held, self._files(held, sorted(touched)), lambda left: left.join(gone, "id", "left_anti").distinct())

    def _in(self, held: Held, buckets: Sequence[str]) -> DataFrame:
        """Entries of some buckets. Only their folders are listed and read."""
        folder = self._folder(held)
        paths = [f"{folder}/bucket={b}" for b in buckets]
        return self.spark.read.schema(f"{ENTRIES}, bucket string").option("basePath", folder).parquet(*paths).drop("bucket")

    def candidates(self, keys: DataFrame) -> DataFrame:
        """Entries in the buckets of the given keys (job, name)."""
        if not self.exists():
            return self.read()
        held = self._held()[-1]
        wanted = {row[0] for row in keys.select(_prefix(held.depth)).distinct().collect()}  # at most as many as buckets
        found = sorted(wanted & set(self._buckets(held)))
        return self._in(held, found) if found else few_rows(self.spark, [], ENTRIES)

    def matching(self, keys: DataFrame) -> DataFrame:
        """Entries with one of the given keys. Few keys are sent to the buckets, which then need no shuffle; many touch all buckets."""
        if fits_broadcast(keys):
            return self.candidates(keys).join(F.broadcast(keys), list(NATURAL_KEY), "left_semi")
        return self.read().join(keys, list(NATURAL_KEY), "left_semi")
