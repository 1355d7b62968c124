"""The candidate table and its file side table, as partitioned catalog tables.

Parquet has no row-level writes. A change writes the new content of the touched
partitions to a new folder and then points those partitions there. Nothing that
is being read is overwritten, untouched partitions are not rewritten, and a job
that fails before the switch leaves the table as it was. The switch goes partition
by partition: if it breaks off, repeating the same call completes it. One writer
at a time. The folders of replaced partitions stay until `CandidateStore.vacuum`.

`applied_month` lets date ranges read only their months; `segment` holds the rows of
one load, so that a repeated load replaces its own rows and nothing else, until
`CandidateStore.compact` packs the segments of closed loads together; `id_prefix` keeps
a look-up or delete from touching all files of a load.

Beside the tables lie an index of natural keys (`sources.keys`), counts by job and day for
each partition, which every change renews for the partitions it touches, and the list of
finished and of closed loads.
"""

from __future__ import annotations

import hashlib
import re
import time
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postulant.functions.dates import calendar_part
from postulant.operators.browse import BrowseSpec, lookup, loosely_equal
from postulant.operators.saving import CONFLICT, GONE, three_way, to_store
from postulant.operators.upsert import (
    absent_rows,
    broadcast_if_small,
    changed_rows,
    delete_by_id,
    has_key,
    last_edits,
    update_by_id,
)
from postulant.schema import ALL, CANDIDATE_CV, CANDIDATE_PARTITIONS, CANDIDATES, CV_PARTITIONS, NATURAL_KEY, STORED, UNKNOWN_MONTH
from postulant.sources.files import few_rows, listed, remove
from postulant.sources.keys import KeyIndex


# What tells the mails of one load apart.
IDENTITY = ("filename", "applied_at", "job", "name")
# Partitions that are pointed elsewhere at the same time.
SWITCHES = 8
# Hits of the key index up to this number are looked up by plain ids, which file filters understand.
LISTED_IDS = 1000
# Spellings of one job, up to which they are pushed to the scan.
MANY_SPELLINGS = 1000
COUNTS = "job string, day date, n long, applied_month string, segment string"
# Files of counts, above which they are written anew as one.
COUNT_FILES = 64
LOADS = "load_id string, finished_at timestamp"
MERGED = "merged-"  # names of segments that hold several loads


@dataclass(frozen=True)
class PartitionedTable:
    spark: SparkSession
    name: str
    root: str
    schema: T.StructType
    partitions: tuple[str, ...]
    sorted_by: tuple[str, ...] = ()

    def _stored(self) -> T.StructType:
        return T.StructType(self.schema.fields + [T.StructField(p, T.StringType()) for p in self.partitions])

    def create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({self._stored().toDDL()}) USING parquet "
            f"PARTITIONED BY ({', '.join(self.partitions)}) LOCATION '{self.root}/{self.name}'"
        )

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def known(self) -> set[str]:
        """The partitions the catalog has. No file is opened."""
        return {self._from_path(row[0]) for row in self.spark.sql(f"SHOW PARTITIONS {self.name}").collect()}

    def holding(self, column: str, values: Iterable[str]) -> list[str]:
        """The partitions with one of these values in a partition column."""
        at, wanted = self.partitions.index(column), {*values}
        return sorted(label for label in self.known() if label.split("/")[at] in wanted)

    def label(self) -> Column:
        return F.concat_ws("/", *self.partitions)

    def labels(self, rows: DataFrame) -> list[str]:
        """The partitions rows lie in. There are as many as folders, which the driver lists anyway."""
        return [row[0] for row in rows.select(self.label()).distinct().collect()]

    def content(self, labels: list[str]) -> DataFrame:
        """Rows of some partitions; the filter uses partition columns only, so others are not read."""
        # A metastore can evaluate the plain conditions; the label then picks the exact pairs.
        values = [sorted(set(column)) for column in zip(*[label.split("/") for label in labels])]
        rows = self.read().where(self.label().isin(labels))
        for column, known in zip(self.partitions, values):
            rows = rows.where(F.col(column).isin(known))
        return rows

    def replace(self, rows: DataFrame, labels: list[str], gaining: Iterable[str] = ()) -> list[str]:
        """Let `rows` be the content of the given partitions and of those they lie in; all partitions that changed.

        Partitions that gain rows from others switch first, so that no row is ever missing.
        """
        return self.switch(self.stage(rows), labels, gaining)

    def stage(self, rows: DataFrame) -> str:
        """Write rows to a new folder, which no partition points to yet."""
        folder = f"{self.root}/{self.name}-{uuid.uuid4().hex}"
        kept = rows.select(*[f.name for f in self.schema.fields], *self.partitions)
        # Few files per folder: rows of a folder meet, and AQE splits what grows too large.
        balanced = kept.hint("rebalance", *[F.col(p) for p in self.partitions])
        writer = balanced.sortWithinPartitions(*self.partitions, *self.sorted_by).write.partitionBy(*self.partitions)
        for column in ("id", *self.sorted_by):  # look-ups skip files without the value
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.option("parquet.bloom.filter.adaptive.enabled", "true").parquet(folder)
        return folder

    def staged(self, folder: str) -> DataFrame:
        return self.spark.read.schema(self._stored()).parquet(folder)

    def switch(self, folder: str, labels: list[str], gaining: Iterable[str] = (), filled: Iterable[str] | None = None) -> list[str]:
        """Point the given partitions, and those the folder has rows for (`filled`), to its content; all partitions that changed."""
        filled = set(self.labels(self.staged(folder)) if filled is None else filled)
        known = self.known()
        foreign = filled & known - {*labels}
        if foreign:
            raise RuntimeError(f"rows for partitions whose content was not read: {sorted(foreign)[:3]}; nothing was changed")
        added = [f"{self._spec(label)} LOCATION '{folder}/{self._path(label)}'" for label in sorted(filled - known)]
        if added:
            self._alter("ADD IF NOT EXISTS " + " ".join(added))
        gaining = {*gaining}
        for turn in (filled & known & gaining, filled & known - gaining):
            changes = [f"{self._spec(label)} SET LOCATION '{folder}/{self._path(label)}'" for label in sorted(turn)]
            with ThreadPoolExecutor(SWITCHES) as pool:  # one statement per partition, several at a time
                list(pool.map(self._alter, changes))
        emptied = sorted(set(labels) & known - filled)
        if emptied:
            self.forget(emptied)
        return sorted(filled | set(labels))

    def forget(self, labels: list[str]) -> None:
        """Drop partitions, all in one statement; their folders stay."""
        self._alter("DROP IF EXISTS " + ", ".join(self._spec(label) for label in labels))

    def _alter(self, change: str) -> None:
        self.spark.sql(f"ALTER TABLE {self.name} {change}")

    def _path(self, label: str) -> str:
        return "/".join(f"{column}={value}" for column, value in zip(self.partitions, label.split("/")))

    def _from_path(self, path: str) -> str:
        return "/".join(step.split("=", 1)[1] for step in path.split("/"))

    def _spec(self, label: str) -> str:
        values = zip(self.partitions, label.split("/"))
        return "PARTITION (" + ", ".join(f"{column}='{value}'" for column, value in values) + ")"


class CandidateStore:
    """The candidate table together with the stored resume files, the key index and the counts."""

    def __init__(self, spark: SparkSession, root: str, name: str = "candidates"):
        self.spark = spark
        self.root = root
        self.people = PartitionedTable(spark, name, root, STORED, CANDIDATE_PARTITIONS, ("job",))
        self.files = PartitionedTable(spark, f"{name}_cv", root, CANDIDATE_CV, CV_PARTITIONS)
        self.keys = KeyIndex(spark, f"{root}/{name}-keys")
        self.people.create()
        self.files.create()

    def read(self) -> DataFrame:
        return self.people.read()

    def read_files(self) -> DataFrame:
        return self.files.read()

    def insert(
        self,
        batch: DataFrame,
        load_id: str | None,
        store_cv: bool = False,
        finish: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    ) -> None:
        """Append the new rows of a batch of `plans.ingest.candidates`.

        A batch of `plans.ingest.keyed` with `finished` as `finish` will do too: known
        applications then go before any text is read. Stored files are still read with all rows.

        Keys count as known if another load holds them. A repeated load therefore
        never finds its own first attempt, and replaces that attempt. A load that
        `compact` has closed is refused: its rows lie among those of others.

        Without a load id the batch names the load of each row in a column `load_id`: many loads
        at once, with the result of inserting them one after the other in the order of their names.
        """
        loads = [load_id] if load_id is not None else sorted(row[0] for row in batch.select("load_id").distinct().collect())
        for name in loads:
            if not re.fullmatch(r"[\w.-]+", name) or name.startswith(MERGED):
                raise ValueError(f"a load id names a folder, so {name!r} will not do")
        closed = self._loads("closed").where(F.col("load_id").isin(loads)).select("load_id").distinct().collect()
        if closed:
            raise ValueError(f"closed loads: {sorted(row[0] for row in closed)}; what they still have to add needs a load of its own")
        before = self.people.holding("segment", loads)
        load = F.lit(load_id) if load_id is not None else F.col("load_id")
        # The same mail of the same load keeps its id when the load is repeated.
        identity = F.concat_ws("/", load, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in IDENTITY])
        added = {"id": F.substring(F.sha2(identity, 256), 1, 32), "load_id": load, "segment": load}
        order = ("applied_at", "filename") if load_id is not None else ("load_id", "applied_at", "filename")
        old_files = self.files.holding("load_id", loads)
        known = self._known(batch, loads)
        if not store_cv:
            new = finish(absent_rows(batch.drop("cv"), known, order=order)).drop("cv").withColumns(added)
            self._put(self.people.stage(_placed(new)), before)
            if old_files:
                self.files.replace(self.read_files().where(F.lit(False)), old_files)
        else:
            # Writing the batch once keeps the files out of the sort and shuffle that find the new rows.
            staged = f"{self.root}/staged-{uuid.uuid4().hex}"
            named = finish(batch).withColumns(added)
            named.write.parquet(staged)
            named = self.spark.read.schema(named.schema).parquet(staged)
            self._put(self.people.stage(_placed(absent_rows(named.drop("cv"), known, order=order))), before)
            inserted = broadcast_if_small(self.read().where(F.col("segment").isin(loads)).select("id"))
            files = named.where(F.col("cv").isNotNull()).join(inserted, "id", "left_semi")
            self.files.replace(_prefixed(files), old_files)
            remove(self.spark, staged)
        ended = few_rows(self.spark, [(name, datetime.now()) for name in loads], LOADS)
        ended.coalesce(1).write.mode("append").parquet(self._place("loads"))

    def _known(self, batch: DataFrame, loads: list[str]) -> DataFrame:
        """Keys among the batch's that a row of another load than these holds."""
        if not self.keys.exists():
            self.keys.rebuild(self.read())
        if self.keys.empty():  # the first load need not look for its keys
            return self.read().where(F.lit(False)).select(*NATURAL_KEY)
        keys = f"{self.root}/staged-{uuid.uuid4().hex}"
        batch.where(has_key(batch)).select(*NATURAL_KEY).distinct().write.parquet(keys)
        wanted = self.spark.read.schema("job string, name string").parquet(keys)
        others = ~F.col("load_id").isin(loads)
        hits = self.keys.matching(wanted).where(others).select("id", "applied_month").distinct()
        few = hits.limit(LISTED_IDS + 1).collect()
        if len(few) <= LISTED_IDS:
            months, ids = {row["applied_month"] for row in few}, [row["id"] for row in few]
            held = self.read().where(F.col("applied_month").isin(sorted(months)) & F.col("id").isin(ids))
        else:
            place = f"{self.root}/staged-{uuid.uuid4().hex}"
            hits.write.parquet(place)
            hits = self.spark.read.schema("id string, applied_month string").parquet(place)
            months = {row[0] for row in hits.select("applied_month").distinct().collect()}
            held = self.read().where(F.col("applied_month").isin(sorted(months))).join(broadcast_if_small(hits), ["id", "applied_month"], "left_semi")
        remove(self.spark, keys)
        return held.where(others).select(*NATURAL_KEY).distinct()

    def _put(self, folder: str, labels: list[str], gaining: Iterable[str] = ()) -> None:
        """Index the keys of a staged folder, switch to it and renew the counts of what changed."""
        rows = self.people.staged(folder)
        place = f"{self.root}/staged-{uuid.uuid4().hex}"
        self._tally(rows).coalesce(1).write.parquet(place)
        counts = self.spark.read.schema(COUNTS).parquet(place)  # tells spellings and partitions, too, without the rows
        sizes = {row["label"]: row["n"] for row in counts.groupBy(self.people.label().alias("label")).agg(F.sum("n").alias("n")).collect()}
        self.keys.add(rows, sum(sizes.values()))
        self._spell(counts)
        self._renew(self.people.switch(folder, labels, gaining, sizes), counts)
        remove(self.spark, place)

    def _tally(self, rows: DataFrame) -> DataFrame:
        counts = rows.groupBy("job", F.to_date("applied_at").alias("day"), *CANDIDATE_PARTITIONS).agg(F.count("*").alias("n"))
        return counts.select("job", "day", "n", *CANDIDATE_PARTITIONS)

    def _count(self, labels: list[str], rows: DataFrame) -> None:
        """Replace the counts of some partitions by those of their rows."""
        self._renew(labels, self._tally(rows))

    def _renew(self, labels: list[str], counts: DataFrame) -> None:
        """Replace the counts of some partitions: all in one append, of a newer version."""
        # A partition without rows still replaces its counts.
        marks = [(None, None, 0, *label.split("/")) for label in labels]
        both = counts.union(few_rows(self.spark, marks, COUNTS))
        self._append_counts(both)
        files = [name for name in listed(self.spark, self._place("counts")) if name.endswith(".parquet")]
        if len(files) > COUNT_FILES:
            # The new file is newer for every partition, emptied ones included, so a break while old files go does no harm.
            self._append_counts(self._counted())
            for name in files:
                remove(self.spark, f"{self._place('counts')}/{name}")

    def _append_counts(self, rows: DataFrame) -> None:
        rows.withColumn("version", F.lit(time.time_ns())).coalesce(1).write.mode("append").parquet(self._place("counts"))

    def _counted(self) -> DataFrame:
        """The newest counts of every partition; one row of 0 for a partition that has none left."""
        place = self._place("counts")
        if not listed(self.spark, place):
            return few_rows(self.spark, [], COUNTS)
        rows = self.spark.read.schema(f"{COUNTS}, version long").parquet(place)
        newest = F.max("version").over(W.partitionBy(*CANDIDATE_PARTITIONS))
        return rows.withColumn("newest", newest).where("version = newest").drop("version", "newest")

    def counts(self) -> DataFrame:
        """(job, day, n): applications by job and day, ready to be added up. Candidates are not read."""
        return self._counted().where("n > 0").select("job", "day", "n")

    def _spell(self, rows: DataFrame) -> None:
        """Note the spellings of jobs that are new. Like keys, they are written before the rows that have them."""
        new = rows.select("job").where(F.col("job").isNotNull()).distinct().join(self.spellings(), "job", "left_anti")
        found = [(row["job"],) for row in new.limit(MANY_SPELLINGS).collect()]
        if len(found) == MANY_SPELLINGS:
            new.write.mode("append").parquet(self._place("spellings"))
        elif found:
            few_rows(self.spark, found, "job string").coalesce(1).write.mode("append").parquet(self._place("spellings"))

    def spellings(self) -> DataFrame:
        """Every spelling of a job that a stored row has or had, perhaps more than once."""
        place = self._place("spellings")
        found = any(name.endswith(".parquet") for name in listed(self.spark, place))
        return self.spark.read.schema("job string").parquet(place) if found else few_rows(self.spark, [], "job string")

    def rows_for(self, spec: BrowseSpec) -> DataFrame:
        """The table's rows for a listing, narrowed so that files without the spec's job are skipped.

        A collated comparison cannot be pushed to a scan. The spellings that are equal to the
        job by it can: they are few, and are found in a list of all spellings. The listing's own
        predicate decides all the same.
        """
        if spec.job == ALL:
            return self.read()
        equal = self.spellings().where(loosely_equal("job", spec.job)).distinct().limit(MANY_SPELLINGS).collect()
        if len(equal) == MANY_SPELLINGS:
            return self.read()
        return self.read().where(F.col("job").isin([row["job"] for row in equal]))

    def _place(self, what: str) -> str:
        return f"{self.root}/{self.people.name}-{what}"

    def _loads(self, which: str) -> DataFrame:
        place = self._place(which)
        found = any(name.endswith(".parquet") for name in listed(self.spark, place))
        return self.spark.read.schema(LOADS).parquet(place) if found else few_rows(self.spark, [], LOADS)

    def delete(self, ids: DataFrame) -> None:
        """Remove candidates and their files, rewriting only the partitions they lie in."""
        doomed = self.read().join(broadcast_if_small(ids.select("id")), "id", "left_semi")
        hit = self.people.labels(doomed)
        if hit:
            self._delete_files(doomed, ids)
            folder = self.people.stage(delete_by_id(self.people.content(hit), ids))
            self._count(self.people.switch(folder, hit), self.people.staged(folder))

    def _delete_files(self, doomed: DataFrame, ids: DataFrame) -> None:
        """Remove the files of removed rows; nothing is read or written where none are stored."""
        known = self.files.known()
        files = [label for label in self.files.labels(_prefixed(doomed)) if label in known] if known else []
        if files:
            self.files.replace(delete_by_id(self.files.content(files), ids), files)

    def update(self, edits: DataFrame, order: str | None = None) -> None:
        """Overwrite the supplied columns of the candidates that really change."""
        edits = edits.drop(*CANDIDATE_PARTITIONS, "load_id")
        if "status" in edits.columns:  # a page shows no label for an unknown code; such an edit keeps the code
            stored = self.read().select("id", F.col("status").alias("_stored"))
            edits = edits.join(stored, "id", "left").withColumn("status", F.coalesce("status", "_stored")).drop("_stored")
        # Written once: all that follows sees the same edits, also if their source changes or has no fixed order.
        staged = f"{self.root}/staged-{uuid.uuid4().hex}"
        reduced = last_edits(edits, order=order)
        reduced.write.parquet(staged)
        edits = self.spark.read.schema(reduced.schema).parquet(staged)
        changed = changed_rows(self.read(), edits)  # these still carry their old partition
        gaining = self.people.labels(_placed(changed))
        hit = sorted({*self.people.labels(changed), *gaining})
        if hit:
            # An earlier update that broke off may have left a moved row in both its partitions.
            ids = broadcast_if_small(changed.select("id").distinct())
            content = self.people.content(hit)
            new = update_by_id(content.join(ids, "id", "left_semi"), edits).dropDuplicates(["id"])
            folder = self.people.stage(_placed(content.join(ids, "id", "left_anti").unionByName(new)))
            if {*edits.columns} & {*NATURAL_KEY, "applied_at"}:  # only these make new entries
                moved = self.people.staged(folder).join(edits.select("id"), "id", "left_semi")
                self.keys.add(moved)
                self._spell(moved)
            self._count(self.people.switch(folder, hit, gaining), self.people.staged(folder))
        remove(self.spark, staged)

    def save(self, shown: DataFrame, edited: DataFrame) -> DataFrame:
        """Save an edited page (see `operators.saving`). Rows that conflict or are gone come back, nothing of them is saved."""
        place = f"{self.root}/staged-{uuid.uuid4().hex}"  # stays for the caller until the next vacuum
        outcome = three_way(self.read().drop(*CANDIDATE_PARTITIONS, "load_id"), shown, edited)
        outcome.write.parquet(place)
        outcome = self.spark.read.schema(outcome.schema).parquet(place)
        self.update(to_store(outcome))
        return outcome.where(F.col("state").isin(CONFLICT, GONE))

    def retire(self, before: datetime) -> None:
        """Remove all applications from before a moment, with their files, keys and counts. Undated ones stay.

        Months that end before it are dropped whole, without reading their files; only the
        moment's own month is rewritten. Doing it again changes nothing.
        """
        month, moment = before.strftime("%Y-%m"), F.lit(str(before)).cast("timestamp")
        old = self.read().where((F.col("applied_month") <= month) & (F.col("applied_at") < moment))
        place = f"{self.root}/staged-{uuid.uuid4().hex}"
        old = old.select("id", *NATURAL_KEY, "load_id", *CANDIDATE_PARTITIONS)
        old.write.parquet(place)
        old = self.spark.read.schema(old.schema).parquet(place)
        hit = self.people.labels(old)
        if hit:
            self._delete_files(old, old)
            whole = [label for label in hit if label.split("/")[0] < month]
            if whole:
                self.people.forget(whole)
                self._count(whole, self.read().where(F.lit(False)))
            split = [label for label in hit if label not in {*whole}]
            if split:
                folder = self.people.stage(self.people.content(split).where(~F.coalesce(F.col("applied_at") < moment, F.lit(False))))
                self._count(self.people.switch(folder, split), self.people.staged(folder))
            self.keys.discard(old)
        remove(self.spark, place)

    def newest_day(self, apart_from: str) -> date | None:
        """The last day with an application of another load. Candidates are not read."""
        return self._counted().where((F.col("n") > 0) & (F.col("segment") != apart_from)).agg(F.max("day")).first()[0]

    def compact(self, before: datetime, rows_per_segment: int = 5_000_000) -> None:
        """Pack the small partitions of loads that finished before a moment, month by month.

        The partitions of a month are packed, smallest first, into segments of up to
        `rows_per_segment` rows; larger ones stay as they are. Rows keep their `load_id`.
        The loads are closed by it: repeating one is refused from then on. So leave out
        what may still be repeated, such as a stream's last micro-batch. Like every
        change it can be repeated if it breaks off; then no row stays twice.
        """
        closed = self._loads("loads").groupBy("load_id").agg(F.max("finished_at").alias("finished_at")).where(F.col("finished_at") < before)
        sizes = self.read().groupBy(*CANDIDATE_PARTITIONS).agg(F.count("*").alias("n"))
        old = sizes.join(closed.select(F.col("load_id").alias("segment")), "segment", "left_semi")
        packed = sizes.where(F.col("segment").startswith(MERGED))
        months = defaultdict(list)
        for row in old.unionByName(packed).where(F.col("n") < rows_per_segment).collect():  # one row per partition
            months[row["applied_month"]].append((row["n"], row["segment"]))
        moves = {}
        for month, parts in months.items():
            bins: list[list[str]] = []
            room = 0
            for n, segment in sorted(parts):
                if n > room:
                    bins.append([])
                    room = rows_per_segment
                bins[-1].append(segment)
                room -= n
            for members in bins:
                if len(members) > 1:
                    name = MERGED + hashlib.sha256("/".join(sorted(members)).encode()).hexdigest()[:16]
                    moves |= {f"{month}/{segment}": name for segment in members}
        if not moves:
            return
        labels = sorted(moves)
        content = self.people.content(labels)
        ending = content.select("load_id").distinct().withColumn("finished_at", F.lit(before))
        ending.coalesce(1).write.mode("append").parquet(self._place("closed"))
        names = few_rows(self.spark, [(*label.split("/"), name) for label, name in moves.items()], "applied_month string, segment string, to string")
        # A call that broke off may have left rows both in their old segment and in a merged one.
        merged = content.join(F.broadcast(names), list(CANDIDATE_PARTITIONS)).withColumn("segment", F.col("to")).drop("to").dropDuplicates(["id"])
        folder = self.people.stage(merged)
        self._count(self.people.switch(folder, []), self.people.staged(folder))
        self.people.forget(labels)
        self._count(labels, self.read().where(F.lit(False)))

    def vacuum(self) -> None:
        """Remove folders below the root that no partition points to: replaced, emptied and staged ones.

        Deleted people and files are gone from storage afterwards, and their keys from the
        index. Run it while nothing reads or writes the tables.
        """
        used = set()
        for held in (self.people, self.files):
            used |= {file.split("/")[-1 - len(held.partitions) - 1] for file in held.read().inputFiles()}
        if self.keys.exists():
            self.keys.rebuild(self.read())
        for folder in listed(self.spark, self.root):
            ours = any(re.fullmatch(rf"{re.escape(name)}-[0-9a-f]{{32}}", folder) for name in (self.people.name, self.files.name, "staged"))
            if ours and folder not in used:
                remove(self.spark, f"{self.root}/{folder}")

    def drop(self) -> None:
        """Forget both tables; their folders below the root stay."""
        for held in (self.people, self.files):
            self.spark.sql(f"DROP TABLE IF EXISTS {held.name}")

    def lookup(self, candidate_id: str) -> DataFrame:
        """File, name and job of one candidate: one row or none."""
        files = self.read_files().where(F.col("id_prefix") == candidate_id[:1])
        return lookup(self.read(), files, candidate_id)


def _prefixed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id_prefix", F.substring("id", 1, 1))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with the month they belong to."""
    return rows.withColumn("applied_month", F.coalesce(calendar_part("applied_at", "month"), F.lit(UNKNOWN_MONTH)))
