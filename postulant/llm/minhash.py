"""Near-duplicate texts by MinHash with sequential Bayesian verification.

A text's set holds its distinct runs of four words (`[^\\x20\\x09-\\x0D]+`, A-Z in
lower case); with fewer words it holds their whole sequence, without words nothing.
Texts are linked if their sets share 80 % of their union. Sets are kept as 64-bit
hashes of the shingles.

1. One pass makes signatures of `BANDS` x `ROWS` minimum hashes. Texts with equal
   sets form a class, and one row of each class goes on.
2. Rows that share a band are candidates. Every bucket first links its members to
   its smallest one, so that a large group of copies costs as many pairs as it has
   members.
3. A candidate's signatures are compared batch by batch. After each batch the
   posterior of the similarity given the matches so far (uniform prior) decides:
   if it reaches the threshold with a probability below `MISS`, the pair is pruned.
4. Survivors are verified on the full sets.
5. Buckets that then still hold several components compare the members of different
   components in blocks of at most 2 x `BLOCK` rows: pruned as before and verified on
   the full sets within the task. A link joins its components there at once, so a
   task emits at most one link for each component it joins.

So no link between different components is missed but by banding (below 1e-4 at a
similarity of exactly 0.8) or by pruning (`MISS`); pairs within one component need
no further test, because components are all that is returned.

Defined results: null, empty and blank texts have an empty set and stay alone; rows
with equal text and equal id are the same document and both stay; a null id never
leads a component unless all its ids are null; ties go to the smallest id; an empty
table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.llm.common import components, small, table, written
from postulant.llm.kernel import LOWER, SPACES, U, mix, prefix, slices, spans, words

SHINGLE = 4
PERCENT = 80
BANDS, ROWS = 32, 6
HASHES = BANDS * ROWS
BATCH = 32
MISS = 1e-5
BLOCK = 512
ROW = "_minhash_row"


def sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted shingle hashes of all rows, offsets) per run of rows."""
    for first, end, data, offsets in slices(texts):
        small_letters = LOWER[data]
        starts, ends, rows = words(~SPACES[data], offsets)
        word = spans(prefix(small_letters), starts, ends)
        count = np.bincount(rows, minlength=end - first)
        runs = np.zeros(0, U)
        if len(word) >= SHINGLE:
            runs = word[: len(word) - SHINGLE + 1].copy()
            for i in range(1, SHINGLE):
                runs = runs * U(0x2545F4914F6CDD1D) + word[i : len(word) - SHINGLE + 1 + i]
            runs = mix(runs)
        at = np.concatenate([[0], np.cumsum(count)])
        found = []
        for row in range(end - first):
            a, n = int(at[row]), int(count[row])
            if n >= SHINGLE:
                found.append(np.unique(runs[a : a + n - SHINGLE + 1]))
            elif n:
                whole = U(n)
                with np.errstate(over="ignore"):
                    for w in word[a : a + n]:
                        whole = whole * U(0x9FB21C651E98DF25) + w
                found.append(mix(np.array([whole])))
            else:
                found.append(np.zeros(0, U))
        yield first, end, np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


def _sums(flat: np.ndarray, offsets: np.ndarray, salt: int) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(flat ^ U(salt)), dtype=U)])
    return (total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (seeds[:HASHES] >> U(32)).astype(np.uint32) | np.uint32(1), (seeds[HASHES:] >> U(32)).astype(np.uint32)


def signatures(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of `HASHES` 16-bit values per set; sets must not be empty."""
    low = (flat >> U(32)).astype(np.uint32)
    factors, shifts = _functions()
    out = np.empty((HASHES, len(offsets) - 1), np.uint32)
    for i in range(HASHES):
        out[i] = np.minimum.reduceat(low * factors[i] + shifts[i], offsets[:-1])
    return np.ascontiguousarray(((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).T)


def signed(docs: DataFrame) -> DataFrame:
    """row, doc_id, n, d1, d2 (digests of the set) and the signature of every row of `numbered` documents; no signature for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, flat, offsets in sets(batch.column(2)):
                n = np.diff(offsets)
                filled = np.flatnonzero(n)
                values: list[bytes | None] = [None] * (end - first)
                if len(filled):
                    for row, value in zip(filled, signatures(flat, np.append(offsets[filled], offsets[-1])), strict=True):
                        values[row] = value.tobytes()
                ids = [batch.column(i).slice(first, end - first) for i in (0, 1)]
                digests = [pa.array(_sums(flat, offsets, salt)) for salt in (0x51ED, 0xC0FFEE)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(n), *digests, pa.array(values, pa.binary())], ["row", "doc_id", "n", "d1", "d2", "sig"])

    rows = docs.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, n long, d1 long, d2 long, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, HASHES)


def bands(nodes: DataFrame) -> DataFrame:
    """(key, band, node) of every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _matrix(batch.column(1)).astype(U).reshape(-1, BANDS, ROWS)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), sig.shape[:2])
            for i in range(ROWS):
                key = mix(key * U(0x2545F4914F6CDD1D) + sig[:, :, i])
            node = np.repeat(batch.column(0).to_numpy(), BANDS)
            band = np.tile(np.arange(BANDS, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(band), pa.array(node)], ["key", "band", "node"])

    return nodes.select("node", "sig").mapInArrow(run, "key long, band int, node long")


@lru_cache(maxsize=1)
def least_matches() -> list[tuple[int, int]]:
    """(hashes seen, matches needed) after each batch.

    With a uniform prior, m matches of n give the posterior Beta(m + 1, n - m + 1),
    whose mass above t is the chance of at most m hits in n + 1 trials of t.
    """
    t, out = PERCENT / 100, []
    for n in range(BATCH, HASHES + 1, BATCH):
        mass, m = 0.0, -1
        while mass < MISS:
            m += 1
            mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append((n, m))
    return out


def promising(left: np.ndarray, right: np.ndarray, first_band: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs that no batch prunes, and their matches. With `first_band`, only pairs that share no earlier band."""
    alive = np.arange(len(left))
    matches = np.zeros(len(left), np.int32)
    seen = 0
    for n, least in least_matches():
        if not len(alive):
            break
        matches[alive] += (left[alive, seen:n] == right[alive, seen:n]).sum(1, dtype=np.int32)
        alive = alive[matches[alive] >= least]
        seen = n
    if first_band is not None and len(alive):
        same = (left[alive] == right[alive]).reshape(-1, BANDS, ROWS).all(2)
        alive = alive[same.argmax(1) == first_band[alive]]
    return alive, matches[alive]


def _similar_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)


def prune(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sequential comparison of their signatures leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                kept, _ = promising(_matrix(part.column(2)), _matrix(part.column(3)))
                yield part.take(pa.array(kept)).select(["a", "b"])

    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    close = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb"))
    return close.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def full_sets(asked: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles) of the nodes in `asked`, made anew from their texts."""
    needed = written(nodes.select("node", "doc_id", "n", "d1", "d2").join(asked, "node", "left_semi"), "asked")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, flat, offsets in sets(batch.column(0)):
                values = [flat[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                digests = [pa.array(_sums(flat, offsets, salt)) for salt in (0x51ED, 0xC0FFEE)]
                yield pa.RecordBatch.from_arrays([pa.array(np.diff(offsets)), *digests, pa.array(values, pa.binary())], ["n", "d1", "d2", "shingles"])

    ids = small(needed.select(F.col("doc_id").alias("_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), "text").join(ids, F.col("_doc").eqNullSafe(F.col("_id")), "left_semi").select("text")
    made = texts.mapInArrow(make, "n long, d1 long, d2 long, shingles binary")
    return written(made.join(needed, ["n", "d1", "d2"]).select("node", "shingles").dropDuplicates(["node"]), "sets")


def verify(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that are linked by their full sets."""
    known = full_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), nodes, docs)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                left, right = (np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in (2, 3))
                both = len(np.intersect1d(left, right, assume_unique=True))
                if 100 * both >= PERCENT * (len(left) + len(right) - both):
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64())).select(["a", "b"])

    left = known.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = known.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long")


def _across(column: dict[str, np.ndarray], sig: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Links that join different labels among the rows of one pair of blocks of a bucket.

    Each row meets the later rows of other labels, without its bucket's leader (met before)
    and without rows that share an earlier band with it (met there).
    """
    label, links = column["label"].copy(), []
    _, codes = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(flat) + 1, bool)
    whole = column["b1"] == column["b2"]
    for i in range(len(label) - 1):
        if column["leads"][i]:
            continue
        j = np.arange(i + 1, len(label))
        j = j[(label[j] != label[i]) & ~column["leads"][j] & (whole[j] | (column["block"][j] != column["block"][i]))]
        j = j[_similar_size(column["n"][i], column["n"][j])]
        if not len(j):
            continue
        kept, _ = promising(np.broadcast_to(sig[i], (len(j), HASHES)), sig[j], column["band"][j])
        j = j[kept]
        if not len(j):
            continue
        mine = codes[offsets[i] : offsets[i + 1]]
        mark[mine] = True
        both = np.array([np.count_nonzero(mark[codes[offsets[x] : offsets[x + 1]]]) for x in j])
        mark[mine] = False
        for x in j[100 * both >= PERCENT * (column["n"][i] + column["n"][j] - both)]:
            if label[x] != label[i]:
                links.append((int(column["node"][i]), int(column["node"][x])))
                label[label == label[x]] = label[i]
    return links


def joining(members: DataFrame, labels: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) that join different components within buckets that hold several."""
    labelled = members.where("size > 2").join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    split = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    of_open = written(labelled.join(small(written(split, "open")), "key", "left_semi"), "open-members")
    known = full_sets(of_open.select("node").distinct(), nodes, docs)
    wide = of_open.join(nodes.select("node", "n", "sig").join(known, "node"), "node")
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    placed = wide.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    leads = F.col("node") == F.col("leader")
    narrow = ("block", "band", "node", "label", leads.alias("leads"), "n", "sig", "shingles")
    keyed = placed.select("key", F.least("block", "other").alias("b1"), F.greatest("block", "other").alias("b2"), *narrow)

    def within(table: pa.Table) -> Iterator[pa.RecordBatch]:
        column = {c: table.column(c).to_numpy() for c in ("b1", "b2", "block", "band", "node", "label", "leads", "n")}
        key, sig = table.column("key").to_numpy(), _matrix(table.column("sig"))
        shingles = table.column("shingles").to_pylist()
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (column["b1"][1:] != column["b1"][:-1]) | (column["b2"][1:] != column["b2"][:-1])]))
        links = []
        for a, b in zip(new, [*new[1:], len(key)], strict=True):
            flat = np.frombuffer(b"".join(shingles[a:b]), U)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in shingles[a:b]])])
            links += _across({c: v[a:b] for c, v in column.items()}, sig[a:b], flat, offsets)
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([carried, rows]).combine_chunks() if carried is not None else rows
            if not rows.num_rows:
                continue
            last = [rows.column(c)[-1].as_py() for c in ("key", "b1", "b2")]
            same = np.ones(rows.num_rows, bool)
            for c, v in zip(("key", "b1", "b2"), last, strict=True):
                same &= rows.column(c).to_numpy() == v
            start = int(np.argmax(same))
            if start:
                yield from within(rows.slice(0, start))
            carried = rows.slice(start)
        if carried is not None and carried.num_rows:
            yield from within(carried)

    dealt = keyed.repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2")
    return dealt.mapInArrow(run, "a long, b long")


def numbered(docs: DataFrame) -> DataFrame:
    if ROW in docs.columns:
        raise ValueError(f"column with the name of the row key: {ROW}")
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def grouped(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_shingles, component, component_id) of every row of `numbered` documents; component is null for empty sets."""
    known = written(signed(docs), "signatures")
    same = ["n", "d1", "d2"]
    classes = written(known.where("n > 0").groupBy(*same).agg(F.min("row").alias("node"), F.min("doc_id").alias("first")), "classes")
    nodes = written(known.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "nodes")

    banded = bands(nodes)
    buckets = written(banded.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1"), "buckets")
    members = written(banded.join(buckets, "key"), "members")
    star = written(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), "star")
    links = written(verify(written(prune(star, nodes), "promising"), nodes, docs), "linked")
    labels = components(links)

    labels = components(links.union(written(joining(members, labels, nodes, docs), "joining")))

    of_class = classes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    leaders = of_class.groupBy("component").agg(F.min("first").alias("component_id"))
    found = written(of_class.join(leaders, "component").select(*same, "component", "component_id"), "components")
    joined = known.select("row", "doc_id", *same).join(found, same, "left")
    return joined.select("row", "doc_id", F.col("n").alias("n_shingles"), "component", F.coalesce("component_id", "doc_id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    leads = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return grouped(numbered(docs)).select("doc_id", "n_shingles", "component_id", leads.alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """One row of each component, with the columns it came with: of the smallest doc_id, nulls last, then the first row.

    Rows are told apart by a key of their own, so ids may be null, repeated or stand for several texts.
    Rows with empty sets are alone and stay.
    """
    fixed = written(numbered(docs), "numbered")
    rows = written(grouped(fixed).where("component is not null").select("row", "doc_id", "component"), "rows")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    leads = written(rows.groupBy("component").agg(F.min(order)["row"].alias("lead")), "leads")
    gone = written(rows.join(small(leads), "component").where("row <> lead").select(F.col("row").alias(ROW)), "gone")
    return fixed.join(small(gone), ROW, "left_anti").select(*docs.columns)


def minhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


QUERIES = {"op9_minhash": minhash}
SQL: dict[str, str] = {}
