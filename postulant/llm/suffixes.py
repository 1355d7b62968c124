"""Removal of byte strings that an earlier document holds, by merged Burrows-Wheeler transforms.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document
with a smaller doc_id.

1. Texts are cut into snippets: consecutive strings of `LENGTH` bytes whose smallest
   `GRAM`-byte hash is the same occurrence form one. Equal strings have the same
   smallest gram, so all occurrences of a string meet in the partition of its gram,
   and no suffix leaves it.
2. Equal snippets are counted once per chunk of documents and once per gram
   partition, by hash, with their smallest document. Chunks ship hashes only, so a
   passage that a third of all documents share costs one entry per chunk.
3. A string has at least `SIDE` bytes on one side of its gram. So only snippets that share
   their gram and as much beside it, on the same side, with a different snippet can share a string; hashes of
   both sides travel with the entries. Only those need their texts, from every chunk that
   has the smallest document of one. In the partition they form shards; every shard sorts its suffixes once into a
   Burrows-Wheeler transform. The transforms are merged by refining their interleave:
   each round sorts the interleave, stably, by the symbols before it, which orders
   all suffixes by one more symbol without comparing any. The round in which two
   neighbours part is their common prefix; runs that have not parted after `LENGTH`
   rounds are the repeated intervals.
4. Each chunk marks what the partitions report and removes it.

Defined results: null and empty texts keep nothing and lose nothing; texts below
`LENGTH` bytes stay; rows with the same doc_id do not remove each other; a null
doc_id counts as larger than any other; equal texts of different ids lose all but
the first; an empty table gives an empty result; only doc_id and text are read. A
chunk (`ROWS` documents) is one task's work, so memory follows the texts of a chunk.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postulant.llm.common import parts, table, written
from postulant.llm.kernel import U, mix, powers, prefix, slices, spans

LENGTH = 50
GRAM = 20
WINDOWS = LENGTH - GRAM + 1
SIDE = (LENGTH - GRAM) // 2
SIDE_BITS = 24
ROWS_BITS = 11
SHARDS = 4
MERGED = 1 << 17  # bytes of snippets merged at once
LARGEST = np.iinfo(np.int64).max
BLOBS = "part long, chunk long, blob binary"
ENTRY = np.dtype([("gram", "u8"), ("snippet", "u8"), ("doc", "i8"), ("left", "u4"), ("right", "u4")])
SMALL, SHIP = 1, 2  # flags: a smaller document has the snippet; its text is wanted


class Snippets:
    """The snippets of a run of texts: gram, hash, row, first window and end of windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        none = np.zeros(0, np.int64)
        self.gram = self.hash = np.zeros(0, U)
        self.row, self.start, self.end = none, none, none
        if len(data) < LENGTH:
            return
        sums = prefix(data)
        _, down = powers(len(data) + 1)
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
        least, place, width = grams, np.arange(len(grams), dtype=np.int32), 1
        while width < WINDOWS:
            by = min(width, WINDOWS - width)
            right = least[by:] < least[:-by]
            least, place = np.where(right, least[by:], least[:-by]), np.where(right, place[by:], place[:-by])
            width += by
        ends = np.repeat(offsets[1:], np.diff(offsets))[: len(place)]
        valid = ends - np.arange(len(place)) >= LENGTH
        fresh = valid.copy()
        fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (place[1:] != place[:-1])
        self.start, self.end = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        self.gram = grams[place[self.start]] >> U(24)
        self.hash = spans(sums, self.start, self.end + LENGTH - 1) >> U(16)
        self.row = np.searchsorted(offsets, self.start, "right") - 1
        self._sums, self._at = sums, place[self.start].astype(np.int64)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the gram with the bytes before it and behind it; 0 where the snippet ends before."""
        if not len(self.start):
            return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        at = self._at
        left = self._side(at - SIDE, at + GRAM, at - self.start >= SIDE)
        return left, self._side(at, at + GRAM + SIDE, self.end + LENGTH - 1 - at >= GRAM + SIDE)

    def _side(self, start: np.ndarray, end: np.ndarray, inside: np.ndarray) -> np.ndarray:
        out = np.zeros(len(start), np.uint32)
        out[inside] = np.maximum(spans(self._sums, start[inside], end[inside]) >> U(64 - SIDE_BITS), U(1))
        return out

    @property
    def key(self) -> np.ndarray:
        return (self.hash << U(16)) ^ self.gram


PACKED = (("gram", 5), ("snippet", 6), ("left", 3), ("right", 3))
PACKED_BYTES = sum(size for _, size in PACKED)


def _packed(entries: np.ndarray) -> bytes:
    """5 bytes of gram, 6 of the snippet's hash, 3 for each side, and the document as a distance from the smallest."""
    base = int(entries["doc"].min())
    far = entries["doc"] - base
    wide = 8 if int(far.max()) >= 1 << 32 else 4
    fields = [np.ascontiguousarray(entries[name]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size] for name, size in PACKED]
    return np.int64(base).tobytes() + bytes([wide]) + np.hstack([*fields, far.astype(f"<u{wide}").view(np.uint8).reshape(-1, wide)]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    base, wide = int(np.frombuffer(blob, np.int64, 1)[0]), blob[8]
    rows = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, PACKED_BYTES + wide)
    out = np.zeros(len(rows), ENTRY)
    at = 0
    for name, size in PACKED:
        full = np.zeros((len(rows), 8), np.uint8)
        full[:, :size] = rows[:, at : at + size]
        out[name] = full.view("<u8").ravel()
        at += size
    out["doc"] = np.ascontiguousarray(rows[:, PACKED_BYTES:]).view(f"<u{wide}").ravel().astype(np.int64) + base
    return out


def _rows(found: list[tuple[int, int, bytes]]) -> pa.Table:
    columns = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
    return pa.table(columns, ["part", "chunk", "blob"])


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(LARGEST).to_numpy()


def _keys(entries: np.ndarray) -> np.ndarray:
    return (entries["snippet"] << U(16)) ^ entries["gram"]


def _classes(texts: pa.Table, sides: bool = False) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray, Snippets]]]:
    """The distinct snippets of a chunk with their smallest document, and per run of texts: ids, bytes, offsets, snippets."""
    ids, runs = _ids(texts.column("doc_id")), []
    for first, end, data, offsets in slices(texts.column("text")):
        runs.append((ids[first:end], data, offsets, Snippets(data, offsets)))
    every = np.zeros(sum(len(r[3].start) for r in runs), ENTRY)
    for name, of in (("gram", lambda r: r[3].gram), ("snippet", lambda r: r[3].hash), ("doc", lambda r: r[0][r[3].row])):
        every[name] = np.concatenate([of(r) for r in runs]) if runs else []
    if sides and runs:
        every["left"], every["right"] = (np.concatenate(x) for x in zip(*[r[3].sides() for r in runs], strict=True))
    keys = _keys(every)
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), np.diff(keys[order]) != 0]))
    distinct = every[order[new]]
    if len(new):
        distinct["doc"] = np.minimum.reduceat(every["doc"][order], new)
    return distinct, runs


def count_snippets(n_parts: int):
    def run(key: tuple, texts: pa.Table) -> pa.Table:
        entries, _ = _classes(texts, sides=True)
        part = (entries["gram"] % U(n_parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(n_parts + 1))
        chunk = key[0].as_py()
        return _rows([(p, chunk, _packed(entries[order[cuts[p] : cuts[p + 1]]])) for p in range(n_parts) if cuts[p] < cuts[p + 1]])

    return run


def _shared(distinct: np.ndarray, side: str) -> np.ndarray:
    """Which of different snippets have gram and side in common with another one."""
    order = np.lexsort((distinct[side], distinct["gram"]))
    gram, beside = distinct["gram"][order], distinct[side][order]
    same = (gram[1:] == gram[:-1]) & (beside[1:] == beside[:-1]) & (beside[1:] != 0)
    out = np.zeros(len(distinct), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def judge_snippets(key: tuple, blobs: pa.Table) -> pa.Table:
    """Per chunk: (key, flags) of its snippets that a smaller document has too, or whose text is wanted."""
    chunks = blobs.column("chunk").to_numpy()
    lists = [_unpacked(b.as_py()) for b in blobs.column("blob")]
    entries, source = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    order = np.lexsort((source, entries["doc"], entries["snippet"], entries["gram"]))
    entries, source = entries[order], source[order]
    new_gram = np.ones(len(entries), bool)
    new_gram[1:] = entries["gram"][1:] != entries["gram"][:-1]
    first = new_gram.copy()
    first[1:] |= entries["snippet"][1:] != entries["snippet"][:-1]
    distinct, which = entries[first], np.cumsum(first) - 1
    several = (_shared(distinct, "left") | _shared(distinct, "right"))[which]
    smallest = distinct["doc"][which]
    flags = np.where(entries["doc"] > smallest, SMALL, 0) | np.where((entries["doc"] == smallest) & several, SHIP, 0)  # rows of one id may lie in several chunks
    told = np.flatnonzero(flags)
    found = np.zeros(len(told), [("key", "u8"), ("flags", "u1")])
    found["key"], found["flags"] = _keys(entries[told]), flags[told]
    order = np.argsort(source[told], kind="stable")
    cuts = np.searchsorted(source[told][order], np.arange(len(lists) + 1))
    return _rows([(0, int(chunks[i]), found[order[a:b]].tobytes()) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b])


TOLD = np.dtype([("key", "u8"), ("flags", "u1")])
MASK = np.dtype([("key", "u8"), ("mask", "u4")])


def _lookup(blobs: list[bytes], kind: np.dtype) -> np.ndarray:
    return np.sort(np.frombuffer(b"".join(blobs), kind), order="key")


def _find(known: np.ndarray, keys: np.ndarray, field: str) -> np.ndarray:
    out = np.zeros(len(keys), known[field].dtype)
    if len(known):
        at = np.minimum(np.searchsorted(known["key"], keys), len(known) - 1)
        hit = known["key"][at] == keys
        out[hit] = known[field][at[hit]]
    return out


def ship_snippets(n_parts: int):
    """The texts of the wanted snippets: per partition of grams, entries, lengths and bytes."""

    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        if not texts.num_rows or not told.num_rows:
            return _rows([])
        known = _lookup(told.column("blob").to_pylist(), TOLD)
        entries, runs = _classes(texts)
        keys, order = _keys(entries), np.argsort(_keys(entries), kind="stable")
        sorted_keys, done = keys[order], np.zeros(len(entries), bool)
        found: dict[int, list] = {}
        for _, data, _, s in runs:
            wanted = np.flatnonzero(_find(known, s.key, "flags") & SHIP)
            at = order[np.searchsorted(sorted_keys, s.key[wanted])] if len(wanted) else wanted
            raw = data.tobytes()
            for i, entry in zip(wanted, at, strict=True):
                if not done[entry]:
                    done[entry] = True
                    found.setdefault(int(entries["gram"][entry]) % n_parts, []).append((entries[entry], raw[s.start[i] : s.end[i] + LENGTH - 1]))
        chunk = key[0].as_py()
        rows = []
        for part, pieces in found.items():
            head = np.array([p[0] for p in pieces], ENTRY).tobytes()
            sizes = np.array([len(p[1]) for p in pieces], np.int32).tobytes()
            rows.append((part, chunk, np.int64(len(pieces)).tobytes() + head + sizes + b"".join(p[1] for p in pieces)))
        return _rows(rows)

    return run


def _transform(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted suffixes of strings closed by 0: places, symbols before them (0 at a string's start), and where those suffixes rank."""
    longest = int((ends - np.concatenate([[0], ends[:-1] + 1])).max()) + 1
    own_end = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
    windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(longest, np.uint8)]), longest)[: len(text)]
    left = (own_end - np.arange(len(text))).astype(np.int16 if longest < 1 << 15 else np.int64)
    seen = np.where(np.arange(longest, dtype=left.dtype) <= left[:, None], windows, np.uint8(0))
    places = np.argsort(seen.view(f"S{longest}").ravel(), kind="stable")
    rank = np.empty(len(text), np.int64)
    rank[places] = np.arange(len(text))
    before = np.where(places > 0, text[places - 1], 0)
    return places, before, rank[places - 1]


def merge_transforms(strings: list[bytes], shards: int = SHARDS, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of the strings by their first `depth` bytes: string, offset, and the common prefix with the suffix before (at most depth)."""
    whose, offset, symbols, back = [], [], [], []
    closing, base = [], 0
    for shard in range(min(shards, len(strings))):
        mine = range(shard, len(strings), shards)
        text = np.frombuffer(b"\xff".join(strings[i] for i in mine) + b"\xff", np.uint8) + np.uint8(1)  # the byte 255, never in UTF-8, becomes 0
        ends = np.flatnonzero(text == 0)
        places, before, ahead = _transform(text, ends)
        number = np.searchsorted(ends, places)
        whose.append(np.array(mine)[number])
        offset.append(places - np.concatenate([[0], ends[:-1] + 1])[number])
        symbols.append(before)
        back.append(ahead + base)
        closing.append(base + np.arange(len(ends)))  # closing symbols rank first in their shard
        base += len(text)
    symbol, ahead, closed = np.concatenate(symbols), np.concatenate(back).astype(np.int32), np.concatenate(closing).astype(np.int32)
    interleave, group = np.arange(base, dtype=np.int32), np.zeros(base, np.int32)
    common = np.full(base, depth, np.int16)
    common[:1] = 0
    for round_ in range(depth):
        c = symbol[interleave]
        order = np.argsort(c, kind="stable")
        c, group = c[order], group[order]
        parted = np.zeros(base, bool)
        parted[1:] = (c[1:] != c[:-1]) | (group[1:] != group[:-1])
        parted[1 : len(closed)] = False
        common[parted & (common == depth)] = round_
        interleave = np.concatenate([closed, ahead[interleave[order[len(closed) :]]]])
        group = np.cumsum(parted, dtype=np.int32)
    common[parted & (common == depth)] = depth - 1
    return np.concatenate(whose)[interleave], np.concatenate(offset)[interleave], common


def merge_snippets(key: tuple, blobs: pa.Table) -> pa.Table:
    """Per chunk: (key, mask) of shipped snippets; bit i tells that a smaller document has the string at offset i."""
    entries, strings, source = [], [], []
    for i, blob in enumerate(blobs.column("blob").to_pylist()):
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        entries.append(np.frombuffer(blob, ENTRY, n, 8))
        sizes = np.frombuffer(blob, np.int32, n, 8 + n * ENTRY.itemsize)
        ends = np.cumsum(sizes) + 8 + n * (ENTRY.itemsize + 4)
        strings += [blob[b - s : b] for b, s in zip(ends, sizes, strict=True)]
        source += [i] * n
    every, source = np.concatenate(entries), np.array(source)
    order = np.argsort(every["gram"], kind="stable")
    masks = np.zeros(len(every), np.uint32)
    size = np.cumsum([len(strings[i]) + 1 for i in order])
    new = np.flatnonzero(np.concatenate([[True], every["gram"][order][1:] != every["gram"][order][:-1]]))
    cut = 0
    for a, b in zip(new, [*new[1:], len(order)], strict=True):  # whole grams, about MERGED bytes at once
        if b < len(order) and size[b - 1] - (size[cut - 1] if cut else 0) < MERGED:
            continue
        mine = order[cut:b]
        cut = b
        whose, offset, common = merge_transforms([strings[i] for i in mine])
        interval = np.cumsum(common < LENGTH)
        full = np.array([len(strings[i]) for i in mine])[whose] - offset >= LENGTH
        whose, offset, interval = whose[full], offset[full], interval[full]
        doc = every["doc"][mine][whose]
        least = np.full(int(interval.max()) + 1, LARGEST)
        np.minimum.at(least, interval, doc)
        covered = least[interval] < doc
        np.bitwise_or.at(masks, mine[whose[covered]], np.uint32(1) << offset[covered].astype(np.uint32))
    chunks = blobs.column("chunk").to_numpy()
    out = np.zeros(len(every), MASK)
    out["key"], out["mask"] = _keys(every), masks
    rows = []
    for i in np.unique(source[masks > 0]):
        rows.append((1, int(chunks[i]), out[(source == i) & (masks > 0)].tobytes()))
    return _rows(rows)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def cut_texts(digest_only: bool):
    def run(key: tuple, texts: pa.Table, told: pa.Table) -> pa.Table:
        kinds, blobs = told.column("part").to_pylist(), told.column("blob").to_pylist()
        flags = _lookup([b for k, b in zip(kinds, blobs, strict=True) if k == 0], TOLD)
        masks = _lookup([b for k, b in zip(kinds, blobs, strict=True) if k == 1], MASK)
        entries, runs = _classes(texts)
        classes = np.zeros(len(entries), [("key", "u8"), ("doc", "i8")])
        classes["key"], classes["doc"] = _keys(entries), entries["doc"]
        classes.sort(order="key")
        columns: list[list] = [[] for _ in range(5)]
        for ids, data, offsets, s in runs:
            keys, doc = s.key, ids[s.row]
            whole = (doc > _find(classes, keys, "doc")) | (_find(flags, keys, "flags") & SMALL > 0)
            mask = np.where(whole, 0, _find(masks, keys, "mask"))
            edge = np.zeros(len(data) + 1, np.int32)
            np.add.at(edge, s.start[whole], 1)
            np.add.at(edge, s.end[whole] + LENGTH - 1, -1)
            some = np.flatnonzero(mask)
            for bit in range(WINDOWS):
                hit = s.start[some[(mask[some] >> np.uint32(bit)) & 1 > 0]] + bit
                np.add.at(edge, hit, 1)
                np.add.at(edge, hit + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            border = np.zeros(len(data) + 1, bool)
            border[offsets] = True
            opens, closes = gone.copy(), gone.copy()
            opens[1:] &= ~gone[:-1] | border[1:-1]
            closes[:-1] &= ~gone[1:] | border[1:-1]
            first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            cuts = np.searchsorted(first, offsets)
            for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                left = data[a:b][~gone[a:b]].tobytes()
                removed = list(zip((first[cuts[i] : cuts[i + 1]] - a).tolist(), (last[cuts[i] : cuts[i + 1]] - a).tolist(), strict=True))
                columns[0].append(int(b - a))
                columns[1].append(int(b - a) - len(left))
                columns[2].append(len(removed))
                columns[3].append(hashlib.sha256(left).digest() if digest_only else left)
                columns[4].append([] if digest_only else [{"start": x, "end": y} for x, y in removed])
        ids = texts.column("doc_id").combine_chunks()
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pair)
        return pa.table([ids, *[pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    return run


def remove_repeats(docs: DataFrame, digest_only: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes left, or their SHA-256) and spans (removed, in bytes; none with digests).

    Texts are written once, bucketed by chunk, so that later passes meet them without
    a shuffle; a chunk is a run of rows of one input task.
    """
    spark = docs.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    rows = docs.select(F.shiftright(F.monotonically_increasing_id(), ROWS_BITS).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = parts(docs, 16 << 20, size)
    rows.write.option("compression", "zstd").bucketBy(n, "chunk").sortBy("chunk").saveAsTable(name)
    try:
        texts = spark.table(name).groupBy("chunk")
        told = written(texts.applyInArrow(count_snippets(n), BLOBS).groupBy("part").applyInArrow(judge_snippets, BLOBS), "told")
        masks = written(texts.cogroup(told.groupBy("chunk")).applyInArrow(ship_snippets(n), BLOBS).groupBy("part").applyInArrow(merge_snippets, BLOBS), "masks")
        return written(texts.cogroup(told.union(masks).groupBy("chunk")).applyInArrow(cut_texts(digest_only), RESULT), "cut")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeats(table(spark, folder, "documents"), digest_only=True)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256"))


QUERIES = {"op8_suffixes": repeats}
SQL: dict[str, str] = {}
