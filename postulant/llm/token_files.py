"""Token ids in binary files: frequency-ranked ids, byte-aligned lengths in control bytes of their own.

`write_files` encodes texts with a tokenizer file of the `tokenizers` library, appends an
end id to each document and writes the ids in ascending doc_id order. An id is stored as
its rank by frequency over the whole table (ties: smaller id), so that frequent ids take
one byte. Four ids share a control byte, two bits each, for lengths of 1 to 4 bytes; the
ids' bytes follow apart. A reader looks the lengths up in a table of 256 rows and gathers
all ids of a block at once.

A folder holds `ranks` (rank, id: Parquet) and `ids`: files `part-*` of blocks, in
ascending order by partition and file number. A block is

    4 bytes   b"TID1"
    uint32    documents, then uint64 ids, then uint64 bytes of ids
    int64     doc_id of each document, then one byte each: 1 if it has a doc_id
    uint64    number of ids of each document
    bytes     control bytes, one for four ids, the last padded
    bytes     the ids' ranks, little-endian, 1 to 4 bytes each
    1 byte    line feed

with all numbers little-endian. Spark's own writer commits the files, so a lost task
leaves nothing behind. A document never spans blocks.

Texts are cut into pieces before encoding, where the tokenizer separates them itself (see
`pieces`), and each distinct piece is encoded once and remembered within bounds by a Python worker,
over its tasks; it compares pieces as bytes. The cuts hold for tokenizers that drop white space, ignore case and
match letters, single digits and other characters apart, and mark the ends of words, as the one used here. Strings of special tokens in a text are ordinary text.

Defined results: a null or empty text has the end id only. Rows without doc_id follow all
others. Rows with one doc_id are ordered by a hash of the text; they are dealt by row too,
so an id on a third of all rows does not fill one task. Bytes that are no UTF-8 are read as
U+FFFD. Only doc_id and text are read, so other columns cannot clash. An empty table gives
no blocks and an empty result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from postulant.llm.common import small, table, written
from postulant.llm.kernel import LOWER, SPACES, slices
from postulant.session import work_folder

MAGIC = b"TID1"
HEAD = struct.Struct("<4sIQQ")
# A block is closed when it has this many ids; a file has so many blocks.
BLOCK_IDS = 1 << 20
FILE_BLOCKS = 8
# Ids that a Python worker remembers for words it has met, before it starts afresh.
REMEMBERED = 1 << 21
# Different pieces that a task counts before it passes the counts on.
COUNTED = 1 << 19
# Words encoded in one call.
TOGETHER = 200
# Bytes of text that a task works on at once.
SLICE = 1 << 22

# Lengths of the four ids that each control byte stands for.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    return made


@lru_cache(maxsize=2)
def letters_only(path: str):
    """The tokenizer's model alone, for words of lower-case `LATIN` letters: its other steps leave these as they are and take each as one match."""
    from tokenizers import Tokenizer, pre_tokenizers

    made = Tokenizer(tokenizer(path).model)
    made.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


@lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """For each id whether its token ends a word; every word has one such token, its last."""
    made = tokenizer(path)
    out = np.zeros(made.get_vocab_size(with_added_tokens=True), bool)
    for token, i in made.get_vocab(with_added_tokens=True).items():
        out[i] = token.endswith(made.model.end_of_word_suffix)
    return out


# Classes of bytes: white space, ASCII letters, digits, other ASCII, all else.
BLANK, LETTER, DIGIT, MARK, HIGH = range(5)
CLASSES = np.full(256, MARK, np.uint8)
CLASSES[SPACES] = BLANK
CLASSES[65:91] = CLASSES[97:123] = LETTER
CLASSES[48:58] = DIGIT
CLASSES[128:] = HIGH
# Letters without combining marks, each with one lower-case form of its own: U+00C0 to U+024F but for two signs and the dotted I.
LATIN = re.compile("[a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The pieces of texts as numbers, the rows' borders among them, and the distinct pieces, ASCII in lower case.

    Texts are cut at white space, and between two ASCII characters where letters, digits
    and other characters meet, and between digits: the tokenizer never matches across
    those. An apostrophe before a letter may begin a contraction and is not cut off.
    """
    kind = CLASSES[data]
    inside = kind != BLANK
    left, right = kind[:-1], kind[1:]
    apart = (left != HIGH) & (right != HIGH) & ((left != right) | (left == DIGIT)) & ~((data[:-1] == 39) & (right == LETTER))
    opens = np.ones(len(data) + 1, bool)
    opens[1:-1] = apart | (left == BLANK)
    opens[offsets] = True
    starts = np.flatnonzero(inside & opens[:-1])
    closes = inside.copy()
    closes[:-1] &= opens[1:-1] | ~inside[1:]
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.flatnonzero(closes) + 1 - starts, out=places[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(LOWER[data[inside]])]).dictionary_encode()
    return found.indices.to_numpy(), np.searchsorted(starts, offsets), found.dictionary


# Stands for the end of a document among the pieces; no UTF-8 text has these bytes.
END = b"\xff\xff"


def ids_of(distinct: pa.Array, path: str, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each piece, all ids)."""
    raw = distinct.to_pylist()
    words = [w.decode("utf-8", "replace") for w in raw]
    small = np.fromiter((LATIN.fullmatch(w) is not None for w in words), bool, len(words))
    plain, other = np.flatnonzero(small), np.flatnonzero(~small)
    lower = [words[i].lower() for i in plain]
    lines = [" ".join(lower[i : i + TOGETHER]) for i in range(0, len(lower), TOGETHER)]
    found = letters_only(path).encode_batch_fast(lines, add_special_tokens=False)
    plain_ids = np.fromiter(chain.from_iterable(x.ids for x in found), np.int32)
    encoded_ = tokenizer(path).encode_batch_fast([words[i] for i in other], add_special_tokens=False)
    rest = [[end] if raw[i] == END else x.ids for i, x in zip(other, encoded_, strict=True)]
    lengths = np.zeros(len(distinct), np.int64)
    lengths[plain] = np.diff(np.flatnonzero(word_ends(path)[plain_ids]) + 1, prepend=0)
    lengths[other] = [len(x) for x in rest]
    starts = np.cumsum(lengths) - lengths
    ids = np.empty(int(lengths.sum()), np.int32)
    ids[spread(starts[plain], lengths[plain])] = plain_ids
    ids[spread(starts[other], lengths[other])] = np.fromiter((i for x in rest for i in x), np.int32, int(lengths[other].sum()))
    return lengths, ids


class Known:
    """Pieces that a task has met, by number; number 0 is the end of a document."""

    def __init__(self) -> None:
        self.pieces = pa.array([END], pa.large_binary())

    def numbers(self, distinct: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The numbers of pieces, and the pieces that are new and have got the next ones."""
        at = pc.index_in(distinct, value_set=self.pieces)
        new = distinct.filter(at.is_null())
        found = at.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        found[found < 0] = len(self.pieces) + np.arange(len(new))
        if len(new):
            self.pieces = pa.concat_arrays([self.pieces, new])
        return found, new


class Words:
    """The ids of pieces, remembered within bounds."""

    def __init__(self, path: str, end: int):
        self.path, self.end = path, end
        self.forget()

    def forget(self) -> None:
        self.known = Known()
        self.starts, self.ids = np.array([0, 1]), np.array([self.end], np.int32)

    def learn(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of the pieces; `starts` and `ids` hold the ids by these numbers."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        numbers, new = self.known.numbers(distinct)
        if len(new):
            try:
                lengths, ids = ids_of(new, self.path, self.end)
            except BaseException:
                self.forget()  # the pieces have numbers, but no ids; another task may go on with these words
                raise
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, ids])
        return numbers


@lru_cache(maxsize=1)
def remembered(path: str, end: int) -> Words:
    """The words of this Python worker: its next tasks need not encode again what an earlier one has met."""
    return Words(path, end)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each of many stretches, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def encoded(texts: pa.Array, known: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of ids of each document, all ids) of runs of rows, each document with its end id."""
    for _, _, data, offsets in slices(texts, SLICE):
        codes, borders, distinct = pieces(data, offsets)
        numbers = np.insert(known.learn(distinct)[codes], borders[1:], 0)
        starts = known.starts[numbers]
        sizes = known.starts[numbers + 1] - starts
        total = np.concatenate([[0], np.cumsum(sizes)])
        yield np.diff(total[borders + np.arange(len(borders))]), known.ids[spread(starts, sizes)]


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ranks below 2^32."""
    values = ranks.astype("<u4")
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = extra
    control = padded.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    kept = np.arange(4, dtype=np.uint8) <= extra[:, None]
    return control.astype(np.uint8).tobytes(), values.view(np.uint8).reshape(-1, 4)[kept].tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The n ranks behind control and data bytes, by look-up of all lengths at once."""
    sizes = LENGTHS[control].reshape(-1)[:n]
    ends = np.cumsum(sizes, dtype=np.int64)
    starts = ends - sizes
    out = data[starts].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(sizes > k)
        out[longer] |= data[starts[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = pack(ranks)
    held = np.array([i is not None for i in doc_ids], np.uint8)
    numbers = np.array([i or 0 for i in doc_ids], "<i8")
    head = HEAD.pack(MAGIC, len(doc_ids), len(ranks), len(data))
    return b"".join([head, numbers.tobytes(), held.tobytes(), lengths.astype("<u8").tobytes(), control, data])


def blocks(content: bytes | memoryview) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[], np.ndarray]]]:
    """(doc_ids, whether known, numbers of ids, function that decodes the ranks) of each block of a file."""
    at = 0
    while at < len(content):
        magic, n_docs, n_ids, n_data = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEAD.size
        doc_ids, at = np.frombuffer(content, "<i8", n_docs, at), at + 8 * n_docs
        held, at = np.frombuffer(content, np.uint8, n_docs, at), at + n_docs
        lengths, at = np.frombuffer(content, "<u8", n_docs, at).astype(np.int64), at + 8 * n_docs
        control, at = np.frombuffer(content, np.uint8, -(-n_ids // 4), at), at - (-n_ids // 4)
        data, at = np.frombuffer(content, np.uint8, n_data, at), at + n_data + 1
        if int(lengths.sum()) != n_ids:
            raise ValueError("a block's documents do not add up to its ids")
        yield doc_ids, held, lengths, lambda c=control, d=data, n=n_ids: unpack(c, d, n)


def rank_by_frequency(docs: DataFrame, path: str, end: int) -> np.ndarray:
    """Ids by falling frequency in the whole table, then the unused ones; as long as the vocabulary.

    Pieces are counted first, per task and then over all, so each is encoded once for the whole table.
    """
    size = max(tokenizer(path).get_vocab_size(with_added_tokens=True), end + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Known(), np.zeros(1, np.int64)
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0), SLICE):
                codes, _, distinct = pieces(data, offsets)
                numbers, new = known.numbers(distinct)
                held = np.concatenate([held, np.zeros(len(new), np.int64)])
                held[numbers] += np.bincount(codes, minlength=len(distinct))
                held[0] += len(offsets) - 1
                if len(held) > COUNTED:
                    yield pa.RecordBatch.from_arrays([known.pieces.cast(pa.binary()), pa.array(held)], ["piece", "n"])
                    known, held = Known(), np.zeros(1, np.int64)
        yield pa.RecordBatch.from_arrays([known.pieces.cast(pa.binary()), pa.array(held)], ["piece", "n"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            lengths, ids = ids_of(batch.column(0).cast(pa.large_binary()), path, end)
            np.add.at(total, ids, np.repeat(batch.column(1).to_numpy(), lengths))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    distinct = docs.select("text").mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    # One row per id of the vocabulary reaches the driver, whatever the table's size.
    counted = distinct.mapInArrow(weigh, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(size, np.int64)
    for row in counted:
        total[row["id"]] = row["n"]
    return np.argsort(-total, kind="stable").astype(np.int32)


def write_files(docs: DataFrame, path: str, folder: str, end: int) -> None:
    """Writes the ids of every row's text below a folder, in ascending doc_id order."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    by_rank = rank_by_frequency(plain, path, end)
    ranks = np.empty(len(by_rank), np.uint32)
    ranks[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    spark.createDataFrame(list(enumerate(by_rank.tolist())), "rank int, id int").coalesce(1).write.parquet(f"{folder}/ranks")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = remembered(path, end)
        names, lengths, parts, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            made = block(names, np.concatenate(lengths), np.concatenate(parts))
            names.clear(), lengths.clear(), parts.clear()
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], ["block"])

        for batch in batches:
            ids_of_rows, done = batch.column(0).to_pylist(), 0
            for sizes, ids in encoded(batch.column(1), known):
                found, at = ranks[ids], np.concatenate([[0], np.cumsum(sizes)])
                first = 0
                while first < len(sizes):
                    last = min(max(first + 1, int(np.searchsorted(at, at[first] + BLOCK_IDS - held, "right")) - 1), len(sizes))
                    names += ids_of_rows[done + first : done + last]
                    lengths.append(sizes[first:last])
                    parts.append(found[at[first] : at[last]])
                    held += int(at[last] - at[first])
                    first = last
                    if held >= BLOCK_IDS:
                        yield close()
                        held = 0
                done += len(sizes)
        if names:
            yield close()

    keyed = plain.select("*", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    made = ranged.mapInArrow(encode, "block binary").select(F.col("block").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("maxRecordsPerFile", FILE_BLOCKS).text(f"{folder}/ids")


# Partition and number within it, by which the files of a folder ascend.
FILE_NAME = r"part-(\d+)-.*-c(\d+)"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/ids")
    numbers = [F.regexp_extract("path", FILE_NAME, k).cast("long") for k in (1, 2)]
    return files.select((numbers[0] * 1_000_000 + numbers[1]).alias("file"), "content")


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, ids in all files before it). One row per file, a few megabytes each, meets in the window."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total = sum(int(lengths.sum()) for _, _, lengths, _ in blocks(memoryview(content.as_buffer())))
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([total], pa.int64())], ["file", "n"])

    totals = written(_files(spark, folder).mapInArrow(count, "file long, n long"), "files")
    before = F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1))
    return totals.select("file", F.coalesce(before, F.lit(0)).alias("before"))


def _read(spark: SparkSession, folder: str, column: str, kind: pa.DataType, make: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    held = spark.read.schema("rank int, id int").parquet(f"{folder}/ranks").orderBy("rank").collect()  # as long as the vocabulary
    ids = np.array([r["id"] for r in held], np.uint32)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                start = 0
                for doc_ids, known, lengths, ranks in blocks(memoryview(content.as_buffer())):
                    ends = np.cumsum(lengths)
                    made = make(ids[ranks()], np.concatenate([[0], ends]))
                    columns = [np.full(len(lengths), file), pa.array(doc_ids, mask=known == 0), start + ends - lengths, lengths]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [made], ["file", "doc_id", "start", "n_tokens", column])
                    start += int(lengths.sum())

    shown = {pa.int64(): "long", pa.list_(pa.int32()): "array<int>"}[kind]
    rows = _files(spark, folder).mapInArrow(decode, f"file long, doc_id long, start long, n_tokens long, {column} {shown}")
    joined = rows.join(small(written(_starts(spark, folder), "starts")), "file")
    return joined.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", column)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array of int), end id included."""
    kind = pa.list_(pa.int32())
    return _read(spark, folder, "ids", kind, lambda ids, at: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """As `read_files`, with the crc32 of the ids as little-endian unsigned 32-bit integers in place of the ids."""

    def make(ids: np.ndarray, at: np.ndarray) -> pa.Array:
        raw = memoryview(ids.astype("<u4").tobytes())
        return pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64())

    return _read(spark, folder, "ids_crc32", pa.int64(), make)


def token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    target = work_folder(spark, "token-files")
    write_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), target, end=1)
    return read_digests(spark, target)


QUERIES = {"op12_token_files": token_files}
SQL: dict[str, str] = {}
