"""Byte-level BPE with the `tokenizers` library over Arrow batches, and its inverse.

The vocabulary is a rank file: one base64 token and its rank per line. Its path
is a parameter. The library works on characters, so every byte stands for one
printable character (`byte_table`); decoding reverses that table. Every split of
a token into two known tokens is a merge, ordered by the token's rank, which is
how rank files are applied.

Null texts count as empty, empty texts give no tokens. Rows are independent:
repeated rows give repeated results, other columns pass through, and an empty
table gives an empty result. Tables whose columns have the names of results are
refused by `encode`, because Spark could not tell them apart.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postulant.llm.common import table
from postulant.llm.kernel import slices


def byte_table() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain}
    others = [b for b in range(256) if b not in shown]
    shown |= {b: chr(256 + i) for i, b in enumerate(others)}
    return [shown[b] for b in range(256)]


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def tokens(path: str) -> list[bytes]:
    """The bytes of each id; ids without a token are empty."""
    known = ranks(path)
    out = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        out[rank] = token
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    """A tokenizer of the library built from the ranks."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    shown, known = byte_table(), ranks(path)
    as_text = {token: "".join([shown[b] for b in token]) for token in known}
    merges = []
    for token in sorted(known, key=known.get):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in known and right in known:
                merges.append((as_text[left], as_text[right]))
    vocabulary = {as_text[token]: rank for token, rank in known.items()}
    made = Tokenizer(models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True))
    pieces = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
    made.pre_tokenizer = pre_tokenizers.Sequence([pieces, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return made


def character_offsets(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end character of each token from the UTF-8 bytes and the tokens' byte lengths.

    A token that holds part of a character starts at that character and ends
    behind it, so tokens that split a character overlap.
    """
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    ends = np.cumsum(lengths)
    return np.maximum(leads[np.minimum(ends - lengths + 1, len(data))] - 1, 0), leads[ends]


def segments(text: str) -> list[str]:
    """Cuts a text before every single space between two characters that are no white space.

    No match of a pattern that takes a space only at the start of a match, or
    within runs of white space, reaches over such a cut. So segments can be
    encoded alone, and frequent ones once.
    """
    if not text:
        return []
    first, *rest = text.split(" ")
    out, run = [], first
    for part in rest:
        if part and run and not part[0].isspace() and not run[-1].isspace():
            out.append(run)
            run = " " + part
        else:
            run += " " + part
    return [*out, run]


# Segments whose ids a task remembers before it starts afresh.
REMEMBERED = 600_000


def _encoded(texts: pa.Array, path: str, pattern: str, seen: dict[str, list[int]]) -> Iterator[tuple[list[bytes], list[list[int]]]]:
    made = tokenizer(path, pattern)
    for _, _, data, offsets in slices(texts, 1 << 20):
        raw = data.tobytes()
        strings = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        cut = [segments(s) for s in strings]
        if len(seen) > REMEMBERED:
            seen.clear()
        new = list({x for s in cut for x in s if x not in seen})
        seen.update(zip(new, (x.ids for x in made.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        yield [s.encode() for s in strings], [[*chain.from_iterable(map(seen.__getitem__, s))] for s in cut]


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds `ids` and the characters each token covers: `starts`, `ends` (end exclusive), arrays of int."""
    clash = {"ids", "starts", "ends"} & set(df.columns)
    if clash:
        raise ValueError(f"columns with the names of results: {sorted(clash)}")
    schema = T.StructType([*df.schema, *(T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("ids", "starts", "ends"))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, seen = np.array([len(t) for t in tokens(path)]), {}
        for batch in batches:
            done = 0
            for texts, ids in _encoded(batch.column(place), path, pattern, seen):
                covered = [character_offsets(np.frombuffer(s, np.uint8), sizes[x]) if x else ([], []) for s, x in zip(texts, ids, strict=True)]
                more = [pa.array(c, pa.list_(pa.int32())) for c in (ids, [a for a, _ in covered], [b for _, b in covered])]
                part = batch.slice(done, len(ids))
                done += len(ids)
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "ids", "starts", "ends"])

    return df.mapInArrow(run, schema)


def decoded_bytes(ids: list[int], path: str) -> bytes:
    """The bytes of a sequence of ids; characters that tokens split come together again."""
    return b"".join(map(tokens(path).__getitem__, ids))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds `decoded` (binary) and `decoded_text`, where bytes that are no UTF-8 become U+FFFD. Null ids count as none."""
    schema = T.StructType([*df.schema, T.StructField("decoded", T.BinaryType()), T.StructField("decoded_text", T.StringType())])
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decoded_bytes(x or [], path) for x in batch.column(place).to_pylist()]
            more = [pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "decoded", "decoded_text"])

    return df.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes in one pass and keeps digests only, so that ids never leave the task.

    Columns doc_id, n_tokens, ids_sha256 and decoded_sha256. A null doc_id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits, seen = [str(i).encode() for i in range(len(tokens(path)))], {}
        for batch in batches:
            done = 0
            for _, ids in _encoded(batch.column(1), path, pattern, seen):
                plain = [hashlib.sha256(b",".join([digits[i] for i in x])).hexdigest() for x in ids]
                back = [hashlib.sha256(decoded_bytes(x, path)).hexdigest() for x in ids]
                names = batch.column(0).slice(done, len(ids))
                done += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [names, pa.array([len(x) for x in ids], pa.int64()), pa.array(plain), pa.array(back)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DIGESTS)


def bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op7_byte_bpe": bpe}
SQL: dict[str, str] = {}
