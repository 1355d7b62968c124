"""Vectorised work on UTF-8 bytes inside a task: slices of a batch, words and hashes of byte strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the hash base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(n, x, U)])) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which `spans` takes the hash of any substring."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end), equal for equal substrings."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about `most` bytes; null texts are empty.

    A single longer text is a run of its own, so memory follows the longest text, not the batch.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if texts.type in (pa.large_string(), pa.large_binary()) else pa.binary()
    filled = texts.cast(kind).fill_null(b"") if texts.null_count else texts.cast(kind)
    width = np.int64 if kind == pa.large_binary() else np.int32
    offsets = np.frombuffer(filled.buffers()[1], width)[filled.offset : filled.offset + len(filled) + 1].astype(np.int64)
    raw = filled.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(filled):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        end = min(end, len(filled))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of `inside`, which never cross a row's border."""
    n = len(inside)
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | border[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | border[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def vocabulary(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of a slice as numbers: number of each word, the rows' borders among the words, distinct words by number.

    `inside` tells for each byte value whether it belongs to words, `fold` maps bytes (to lower case, say).
    Words are compared as byte strings, not as hashes.
    """
    within = inside[data]
    starts, ends, _ = words(within, offsets)
    packed = data[within] if fold is None else fold[data[within]]
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(packed)]).dictionary_encode()
    return found.indices.to_numpy(), np.searchsorted(starts, offsets), found.dictionary


def bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an array of large binary values without nulls."""
    raw = strings.buffers()[2]
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8), offsets
