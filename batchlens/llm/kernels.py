"""Vectorised text kernels: words and word hashes of a whole Arrow batch at once, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Odd, so that it has an inverse modulo 2**64.
ROOT = 0x9E3779B97F4A7C15
INVERSE = pow(ROOT, -1, 2**64)
#: Words are runs of bytes other than 32 and 9 to 13.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
#: Words are runs of ASCII letters, digits and bytes of longer characters.
SYMBOLS = np.ones(256, bool)
SYMBOLS[48:58] = SYMBOLS[65:91] = SYMBOLS[97:123] = SYMBOLS[128:] = False
#: Lower-cases A-Z alone; one more than the byte, so that no word hashes like its zero-padded form.
LOWER = (np.arange(256) + 1).astype(U64)
LOWER[65:91] += U64(32)
#: Keeps case.
EXACT = (np.arange(256) + 1).astype(U64)

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**i and ROOT**-i modulo 2**64 for i < n."""
    if _powers.get("n", np.zeros(0)).size < n:
        size = max(n, 1 << 20)
        for key, base in (("n", ROOT), ("i", INVERSE)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["n"][:n], _powers["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts together, and where each text starts (one more entry than texts); null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes of text (a longer text comes alone)."""
    _, starts = text_bytes(batch.column(batch.schema.get_field_index(column)))
    row, n = 0, batch.num_rows
    while row < n:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + most, "right")) - 1)
        yield batch.slice(row, end - row)
        row = end


def words(data: np.ndarray, starts: np.ndarray, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words start and end, and how many each text has. A word never spans two texts."""
    if not data.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(starts) - 1, np.int64)
    inside = ~breaks[data]
    edge = np.zeros(data.size + 1, bool)
    edge[starts] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    counts = np.diff(np.searchsorted(begin, starts))
    return begin, end, counts


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, letters: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word, by default with A-Z lower-cased, by differences of a running polynomial."""
    power, inverse = powers(data.size + 1)
    total = np.zeros(data.size + 1, U64)
    np.cumsum(letters[data] * power[: data.size], out=total[1:])
    return mix((total[end] - total[begin]) * inverse[begin])


def shingle_sets(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of every text, text after text and ascending in each, and how many each text has.

    A text with fewer words than `size` has its whole word sequence as its one shingle, one without words none.
    """
    data, starts = text_bytes(column)
    begin, end, counts = words(data, starts)
    if not begin.size:
        return np.zeros(0, U64), counts
    hashed = word_hashes(data, begin, end)
    short = (counts > 0) & (counts < size)
    offset = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(counts)), counts)
    value = np.zeros(max(0, hashed.size - size + 1), U64)
    for k in range(size):
        value = value * U64(ROOT) + hashed[k : k + value.size]
    keep = owner[: value.size] == owner[size - 1 :] if value.size else np.zeros(0, bool)
    value, at = mix(value[keep]), owner[: value.size][keep]
    for i in np.flatnonzero(short):
        total = U64(counts[i])
        with np.errstate(over="ignore"):
            for h in hashed[offset[i] : offset[i + 1]]:
                total = total * U64(ROOT) + h
        value = np.append(value, mix(np.array([total], U64)))
        at = np.append(at, i)
    order = np.lexsort((value, at))
    value, at = value[order], at[order]
    new = np.ones(value.size, bool)
    new[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
    return value[new], np.bincount(at[new], minlength=len(counts))
