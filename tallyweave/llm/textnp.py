"""Vectorised work on Arrow text columns: words, word hashes and n-gram hashes without a Python loop per word.

Rows arrive as Arrow batches; `chunks` cuts them into runs of whole documents of a few MB, so the numpy
temporaries (about 60 bytes for each byte of text) stay bounded however large the batch is. A single longer
document makes a chunk of its own: whole texts are always processed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20
U64 = np.uint64

#: Byte classes: the separators of words are blank, and 0x09 to 0x0D.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + (1 << 16))
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about `most` bytes, one row at least."""
    data, offsets = text_buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(n, max(j, i + 1, min(i + 1, n)))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the n+1 offsets of each document in that list."""
    word = ~separator[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = word[:-1]
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = word[1:]
    starts = np.flatnonzero(word & (cut[:-1] | ~before))
    ends = np.flatnonzero(word & (cut[1:] | ~after)) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial over random byte values by prefix sums, then mixed."""
    up, down = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of sequences put together from two adjacent sequences."""
    return mix(left * U64(0xA24BAED4963EE407) + (right ^ (right >> U64(29))) * U64(0x9FB21C651E98DF25) + U64(0x632BE59BD9B4E019))


def ngram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive items, whatever documents they touch, by doubling; len - k + 1 of them."""
    out, have, part, width = None, 0, hashes, 1
    while True:
        if k & width:
            if out is None:
                out, have = part, width
            else:
                n = len(hashes) - (have + width) + 1
                out, have = joined(out[: max(n, 0)], part[have : have + max(n, 0)]), have + width
        if 2 * width > k:
            return out[: max(0, len(hashes) - k + 1)]
        n = max(0, len(hashes) - 2 * width + 1)
        part, width = joined(part[:n], part[width : width + n]), 2 * width


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For items in documents with n+1 offsets `first`: which of the len-k+1 runs of k lie in one document."""
    total = int(first[-1])
    ok = np.ones(max(0, total - k + 1), bool)
    ends = np.repeat(first[1:], np.diff(first))[: len(ok)]
    return ok & (np.arange(len(ok)) + k <= ends)



def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A table of byte values that is true within the spans, both ends included."""
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


def coded_terms(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Terms between separators, A-Z in lower case: the distinct ones, and for each occurrence its number there and its document.

    Terms are told apart by their bytes, in Arrow's dictionary of them. Separators are ASCII, so no code point is cut."""
    starts, ends, first = words(data, offsets, separator)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64)
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    wide = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(LOWER[data[~separator[data]]]))
    found = wide.dictionary_encode()
    return found.dictionary.cast(pa.string()), found.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(offsets) - 1), np.diff(first))
