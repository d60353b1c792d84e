"""Vectorised work on Arrow string columns: whole texts as bytes, without Python strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed value: the base of all polynomial hashes here, odd, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Fixed value: ASCII white space ends a word.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

#: A power is the product of two table entries, one for the low bits of its exponent and one for the others.
POWER_BITS = 16
_powers: dict[tuple[int, int], np.ndarray] = {}


def _table(base: int, step: int, n: int) -> np.ndarray:
    """base^0, base^step, ... , n of them at least, modulo 2^64; kept, and made anew, twice as long, as longer texts come."""
    have = _powers.get((base, step))
    if have is None or len(have) < n:
        have = np.full(1 << int(n - 1).bit_length(), pow(base, step, 1 << 64), dtype=np.uint64)
        have[0] = 1
        _powers[base, step] = np.multiply.accumulate(have, out=have)
    return have


def power(base: int, at: np.ndarray) -> np.ndarray:
    """base^k modulo 2^64 for every k of at; the tables take a few bytes for each 10,000 of the largest."""
    size = 1 << POWER_BITS
    out = _table(base, 1, size)[at & (size - 1)]
    far = at >> POWER_BITS
    out *= _table(base, size, int(far.max(initial=0)) + 1)[far]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return held[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of (data[j] + 1) BASE^j over j < i; the piece from a to b hashes to (h[b] - h[a]) INVERSE^a."""
    out, size = np.zeros(len(data) + 1, dtype=np.uint64), 1 << POWER_BITS
    near, far = _table(BASE, 1, size), _table(BASE, size, len(data) // size + 1)
    for k, lo in enumerate(range(0, len(data), size)):
        terms = data[lo : lo + size].astype(np.uint64)
        terms += np.uint64(1)
        terms *= near[: len(terms)]
        terms *= far[k]
        terms[:1] += out[lo : lo + 1]
        np.cumsum(terms, out=out[lo + 1 : lo + 1 + len(terms)])
    return out


def piece_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = prefix[end]
    out -= prefix[begin]
    out *= power(INVERSE, begin)
    return out


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word of the rows, and the number of the first word of each row (n + 1 numbers)."""
    inside = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and the number of the first word of each row (n + 1 numbers)."""
    begins, ends, first = word_bounds(data, offsets)
    return mixed(piece_hash(prefix_hash(data), begins, ends) + (ends - begins).astype(np.uint64)), first


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each run of n words, and the number of each row's first one. A row of fewer words has one of them all."""
    words, first = word_hashes(data, offsets)
    count = np.diff(first)
    mine = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(mine)])
    begin = np.repeat(first[:-1] - starts[:-1], mine) + np.arange(starts[-1])
    many = np.repeat(np.minimum(count, n), mine)
    out = np.zeros(len(begin), dtype=np.uint64)
    for k in range(n):
        took = many > k
        step = words[np.where(took, begin + k, 0)] if len(words) else out
        out = np.where(took, (out ^ (out >> np.uint64(29))) * np.uint64(BASE) + step, out)
    return mixed(out + many.astype(np.uint64)), starts


def distinct(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of each row, and where they start."""
    if not len(hashes):
        return hashes, starts
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, row))
    h, r = hashes[order], row[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], np.searchsorted(r[new], np.arange(len(starts)))


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key, from batches that come sorted by key."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not len(table):
            continue
        k = table[key].combine_chunks().to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = table.slice(a, b - a)
            if held and held[-1][key][0].as_py() != part[key][0].as_py():
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)
