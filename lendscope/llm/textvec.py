"""Numpy over whole Arrow batches of texts: words, word hashes, shingles. Used inside ``mapInArrow`` tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that one numpy pass takes; a single longer text is taken alone.
CHUNK = 1 << 21


def odd_constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) * U(2) + U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (in place where ``x`` is a fresh array)."""
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xA0761D6478BD642F)
    x ^= x >> U(32)
    return x


@lru_cache(maxsize=2)
def byte_values(lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower`` A-Z have those of a-z."""
    table = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
    if lower:
        table[65:91] = table[97:123]
    return table


@lru_cache(maxsize=4)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = 0x9E3779B97F4A7C15 | 1
    base = pow(base, -1, 1 << 64) if inverse else base
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, inverse: bool = False) -> np.ndarray:
    size = 1 << max(CHUNK.bit_length(), int(n).bit_length())
    return _powers(size, inverse)[:n]


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and the n + 1 offsets of the texts; NULL counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    buf = col.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None and buf.size else np.zeros(0, dtype=np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of stretches of about ``CHUNK`` bytes."""
    data, off = bytes_of(col)
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + CHUNK, "right")) - 1)
        yield a, b, data[off[a]:off[b]], off[a:b + 1] - off[a]
        a = b


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every word (runs of bytes that are no white space)."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(byte_values(lower)[data] * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, inverse=True)[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, off: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct ``size``-word shingles of each text, ascending, and their n + 1 offsets.

    A-Z are lower-cased. A text with fewer words has its whole sequence as one; one without words has none.
    """
    n = len(off) - 1
    starts, ends, doc = word_bounds(data, off)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(n + 1, dtype=np.int64)
    words = word_hashes(data, starts, ends, lower=True)
    weights = odd_constants(size, 5)
    count = np.bincount(doc, minlength=n)
    windows = np.maximum(len(words) - size + 1, 0)
    total = np.zeros(windows, dtype=np.uint64)
    for k in range(size):
        total += words[k:k + windows] * weights[k]
    whole = doc[:windows] == doc[size - 1:size - 1 + windows] if windows else np.zeros(0, dtype=bool)
    values, owner = mix(total[whole]), doc[:windows][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        at = np.concatenate([[0], np.cumsum(count)])
        one = np.array([int((words[at[i]:at[i + 1]] * weights[:count[i]]).sum()) ^ int(count[i]) for i in short], dtype=np.uint64)
        values, owner = np.concatenate([values, mix(one)]), np.concatenate([owner, short])
        by = np.argsort(owner, kind="stable")
        values, owner = values[by], owner[by]
    at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=n))])


def long_lists(values: np.ndarray, off: np.ndarray) -> pa.ListArray:
    """A list<int64> array from values and offsets."""
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))


def list_values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list<int64> column without NULLs."""
    off = col.offsets.to_numpy()
    return col.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]], off - off[0]


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` as one table each, from batches sorted by them; runs may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
