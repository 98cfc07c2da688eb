"""Array helpers that run inside Spark tasks: texts as byte buffers, words and their hashes.

Every helper works on whole texts of one Arrow batch at a time; callers cut batches
with :func:`slices`, so memory follows the slice and the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
_TABLE = np.random.default_rng(20240601).integers(0, 2**64, 256, dtype=U) | U(1)
_POWERS = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the result."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            p = np.full(size, U(base), U)
            p[0] = U(1)
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as the empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 512 << 10) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about `most` bytes of text (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if total and total + size > most or k - start >= 2000:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(size)
    if start < len(sizes):
        yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space, and each text's first word number."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = (buf == 32) | ((buf >= 9) & (buf <= 13))
    before = np.empty(len(buf), bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(len(buf), bool)
    after[-1], after[:-1] = True, space[1:]
    inner = off[(off > 0) & (off < len(buf))]
    before[inner] = True
    after[inner - 1] = True
    starts = np.flatnonzero(before & ~space)
    return starts, np.flatnonzero(after & ~space) + 1, np.searchsorted(starts, off)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Running sums from which :func:`range_hash` takes the hash of any range of bytes."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum(_TABLE[buf] * p[: len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: equal bytes have equal hashes wherever they stand."""
    _, inverse = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(U) * _ODD)


def shingles(buf: np.ndarray, off: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of n successive words of each text, ascending in each text, and offsets.

    A text of 1 to n-1 words has one shingle, all its words; one without words has none.
    """
    starts, ends, first = words(buf, off)
    hashes = range_hash(prefix_sums(buf), starts, ends)
    counts = np.diff(first)
    have = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(have)])
    total = int(at[-1])
    owner = np.repeat(np.arange(len(counts)), have)
    base = first[:-1][owner] + (np.arange(total) - at[:-1][owner])
    length = np.minimum(counts[owner], n)
    out = np.zeros(total, U)
    padded = np.concatenate([hashes, np.zeros(n, U)])
    for k in range(n):
        out = np.where(length > k, mix(out * _ODD + padded[base + k] + U(k + 1)), out)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    if total:
        keep = np.ones(total, bool)
        keep[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
        out, owner = out[keep], owner[keep]
    return out, np.searchsorted(owner, np.arange(len(counts) + 1))


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole groups of a partition that is sorted by `key`, across batch borders."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        begin = 0
        for cut in [*cuts.tolist(), len(values)]:
            if held and values[begin] != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(begin, cut - begin))
            last = values[begin]
            begin = cut
    if held:
        yield pa.concat_tables(held)
