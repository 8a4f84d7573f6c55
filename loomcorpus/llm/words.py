"""Words of texts as 64-bit hashes, in arrays.

A word's hash is a polynomial in an odd number, with a random value for each byte, modulo 2**64 and
mixed. So the words of many texts are hashed by a few passes over their bytes, with no object per
word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes hashed in one go, and bytes of text that a batch is taken apart into, about.
_CHUNK, SLICE = 1 << 16, 1 << 21
_BASE, _MASK = 0x9E3779B97F4A7C1B, (1 << 64) - 1


def _table() -> np.ndarray:
    """A value for each byte: capitals have their small letter's, white space has none."""
    out = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out[65:91] = out[97:123]
    out[[32, *range(9, 14)]] = 0
    return out


_VALUE = _table()
_IN_WORD = _VALUE != 0


def _powers(base: int) -> np.ndarray:
    steps = np.full(_CHUNK, base, np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a column, one text after another, and where each text's
    begin, with the end as a last entry. Words are runs of anything but space and 0x09-0x0D, after
    lower-casing A-Z; a null text has none."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, places, body = column.buffers()
    if len(column) == 0 or body is None or body.size == 0:
        return np.zeros(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    rows = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
    text = np.frombuffer(body, np.uint8)[rows[0] : rows[-1]]
    rows = rows - rows[0]
    hashes, begins = [], []
    open_at = -1  # where the word starts that the chunk before left unfinished
    for at in range(0, len(text), _CHUNK):
        part = text[at : at + _CHUNK]
        inside = _IN_WORD[part]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        first, past = np.searchsorted(rows, (at, at + len(part)))
        own = rows[first:past] - at
        begin[own] = inside[own]
        goes_on = open_at >= 0 and inside[0] and not (len(own) and own[0] == 0)
        if goes_on:
            begin[0] = False
        starts = np.flatnonzero(begin)
        values = _VALUE[part] * _UP[: len(part)]
        if goes_on:
            rest = int(values[: starts[0] if len(starts) else len(part)].sum(dtype=np.uint64))
            hashes[-1][-1:] += np.uint64(rest * pow(_BASE, at - open_at, 1 << 64) & _MASK)
        if len(starts):
            hashes.append(np.add.reduceat(values, starts) * _DOWN[starts])
            begins.append(starts + at)
        if not inside[-1]:
            open_at = -1
        elif len(starts):
            open_at = at + int(starts[-1])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(rows), np.int64)
    return mixed(np.concatenate(hashes)), np.searchsorted(np.concatenate(begins), rows)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about ``size`` bytes of text, no row being parted."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // size
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def word_hashes(text: bytes | str | None) -> np.ndarray:
    """Hashes of one text's words."""
    return batch_words(pa.array([text.encode() if isinstance(text, str) else text], pa.binary()))[0]


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; a shorter sequence is one run, none gives none."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    out = mixed(h[: len(h) - n + 1] + np.uint64(n))
    for i in range(1, n):
        out = mixed(out ^ (h[i : len(h) - n + 1 + i] * np.uint64(0x9E3779B97F4A7C15)))
    return out


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each text of a column, sorted. Shingles are told apart by
    64-bit hashes."""
    flat, places = batch_words(column)
    every = runs(flat, n)
    for a, b in zip(places, places[1:]):
        yield np.unique(every[a : b - n + 1] if b - a >= n else runs(flat[a:b], n))


def folded(h: np.ndarray) -> int:
    """One hash of a sorted array."""
    return xxhash.xxh64_intdigest(h.tobytes())


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
