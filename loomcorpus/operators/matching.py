"""Terms of a table in texts: each is looked up by a few of its bytes, then compared.

A term's key is one of its runs of 8, 4, 2 or 1 bytes, the largest size it has, and of those the one
that the fewest terms share. A task takes the runs of that size of all its texts as whole numbers in
one array, drops those that are no term's key by a table of bits, and compares the terms of the others
byte by byte. The work grows with the texts and with the places that share a key, not with texts
times terms. The terms are sent to the tasks in lots of a checked size, a reading of the texts each.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..sources.shared import written

#: Bytes of the terms of one reading, bytes of text that are looked through at once, bits of the table.
LOT, SLICE, BITS = 16 << 20, 1 << 19, 22
_EDGE = re.compile(r"[一-鿿A-Za-z0-9]")


def runs(data: np.ndarray, size: int) -> np.ndarray:
    """The runs of ``size`` bytes from each place on, as whole numbers."""
    n = len(data) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for i in range(size):
        out |= data[i : i + len(out)].astype(np.uint64) << np.uint64(8 * i)
    return out


def _slots(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)


class _Keys:
    """The terms whose keys have one size, in order of key."""

    def __init__(self, size: int, terms: list[tuple[int, bytes]]):
        own = [runs(np.frombuffer(t, np.uint8), size) for _, t in terms]
        names, of, count = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        key, offset, at = np.zeros(len(terms), np.uint64), np.zeros(len(terms), np.int64), 0
        for i, r in enumerate(own):
            j = int(np.argmin(count[of[at : at + len(r)]]))
            key[i], offset[i] = r[j], j
            at += len(r)
        order = np.argsort(key, kind="stable")
        self.size, self.key, self.offset = size, key[order], offset[order]
        self.number = np.array([n for n, _ in terms], np.int64)[order]
        self.length = np.array([len(t) for _, t in terms], np.int64)[order]
        self.table = np.zeros(1 << BITS, bool)
        self.table[_slots(key)] = True

    def candidates(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places where a term may start, its place in the order)."""
        found = runs(data, self.size)
        at = np.flatnonzero(self.table[_slots(found)])
        first, last = (np.searchsorted(self.key, found[at], side) for side in ("left", "right"))
        n = last - first
        term = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n) - self.offset[term], term


class Matcher:
    """A lot of distinct terms that aren't empty."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        sizes: dict[int, list[tuple[int, bytes]]] = {}
        for i, t in enumerate(terms):
            sizes.setdefault(next(s for s in (8, 4, 2, 1) if s <= len(t)), []).append((i, t))
        self.keys = [_Keys(s, held) for s, held in sizes.items()]

    def occurrences(self, data: bytes, rows: np.ndarray) -> dict[tuple[int, int], list[int]]:
        """The places of each (row, term), in order, of texts that lie in ``data`` from ``rows[i]`` to
        ``rows[i + 1]``; places of one term that overlap count from the left."""
        flat, out = np.frombuffer(data, np.uint8), {}
        for keys in self.keys:
            start, term = keys.candidates(flat)
            row = np.searchsorted(rows, start, "right") - 1
            inside = (start >= 0) & (start + keys.length[term] <= rows[np.minimum(row + 1, len(rows) - 1)])
            order = np.argsort(start[inside], kind="stable")
            for s, t, r in zip(*(x[inside][order].tolist() for x in (start, term, row))):
                number = int(keys.number[t])
                word = self.terms[number]
                if data[s : s + len(word)] == word:
                    held = out.setdefault((r, number), [])
                    if not held or s >= held[-1] + len(word):
                        held.append(s)
        return out


def alone(data: bytes, start: int, end: int, first: int, last: int) -> bool:
    """Whether no letter or digit stands beside what lies from ``first`` to ``last`` of a text that
    lies from ``start`` to ``end``."""
    left = data[max(start, first - 4) : first].decode("utf-8", "ignore")[-1:]
    right = data[last : min(end, last + 4)].decode("utf-8", "ignore")[:1]
    return not (_EDGE.match(left) or _EDGE.match(right))


def lots(terms: Iterable[str], most: int = LOT) -> Iterator[list[bytes]]:
    lot, held = [], 0
    for term in terms:
        data = term.encode()
        if lot and held + len(data) > most:
            yield lot
            lot, held = [], 0
        lot.append(data)
        held += len(data)
    if lot:
        yield lot


def _slices(b: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, bytes, np.ndarray]]:
    """A batch in parts, with the bytes of their texts and where each starts."""
    sizes = pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:]):
        if a < z:
            some = b.slice(a, z - a)
            yield some, b"".join(x or b"" for x in some.column(text).cast(pa.binary()).to_pylist()), np.concatenate([[0], np.cumsum(sizes[a:z])])


def term_matches(docs: DataFrame, key: str, text: str, terms: DataFrame, standalone: bool = True) -> DataFrame:
    """(key, term, n): how often each of ``terms`` (term) occurs in each text that has it. If
    ``standalone``, a term of one character must stand at least once with no letter or digit beside
    it. Null and empty terms occur nowhere, null texts have none; repeated terms count once."""
    spark = docs.sparkSession
    kind = docs.schema[key]
    schema = T.StructType([T.StructField(key, kind.dataType), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    found = []
    for lot in lots(r["term"] for r in terms.select("term").filter("term <> ''").distinct().toLocalIterator()):
        held = spark.sparkContext.broadcast(lot)

        def run(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(held.value)
            single = [len(t.decode()) == 1 for t in held.value]
            for b in it:
                for some, data, rows in _slices(b, text):
                    of, term, n = [], [], []
                    for (r, t), places in matcher.occurrences(data, rows).items():
                        size = len(held.value[t])
                        if not (standalone and single[t]) or any(alone(data, rows[r], rows[r + 1], s, s + size) for s in places):
                            of.append(r)
                            term.append(held.value[t].decode())
                            n.append(len(places))
                    yield pa.RecordBatch.from_arrays([some.column(key).take(pa.array(of, pa.int64())), pa.array(term, pa.string()), pa.array(n, pa.int64())], schema.names)

        found.append(written(docs.select(key, text).mapInArrow(run, schema), "matches"))
        held.destroy()
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)
