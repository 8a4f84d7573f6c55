"""Best-fit packing of documents into sequences of fixed capacity by bin completion.

What decides a packing is how many pieces there are of each length, and there are at most
``capacity`` lengths. So the tasks count lengths, the driver packs the counts (a table of at most
``capacity`` rows, however large the corpus), and the tasks look their pieces' places up by length
and rank among pieces of that length.

Packing the counts is a depth-first branch and bound. A step takes the largest length left and
enumerates the undominated fillings of its bin, the fullest first; a filling is used as often as the
counts allow, or once, so every packing is within reach. A filling is dominated if a single longer
piece could take the place of some of its pieces in the room there is. A branch ends when the room it
has wasted is more than any better packing may waste, or when its bins and the bound on what is left
reach the incumbent, which best fit by decreasing length gives first. The search ends when the bound
is reached, nothing is left to try, or its nodes are spent; then the gap to the bound is reported.
"""

from __future__ import annotations

import logging
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .expressions import gapless
from .scratch import materialize
from .tokens import encoder
from .words import slices

_log = logging.getLogger(__name__)

#: Fillings enumerated for one bin, and bins completed in all, before the search settles: both are
#: parameters, and None for the fillings enumerates all.
FILLINGS, NODES = 400, 20_000
#: Bytes of text whose pieces are looked up at once, about.
SLICE = 8 << 20

Bins = list[tuple[tuple[int, ...], int]]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins: pieces over half the capacity need one each, and for any limit
    k, pieces over capacity - k share theirs with none of k or more."""
    number = np.zeros(capacity + 2, np.int64)
    for n, c in counts.items():
        number[n + 1] = c
    below = np.cumsum(number)  # pieces shorter than n
    length = np.cumsum(number * np.arange(-1, capacity + 1))
    k = np.arange(capacity // 2 + 1)
    half = capacity // 2 + 1  # the shortest length over half the capacity
    alone = below[capacity + 1] - below[capacity - k + 1]
    paired = below[capacity - k + 1] - below[half]
    room = paired * capacity - (length[capacity - k + 1] - length[half])
    small = length[half] - length[k]
    return int(np.max(alone + paired + np.maximum(0, -((room - small) // capacity)), initial=0))


def best_fit(counts: dict[int, int], capacity: int) -> Bins:
    """Best fit by decreasing length: a piece goes to the fullest bin that has room for it. Equal
    bins are kept as one entry with their number."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: tuple[int, ...], times: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((filling, times))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            at = bisect_left(rooms, n)
            room = rooms[at] if at < len(rooms) else capacity
            filling, times = open_[room].pop() if at < len(rooms) else ((), left)
            if at < len(rooms) and not open_[room]:
                del open_[room], rooms[at]
            each = room // n
            full = min(times, left // each)
            rest = left - full * each if full < times else 0
            if full:
                put(room - each * n, filling + (n,) * each, full)
            if rest:
                put(room - rest * n, filling + (n,) * rest, 1)
            over = times - full - (rest > 0)
            if over and filling:
                put(room, filling, over)
            left -= full * each + rest
    return [x for some in open_.values() for x in some]


def dominated(pieces: tuple[int, ...], left: int, counts: dict[int, int], lengths: list[int]) -> bool:
    """Whether one unused piece could take the place of some shorter ones, or of none, in the room
    they and ``left`` give. ``lengths`` is ascending."""
    sums, order, at = 1, sorted(pieces), 0
    for x in lengths:
        while at < len(order) and order[at] < x:
            sums |= sums << order[at]
            at += 1
        if counts[x] > order.count(x) and sums >> max(0, x - left) & ((1 << min(left, x) + 1) - 1):
            return True
    return False


def fillings(counts: dict[int, int], lengths: list[int], room: int, limit: int | None = FILLINGS) -> Iterator[tuple[int, tuple[int, ...]] | None]:
    """(room left, pieces) of the undominated fillings of ``room``, the fullest first; at last None
    if ``limit`` ended the enumeration. ``lengths`` is ascending, ``counts`` what may be used."""
    held: list[tuple[int, tuple[int, ...]]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(room, len(lengths), ())]
    looked = 0
    while stack and (limit is None or looked < limit):
        left, at, pieces = stack.pop()
        at = min(at, bisect_right(lengths, left))
        if at == 0:
            looked += 1
            if left == 0 and not dominated(pieces, 0, counts, lengths):
                yield 0, pieces
            elif left:
                held.append((left, pieces))
            continue
        n = lengths[at - 1]
        stack += [(left - k * n, at - 1, pieces + (n,) * k) for k in range(min(counts[n], left // n) + 1)]
    for left, pieces in sorted(held, key=lambda x: (x[0], len(x[1]))):
        if not dominated(pieces, left, counts, lengths):
            yield left, pieces
    if stack:
        yield None


@dataclass
class Packing:
    """Bins as (pieces, times); no packing has fewer than ``bound``; ``proved`` if none has fewer
    than this one."""

    bins: Bins
    bound: int
    proved: bool

    @property
    def made(self) -> int:
        return sum(times for _, times in self.bins)

    @property
    def gap(self) -> int:
        return 0 if self.proved else self.made - self.bound


def search(counts: dict[int, int], capacity: int, nodes: int = NODES, limit: int | None = FILLINGS) -> Packing:
    """The best packing of a count of pieces by length that ``nodes`` bins completed, each by one of
    the first ``limit`` fillings, can find. Each length must be 1 to ``capacity``. An empty count gives
    no bins."""
    counts = {n: c for n, c in counts.items() if c > 0}
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must be 1 to the capacity")
    found = Packing(best_fit(counts, capacity), lower_bound(counts, capacity), False)
    total, made_best = sum(n * c for n, c in counts.items()), found.made
    whole = True
    path: Bins = []

    def options(left: dict[int, int], wasted: int) -> Iterator[tuple[tuple[int, ...], int, int]]:
        """(pieces, times, room wasted by now) of the next bin."""
        nonlocal whole
        lengths = sorted(left)
        top = lengths[-1]
        rest = {n: c - (n == top) for n, c in left.items() if c > (n == top)}
        usable = lengths if top in rest else lengths[:-1]
        for option in fillings(rest, usable, capacity - top, limit):
            if option is None:
                whole = False
                return
            waste, others = option
            if wasted + waste > (made_best - 1) * capacity - total:
                continue  # a better packing has no room for so much waste
            pieces = (top, *others)
            most = min(left[n] // pieces.count(n) for n in set(pieces))
            for times in dict.fromkeys((most, 1)):
                yield pieces, times, wasted + times * waste

    stack = [(counts, 0, 0, options(counts, 0))] if counts else []
    while stack and made_best > found.bound and nodes > 0:
        left, made, wasted, more = stack[-1]
        del path[len(stack) - 1 :]
        step = next(more, None)
        if step is None:
            stack.pop()
            continue
        nodes -= 1
        pieces, times, wasted = step
        after = dict(left)
        for n in pieces:
            after[n] -= times
        after = {n: c for n, c in after.items() if c}
        made += times
        if wasted > (made_best - 1) * capacity - total or made + lower_bound(after, capacity) >= made_best:
            continue
        path.append((pieces, times))
        if after:
            stack.append((after, made, wasted, options(after, wasted)))
        else:
            found.bins, made_best = list(path), made
    found.proved = made_best == found.bound or (whole and not stack)
    return found


def pack_counts(counts: dict[int, int], capacity: int, nodes: int = NODES, limit: int | None = FILLINGS) -> Bins:
    """The bins of ``search``; a gap that it leaves is logged."""
    found = search(counts, capacity, nodes, limit)
    if found.gap:
        _log.info("packed into %d bins; %d is the least that is possible", found.made, found.bound)
    return found.bins


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a first
    one that may be shorter."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *[(s, capacity) for s in range(first, n, capacity)]]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end: int) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32."""

    tail = np.asarray([end], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in (part for b in it for part in slices(b, size=SLICE)):
            of, piece, start, length, crc = [], [], [], [], []
            ids, begins, ends = enc.encode_column(part.column("text"))
            body = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for i, (first, last) in enumerate(zip(begins.tolist(), ends.tolist())):
                n = last - first + 1
                for k, (s, m) in enumerate(cut(n, capacity)):
                    own = zlib.crc32(body[4 * (first + s) : 4 * min(first + s + m, last)])
                    of.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(tail, own) if s + m == n else own)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()),
                 *[pa.array(c, pa.int64()) for c in (start, length, crc)]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        batches, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length, runs of equal bins: (first rank, first sequence, pieces a bin, first offset)."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for filling, times in bins:
        offset = 0
        for n in dict.fromkeys(filling):
            k = filling.count(n)
            runs.setdefault(n, []).append((ranks.get(n, 0), sequence, k, offset))
            ranks[n] = ranks.get(n, 0) + k * times
            offset += k * n
        sequence += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r)) for n, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int = 2, nodes: int = NODES, limit: int | None = FILLINGS) -> DataFrame:
    """Every piece of every row of ``docs`` with its ``sequence_id`` and ``offset``.

    A null or empty text is one piece of the end token. Repeated rows are packed as often as they
    occur; an empty table gives an empty one. Other columns of ``docs`` are ignored.
    """
    cut_up = materialize(pieces(docs, tokenizer, capacity, end), "packing-pieces")
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    runs = places(pack_counts(counts, capacity, nodes, limit))
    ranked = gapless(cut_up, ["length"], ["doc_id", "piece"], "_rank", 20_000)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                firsts, sequences, per_bin, offsets = runs[int(n)]
                run = np.searchsorted(firsts, rank[mine], "right") - 1
                nth = rank[mine] - firsts[run]
                sequence[mine] = sequences[run] + nth // per_bin[run]
                offset[mine] = offsets[run] + nth % per_bin[run] * n
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(
        batches,
        f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_bin_completion(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
