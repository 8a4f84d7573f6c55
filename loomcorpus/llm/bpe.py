"""Byte-level BPE by the ranks of a public vocabulary, and back.

A text is parted by the vocabulary's pattern, and each part is merged on its own: of all adjacent
pairs that a token stands for, the one of the lowest rank becomes that token, the leftmost first. The
pairs wait in a queue by rank: a bucket per rank holds the places of its pairs, and a hierarchical
bitmap over the ranks finds the first bucket that isn't empty by a find-first-set a level. The parts
are linked lists of symbols in arrays; a merge changes two neighbours and leaves the entries of their
former pairs where they are, to be skipped as stale. So a part of n bytes takes some n steps, each of
a bounded number of levels, which keeps runs of a million letters as cheap a byte as words.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of one worker's cache of parts, and characters beyond which a part isn't kept there.
CACHE, LONGEST = 800_000, 256
#: Characters from which a text's parts are taken in blocks, and parts of a block.
LONG, BLOCK = 1 << 20, 100_000


class RankQueue:
    """Buckets of places by rank under a bitmap of two levels, whose words have some square root of
    the ranks' number of bits: a find-first-set in ``top`` gives a word, one there gives a rank. It is
    empty between two parts."""

    def __init__(self, ranks: int):
        self.buckets: list[list[int]] = [[] for _ in range(ranks)]
        self.shift = max(1, (ranks - 1).bit_length() + 1 >> 1)
        self.words = [0] * ((ranks - 1 >> self.shift) + 1)
        self.bit = [1 << i for i in range(1 << self.shift)]


def merged(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """The tokens of one part."""
    if piece in ranks:
        return [ranks[piece]]
    rank_of, buckets, words, shift, bits = ranks.get, queue.buckets, queue.words, queue.shift, queue.bit
    low, top = len(bits) - 1, 0
    n = len(piece)
    # where the symbol at a place ends, and where the one before it starts
    after, before = list(range(1, n + 1)), list(range(-1, n))
    # the rank of the pair that starts at a place, if a symbol starts there and a token is its pair,
    # how many pairs have one, and the ranks whose buckets were filled
    due = [rank_of(piece[i : i + 2], -1) for i in range(n - 1)]
    due.append(-1)
    live, met = 0, []
    for i, rank in enumerate(due):
        if rank >= 0:
            live += 1
            bucket = buckets[rank]
            if not bucket:
                at = rank >> shift
                words[at] |= bits[rank & low]
                top |= 1 << at
                met.append(rank)
            bucket.append(i)
    while live:
        at = (top & -top).bit_length() - 1
        word = words[at]
        rank = (at << shift) + (word & -word).bit_length() - 1
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            words[at] = word = word & (word - 1)
            if not word:
                top &= top - 1
        if due[i] != rank:
            continue  # stale
        gone = after[i]
        past = after[i] = after[gone]
        left = before[i]
        live -= 1 + (due[gone] >= 0)
        due[gone] = due[i] = -1
        if past < n:
            before[past] = i
            due[i] = rank = rank_of(piece[i : after[past]], -1)
            if rank >= 0:
                live += 1
                bucket = buckets[rank]
                if not bucket:
                    at = rank >> shift
                    words[at] |= bits[rank & low]
                    top |= 1 << at
                    met.append(rank)
                heappush(bucket, i)
        if left >= 0:
            live -= due[left] >= 0
            due[left] = rank = rank_of(piece[left:past], -1)
            if rank >= 0:
                live += 1
                bucket = buckets[rank]
                if not bucket:
                    at = rank >> shift
                    words[at] |= bits[rank & low]
                    top |= 1 << at
                    met.append(rank)
                heappush(bucket, left)
    if top:  # only stale entries are left
        for rank in met:
            buckets[rank].clear()
            words[rank >> shift] = 0
    out, i = [], 0
    while i < n:
        past = after[i]
        out.append(ranks[piece[i:past]])
        i = past
    return out


class _Parts(dict):
    """Ids of parts as bytes; one that isn't there is merged. What was used since the cache was last
    half full stays when it is full."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.queue = ranks, RankQueue(max(ranks.values()) + 1)
        self.older: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            ids = np.array(merged(part.encode(), self.ranks, self.queue), "<u4").tobytes()
        if len(part) <= LONGEST:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Vocabulary:
    """A file of ranks and the pattern that parts texts."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError(f"{path} lacks a byte")
        tokens = {rank: token for token, rank in self.ranks.items()}
        self.tokens = pa.array([tokens.get(i) for i in range(max(tokens) + 1)], pa.binary())
        self.pattern = regex.compile(pattern)
        self.parts = _Parts(self.ranks)

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; a null text has none."""
        if not text:
            return b""
        ids = self.parts.__getitem__
        if len(text) < LONG:
            return b"".join(map(ids, self.pattern.findall(text)))
        found = (m.group() for m in self.pattern.finditer(text))
        return b"".join(iter(lambda: b"".join(map(ids, islice(found, BLOCK))), b""))

    def decode(self, ids: bytes | None) -> bytes | None:
        """The bytes that ids stand for. An id that isn't in the vocabulary is an error."""
        if not ids:
            return ids
        numbers = np.frombuffer(ids, "<u4")
        if numbers.max() >= len(self.tokens):
            raise KeyError(int(numbers.max()))
        found = self.tokens.take(pa.array(numbers))
        if found.null_count:
            raise KeyError(int(numbers[found.is_null().to_numpy(zero_copy_only=False)][0]))
        _, ends, data = found.buffers()
        return data[: int(np.frombuffer(ends, np.int32)[len(found)])].to_pybytes()


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    """One a worker process, so its cache outlives a task."""
    return Vocabulary(path, pattern)


def _binary(work: str, path: str, pattern: str):
    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = getattr(vocabulary(path, pattern), work)
        for column in batches:
            yield pa.array([each(x.as_py()) for x in column], pa.binary())

    return run


def encoded(text: Column, path: str, pattern: str) -> Column:
    """The ids of a column of texts, as little-endian unsigned 32-bit integers in a binary. A null
    or empty text has none; special tokens in a text are ordinary text. Texts are read whole, of any
    length; a row depends on nothing but its text, so repeated rows have the same ids."""
    return _binary("encode", path, pattern)(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes of a column of ids as ``encoded`` makes them; null for null. They need not be
    UTF-8, as ids may end within a character."""
    return _binary("decode", path, pattern)(ids)


def encoded_and_decoded(text: Column, path: str, pattern: str) -> Column:
    """A struct of ``ids`` as ``encoded`` makes them and the ``bytes`` that ``decoded`` makes of those.
    One worker does both, so a task holds one vocabulary and the ids don't travel between two."""

    @F.arrow_udf("ids binary, bytes binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(path, pattern)
        for column in batches:
            ids = pa.array((v.encode(x.as_py()) for x in column), pa.binary(), size=len(column))
            back = pa.array((v.decode(x.as_py()) for x in ids), pa.binary(), size=len(column))
            yield pa.StructArray.from_arrays([ids, back], ["ids", "bytes"])

    return run(text)


def multilingual() -> tuple[str, str]:
    """The file and pattern of the public vocabulary for many languages."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op11_bitmap_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = docs.select("doc_id", encoded_and_decoded(F.col("text"), *multilingual()).alias("both"))
    return both.select(
        "doc_id", (F.octet_length("both.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("both.ids", 256).alias("ids_sha256"), F.sha2("both.bytes", 256).alias("decoded_sha256"),
    )
