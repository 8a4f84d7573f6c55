"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of neighbouring lines decides where a chunk ends, so the chunks of a
passage don't depend on what stands before it: after an insertion the boundaries fall into step
again. A chunk that occurs more than once in the corpus is compared byte by byte with the first
occurrence, by doc_id, row and place, and removed from everywhere else. The documents are written with a
row number first, so that rows of one doc_id, and rows alike in all, are told apart.

Passages are what chunks leave of a repeat: its edges, and runs in which no chunk lies. Two lines
with words that follow one another, over empty lines if need be, are a pair, the smallest chunk there
is. Where every pair of a run of lines occurred before, the run goes if it has over LONG_LINE words or
meets a chunk that goes. Pairs are compared byte by byte as chunks are: digests only choose which are
fetched. Of every line with words, the first occurrence stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .expressions import fresh
from .scratch import bucketed, materialize

#: Lines the rolling hash looks back on; one chunk end in DIVISOR lines; least and most lines of a
#: chunk; the words that a passage has more than, as the contract counts passages: a line of more is
#: a chunk of its own, as a passage pasted as one line is.
ROLL, DIVISOR, LEAST, MOST, LONG_LINE = 2, 2, 2, 64, 50
#: Kinds of marks.
CHUNK, PAIR = 0, 1
_MASK = (1 << 64) - 1
_PRIME = 0x9E3779B185EBCA87


def digest(body: bytes) -> bytes:
    return xxhash.xxh3_128_digest(body)


@lru_cache(1 << 16)
def _hash(line: bytes) -> int:
    return xxhash.xxh64_intdigest(line)


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, line after the last) of a document's chunks, which cover it."""
    out = []
    start = 0
    hashes = [_hash(x) for x in lines]
    for i, line in enumerate(lines):
        if len(line) > 2 * LONG_LINE and len(line.split()) > LONG_LINE:
            if i > start:
                out.append((start, i))
            out.append((i, i + 1))
            start = i + 1
            continue
        n = i + 1 - start
        if n < LEAST:
            continue
        rolled = 0
        for h in hashes[i + 1 - ROLL : i + 1]:
            rolled = ((rolled * _PRIME) ^ h) & _MASK
        rolled = rolled * _PRIME & _MASK
        if (rolled >> 40) % DIVISOR == 0 or n >= MOST:
            out.append((start, i + 1))
            start = i + 1
    if start < len(lines):
        out.append((start, len(lines)))
    return out


def removable(lines: list[bytes], start: int, end: int) -> bool:
    """Whether a chunk may go if it is repeated: two lines with words at least, or a long one."""
    worded = sum(1 for x in lines[start:end] if x.split())
    return worded >= LEAST or (end - start == 1 and len(lines[start].split()) > LONG_LINE)


def _worded(lines: list[bytes]) -> list[int]:
    return [i for i, x in enumerate(lines) if x and not x.isspace()]


def _pair(lines: list[bytes], worded: list[int], k: int) -> bytes:
    return lines[worded[k]] + b"\n" + lines[worded[k + 1]]


def mark_table(docs: DataFrame, whole: bool) -> DataFrame:
    """(doc_id, row, kind, at, hash, more) of every removable chunk (CHUNK) of ``docs`` (doc_id, row,
    text) and, if ``whole``, of every pair of lines (PAIR); hash and more are the halves of a digest
    of its bytes. A null text has none."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            of, kind, place, digests = [], [], [], []
            for i, t in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
                lines = t.split(b"\n") if t else []
                found = [(CHUNK, k, b"\n".join(lines[s:e])) for k, (s, e) in enumerate(chunks(lines)) if removable(lines, s, e)]
                if whole:
                    worded = _worded(lines)
                    found += [(PAIR, k, _pair(lines, worded, k)) for k in range(len(worded) - 1)]
                of += [i] * len(found)
                kind += [x[0] for x in found]
                place += [x[1] for x in found]
                digests += [digest(x[2]) for x in found]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("row").take(at), pa.array(kind, pa.int32()), pa.array(place, pa.int32()),
                 pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))],
                ["doc_id", "row", "kind", "at", "hash", "more"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "row", "text").mapInArrow(batches, f"doc_id {kind}, row long, kind int, at int, hash long, more long")


def _order():
    """Where something stands in the corpus; a null doc_id is the last."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row", "at")


def _firsts(table: DataFrame, by: list[str]) -> DataFrame:
    """(row, kind, at, is_first) of what occurs more than once by ``by``, with the columns ``by``."""
    first = materialize(
        table.groupBy(*by).agg(F.min(_order()).alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(*[F.col(c).alias(f"_{c}") for c in by], "_first"),
        "line-firsts",
    )
    same = [F.col(c) == F.col(f"_{c}") for c in by]
    # a plain join, which Spark can split at a hot chunk
    return table.join(first, same).select("row", "kind", "at", (_order() == F.col("_first")).alias("is_first"), *[c for c in by if c != "kind"])


def claims(lines: list[bytes], chunk_places: set[int], pairs: set[int]) -> list[int]:
    """Of the pairs that seem repeated, those that decide whether a passage goes: in runs that may go,
    outside the chunks that seem to go themselves."""
    inside = {i for k, (s, e) in enumerate(chunks(lines)) if k in chunk_places for i in range(s, e)}
    worded = _worded(lines)
    within = {k for k in range(len(worded) - 1) if worded[k] in inside and worded[k + 1] in inside}
    lost = passages(lines, inside, pairs | within)
    return [k for k in sorted(pairs - within) if worded[k] in lost and worded[k + 1] in lost]


def passages(lines: list[bytes], gone: set[int], repeated: set[int]) -> set[int]:
    """The lines of ``gone`` and those of the repeated passages. ``repeated`` has numbers of pairs."""
    worded = _worded(lines)
    out = set(gone)
    start = None
    for k in range(len(worded)):  # the last line starts no pair, so every run is closed
        on = k in repeated
        if on and start is None:
            start = k
        elif not on and start is not None:
            run = range(worded[start], worded[k] + 1)
            if not gone.isdisjoint(run) or sum(len(lines[i].split()) for i in run) > LONG_LINE:
                out.update(run)
            start = None
    return out


def bodies(held: DataFrame, row: str, repeated: DataFrame) -> DataFrame:
    """(doc_id, row, kind, at, body): the bytes of all chunks that seem repeated, of the claimed pairs
    and of the first of each pair."""
    mark = F.struct("kind", "at", "is_first")
    wanted = materialize(repeated.groupBy(F.col("row").alias("_of")).agg(F.collect_list(mark).alias("_marks")), "line-marks")
    joined = held.select("doc_id", F.col(row).alias("row"), "text").join(wanted.hint("shuffle_hash"), F.col("row") == F.col("_of"))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            of, kinds, place, text = [], [], [], []
            for i, (t, marks) in enumerate(zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("_marks").to_pylist())):
                lines = t.split(b"\n")
                worded, spans = _worded(lines), chunks(lines)
                seen = {kind: {m["at"] for m in marks if m["kind"] == kind and not m["is_first"]} for kind in (CHUNK, PAIR)}
                found = [(CHUNK, m["at"]) for m in marks if m["kind"] == CHUNK]
                found += [(PAIR, m["at"]) for m in marks if m["kind"] == PAIR and m["is_first"]]
                found += [(PAIR, k) for k in claims(lines, seen[CHUNK], seen[PAIR])] if seen[PAIR] else []
                for kind, k in found:
                    of.append(i)
                    kinds.append(kind)
                    place.append(k)
                    text.append(b"\n".join(lines[slice(*spans[k])]) if kind == CHUNK else _pair(lines, worded, k))
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(at), b.column("row").take(at), pa.array(kinds, pa.int32()), pa.array(place, pa.int32()), pa.array(text, pa.binary())],
                ["doc_id", "row", "kind", "at", "body"],
            )

    kind = held.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(batches, f"doc_id {kind}, row long, kind int, at int, body binary")


def repeats(held: DataFrame, row: str, whole: bool) -> DataFrame:
    """(row, kind, at) of the chunks that go and, if ``whole``, of the pairs that stood before.

    Digests are counted first, with partial sums before the shuffle; only what seems repeated is
    fetched as bytes, and grouping those by their bytes is the byte comparison, so a digest that two
    texts share by chance removes nothing.
    """
    narrow = held.select("doc_id", F.col(row).alias("row"), "text")
    marks = materialize(mark_table(narrow, whole), "line-marks")
    candidates = materialize(bodies(held, row, _firsts(marks, ["kind", "hash", "more"])), "line-candidates")
    gone = _firsts(candidates.withColumn("hash", F.xxhash64("body")), ["kind", "hash", "body"])
    return gone.filter(~F.col("is_first")).select("row", "kind", "at")


def dedup_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``docs`` with repeated chunks removed from ``text``, and n_lines, n_removed_lines; if
    ``whole``, with the repeated passages removed too.

    Every row stays. A null text stays null; a document wholly repeated is left with an empty text.
    Occurrences are ordered by doc_id, null being the last, then by row, then by place; of rows alike
    in all, one is the first. Rows that share a doc_id are documents of their own. Texts of any length
    are read whole; an empty table stays empty. Columns that are named like the added ones are
    replaced, any others kept.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    row, key, places, pairs = fresh(docs, "_row", "key", "places", "pairs")
    # dealt by rows once, so neither join below moves the texts
    held = bucketed(docs.select(*own).withColumn(row, F.monotonically_increasing_id()), row, "line-documents")
    at = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("at")))
    gone = repeats(held, row, whole).groupBy(F.col("row").alias(key)).agg(at(CHUNK).alias(places), at(PAIR).alias(pairs))
    # the same plan at every size: what goes is a share of all lines, so it outgrows a broadcast
    gone = materialize(gone, "line-repeats").hint("shuffle_hash")
    joined = held.join(gone, F.col(row) == F.col(key), "left").drop(row, key)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own.index("text")
        for b in it:
            texts, total, removed = [], [], []
            columns = (b.column(c).to_pylist() for c in (places, pairs))
            for t, drop, repeated in zip(b.column("text").cast(pa.binary()).to_pylist(), *columns):
                lines = t.split(b"\n") if t else []
                total.append(len(lines))
                left = 0
                if drop or repeated:
                    drop = set(drop)
                    out = {i for k, (s, e) in enumerate(chunks(lines)) if k in drop for i in range(s, e)}
                    if whole:
                        worded = _worded(lines)
                        within = {k for k in range(len(worded) - 1) if worded[k] in out and worded[k + 1] in out}
                        out = passages(lines, out, within.union(repeated))
                    stay = [x for i, x in enumerate(lines) if i not in out]
                    left = len(lines) - len(stay)
                    t = b"\n".join(stay)
                texts.append(t)
                removed.append(left)
            columns = [b.column(c) for c in own]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())],
                [*own, "n_lines", "n_removed_lines"],
            )

    fields = [f for f in held.schema.fields if f.name in own]
    schema = T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed_lines", T.LongType())])
    return joined.mapInArrow(batches, schema)


def op1_line_chunks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, whole=True)
