"""Chunks of texts, turns and cues: units and texts as columns, where chunks end from sums of sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, context_flags, strip
from ..functions.urls import stable_id
from .folds import Rule, folded
from .ordered import fresh

#: Rows of a batch that are taken apart at once.
ROWS = 128
_ENDS, _SOFT = "。！？!?；;.", "。！？；，.,;"
_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
_WHOLE = r"^(?:#|- |\* |• )"


def units(text: Column, most: int) -> Column:
    """The units of a text in order: headings and list lines whole, other lines by sentences, what is
    longer than ``most`` characters in pieces, cut after the last soft mark past the middle if there
    is one. Units have no white space at their ends and aren't empty; a null text has none."""
    filled = lambda a: F.filter(a, lambda x: x != "")
    lines = filled(F.transform(F.split(F.coalesce(text, F.lit("")), _LINES), strip))
    sentences = lambda x: filled(F.transform(F.split(x, rf"(?<=[{_ENDS}])"), strip))
    flat = F.flatten(F.transform(lines, lambda x: F.when(x.rlike(_WHOLE), F.array(x)).otherwise(sentences(x))))
    piece = rf"{SPACE}*+((?s:.{{1,{most}}}\z|.{{{most // 2},{most - 1}}}[{re.escape(_SOFT)}]|.{{{most}}}))"
    pieces = lambda x: F.transform(F.regexp_extract_all(x, F.lit(piece), F.lit(1)), strip)
    return F.flatten(F.transform(flat, lambda x: F.when(F.length(x) <= most, F.array(x)).otherwise(pieces(x))))


def text_spans(sizes: np.ndarray, target: int, most: int, overlap: int) -> tuple[list[tuple[int, int]], int]:
    """(first unit, unit after the last) of the chunks of units of these sizes, and where the units
    start that are left. A chunk ends once it has ``target`` characters, its units being joined by one
    each, or where the next unit would take it over ``most``; it shares the units with the chunk
    before that have ``overlap`` characters or fewer, one at least, and has one more at least."""
    joined, plain = (np.concatenate([[0], np.cumsum(x)]) for x in (sizes + 1, sizes))
    n, spans, start, new = len(sizes), [], 0, 0
    size = lambda end: joined[end] - joined[start] - 1
    shared = lambda end: max(start, min(end - 1, int(np.searchsorted(plain, plain[end] - overlap))))
    while new < n:
        reached = np.searchsorted(joined, joined[start] + 1 + target)
        fits = np.searchsorted(joined, joined[start] + 1 + most, "right") - 1
        end = int(min(max(min(reached, fits), new + 1), n))
        full = size(end) >= target
        if end == n and not full:
            break
        spans.append((start, end))
        start, new = shared(end), end
        if full and end < n and size(end + 1) > most:  # nothing more fits what is shared
            spans.append((start, end))
            start = shared(end)
    return spans, start


def with_chunks(df: DataFrame, text: str, out: str = "chunks", target: int = 700, least: int = 500, most: int = 900, overlap: int = 100) -> DataFrame:
    """``df`` with the chunks of a text, by ``units`` and ``text_spans``. Units that are left and have
    fewer than ``least`` characters join the last chunk if both fit ``most``, and are left out if it
    has them; otherwise they are a chunk. Chunks are distinct; a null or empty text has none."""
    if not 0 < overlap < least <= target <= most:
        raise ValueError("sizes must be 0 < overlap < least <= target <= most")

    kind = pa.struct([("full", pa.list_(pa.string())), ("rest", pa.string())])

    @F.arrow_udf("struct<full: array<string>, rest: string>")
    def joined(column: pa.Array) -> pa.Array:
        made = [pa.array([], kind)]
        for at in range(0, len(column), ROWS):  # as Python's strings, a few rows are held at once
            rows = []
            for x in column.slice(at, ROWS):
                own = x.as_py()
                found, rest = text_spans(np.array([len(u) for u in own], np.int64), target, most, overlap)
                rows.append({"full": ["\n".join(own[s:e]) for s, e in found], "rest": "\n".join(own[rest:])})
            made.append(pa.array(rows, kind))
        return pa.concat_arrays(made)

    made, full, rest = fresh(df, "_made", "_full", "_rest")
    df = df.withColumn(made, joined(units(F.col(text), most)))
    df = df.withColumns({full: F.col(made)["full"], rest: F.col(made)["rest"]})
    last = F.try_element_at(F.col(full), F.lit(-1))
    both, more = F.concat_ws("\n", last, rest), F.array_append(full, F.col(rest))
    short = F.when(F.length(both) <= most, F.array_append(F.slice(full, F.lit(1), F.size(full) - 1), both)).when(last.contains(F.col(rest)), F.col(full)).otherwise(more)
    settled = F.when(F.col(rest) == "", F.col(full)).when(F.size(full) == 0, more).when(F.length(rest) < least, short).when(last == F.col(rest), F.col(full)).otherwise(more)
    return df.withColumn(out, F.array_distinct(settled)).drop(made, full, rest)


def chunk_documents(docs: DataFrame, key: str, text: str, **sizes: int) -> DataFrame:
    """(key, position, chunk) of every document."""
    held = with_chunks(docs.select(key, text), text, "_chunks", **sizes)
    return held.select(key, F.posexplode("_chunks").alias("position", "chunk"))


def build_chunks(docs: DataFrame, key: str, text: str, tier: Column, status: str, catalog: Mapping[str, Sequence[str]], **sizes: int) -> DataFrame:
    """(chunk_id, key, position, chunk, tier, and an array for each of ``catalog``) of the accepted
    documents: a stable id from the document and place, and the catalog's terms that a chunk has."""
    accepted = docs.filter(F.col(status) == "accepted")
    made = chunk_documents(accepted, key, text, **sizes).join(accepted.select(F.col(key).alias("_k"), tier.alias("tier")), F.col(key) == F.col("_k")).drop("_k")
    name = stable_id("chunk", F.concat_ws(":", F.col(key).cast("string"), F.col("position").cast("string"), F.md5("chunk")))
    return made.select(name.alias("chunk_id"), key, "position", "chunk", "tier", *[context_flags(F.col("chunk"), terms).alias(c) for c, terms in catalog.items()])


def split_long_units(text: Column, most: int) -> Column:
    """Hard pieces of one long unit, as a column: up to ``most`` characters, cut after a soft mark
    past the middle where there is one."""
    soft = rf"[{re.escape(_SOFT)}]"
    pattern = rf"(?s)(?:.{{1,{most}}}\z|.{{{most // 2},{most - 1}}}{soft}|.{{{most}}})"
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def chunk_turns(turns: DataFrame, key: str, order: str, size: Column, whole: int = 1200, least: int = 600, most: int = 1000, overlap: int = 3) -> DataFrame:
    """``turns`` with the ``group`` of each chunk that a turn is in: chunks are parted between turns
    only, of ``least`` to ``most`` characters, each starting ``overlap`` turns before the end of the
    one before; all is one chunk where it has under ``whole``."""
    return folded(turns, key, order, size, Rule(least, most, overlap), whole)


def chunk_cues(cues: DataFrame, key: str, order: str, size: Column, limit: int = 450) -> DataFrame:
    """``cues`` with the ``group`` of their chunk, which ends once it has ``limit`` characters."""
    return folded(cues, key, order, size, Rule(limit, limit, 0))
