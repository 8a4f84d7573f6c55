"""License scans by ordered signature rules.

Rules are tried only where one of their keywords is among the text's words; every match holds one.
Matches are taken in order of priority, then length, then place; one that lies inside a match taken
before is suppressed.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from .license_rules import Rule, rules

#: Base phrases (fixed values): words and label.
BASE = ((("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl"))
_BASE = [(tuple(w.encode() for w in words), label) for words, label in BASE]
_APART = bytes(c if c >= 128 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))
_OUT = pa.schema(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())]
)


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z."""
    return text.lower().translate(_APART).split() if text else []


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase's words stand consecutively."""
    found = []
    at = -1
    for _ in range(words.count(b"license")):
        at = words.index(b"license", at + 1)
        for phrase, label in _BASE:
            start = at - len(phrase) + 1
            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                found.append((start, label))
    return found


@lru_cache(1)
def _by_keyword() -> dict[str, list[Rule]]:
    ordered = sorted(((k, r) for r in rules() for k in r.keywords), key=lambda x: x[0])
    return {k: [r for _, r in g] for k, g in groupby(ordered, key=lambda x: x[0])}


def detect(words: list[bytes]) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) of the matches that stay, as offsets into the words joined by spaces."""
    text = b" ".join(words).decode("utf-8", "replace")
    # split as the regexes see it: spaces beyond ASCII part words too
    tried = dict.fromkeys(r for k in _by_keyword().keys() & set(text.split()) for r in _by_keyword()[k])
    return _kept(text, tried)


def _kept(text: str, tried: Iterable[Rule]) -> list[tuple[int, int, Rule]]:
    found = [(m.start(), m.end(), rule) for rule in tried for m in rule.pattern.finditer(text)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
    kept: list[tuple[int, int, Rule]] = []
    # of the kept intervals those in no other, whose starts and ends both ascend
    starts: list[int] = []
    ends: list[int] = []
    for start, end, rule in found:
        at = bisect_right(starts, start)
        if at and ends[at - 1] >= end:
            continue
        kept.append((start, end, rule))
        low, high = bisect_left(starts, start), bisect_right(ends, end)
        starts[low:high], ends[low:high] = [start], [end]
    return kept


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, base places, labels and score.

    The score is the chance that one detection at least is right, were their confidences
    independent; 0 without any label. A null text is an empty one; a text of any length is read
    whole. Repeated rows give repeated results, an empty table an empty one; other columns are
    ignored. Of matches of equal priority the longest goes first, of equally long ones the first in
    the text, of rules that match alike the one whose label is first in the alphabet.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                words = words_of(text)
                places = base_places(words)
                kept = detect(words)
                base = {label for _, label in places}
                miss = 1.0
                for _, _, rule in kept:
                    miss *= 1 - rule.confidence
                starts = [s for s, _ in places]
                rows.append(
                    (len(words), len(places), min(starts, default=None), max(starts, default=None),
                     ",".join(sorted(base)), ",".join(sorted(base | {r.label for _, _, r in kept})),
                     round(max(1 - miss, 0.6 if base else 0.0), 9), len(kept))
                )
            columns = list(zip(*rows)) or [[] for _ in _OUT]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, _OUT)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *_OUT.names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        batches,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, "
        "labels string, score double, n_detections long",
    )


def op10_license_signatures(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
