"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over the benchmark's telling terms, weighted by document frequencies of
the whole corpus. A randomised SVD, whose products with the passage matrix are summed over
partitions, gives their latent space. Every document is then read whole: windows around its telling
terms are projected, windows near an item by cosine become candidates, and a candidate is a leak if
the longest common subsequence of words covers enough of the item, less being enough if the item's
answer stands there too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import materialize
from .words import batch_words, slices, word_hashes

#: Items that share a latent space, no more than twice its dimensions, or short items drown in it;
#: items searched for in one reading of the documents, which bounds what is broadcast.
SPACE_ITEMS, SCAN_ITEMS = 256, 4096
#: Characters of the items of one reading and words of those of one latent space, at most; a longer
#: item is alone.
SCAN_CHARS, SPACE_WORDS = 8 << 20, 1 << 17
#: Terms in more than this share of documents tell little; each item keeps its rarest few anyway.
COMMON, RAREST = 0.02, 6
#: Dimensions kept, dimensions drawn beyond those, rounds of power iteration.
RANK, SPARE, ROUNDS = 128, 16, 2
#: Passages of the documents for each item's weight in the fitted matrix, at most, or items drown in
#: a large corpus; entries of that matrix that are multiplied at once.
ITEM_SHARE, ENTRIES = 50, 16384
WINDOW = 64
COSINE, SURE, LIKELY = 0.3, 0.75, 0.55
ANSWER_WORDS = 5


@dataclass(frozen=True)
class Item:
    item_id: object
    words: np.ndarray
    answer: np.ndarray
    counts: dict[int, int]


def items_of(rows: list) -> list[Item]:
    """Items with words. The answer is the ``answer`` column's text if there is one, else the last
    words of the item."""
    out = []
    for r in rows:
        h = word_hashes(r["text"])
        if len(h):
            given = word_hashes(r["answer"]) if "answer" in r.asDict() else h[:0]
            answer = given if len(given) else h[-ANSWER_WORDS:]
            out.append(Item(r["item_id"], h, answer, dict(Counter(h.tolist()))))
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of integers."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        m = row & at.get(x, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


class Lookup:
    """Places of a sorted array's hashes among many. Most words are ruled out by their first bits."""

    def __init__(self, terms: np.ndarray):
        self.terms = terms
        self.mask = np.zeros(1 << 18, bool)
        self.mask[terms >> np.uint64(46)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are terms, and which terms."""
        if not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        places = np.flatnonzero(self.mask[h >> np.uint64(46)])
        at = np.minimum(np.searchsorted(self.terms, h[places]), len(self.terms) - 1)
        right = self.terms[at] == h[places]
        return places[right], at[right]


def document_frequencies(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How many documents have each word of ``vocabulary``, and how many there are. Tasks send
    sums; the result is as long as the vocabulary, which SCAN_ITEMS bounds."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, total, n = Lookup(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for b in it:
            for part in slices(b):
                flat, places = batch_words(part.column("text"))
                where, term = lookup.hits(flat)
                row = np.searchsorted(places, where, "right")
                total += np.bincount(np.unique(row * len(vocabulary) + term) % len(vocabulary), minlength=len(vocabulary))
                n += part.num_rows
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*met, -1], pa.int64()), pa.array([*total[met], n], pa.int64())], ["term", "n"])

    rows = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(len(vocabulary), np.int64)
    for term, n in rows:
        if term >= 0:
            counts[term] = n
    return counts, sum(n for term, n in rows if term < 0)


class Space(Lookup):
    """Telling terms, their weights and the latent basis."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray, basis: np.ndarray):
        super().__init__(terms)
        self.weights, self.basis = weights, basis

    def project(self, h: np.ndarray) -> np.ndarray:
        """The unit vector of a passage, or zeros."""
        _, columns = self.hits(h)
        v = (self.basis[columns] * self.weights[columns, None]).sum(0)
        norm = np.linalg.norm(v)
        return v / norm if norm > 0 else v


_PASSAGES = "n long, start binary, term binary, tf binary"


def passage_rows(flat: np.ndarray, places: np.ndarray, terms: Lookup) -> list:
    """The passages of some texts that have one of ``terms`` as sparse rows: how many, where each
    starts, the terms' places and how often they occur."""
    where, term = terms.hits(flat)
    text = np.searchsorted(places, where, "right") - 1
    first = np.concatenate([[0], np.cumsum(-(-np.diff(places) // WINDOW))])
    passage = first[text] + (where - places[text]) // WINDOW
    pairs, tf = np.unique(passage * max(1, len(terms.terms)) + term, return_counts=True)
    passage, term = np.divmod(pairs, max(1, len(terms.terms)))
    start = np.flatnonzero(np.diff(passage, prepend=-1))
    return [len(start), start.astype(np.int64).tobytes(), term.astype(np.int32).tobytes(), tf.astype(np.int32).tobytes()]


def fit(passages: DataFrame, items: list[list], weight: float, every: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Space:
    """The leading right singular vectors of the TF-IDF matrix A of all passages and of ``items``,
    which count ``weight`` times, by randomised range finding: each round sums A'(A Q) over
    partitions in slabs of terms and orthonormalises. Rows have places in ``every``, of whose terms
    ``terms`` are some. The matrices that reach the driver are terms by rank, which a block of items
    bounds."""
    rank = min(RANK + SPARE, len(terms))
    own = np.full(len(every), -1, np.int64)
    own[np.searchsorted(every, terms)] = np.arange(len(terms))
    slab = 512

    def add(out: np.ndarray, q: np.ndarray, row: list) -> None:
        n, start, term, tf = row
        column = own[np.frombuffer(term, np.int32)]
        at = np.repeat(np.arange(n), np.diff([*np.frombuffer(start, np.int64), len(column)]))
        has = column >= 0
        at, column, x = at[has], column[has], np.frombuffer(tf, np.int32)[has] * weights[column[has]]
        x = x / np.maximum(np.sqrt(np.bincount(at, weights=x * x, minlength=n)), 1e-12)[at]
        cuts = [0]
        while cuts[-1] < len(at):  # whole passages, about ENTRIES at once
            end = min(cuts[-1] + ENTRIES, len(at))
            cuts.append(int(np.searchsorted(at, at[end - 1], "right")))
        for a, z in zip(cuts, cuts[1:]):
            of, c, v = at[a:z], column[a:z], x[a:z, None]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            y = np.add.reduceat(v * q[c], starts, axis=0)
            back = v * np.repeat(y, np.diff([*starts, len(of)]), axis=0)
            order = np.argsort(c, kind="stable")
            firsts = np.flatnonzero(np.diff(c[order], prepend=-1))
            out[c[order][firsts]] += np.add.reduceat(back[order], firsts, axis=0)

    def product(q: np.ndarray) -> np.ndarray:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(q.shape)
            for b in it:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    add(out, q, row)
            at = list(range(0, len(q), slab))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.int64()), pa.array([out[i : i + slab].tobytes() for i in at], pa.binary())], ["slab", "sum"]
            )

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x) for x in pdf["sum"])
            return pd.DataFrame({"slab": pdf["slab"].iloc[:1], "sum": [total.tobytes()]})

        parts = passages.mapInArrow(run, "slab long, sum binary").groupBy("slab").applyInPandas(added, "slab long, sum binary")
        mine = np.zeros(q.shape)
        for row in items:
            add(mine, q, row)
        found = [np.frombuffer(r["sum"]) for r in sorted(parts.collect())]
        return weight * mine + (np.concatenate(found).reshape(q.shape) if found else 0)

    q = np.random.default_rng(7).standard_normal((len(terms), rank))
    for _ in range(ROUNDS + 1):
        q = np.linalg.qr(product(q))[0]
    values, turn = np.linalg.eigh(q.T @ product(q))
    basis = (q @ turn[:, ::-1])[:, :RANK]
    return Space(terms, weights.astype(np.float32), np.ascontiguousarray(basis, np.float32))


class Group:
    """Items that share a space: their vectors there and which of their words each has."""

    def __init__(self, space: Space, items: list[Item]):
        self.space, self.items = space, items
        self.targets = np.stack([space.project(i.words) for i in items]).astype(np.float32)
        self.words = Lookup(np.unique(np.concatenate([i.words for i in items])))
        self.sizes = np.array([len(i.words) for i in items])
        self.has = np.zeros((len(items), len(self.words.terms)), bool)
        for k, item in enumerate(items):
            self.has[k, np.searchsorted(self.words.terms, item.words)] = True

    def stretch(self, place: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the text around a place is read for an item: it reaches past any passage that
        starts a little later."""
        n = self.sizes[item]
        return np.maximum(begin, place - n), np.minimum(end, place + n + n // 4 + 1)


def near_items(flat: np.ndarray, places: np.ndarray, space: Space, targets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(texts, places in ``flat``, targets, cosines) of the windows that are near a target, in the
    order of places. A window starts at a telling term and ends with its text at the latest."""
    at_terms, columns = space.hits(flat)
    text = np.searchsorted(places, at_terms, "right") - 1
    past = np.searchsorted(at_terms, np.minimum(at_terms + WINDOW, places[text + 1]))
    for at in range(0, len(at_terms), 2048):
        last = min(at + 2048, len(at_terms))
        mine = columns[at : past[last - 1]]
        summed = np.zeros((len(mine) + 1, space.basis.shape[1]), np.float32)
        np.cumsum(space.basis[mine] * space.weights[mine, None], axis=0, out=summed[1:])
        v = summed[past[at:last] - at] - summed[: last - at]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
        near = v @ targets.T
        rows, found = np.nonzero(near >= COSINE)
        yield text[at + rows], at_terms[at + rows], found, near[rows, found]


def candidates(flat: np.ndarray, places: np.ndarray, group: Group) -> Iterator[tuple[int, int, int, float, int, int]]:
    """(text, place, item, cosine, start, end) of near windows whose stretch has enough places with
    words of the item: a common subsequence has no more."""
    at_words, word = group.words.hits(flat)
    for text, place, item, cosine in near_items(flat, places, group.space, group.targets):
        start, end = group.stretch(place, item, places[text], places[text + 1])
        low, high = np.searchsorted(at_words, start), np.searchsorted(at_words, end)
        least = LIKELY * group.sizes[item]
        open_ = np.flatnonzero(high - low >= least)
        step = max(1, 500_000 // int((high - low).max(initial=1)))
        for k in range(0, len(open_), step):
            some = open_[k : k + step]
            n = high[some] - low[some]
            first = np.cumsum(n) - n
            at = np.repeat(low[some] - first, n) + np.arange(n.sum())
            met = np.add.reduceat(group.has[np.repeat(item[some], n), word[at]], first, dtype=np.int64)
            some = some[met >= least[some]]
            yield from zip(*(x[some].tolist() for x in (text, place, item, cosine, start, end)))


def leaks_in(flat: np.ndarray, places: np.ndarray, group: Group) -> list[tuple]:
    """(text, item number, cosine, share of the item's words, answer found, first word, word after
    the last) of the leaks in some texts, the best of each text and item; of equally good ones the
    first."""
    best: dict[tuple[int, int], tuple] = {}
    tried: dict[tuple[int, int], int] = {}
    for text, place, i, cosine, start, end in candidates(flat, places, group):
        item, key = group.items[i], (text, i)
        n = len(item.words)
        if place - tried.get(key, -n) <= n // 4 or (key in best and best[key][1] == 1.0):
            continue
        tried[key] = place
        begin = int(places[text])
        first = flat[start:end]
        present = item.counts.keys() & set(first.tolist())
        if sum(item.counts[w] for w in present) < LIKELY * n:  # no subsequence can be longer
            continue
        if common_subsequence(item.words, first) < LIKELY * n:
            continue
        # the tightest stretch: the subsequence must not be picked from far apart
        width = n + n // 4 + 2
        for s in range(0, max(1, len(first) - n + 1), max(1, n // 8)):
            part = first[s : s + width]
            share = common_subsequence(item.words, part) / n
            answer = common_subsequence(item.answer, part) >= 0.8 * len(item.answer)
            if (share >= SURE or (share >= LIKELY and answer)) and (key not in best or share > best[key][1]):
                best[key] = (cosine, share, bool(answer), start + s - begin, start + s + len(part) - begin)
    return [(*key, *v) for key, v in sorted(best.items())]


def lots(rows: Iterable, most: int, chars: int, size: Callable) -> Iterator[list]:
    """The rows in turn, in lots of at most ``most`` rows and ``chars`` characters or one row."""
    lot, held = [], 0
    for r in rows:
        n = size(r)
        if lot and (len(lot) == most or held + n > chars):
            yield lot
            lot, held = [], 0
        lot.append(r)
        held += n
    if lot:
        yield lot


def _groups(docs: DataFrame, items: list[Item]) -> list[Group]:
    """The items in groups of at most SPACE_ITEMS, each with its latent space."""
    vocabulary = np.unique(np.concatenate([i.words for i in items]))
    df, n = document_frequencies(docs, vocabulary)
    idf = np.maximum(np.log((n + 1) / (df + 0.5)), 1e-3)

    groups, telling = [], np.zeros(len(vocabulary), bool)
    for group in lots(items, SPACE_ITEMS, SPACE_WORDS, lambda i: len(i.words)):
        at = np.searchsorted(vocabulary, np.unique(np.concatenate([i.words for i in group])))
        tells = df[at] <= COMMON * n
        for item in group:
            mine = np.searchsorted(vocabulary[at], np.unique(item.words))
            tells[mine[np.argsort(df[at][mine], kind="stable")[:RAREST]]] = True
        groups.append((group, at[tells]))
        telling[at[tells]] = True
    every = vocabulary[telling]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(every)
        for b in it:
            for part in slices(b):
                rows = passage_rows(*batch_words(part.column("text")), lookup)
                yield pa.RecordBatch.from_pylist([dict(zip(("n", "start", "term", "tf"), rows))])

    # the telling terms of all passages of all documents, once for all groups
    passages = materialize(docs.select("text").mapInArrow(cut, _PASSAGES), "lsa-passages")
    count = passages.agg(F.sum("n")).first()[0] or 0
    out = []
    for group, at in groups:
        rows = [passage_rows(i.words, np.array([0, len(i.words)]), Lookup(every)) for i in group]
        weight = max(1.0, count / (ITEM_SHARE * len(group)))
        out.append(Group(fit(passages, rows, weight, every, vocabulary[at], idf[at]), group))
    return out


def _search(docs: DataFrame, items: list[Item], item_type: T.DataType) -> DataFrame:
    """What is found of one lot, written, so that the lot's groups can go before the next one's come."""
    groups = docs.sparkSession.sparkContext.broadcast(_groups(docs, items))
    schema = _found_schema(docs, item_type)
    item_kind = to_arrow_type(item_type)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b):
                flat, places = batch_words(part.column("text"))
                out = [
                    (text, group.items[i].item_id, *rest)
                    for group in groups.value
                    for text, i, *rest in leaks_in(flat, places, group)
                ]
                of, ids, cosine, covered, answer, first, end = zip(*out) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(of, pa.int64())), pa.array(ids, item_kind), pa.array(cosine, pa.float64()),
                     pa.array(covered, pa.float64()), pa.array(answer, pa.bool_()), pa.array(first, pa.int64()), pa.array(end, pa.int64())],
                    schema.names,
                )

    found = materialize(docs.select("doc_id", "text").mapInArrow(run, schema), "lsa-found")
    groups.destroy()
    return found


def _found_schema(docs: DataFrame, item_type: T.DataType) -> T.StructType:
    rest = "cosine double, covered double, answer_found boolean, first_word long, end_word long"
    ids = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item_type)]
    return T.StructType([*ids, *T.StructType.fromDDL(rest)])


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item (item_id, text and, if it has one, answer) that
    leaked into it: the best covered stretch, of equally covered ones the first.

    Null and empty texts and items match nothing. Repeated documents and items give repeated
    results; other columns of either table are ignored, and texts of any length are read whole. The
    benchmark comes to the driver at most SCAN_ITEMS items and SCAN_CHARS characters at a time; each
    lot is searched for in one reading of the documents and written before the next one is read.
    """
    columns = ["item_id", "text", *(["answer"] if "answer" in benchmark.columns else [])]
    rows = benchmark.select(*columns)
    item_type = rows.schema["item_id"].dataType
    every = lots(rows.toLocalIterator(), SCAN_ITEMS, SCAN_CHARS, lambda r: len(r["text"] or ""))
    found = [_search(docs, items, item_type) for items in map(items_of, every) if items]
    none = docs.sparkSession.createDataFrame([], _found_schema(docs, item_type))
    return reduce(DataFrame.unionByName, found) if found else none


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document has no leak, with their own columns."""
    leaked = materialize(find_leaks(docs, benchmark).select("doc_id").distinct(), "lsa-leaks")
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["doc_id"]), "left_anti")


def op3_latent_leaks(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
