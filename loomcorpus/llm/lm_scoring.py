"""LM scoring by deleted interpolation.

A token's probability mixes the maximum-likelihood estimates after the word before it and, in a model
of order 3, the two before it, with the unigram estimate and a uniform one. The weights depend on how
often the contexts were seen, by octaves of their counts, and are learned by expectation-maximisation on a deleted part of the training texts,
against estimates from the rest; the estimates then use all of the training texts.

Counts cover the whole corpus and are never gathered. Tasks work on blocks of texts. A block sends
each distinct word, pair and triple once, by hash, with its counts in the block, to the hash's part;
the part adds up all blocks' counts and answers each block in the block's own order. So a word that
is in every text costs a part one entry a block. The blocks' token sequences meet the answers, and
what is kept for scoring is written once. Words are told apart by 64-bit hashes; pairs and triples,
within a part, whose size is the same at every size of the corpus, by 40 bits, so that about one in
half a million shares another's counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import materialize
from .words import batch_words, mixed, slices

#: Tokens of a block, about; bytes of text for each part; octaves of context counts.
BLOCK_TOKENS, PART_BYTES, OCTAVES = 1_000_000, 8_000_000, 26
#: Words have no spaces, so these are none.
_END, _START, _BEFORE = (np.uint64(xxhash.xxh64_intdigest(x)) for x in (b" end", b" start", b" before the start"))
#: Tokens that the weights of all contexts count for in each class of contexts; most rounds of EM, and
#: the change of a weight below which they end.
_PRIOR, _ITERATIONS, _STILL = 100.0, 30, 1e-3


def planes(a: np.ndarray) -> bytes:
    """An array, compressed with the lowest bytes of all its numbers first, then the next."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unplanes(b: bytes, kind: type) -> np.ndarray:
    raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def remainder(doc_id) -> int:
    """crc32 of the id as text, modulo 5; -1 for a null id, which counts as training."""
    return -1 if doc_id is None else zlib.crc32(str(doc_id).encode()) % 5


class Grams:
    """A block's tokens as pairs and, for order 3, triples, numbered in the order of (part, key)."""

    def __init__(self, tokens: np.ndarray, lengths: np.ndarray, start: int, names: np.ndarray, parts: int, order: int = 3):
        first = np.cumsum(lengths) - lengths
        self.before = _shifted(tokens, first, start)
        self.pairs, self.pair, whole = _numbered(self.before, tokens, names, names, parts)
        self.longer = {2: (self.pairs, self.pair)}
        if order == 3:
            self.context = _shifted(self.pair, first, len(self.pairs))  # the pair before a token
            self.triples, self.triple, _ = _numbered(self.context, tokens, np.append(whole, _BEFORE), names, parts)
            self.longer[3] = (self.triples, self.triple)


def _shifted(a: np.ndarray, first: np.ndarray, fill: int) -> np.ndarray:
    out = np.empty(len(a), np.int64)
    out[1:] = a[:-1]
    out[first] = fill
    return out


def _numbered(left: np.ndarray, right: np.ndarray, left_names: np.ndarray, names: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """The hashes' (part, key) of the distinct (left, right) in order, as one number each, every
    token's place there, and the hashes themselves."""
    codes, inverse = np.unique(left * len(names) + right, return_inverse=True)
    u, w = np.divmod(codes, len(names))
    hashes = mixed(mixed(left_names[u]) ^ (names[w] * np.uint64(0x9E3779B97F4A7C15)))
    part, key = hashes % np.uint64(parts), hashes >> np.uint64(24)
    order = np.lexsort((key, part))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return np.stack([part, key])[:, order].T, rank[inverse], hashes[order]


class Block:
    """Texts as sequences of local word numbers; words are numbered in order of (part, hash)."""

    def __init__(self, texts: list[tuple[object, np.ndarray]], parts: int):
        self.ids = [i for i, _ in texts]
        self.rest = np.array([remainder(i) for i in self.ids])
        self.lengths = np.array([len(h) for _, h in texts])
        flat = np.concatenate([h for _, h in texts])
        names, inverse = np.unique(flat, return_inverse=True)
        names = np.append(names, _START)
        order = np.lexsort((names, names % np.uint64(parts)))
        self.names = names[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.tokens, self.start = rank[inverse].astype(np.int32), int(rank[-1])
        self.parts = parts

    def requests(self, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(order, part, keys, training counts, counts in the deleted part)."""
        per_token = np.repeat(self.rest, self.lengths)
        train, deleted = per_token != 1, per_token == 2
        g = Grams(self.tokens, self.lengths, self.start, self.names, self.parts, order)
        words = np.stack([self.names % np.uint64(self.parts), self.names]).T
        for n, (keys, place) in ({1: (words, self.tokens)} | g.longer).items():
            c, h = (np.bincount(place[keep], minlength=len(keys)) for keep in (train, deleted))
            if n == 1:
                c[self.start], h[self.start] = (self.rest != 1).sum(), (self.rest == 2).sum()
            part = keys[:, 0].astype(np.int64)
            met, first = np.unique(part, return_index=True)
            for p, a, z in zip(met.tolist(), first, [*first[1:], len(part)]):
                yield n, p, keys[a:z, 1], c[a:z], h[a:z]


def _blocks(it: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[int, Block]]:
    """Blocks of a partition's rows in order, each named by a hash of what it holds. A text longer
    than a block is a block of its own."""

    def closed(held: list[tuple[object, np.ndarray]]) -> tuple[int, Block]:
        name = xxhash.xxh64(repr([i for i, _ in held]).encode())
        for _, h in held:
            name.update(h.tobytes())
        return name.intdigest() >> 1, Block(held, parts)

    held: list[tuple[object, np.ndarray]] = []
    tokens = 0
    for b in it:
        for part in slices(b):
            flat, places = batch_words(part.column("text"))
            for i, first, past in zip(part.column("doc_id").to_pylist(), places, places[1:]):
                held.append((i, np.append(flat[first:past], _END)))
                tokens += past - first + 1
                if tokens >= BLOCK_TOKENS:
                    yield closed(held)
                    held, tokens = [], 0
    if held:
        yield closed(held)


def _requests(docs: DataFrame, parts: int, order: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int64(), pa.int8(), pa.binary(), pa.binary(), pa.binary())
        for number, block in _blocks(it, parts):
            rows = [
                (p, number, n, planes(np.diff(keys, prepend=np.uint64(0))), planes(c.astype(np.uint32)), planes(h.astype(np.uint32)))
                for n, p, keys, c, h in block.requests(order)
            ]
            for at in range(0, len(rows), 64):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows[at : at + 64]), kinds)],
                    ["part", "block", "ngram", "keys", "c", "h"],
                )

    return docs.mapInArrow(run, "part int, block long, ngram byte, keys binary, c binary, h binary")


_ANSWER = "block long, ngram byte, part int, c binary, h binary, ids binary, names binary, v long, n long"


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """A part's totals, for each block in its own order, and the part's vocabulary and tokens."""
    out = []
    for order, rows in pdf.groupby("ngram"):
        keys = [np.cumsum(unplanes(x, np.uint64), dtype=np.uint64) for x in rows["keys"]]
        names, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = []
        for c in ("c", "h"):
            each = np.concatenate([unplanes(x, np.uint32) for x in rows[c]])
            total.append(np.bincount(inverse, weights=each, minlength=len(names)).astype(np.int64))
        at = 0
        for block, part, own in zip(rows["block"], rows["part"], rows["h"]):
            own = unplanes(own, np.uint32) > 0  # only a block's deleted texts ask for deleted counts
            mine = inverse[at : at + len(own)]
            at += len(own)
            out.append((block, order, part, planes(total[0][mine]), planes(total[1][mine][own]), None, None, 0, 0))
        if order == 1:
            known = (total[0] > 0) & (names != _START)
            out.append((-1, 0, int(rows["part"].iloc[0]), None, None, None, None, int(known.sum()), int(total[0][known].sum())))
    return pd.DataFrame(out, columns=["block", "ngram", "part", "c", "h", "ids", "names", "v", "n"])


def _sequences(docs: DataFrame, parts: int) -> DataFrame:
    """Blocks' token sequences, as rows like the answers'."""
    id_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in _blocks(it, parts):
            ids = pa.array(block.ids, id_type)
            sink = pa.BufferOutputStream()
            table = pa.record_batch([ids, pa.array(block.lengths)], ["doc_id", "n"])
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_batch(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([0], pa.int8()), pa.array([parts], pa.int32()),
                 pa.array([planes(block.tokens)]), pa.nulls(1, pa.binary()), pa.array([sink.getvalue().to_pybytes()]),
                 pa.array([planes(block.names)]), pa.array([block.start], pa.int64()), pa.array([0], pa.int64())],
                ["block", "ngram", "part", "c", "h", "ids", "names", "v", "n"],
            )

    return docs.mapInArrow(run, _ANSWER)


def octave(c: np.ndarray) -> np.ndarray:
    """0 for none, 1 for 1, 2 for 2 and 3, 3 for 4 to 7, and so on."""
    return np.minimum(np.frexp(c.astype(np.float64))[1], OCTAVES - 1)


def classes(longer: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """The class of a token's contexts, by the octaves of how often the two words and the one word
    before it were seen."""
    return octave(longer) * OCTAVES + octave(shorter)


def ratio(n: np.ndarray, of: np.ndarray) -> np.ndarray:
    return np.divide(n, of, out=np.zeros(len(n)), where=of > 0)


_MET = "block long, ids binary, tokens binary, before int, c1 binary, c2 binary, c3 binary, kind binary, e3 binary, e2 binary, e1 binary, held long, v long, n long"


def _meet(parts: int, order: int):
    """Put a block's sequence and answers together, as a row to score from; with it the deleted part's
    tokens, by class, probabilities after their contexts and the word's count."""
    names_out = [c.split()[0] for c in _MET.split(", ")]

    def frame(**columns) -> pd.DataFrame:
        blank = dict.fromkeys(names_out) | {"before": 0, "held": 0, "v": 0, "n": 0}
        return pd.DataFrame([blank | columns])[names_out]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["block"].iloc[0] == -1:
            return frame(block=-1, v=int(pdf["v"].sum()), n=int(pdf["n"].sum()))
        sequences = pdf[pdf["ngram"] == 0]  # blocks that hold the same share their answers
        own = sequences.iloc[0]
        tokens, names, start = unplanes(own["c"], np.int32), unplanes(own["names"], np.uint64), int(own["v"])
        docs = pa.ipc.open_stream(own["ids"]).read_all()
        lengths = docs["n"].to_numpy()
        g = Grams(tokens, lengths, start, names, parts, order)
        got = {}
        for n, rows in pdf[pdf["ngram"] > 0].drop_duplicates(["ngram", "part"]).sort_values("part").groupby("ngram"):
            got[n] = [np.concatenate([unplanes(x, np.int64) for x in rows[c]]) for c in ("c", "h")]
        rest = np.array([remainder(i) for i in docs["doc_id"].to_pylist()])
        held = np.repeat(rest == 2, lengths)
        less, expected = {}, []
        for n, (keys, place) in ({1: (names, tokens)} | g.longer).items():
            asked = np.bincount(place[held], minlength=len(keys)) > 0
            if n == 1:
                asked[start] = (rest == 2).any()
            expected += [len(keys), int(asked.sum())]
            less[n] = asked
        if [len(x) for n in sorted(got) for x in got[n]] != expected:
            raise ValueError("the documents changed between two reads; write them to a table first")
        of_token = {f"c{n}": planes(got[n][0][place]) for n, (_, place) in g.longer.items()}
        row = {"block": int(own["block"]), "ids": own["ids"], "tokens": own["c"], "before": start, "c1": planes(got[1][0]), **of_token}
        if held.any():
            kept = {}
            for n, (c, h) in got.items():
                kept[n] = c.copy()
                kept[n][less[n]] -= h
            r1, r2 = kept[1], np.append(kept[2], kept[1][start])
            shorter, longer = r1[g.before[held]], np.zeros(int(held.sum()), np.int64)
            row |= {"held": len(longer), "e2": planes(ratio(r2[g.pair[held]], shorter).astype(np.float32)), "e1": planes(r1[tokens[held]])}
            if order == 3:
                longer = r2[g.context[held]]
                row["e3"] = planes(ratio(kept[3][g.triple[held]], longer).astype(np.float32))
            row["kind"] = planes(classes(longer, shorter).astype(np.int16))
        return pd.concat([frame(**row)] * len(sequences), ignore_index=True)

    return run


def shares(kind: np.ndarray, p: np.ndarray, weights: np.ndarray, every: np.ndarray) -> np.ndarray:
    """One round's sums: of each class, how much of its tokens falls to each of the four estimates,
    by the classes' weights and by the weights of all."""
    out = np.zeros((len(weights), 8))
    for at, w in ((0, weights[kind]), (4, every)):
        share = w * p
        share /= share.sum(1, keepdims=True)
        for i in range(4):
            out[:, at + i] = np.bincount(kind, weights=share[:, i], minlength=len(weights))
    return out


def after_round(sums: np.ndarray, every: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes' weights and those of all after a round's sums. In each class the weights of all
    count for _PRIOR tokens, so a class without tokens has those."""
    total = sums[:, 4:].sum(0) + 1e-9
    every = total / total.sum() if sums[:, 4:].sum() else every
    weights = sums[:, :4] + _PRIOR * every + 1e-9
    return weights / weights.sum(1, keepdims=True), every


def learn(met: DataFrame, n: float, v: int) -> np.ndarray:
    """Weights (trigram, bigram, unigram, uniform) per class by EM over the deleted part's tokens,
    each with its own probabilities. A round is one sum over the blocks' rows; what comes to the
    driver is a row of sums for each class."""
    every = np.array([0.3, 0.3, 0.3, 0.1])
    weights = np.tile(every, (OCTAVES * OCTAVES, 1))
    held = met.filter("held > 0").select("kind", "e3", "e2", "e1")
    schema = "class int, " + ", ".join(f"s{i} double" for i in range(8))

    def one_round(weights: np.ndarray, every: np.ndarray) -> np.ndarray:
        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(weights), 8))
            for b in it:
                for kind, e3, e2, e1 in zip(*(b.column(c).to_pylist() for c in ("kind", "e3", "e2", "e1"))):
                    kind, e2 = unplanes(kind, np.int16), unplanes(e2, np.float32)
                    e3 = unplanes(e3, np.float32) if e3 else np.zeros(len(e2))
                    p = np.stack([e3, e2, unplanes(e1, np.int64) / max(n, 1.0), np.full(len(e2), 1.0 / (v + 1))], 1)
                    total += shares(kind, p, weights, every)
            met_ = np.flatnonzero(total.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(met_, pa.int32()), *[pa.array(total[met_, i]) for i in range(8)]], ["class", *[f"s{i}" for i in range(8)]])

        sums = np.zeros((len(weights), 8))
        parts = held.mapInArrow(run, schema).groupBy("class").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(8)])
        for k, *row in parts.collect():
            sums[k] = row
        return sums

    for _ in range(_ITERATIONS):
        before = weights
        weights, every = after_round(one_round(weights, every), every)
        if np.abs(weights - before).max() < _STILL:
            break
    # what was never seen has no estimate, so its share goes to those that have one
    seen = np.arange(OCTAVES * OCTAVES)
    weights[seen // OCTAVES == 0, 0] = 0.0
    weights[seen % OCTAVES == 0, 1] = 0.0
    return weights / weights.sum(1, keepdims=True)


def mixture(tokens, lengths, start, c1, c2, c3, weights: np.ndarray, n: int, v: int) -> np.ndarray:
    """The probability of each token, from its counts and those of its contexts; without ``c3`` a
    context of two words counts as never seen."""
    first = np.cumsum(lengths) - lengths
    shorter = c1[_shifted(tokens, first, start)]
    longer = np.zeros(len(tokens), np.int64)
    if c3 is not None:
        longer = _shifted(c2, first, 0)
        longer[first] = c1[start]
    else:
        c3 = longer
    w = weights[classes(longer, shorter)]
    return w[:, 0] * ratio(c3, longer) + w[:, 1] * ratio(c2, shorter) + w[:, 2] * c1[tokens] / max(n, 1) + w[:, 3] / (v + 1)


def _scores(met: DataFrame, weights: np.ndarray, n: int, v: int, kind: str) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for ids, blob, start, *counts in zip(*(b.column(c).to_pylist() for c in ("ids", "tokens", "before", "c1", "c2", "c3"))):
                docs = pa.ipc.open_stream(ids).read_all()
                lengths, tokens = docs["n"].to_numpy(), unplanes(blob, np.int32)
                c1, c2, c3 = (x and unplanes(x, np.int64) for x in counts)
                first = np.cumsum(lengths) - lengths
                p = mixture(tokens, lengths, start, c1, c2, c3, weights, n, v)
                word = c1[tokens]
                add = lambda x: np.add.reduceat(x, first)
                base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
                held = [remainder(i) == 1 for i in docs["doc_id"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [docs["doc_id"].combine_chunks(), pa.array(held), pa.array(lengths, pa.int64()),
                     pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(len(lengths), n, np.int64)),
                     pa.array(add(base)), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return met.filter("block >= 0").select("ids", "tokens", "before", "c1", "c2", "c3").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def score_documents(docs: DataFrame, order: int = 2) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), a table that reads the same twice, by a model of
    order 2 or 3.

    Texts with crc32(doc_id) % 5 = 1 are held out of the training. A null or empty text is its end
    alone; a text longer than a block is read whole in one. Repeated rows count and are scored as
    often as they occur; an empty table gives an empty one, and other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(8, -(-size // PART_BYTES))
    answers = _requests(docs, parts, order).groupBy("part").applyInPandas(_answer, _ANSWER)
    both = answers.unionByName(_sequences(docs, parts))
    met = materialize(both.groupBy("block").applyInPandas(_meet(parts, order), _MET), "lm-blocks")
    total = met.filter("block = -1").agg(F.sum("n"), F.sum("v")).first()
    n, v = int(total[0] or 0), int(total[1] or 0)
    deleted = met.agg(F.sum("held")).first()[0] or 0
    weights = learn(met, n - deleted, v)
    return _scores(met, weights, n, v, docs.schema["doc_id"].dataType.simpleString())


def op2_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
