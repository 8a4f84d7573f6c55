"""Retrieval for batches of queries: BM25, hashed and dense vectors, fusion, packing, measures.

Every ranking is a table (query_id, chunk_id, score, rank). Queries are taken in blocks of at most
QUERY_BLOCK, which bounds what tasks are sent. A task scores its batches of chunks against a block as
a sparse product and keeps the best of each query, so what is shuffled is a few rows per query and
batch and never a row per query and chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bound
from .matching import term_matches

#: Queries that one pass scores, and chunks that are scored at once.
QUERY_BLOCK, BATCH = 1024, 512
#: Queries and vectors of a block that meets others.
DENSE_QUERIES, DENSE_BLOCK = 4096, 8192
_BEST = "query_id long, chunk_id long, score double"


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query by score (to 10 places), then id; scores must be positive."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "chunk_id")
    good = scores.withColumn("score", F.round("score", 10)).filter("score > 0")
    return good.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def postings(chunks: DataFrame, terms: Column) -> DataFrame:
    """(chunk_id, length, term, tf): a chunk's terms are counted within the chunk, no shuffle."""
    held = chunks.select("chunk_id", terms.alias("_t")).withColumn("length", F.size("_t"))
    each = held.select("chunk_id", "length", F.explode("_t").alias("term"))
    return each.groupBy("chunk_id", "length", "term").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(chunks: DataFrame, terms: Column) -> DataFrame:
    """One row: how many chunks there are and their mean length."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size(terms)).alias("mean_length"))


def term_stats(table: DataFrame) -> DataFrame:
    """(term, df, tf) of a postings table: in how many chunks a term is, and how often in all."""
    return table.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


@dataclass(frozen=True)
class Postings:
    """The entries of a block's queries by column: of column c those from starts[c] to starts[c + 1]."""

    query: np.ndarray
    weight: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, query: np.ndarray, column: np.ndarray, weight: np.ndarray, columns: int) -> Postings:
        order = np.argsort(column, kind="stable")
        return cls(query[order], weight[order], np.searchsorted(column[order], np.arange(columns + 1)))

    def times(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, queries: int, rows: int) -> np.ndarray:
        """The product with sparse rows, as queries by rows."""
        first = self.starts[column]
        n = self.starts[column + 1] - first
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        flat = self.query[at] * rows + np.repeat(row, n)
        return np.bincount(flat, weights=self.weight[at] * np.repeat(value, n), minlength=queries * rows).reshape(queries, rows)


@dataclass(frozen=True)
class Tokens:
    """The tokens of a batch of rows: their row and number in ``names``, and each row's length."""

    row: np.ndarray
    code: np.ndarray
    names: pa.Array
    length: np.ndarray

    @classmethod
    def of(cls, lists: pa.Array) -> Tokens:
        length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        return cls(np.repeat(np.arange(len(lists)), length), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, length)

    def counts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number, how often) of the tokens by the numbers of their names; negative ones are
        left out."""
        number = numbers[self.code]
        width = int(numbers.max(initial=0)) + 1
        pairs, n = np.unique((self.row * width + number)[number >= 0], return_counts=True)
        return pairs // width, pairs % width, n

    def numbers(self, vocabulary: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(self.names, value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass(frozen=True)
class Asked:
    """A block of queries: ids, the vocabulary of their terms, and (query, term, how often)."""

    ids: np.ndarray
    vocabulary: pa.Array
    query: np.ndarray
    term: np.ndarray
    n: np.ndarray

    @classmethod
    def of(cls, rows: Sequence) -> Asked:
        tokens = Tokens.of(pa.array([r["terms"] or [] for r in rows], pa.list_(pa.string())))
        query, term, n = tokens.counts(np.arange(len(tokens.names)))
        return cls(np.array([r["query_id"] for r in rows], np.int64), tokens.names, query, term, n)


def blocks_of(queries: DataFrame, terms: Callable[[Column], Column]) -> Iterator[Asked]:
    rows = queries.select("query_id", terms(F.col("text")).alias("terms")).toLocalIterator()
    return (Asked.of(block) for block in batched(rows, QUERY_BLOCK))


def best_of(ids: np.ndarray, names: np.ndarray, score: np.ndarray, k: int) -> pa.RecordBatch:
    """The ``k`` best positive scores of each query in a matrix of queries by chunks, by id if equal."""
    score = np.round(score, 10)
    k = min(k, score.shape[1])
    least = np.partition(score, -k, axis=1)[:, -k] if k else np.zeros(len(ids))
    query, chunk = np.nonzero((score >= least[:, None]) & (score > 0))
    order = np.lexsort((names[chunk], -score[query, chunk], query))
    query, chunk = query[order], chunk[order]
    nth = np.arange(len(query)) - np.searchsorted(query, query)
    query, chunk = query[nth < k], chunk[nth < k]
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[query], pa.int64()), pa.array(names[chunk], pa.int64()), pa.array(score[query, chunk], pa.float64())],
        ["query_id", "chunk_id", "score"],
    )


def scored(chunks: DataFrame, terms: Callable[[Column], Column], ids: np.ndarray, k: int, score: Callable[[Tokens], np.ndarray]) -> DataFrame:
    """The best chunks of a block of queries, ``score`` giving queries by chunks of a batch."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, BATCH):
                part = b.slice(at, BATCH)
                yield best_of(ids, part.column("chunk_id").to_numpy(zero_copy_only=False), score(Tokens.of(part.column("_t"))), k)

    return chunks.select(F.col("chunk_id").cast("long").alias("chunk_id"), terms(F.col("text")).alias("_t")).mapInArrow(run, _BEST)


def _union(parts: list[DataFrame], queries: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else queries.sparkSession.createDataFrame([], _BEST)


def frequencies(chunks: DataFrame, terms: Callable[[Column], Column], vocabulary: pa.Array) -> tuple[np.ndarray, int, int]:
    """In how many chunks each term of a block's vocabulary is, how many chunks and tokens there
    are. Tasks send sums; no more rows come back than the vocabulary has terms, and two."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, chunks, length = np.zeros(len(vocabulary), np.int64), 0, 0
        for b in it:
            tokens = Tokens.of(b.column("_t"))
            df += np.bincount(tokens.counts(tokens.numbers(vocabulary))[1], minlength=len(vocabulary))
            chunks += b.num_rows
            length += int(tokens.length.sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*met, -1, -2], pa.int64()), pa.array([*df[met], chunks, length], pa.int64())], ["term", "n"])

    each = chunks.select(terms(F.col("text")).alias("_t")).mapInArrow(run, "term long, n long")
    sums = {r["term"]: r["n"] for r in each.groupBy("term").agg(F.sum("n").alias("n")).collect()}
    return np.array([sums.get(i, 0) for i in range(len(vocabulary))], np.int64), sums.get(-1, 0), sums.get(-2, 0)


def bm25(queries: DataFrame, chunks: DataFrame, terms, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``queries`` (query_id, text) against ``chunks`` (chunk_id, text), whose ids are whole numbers;
    ``terms`` makes tokens of a text column. A term that a query repeats counts as often."""
    parts = []
    for asked in blocks_of(queries, terms):
        df, n, length = frequencies(chunks, terms, asked.vocabulary)
        mean = max(1.0, length / max(n, 1))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        held = Postings.of(asked.query, asked.term, asked.n * idf[asked.term], len(df))

        def score(t: Tokens, asked=asked, held=held, mean=mean) -> np.ndarray:
            row, term, tf = t.counts(t.numbers(asked.vocabulary))
            gain = tf * (k1 + 1) / (tf + k1 * (1 - b + b * t.length[row] / mean))
            return held.times(row, term, gain, len(asked.ids), len(t.length))

        parts.append(scored(chunks, terms, asked.ids, k, score))
    return ranked(_union(parts, queries), k)


def bucket(term: Column, dimensions: int) -> Column:
    """The first four bytes of the term's sha256, modulo the dimensions."""
    return (F.conv(F.substring(F.sha2(F.encode(term, "utf-8"), 256), 1, 8), 16, 10).cast("long") % dimensions).cast("int")


def hashed_vectors(rows: DataFrame, key: str, terms: Column, dimensions: int = 2048) -> DataFrame:
    """(key, bucket, weight): counts of hashed terms at unit length. Each row is counted where it is read
    and moved as one value; rows that share a key count as one."""
    kind = f"{key} {rows.schema[key].dataType.simpleString()}"
    pair = np.dtype([("bucket", "<i4"), ("n", "<i4")])

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 4 * BATCH):
                b = whole.slice(at, 4 * BATCH)
                tokens = Tokens.of(b.column("_t"))
                row, bucket, n = tokens.counts(buckets_of(tokens.names, dimensions))
                held = np.empty(len(row), pair)
                held["bucket"], held["n"] = bucket, n
                ends = np.searchsorted(row, np.arange(b.num_rows + 1)) * pair.itemsize
                pairs = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(held.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column(key), pairs], [key, "pairs"])

    def weigh(b: pa.Table) -> Iterator[pa.RecordBatch]:
        name = b.column(key).combine_chunks()
        other = np.append(True, pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False))
        sizes = pc.binary_length(b.column("pairs")).to_numpy() // pair.itemsize
        held = np.frombuffer(b"".join(b.column("pairs").to_pylist()), pair)
        of = np.repeat(np.cumsum(other) - 1, sizes)
        cells, at = np.unique(of * dimensions + held["bucket"], return_inverse=True)
        of, n = cells // dimensions, np.bincount(at, weights=held["n"])
        yield pa.RecordBatch.from_arrays([name.filter(pa.array(other)).take(pa.array(of)), pa.array(cells % dimensions, pa.int32()), pa.array(unit_counts(of, n, int(other.sum())))], [key, "bucket", "weight"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the rows of a batch's last key, which the next may have more of
        for whole in it:
            for at in range(0, whole.num_rows, BATCH):
                b = pa.Table.from_batches([whole.slice(at, BATCH)])
                b = b if held is None else pa.concat_tables([held, b]).combine_chunks()
                name = b.column(key).combine_chunks()
                last = pc.index(name, name[-1]).as_py()
                if last:
                    yield from weigh(b.slice(0, last))
                held = b.slice(last)
        if held is not None:
            yield from weigh(held)

    counted = rows.filter(F.col(key).isNotNull()).select(key, terms.alias("_t")).mapInArrow(count, f"{kind}, pairs binary")
    return counted.repartition(key).sortWithinPartitions(key).mapInArrow(run, f"{kind}, bucket int, weight double")


def buckets_of(names: pa.Array, dimensions: int) -> np.ndarray:
    """``bucket`` of each name."""
    heads = b"".join([sha256(x).digest()[:4] for x in names.cast(pa.binary()).to_pylist()])
    return np.frombuffer(heads, ">u4").astype(np.int64) % dimensions


def unit_counts(row: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    return n / np.sqrt(np.bincount(row, weights=n * n, minlength=rows))[row]


def hashed_rank(queries: DataFrame, chunks: DataFrame, terms, k: int, dimensions: int = 2048) -> DataFrame:
    """Cosine of hashed vectors, for pairs that share a term and not a bucket only."""
    parts = []
    for asked in blocks_of(queries, terms):
        width = len(asked.vocabulary)
        pairs = asked.query * dimensions + buckets_of(asked.vocabulary, dimensions)[asked.term]
        pairs, of = np.unique(pairs, return_inverse=True)
        query, n = pairs // dimensions, np.bincount(of, weights=asked.n)
        held = Postings.of(query, pairs % dimensions, unit_counts(query, n, len(asked.ids)), dimensions)
        said = Postings.of(asked.query, asked.term, np.ones(len(asked.term)), width)

        def score(t: Tokens, asked=asked, held=held, said=said) -> np.ndarray:
            row, bucket, n = t.counts(buckets_of(t.names, dimensions))
            size = len(asked.ids), len(t.length)
            cosine = held.times(row, bucket, unit_counts(row, n.astype(float), size[1]), *size)
            row, term, n = t.counts(t.numbers(asked.vocabulary))
            return np.where(said.times(row, term, n, *size) > 0, cosine, 0.0)

        parts.append(scored(chunks, terms, asked.ids, k, score))
    return ranked(_union(parts, queries), k)


def unit_vector(v: Column) -> Column:
    """At length 1; null unless all numbers are finite and one isn't zero."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    finite = F.forall(v, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, bound(square, lambda s: F.when(s > 0, F.transform(v, lambda x: x.cast("double") / F.sqrt(s)))))


def _flat_vectors(rows: DataFrame, key: str) -> DataFrame:
    """Unit vectors as binary values, which are moved as they are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            v = b.column("v")
            ends = np.append(0, np.cumsum(pc.list_value_length(v).to_numpy(zero_copy_only=False))).astype(np.int32) * 8
            flat = v.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])], [key, "v"])

    return rows.select(F.col(key).cast("long").alias(key), unit_vector(F.col("vector")).alias("v")).filter("v is not null").mapInArrow(run, f"{key} long, v binary")


def dense_rank(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Cosine of ``queries`` (query_id, vector) and ``vectors`` (chunk_id, vector) of one size, whose
    ids are whole numbers. Every block of queries meets every block of vectors in a task, which sends
    on the ``k`` best of each query: the work is queries times vectors, what a task holds is not."""
    parts, blocks = (max(1, -(-t.count() // size)) for t, size in ((queries, DENSE_QUERIES), (vectors, DENSE_BLOCK)))
    own = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _flat_vectors(queries, "query_id").select(own("query_id", parts).alias("part"), every(blocks).alias("block"), "query_id", "v")
    held = _flat_vectors(vectors, "chunk_id").select(every(parts).alias("_part"), own("chunk_id", blocks).alias("_block"), "chunk_id", "v")
    matrix = lambda t: np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(t.num_rows, -1)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        best = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("score", pa.float64())])
        if not (asked.num_rows and held.num_rows):
            return pa.Table.from_batches([], best)
        ids, names, wanted, given = asked.column("query_id").to_numpy(), held.column("chunk_id").to_numpy(), matrix(asked), matrix(held)
        found = pa.Table.from_batches([best_of(ids, names[at : at + BATCH], wanted @ given[at : at + BATCH].T, k) for at in range(0, len(names), BATCH)])
        query, chunk, score = (found.column(c).to_numpy() for c in best.names)
        order = np.lexsort((chunk, -score, query))
        query = query[order]
        return found.take(pa.array(order[np.arange(len(query)) - np.searchsorted(query, query) < k]))

    return ranked(asked.groupBy("part", "block").cogroup(held.groupBy("_part", "_block")).applyInArrow(run, _BEST), k)


def rrf(rankings: Sequence[DataFrame], k: int, c: int = 60, preferred: Column | None = None, bonus: float = 0.002) -> DataFrame:
    """Reciprocal rank fusion; ``preferred`` chunks gain a bonus and come first."""
    tagged = [r.select("query_id", "chunk_id", (1.0 / (c + F.col("rank"))).alias("part")) for r in rankings]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    fused = union.groupBy("query_id", "chunk_id").agg(F.sum("part").alias("score"))
    first = F.lit(False) if preferred is None else preferred
    fused = fused.withColumn("_p", first).withColumn("score", F.round(F.col("score") + F.when(F.col("_p"), bonus).otherwise(0.0), 10))
    order = Window.partitionBy("query_id").orderBy(F.col("_p").desc(), F.col("score").desc(), "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("_p")


def rerank(ranking: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """New ranks by ``keys``, then score and id."""
    order = Window.partitionBy("query_id").orderBy(*keys, F.col("score").desc(), "chunk_id")
    return ranking.withColumn("rank", F.row_number().over(order))


def directed_title(query: Column, pattern: str, form: str) -> Column:
    """The start of the title that a query names, by a pattern of the whole query and a form of its
    groups; empty if the query isn't of that kind."""
    asked = F.trim(query)
    return F.when(asked.rlike(pattern), F.regexp_replace(asked, pattern, form)).otherwise("")


def metadata_keys(preferred: Column, directed: Column, title: Column, shared: Column) -> list[Column]:
    """Keys for ``rerank``: chunks of the preferred corpus, then those whose title starts as the query
    names it, then by how many words title and query share."""
    return [preferred.desc(), ((directed != "") & F.startswith(title, directed)).desc(), shared.desc()]


def diversify(ranking: DataFrame, document: str, k: int) -> DataFrame:
    """One chunk of each document first, then the others, ``k`` in all."""
    nth = F.row_number().over(Window.partitionBy("query_id", document).orderBy("rank"))
    order = Window.partitionBy("query_id").orderBy(F.col("_n") > 1, "rank")
    out = ranking.withColumn("_n", nth).withColumn("position", F.row_number().over(order))
    return out.filter(F.col("position") <= k).drop("_n")


def pack_context(ranking: DataFrame, length: Column, order: str, budget: int, separator: int = 2) -> DataFrame:
    """The chunks that fit a budget of characters, up to the first that doesn't."""
    before = Window.partitionBy("query_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(length + separator).over(before) - separator
    return ranking.withColumn("used", used).filter(F.col("used") <= budget)


def stale(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Ids of ``chunks`` (chunk_id, fingerprint) that an index lacks or holds otherwise."""
    i = index.select(F.col("chunk_id").alias("_c"), F.col("fingerprint").alias("_f"))
    out = chunks.join(i, F.col("chunk_id") == F.col("_c"), "left")
    return out.filter(~F.col("fingerprint").eqNullSafe(F.col("_f"))).select("chunk_id")


def signature(rows: DataFrame, key: str, digest: str) -> DataFrame:
    """One hash of a corpus that doesn't depend on order: the rows' hashes are hashed in order by
    their first eight digits, those by the first six, and so on, so no group is larger than 256 or
    what shares eight digits."""
    level = rows.select(F.sha2(F.concat_ws(":", key, digest), 256).alias("h")).withColumn("p", F.substring("h", 1, 8))
    for digits in (8, 6, 4, 2, 0):
        in_order = F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda s: s["h"])
        group = F.substring("p", 1, digits) if digits else F.lit("")
        level = level.groupBy(group.alias("g")).agg(F.sha2(F.array_join(in_order, ""), 256).alias("h")).select(F.col("g").alias("p"), "h")
    return level.select(F.col("h").alias("signature"))


def passages_in(docs: DataFrame, key: str, text: str, passages: DataFrame) -> DataFrame:
    """(passage_id, key) of the texts in which a passage (passage_id, passage) stands, the texts being
    read once for all passages of a lot. An empty passage stands nowhere."""
    found = term_matches(docs, key, text, passages.select(F.col("passage").alias("term")), standalone=False)
    return passages.join(found, F.col("passage") == F.col("term")).select("passage_id", key)


def evaluate(ranking: DataFrame, gold: DataFrame, cases: DataFrame, ks: Iterable[int] = (1, 3, 5)) -> DataFrame:
    """Per case: recall at each k, reciprocal rank and nDCG at 5. ``gold`` has (query_id,
    chunk_id); a case without gold has nulls."""
    hit = ranking.join(gold.withColumn("_hit", F.lit(1)), ["query_id", "chunk_id"], "left").withColumn("rel", F.coalesce("_hit", F.lit(0)))
    wanted = gold.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n_gold"))
    return measures(hit, cases.select("query_id").join(wanted, "query_id", "left"), ks)


def measures(hits: DataFrame, cases: DataFrame, ks: Iterable[int] = (1, 3, 5)) -> DataFrame:
    """As ``evaluate``, of a ranking with ``rel``, 1 for gold and else 0, and of ``cases`` (query_id,
    n_gold); n_gold is null for a case without gold."""
    rel = F.col("rel")
    each = hits.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, rel).otherwise(0)).alias(f"hits_{k}") for k in ks],
        F.min(F.when(rel == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("rank") <= 5, rel / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    out = cases.join(each, "query_id", "left")
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.lit(5), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0)
    )
    has = F.col("n_gold").isNotNull()
    return out.select(
        "query_id", F.coalesce("n_gold", F.lit(0)).alias("n_gold"),
        *[F.when(has, F.round(F.coalesce(f"hits_{k}", F.lit(0)) / F.col("n_gold"), 6)).alias(f"recall_{k}") for k in ks],
        F.when(has, F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6)).alias("reciprocal_rank"),
        F.when(has, F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6)).alias("ndcg_5"),
    )


def embed(rows: DataFrame, key: str, text: str, encode, dimensions: int) -> DataFrame:
    """(key, vector) by a caller's ``encode`` of a list of texts, batch by batch in the tasks. A
    batch with another number of vectors, or one of another size, is an error."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            vectors = encode([t or "" for t in b.column(text).to_pylist()])
            if len(vectors) != b.num_rows or any(len(v) != dimensions for v in vectors):
                raise ValueError("the encoder gave other vectors than it was asked for")
            out = pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(key), out], [key, "vector"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInArrow(run, f"{key} {kind}, vector array<double>")


#: Rankers by name: functions of (queries, chunks, terms, k) to a ranking.
RANKERS = {"bm25": bm25, "hashed": hashed_rank}


def rank_with(name: str, queries: DataFrame, chunks: DataFrame, terms, k: int) -> DataFrame:
    """The ranking of a registered ranker; callers may add their own to RANKERS."""
    if name not in RANKERS:
        raise ValueError(f"no ranker is named {name}: {sorted(RANKERS)}")
    return RANKERS[name](queries, chunks, terms, k)
