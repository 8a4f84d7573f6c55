"""N-gram Jaccard join by a blocked sparse matrix product of document by n-gram incidence.

Two documents link when their shingle sets' Jaccard similarity is ``percent`` per cent at least.
Documents with equal sets are one class, joined by the hash of the set. Classes are blocked first.
Put all shingles in one order: linked sets of sizes n and m <= n share p = percent * n / 100 shingles at
least, so the first l of those they share are among the first n - p + l of the one and m - p + l of the
other. A class writes that prefix, with l a tenth of its size, and stays only if a tenth of the size
of its smallest possible partner is in other classes' prefixes too. A document with a passage that others have,
or a few common lines, doesn't stay; a near copy does. Classes that stay and share a prefix shingle
fall into one block.

Within a block the incidence matrix is multiplied by its transpose, a row at a time: overlaps are
summed over the postings of the row's shingles, and pairs whose sizes alone rule out a link are
discarded. Rows are multiplied for a pivot first, then for every class outside the largest component
so far. A link between two components has an end outside the largest, so no component is missed, and
no group's pairs are ever written out. A block larger than one task should hold is parted again by an
order of its own, rarest shingles first; what is still large is dealt over cells, and its pivot and
outside rows are multiplied with each cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import discard, materialize
from .words import folded, shingle_sets, signed, slices

#: Shingles that one cell of a large block holds, about.
CELL = 500_000
#: Shingles of small blocks that one task multiplies, about.
BIN = 50_000
#: The share of a set, one in so many, that linked sets must share of their prefixes.
SHARE = 10
#: Documents, by the smallest id hashes, among which common shingles are looked for; how many of
#: them must have one, and how many are kept at most.
LOOK, OFTEN, KEPT = 20_000, 3, 1_000_000


def shared_at_least(n: int) -> int:
    """How many prefix shingles a set of ``n`` and any set linked with it, no smaller, share."""
    return max(1, n // SHARE)


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + shared_at_least(n))


def needed(n: int, percent: int) -> int:
    """How many of its prefix shingles a set of ``n`` shares with any set that it links with."""
    return shared_at_least(-(-percent * n // 100))


def prefix(h: np.ndarray, percent: int, common: np.ndarray | None = None) -> np.ndarray:
    """The first shingles of a sorted set in the order of all shingles: by hash, those of ``common``
    (sorted) last. Any list is right, as it is the same for all sets."""
    if common is not None and len(common):
        often = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate([h[~often], h[often]])
    return h[: prefix_length(len(h), percent)]


def common_shingles(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that many of about LOOK documents have, sorted; at most KEPT. They only guide the
    blocking: any list is right, so a sample of a stated size will do at every size of the corpus."""
    total = docs.count()
    below = int(min(1.0, LOOK / max(total, 1)) * (1 << 64)) - (1 << 63) - 1
    order = F.xxhash64(F.lit("common"), "doc_id")
    # in a few parts, whatever the number of files, so that what is common repeats within a part
    sample = docs.select("text", order.alias("_o")).filter(F.col("_o") <= below).repartition(8, "_o").select("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [h for part in slices(b) for h in shingle_sets(part.column("text"), n)]
            if sets:
                h, c = np.unique(np.concatenate(sets), return_counts=True)
                # what a part has once is rarely common, and is most of what there is
                yield pa.RecordBatch.from_arrays([pa.array(signed(h)[c > 1]), pa.array(c[c > 1])], ["h", "c"])

    counts = sample.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") >= OFTEN)
    kept = counts.orderBy(F.col("c").desc(), "h").limit(KEPT).select("h").toArrow()
    return np.sort(kept["h"].to_numpy().view(np.uint64))


def _class_rows(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """One table of two kinds of rows. 0: a document, its set's size (n) and class (b). 1: a prefix
    shingle (a) of a class (b) and how many of its shingles the class must share (n), once for each
    slice of a batch that has the class."""

    common = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, n))  # KEPT numbers at most

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b):
                sizes, classes, names, prefixes, musts = [], [], [], [], []
                seen: set[int] = set()
                for h in shingle_sets(part.column("text"), n):
                    sizes.append(len(h))
                    c = folded(h) - (1 << 63) if len(h) else None
                    classes.append(c)
                    if c is not None and c not in seen:
                        seen.add(c)
                        names.append(c)
                        prefixes.append(prefix(h, percent, common.value))
                        musts.append(needed(len(h), percent))
                lengths = [len(x) for x in prefixes]
                flat = np.concatenate(prefixes) if prefixes else np.zeros(0, np.uint64)
                rows, more = part.num_rows, len(flat)
                doc_ids = part.column("doc_id")
                at = pa.array([*range(rows)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([0, 1], np.int8), [rows, more])),
                     pa.concat_arrays([doc_ids.take(at), pa.nulls(more, doc_ids.type)]),
                     pa.array(np.concatenate([np.array(sizes, np.int64), np.repeat(np.array(musts, np.int64), lengths)])),
                     pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(signed(flat))]),
                     pa.concat_arrays([pa.array(classes, pa.int64()), pa.array(np.repeat(np.array(names, np.int64), lengths))])],
                    ["kind", "doc_id", "n", "a", "b"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(batches, f"kind byte, doc_id {kind}, n long, a long, b long")


def _shared(held: DataFrame) -> DataFrame:
    """(sig, low) of what two classes or more have; low is the first of them."""
    ends = held.groupBy("sig").agg(F.min("cls").alias("low"), F.max("cls").alias("high"), F.min("need").alias("least"))
    # every class needs one at least, but a sum that reads ``need`` too reads the very rows that are
    # joined with it, so Spark deals them once for both
    return ends.filter("low <> high AND least > 0").select(F.col("sig").alias("_s"), "low")


def _met(held: DataFrame) -> DataFrame:
    """The rows (sig, cls, need) whose shingle others have too, as a table. The rows are dealt by
    shingle once, for the sums and for the join with them."""
    dealt = held.repartition("sig")
    return materialize(dealt.join(_shared(dealt), F.col("sig") == F.col("_s")).select("sig", "cls", "need").distinct(), "join-shared")


def _staying(met: DataFrame) -> DataFrame:
    """The rows of classes that have ``need`` of them."""
    enough = met.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("must"))
    enough = enough.filter("n >= must").select(F.col("cls").alias("_c"))
    return met.join(enough, F.col("cls") == F.col("_c"), "left_semi")


def candidate_components(held: DataFrame) -> DataFrame:
    """Components (node, root) of classes by their prefixes (sig, cls, need), such that linked
    classes are in one. A shingle's classes form a star, never all pairs."""
    first = _met(held)
    second = _met(_staying(first))  # some of what was shared was shared with classes that left
    discard(first)
    stay = _staying(second)
    stars = stay.join(_shared(stay), F.col("sig") == F.col("_s")).filter("cls <> low")
    found = components(stars.select(F.col("low").alias("a"), F.col("cls").alias("b")))
    discard(second)
    return found


class _Sets:
    """Union-find over a block's rows."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, others: np.ndarray) -> None:
        for j in others:
            a, b = self.find(i), self.find(j)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.find(i) for i in range(len(self.up))])


class Incidence:
    """A block's rows by shingles, stored both ways."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), self.sizes)
        self.names, column = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(column, kind="stable")
        self.posting = row[order]
        self.starts = np.searchsorted(column[order], np.arange(len(self.names) + 1))

    def overlaps(self, h: np.ndarray) -> np.ndarray:
        """One row of the product: the overlap of a set with every row."""
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        columns = at[self.names[at] == h]
        first, last = self.starts[columns], self.starts[columns + 1]
        n = last - first
        if n.sum() == 0:
            return np.zeros(len(self.sizes), np.int64)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.bincount(self.posting[np.repeat(first, n) + offset], minlength=len(self.sizes))

    def linked(self, h: np.ndarray, percent: int) -> np.ndarray:
        """Rows that a set links with. Pairs too unlike in size are discarded by their bounds."""
        n = len(h)
        near = np.flatnonzero((100 * self.sizes >= percent * n) & (100 * n >= percent * self.sizes))
        if len(near) == 0:
            return near
        both = self.overlaps(h)[near]
        return near[100 * both >= percent * (self.sizes[near] + n - both)]


def connect(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The root (a row's number) of each row's component in the graph of links."""
    found = _Sets(len(sets))
    table = Incidence(sets)
    done = np.zeros(len(sets), bool)
    todo = [0]
    while todo:
        for i in todo:
            if not done[i]:
                done[i] = True
                found.join(i, table.linked(sets[i], percent))
        roots = found.roots()
        values, counts = np.unique(roots, return_counts=True)
        outside = np.flatnonzero((roots != values[np.argmax(counts)]) & ~done)
        todo = outside[:64].tolist()
    return found.roots()


_EDGES = "a long, b long"


def _block_edges(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in pdf.groupby("block", sort=False):
            part = part.drop_duplicates("cls")
            if len(part) < 2:
                continue
            cls = part["cls"].to_numpy()
            roots = connect([np.frombuffer(x, np.uint64) for x in part["set"]], percent)
            moved = np.flatnonzero(roots != np.arange(len(cls)))
            a.append(cls[roots[moved]])
            b.append(cls[moved])
        return pd.DataFrame({"a": np.concatenate(a) if a else [], "b": np.concatenate(b) if b else []}, dtype="int64")

    return run


def _cell_edges(percent: int):
    """Links between the rows of a cell and the probes dealt to it, as a forest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf[~pdf["probe"]].drop_duplicates("cls")
        probes = pdf[pdf["probe"]].drop_duplicates("cls")
        a, b = [], []
        if len(rows) and len(probes):
            cls = rows["cls"].to_numpy()
            table = Incidence([np.frombuffer(x, np.uint64) for x in rows["set"]])
            index = {c: i for i, c in enumerate(dict.fromkeys([*cls.tolist(), *probes["cls"].tolist()]))}
            found = _Sets(len(index))
            for c, x in zip(probes["cls"], probes["set"]):
                found.join(index[c], table.linked(np.frombuffer(x, np.uint64), percent))
            names = np.array(list(index))
            roots = found.roots()
            moved = np.flatnonzero(roots != np.arange(len(names)))
            a, b = names[roots[moved]], names[moved]
        return pd.DataFrame({"a": a, "b": b}, dtype="int64")

    return run


_HELD = "block long, cls long, set binary"


def _sizes(rows: DataFrame) -> DataFrame:
    """Each block of ``rows`` (block, cls, size) with its shingles, first class and cells."""
    sums = rows.groupBy("block").agg(F.sum("size").alias("shingles"), F.min("cls").alias("pivot"))
    cells = F.ceil(F.col("shingles") / CELL).cast("long")
    return sums.select(F.col("block").alias("_block"), "pivot", cells.alias("cells"), "shingles")


def parted_again(wide: DataFrame, percent: int) -> DataFrame:
    """The rows (block, cls, set) of large blocks in smaller ones: by prefixes in an order of each
    block's own, shingles of fewest classes first. Classes that can't link with any are left out."""

    def taken_apart(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = [np.frombuffer(x, np.int64) for x in part.column("set").to_pylist()]
                n = np.array([len(x) for x in sets])
                of = pa.array(np.repeat(np.arange(len(sets)), n))
                yield pa.RecordBatch.from_arrays(
                    [part.column("block").take(of), part.column("cls").take(of), pa.array(np.concatenate(sets)),
                     pa.array(np.repeat(np.array([prefix_length(x, percent) for x in n.tolist()]), n)),
                     pa.array(np.repeat(np.array([needed(x, percent) for x in n.tolist()]), n))],
                    ["block", "cls", "shingle", "length", "need"],
                )

    each = wide.mapInArrow(taken_apart, "block long, cls long, shingle long, length long, need long")
    each = materialize(each, "join-apart")
    often = each.groupBy("block", "shingle").agg(F.count(F.lit(1)).alias("classes"))
    order = Window.partitionBy("block", "cls").orderBy("classes", "shingle")
    ranked = each.join(often, ["block", "shingle"]).withColumn("nth", F.row_number().over(order))
    held = ranked.filter("nth <= length").select(F.xxhash64("block", "shingle").alias("sig"), "cls", "need")
    held = materialize(held, "join-prefixes")
    found = candidate_components(held)
    discard(each, held)
    found = found.select(F.col("node").alias("_c"), F.col("root").alias("_root"))
    return wide.join(found, F.col("cls") == F.col("_c")).select(F.col("_root").alias("block"), "cls", "set")


def class_links(docs: DataFrame, named: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """Edges (a, b) between classes whose components are those of the graph of links, from documents
    (doc_id, n_shingles, cls) and the prefixes in ``rows``, which are deleted when used."""
    held = rows.filter("kind = 1").select(F.col("a").alias("sig"), F.col("b").alias("cls"), F.col("n").alias("need"))
    blocks = candidate_components(held)
    discard(rows)
    members = materialize(
        named.filter("cls is not null").groupBy("cls")
        .agg(F.min("doc_id").alias("_id"), F.first("n_shingles").alias("size"))
        .join(blocks.select(F.col("node").alias("cls"), F.col("root").alias("block")), "cls"),
        "join-members",
    )
    # the sets of one document of each class that shares its block
    # the same plan at every size: members are a share of all documents, so they outgrow a broadcast
    wanted = members.select("_id", F.col("cls").alias("_cls"), "block").hint("shuffle_hash")
    own = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")))

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep, blobs = [], []
            each = (h for part in slices(b) for h in shingle_sets(part.column("text"), n))
            for i, (h, c) in enumerate(zip(each, b.column("_cls").to_pylist())):
                if len(h) and folded(h) - (1 << 63) == c:  # a repeated doc_id may carry another text
                    keep.append(i)
                    blobs.append(h.tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("block").take(at), b.column("_cls").take(at), pa.array(blobs, pa.binary())],
                ["block", "cls", "set"],
            )

    held = own.select("text", "_cls", "block").mapInArrow(sets, _HELD)
    sizes = materialize(_sizes(members.select("block", "cls", "size")), "join-blocks")
    total = sizes.agg(F.sum("shingles"), F.max("cells")).first()
    if total[0] is None:
        return sizes.select(F.col("_block").alias("a"), F.col("_block").alias("b"))
    large = total[1] > 1
    if large:
        every = held = materialize(held, "join-sets")
        wide = held.join(sizes.filter("cells > 1"), F.col("block") == F.col("_block"), "left_semi")
        again = parted_again(wide, percent)
        rest = held.join(sizes.filter("cells > 1"), F.col("block") == F.col("_block"), "left_anti")
        held = materialize(rest.unionByName(again), "join-sets")
        discard(every)
        sizes = materialize(_sizes(held.select("block", "cls", (F.octet_length("set") / 8).alias("size"))), "join-blocks")
        total = sizes.agg(F.coalesce(F.sum("shingles"), F.lit(0)), F.coalesce(F.max("cells"), F.lit(0))).first()
    held = held.join(sizes, F.col("block") == F.col("_block")).drop("_block", "shingles")
    bins = max(1, -(-int(total[0]) // BIN))
    small = held.filter("cells = 1").withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins)))
    edges = small.select("bin", "block", "cls", "set").groupBy("bin").applyInPandas(_block_edges(percent), _EDGES)
    edges = materialize(edges, "join-links")
    if total[1] <= 1:
        return edges
    wide = held.filter("cells > 1").withColumn("cell", F.pmod(F.xxhash64("cls"), F.col("cells")))

    def multiplied(probes: DataFrame) -> DataFrame:
        to_rows = wide.join(probes.select(F.col("block").alias("_b"), "of").distinct(), F.col("block") == F.col("_b"))
        rows_in = to_rows.select("block", "cell", "of", "cls", "set", F.lit(False).alias("probe"))
        all_cells = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))
        probes_in = probes.select("block", all_cells.alias("cell"), "of", "cls", "set", F.lit(True).alias("probe"))
        both = rows_in.unionByName(probes_in)
        return both.groupBy("block", "cell", "of").applyInPandas(_cell_edges(percent), _EDGES)

    pivots = wide.filter(F.col("cls") == F.col("pivot")).withColumn("of", F.lit(0).cast("long"))
    ties = materialize(multiplied(pivots), "join-pivots")
    found = components(ties)
    labelled = wide.join(found, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls"))
    counts = labelled.groupBy("block", "root").count()
    biggest = counts.groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    outside = labelled.join(biggest.withColumnRenamed("block", "_m"), F.col("block") == F.col("_m"))
    outside = outside.filter(F.col("root") != F.col("main")).withColumn(
        "of", F.pmod(F.xxhash64(F.lit(1), "cls"), F.col("cells")).cast("long")
    )
    more = multiplied(outside.select(*wide.columns, "of"))
    return materialize(edges.unionByName(ties).unionByName(more), "join-links")


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Null and empty texts, and texts without words, have an empty set, link with nothing and are
    their own component. A text of fewer than ``n`` words has its whole sequence as its one
    shingle. Repeated rows are in one component. Components are named by their smallest doc_id,
    nulls aside. Other columns of ``docs`` are ignored.
    """
    rows = materialize(_class_rows(docs, n, percent), "join-classes")
    named = rows.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("b").alias("cls"))
    named = materialize(named, "join-documents")
    found = components(class_links(docs, named, rows, n, percent))
    firsts = named.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("first"))
    rooted = materialize(
        firsts.join(found, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("root", "cls").alias("root")),
        "join-roots",
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    table = materialize(
        rooted.join(names, "root").select(F.col("cls").alias("_cls"), "component_id"), "join-components"
    )
    out = named.join(table, F.col("cls") == F.col("_cls"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that name their component, with their own columns: one document of
    each group stays. Rows that share that document's doc_id stay with it."""
    kept = jaccard_components(docs, n, percent).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    ids = materialize(kept.select("doc_id").distinct(), "join-kept")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=3, percent=90)
