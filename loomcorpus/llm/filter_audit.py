"""What filters do to each other: every order of a few filters, and what each removes at its place.

A row's filters make a bit mask. The one that looks at other rows, copies of a text with a smaller
id, comes from radix tries: compressed tries of whole texts in which a terminal holds the smallest id
of its text. Each batch of rows is inserted into a trie of its own, so a text that a third of the rows
share goes on once a batch. What is left is partitioned by ranges of text prefixes, each as long as
it must be for its texts to fit a range, and a trie of each range joins the batches' terminals. Rows
whose text has a smaller id elsewhere are flagged, and the masks are counted. Only their counts meet
the orders.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import discard, materialize
from .words import slices

#: Bytes of text of one batch's trie, and of one range's, about.
SLICE, RANGE = 32 << 20, 256 << 20
#: Bytes of the shortest prefix, and by what a prefix is lengthened.
PREFIX, LONGER = 8, 8


#: Bytes within a character, after its first, and capitals.
_INSIDE, _CAPITALS = bytes(range(0x80, 0xC0)), bytes(range(65, 91))


class _Node:
    __slots__ = ("label", "children", "terminal")

    def __init__(self, label: bytes, terminal: int = -1):
        self.label, self.terminal = label, terminal
        self.children: dict[int, _Node] = {}


def _shared(a: bytes, b: bytes, at: int) -> int:
    """How many bytes ``a`` and ``b`` from ``at`` have in common at their starts, by bisection."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = low + high + 1 >> 1
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A compressed trie of byte strings. ``least`` has the smallest id of each terminal."""

    def __init__(self):
        self.root = _Node(b"")
        self.least: list = []

    def insert(self, text: bytes, row_id) -> int:
        """The number of the text's terminal, with ``row_id`` noted there unless it is null."""
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                child = node.children[text[at]] = _Node(text[at:])
                node, at = child, len(text)
                break
            label = child.label
            if not text.startswith(label, at):
                k = _shared(label, text, at)
                above = node.children[text[at]] = _Node(label[:k])
                child.label = label[k:]
                above.children[label[k]] = child
                child = above
            node, at = child, at + len(child.label)
        if node.terminal < 0:
            node.terminal = len(self.least)
            self.least.append(row_id)
        elif row_id is not None:
            held = self.least[node.terminal]
            self.least[node.terminal] = row_id if held is None else min(held, row_id)
        return node.terminal


def base_mask(text: bytes) -> int:
    """Bits 0 to 3: under 200 words, under half of the words distinct, over 3 % of the characters
    A-Z, any of ``#$%&*|``. bytes.split() parts at 0x20 and 0x09-0x0D."""
    words = text.split()
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    points = len(text.translate(None, _INSIDE))
    marks = len(text) != len(text.translate(None, b"#$%&*|"))
    return (len(words) < 200) | (100 * len(set(words)) < 50 * len(words)) << 1 | (100 * capitals > 3 * points) << 2 | marks << 3


def batch_tries(docs: DataFrame, key: str, part: str, text: str, mask: Callable[[bytes], int]) -> DataFrame:
    """(id, part, mask, node, text, least, bytes): a row for each of ``docs``. ``node`` is the
    terminal in the trie of the row's batch; the first row of a terminal has its text and smallest
    id, others have nulls there. A null text is empty, a null part too."""
    names = ["id", "part", "mask", "node", "text", "least", "bytes"]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        for batch in it:
            for b in slices(batch, "text", SLICE):
                trie, ids = Trie(), b.column("id").to_pylist()
                texts = [t or b"" for t in b.column("text").to_pylist()]
                ends = [trie.insert(t, i) for t, i in zip(texts, ids)]
                masks, first = {}, []
                for n, t in zip(ends, texts):
                    first.append(n not in masks)
                    if first[-1]:
                        masks[n] = mask(t)
                least = [trie.least[n] if f else None for n, f in zip(ends, first)]
                yield pa.RecordBatch.from_arrays([
                    b.column("id"), b.column("part"), pa.array([masks[n] for n in ends], pa.int32()), pa.array([base + n for n in ends], pa.int64()),
                    pa.array([t if f else None for t, f in zip(texts, first)], pa.binary()), pa.array(least, b.column("id").type),
                    pa.array([len(t) if f else None for t, f in zip(texts, first)], pa.int64()),
                ], names)
                base += len(trie.least)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part string, mask int, node long, text binary, least {kind}, bytes long")


def adaptive_prefix(texts: DataFrame, limit: int) -> Column:
    """The prefix of ``text`` that it is partitioned by: of PREFIX bytes, and longer while more than
    ``limit`` bytes of text share it that aren't all one text. So equal texts have equal prefixes. A
    length that many share gives at most (all bytes / limit) hashes; two prefixes of one hash are
    lengthened together, which loses nothing."""
    size, open_texts, levels = PREFIX, texts, []
    while True:
        prefix = F.substring("text", 1, size)
        found = open_texts.groupBy(F.xxhash64(prefix).alias("h")).agg(F.sum("bytes").alias("sum"), F.max("bytes").alias("most"))
        shared = [r["h"] for r in found.filter((F.col("sum") > limit) & (F.col("most") > size)).select("h").collect()]
        if not shared:
            break
        levels.append((prefix, F.xxhash64(prefix).isin(shared)))
        open_texts = open_texts.filter(levels[-1][1])
        size *= LONGER
    out = F.substring("text", 1, size)
    for prefix, longer in reversed(levels):
        out = F.when(longer, out).otherwise(prefix)
    return out


def range_tries(held: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """(node, first) of the batches' terminals whose text has a smaller id in another batch."""
    texts = held.filter("text IS NOT NULL").select("node", "least", "text", "bytes")
    total = texts.agg(F.sum("bytes")).first()[0] or 0
    spark = held.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // range_bytes))
    prefix = adaptive_prefix(texts, total // ranges + 1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, nodes, ends, leasts, kind = Trie(), array("q"), array("q"), [], None
        for b in it:
            own = b.column("least")
            kind = own.type
            for node, least, text in zip(b.column("node").to_pylist(), own.to_pylist(), b.column("text")):
                nodes.append(node)
                ends.append(trie.insert(text.as_py(), least))
                leasts.append(least)
        changed = [(n, trie.least[e]) for n, e, own in zip(nodes, ends, leasts) if own is not None and trie.least[e] < own]
        if changed:
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in changed], pa.int64()), pa.array([x for _, x in changed], kind)], ["node", "first"])

    dealt = texts.withColumn("prefix", prefix).repartitionByRange(ranges, "prefix").select("node", "least", "text")
    return dealt.mapInArrow(run, f"node long, first {held.schema['least'].dataType.simpleString()}")


def masks_of(docs: DataFrame, key: str, part: str, text: str, mask: Callable[[bytes], int] = base_mask, copy_bit: int = 4, range_bytes: int = RANGE) -> tuple[DataFrame, Callable[[], None]]:
    """(id, part, mask) of every row of ``docs``, bit ``copy_bit`` being set if a row of a smaller id
    has an equal text, and what to call when it has been read. ``mask`` gives the bits of a text.

    Texts are compared whole. Rows of one id and text aren't copies of each other; a row without an id
    is no copy and makes none; null and empty texts are equal. An empty table gives an empty one.
    """
    held = materialize(batch_tries(docs, key, part, text, mask), "audit-batch-tries")
    changed = materialize(range_tries(held, range_bytes), "audit-range-tries")
    own = held.filter("text IS NOT NULL").select(F.col("node").alias("n"), "least")
    smallest = own.join(changed, F.col("n") == F.col("node"), "left").select("n", F.coalesce("first", "least").alias("first"))
    rows = held.select("id", "part", "mask", "node").join(smallest, F.col("node") == F.col("n"))
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    out = rows.select("id", "part", F.col("mask").bitwiseOR(F.when(copy, 1 << copy_bit).otherwise(0)).alias("mask"))
    return out, lambda: discard(held, changed)


def interactions(counts: DataFrame, filters: str, tallies: Sequence[str] = ()) -> DataFrame:
    """One row per part, order of ``filters`` (letters, bit 0 first) and step, of ``counts`` (part,
    mask, n and ``tallies``): kept, removed, redundant, unique_fails, shapley, and of each tally what
    the step removes. A part has at most 2**len(filters) masks, each of which meets every order."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(filters)])
    each = counts.withColumn("filter_order", F.explode(orders))
    each = each.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = F.create_map(*[x for i, c in enumerate(filters) for x in (F.lit(c), F.lit(1 << i))])
    letter = F.expr("substring(filter_order, step, 1)")
    earlier = F.aggregate(F.split(F.expr("substring(filter_order, 1, step - 1)"), ""), F.lit(0), lambda s, c: s.bitwiseOR(F.coalesce(bit[c], F.lit(0))))
    each = each.withColumns({"_letter": letter, "_own": bit[letter], "_before": earlier})
    fails, gone = F.col("mask").bitwiseAND(F.col("_own")) != 0, F.col("mask").bitwiseAND(F.col("_before")) != 0
    total = lambda what, when: F.sum(F.when(when, F.col(what)).otherwise(0))
    out = each.groupBy("part", "filter_order", "step", "_letter").agg(
        total("n", ~fails & ~gone).alias("kept"), total("n", fails & ~gone).alias("removed"), total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("_own")).alias("unique_fails"), *[total(t, fails & ~gone).alias(t) for t in tallies],
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_letter"))).drop("_letter")


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END) || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN doc_id > first THEN 'E' ELSE '' END) AS fails FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS c, filter_order[1:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, c, n, good, toxic, fails, contains(fails, c) AS f, regexp_matches(fails, '[' || before || '_]') AS gone FROM m, s),
r AS (SELECT part, filter_order, step, c, coalesce(sum(n) FILTER (NOT f AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (f AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (f AND gone), 0) AS redundant,
  coalesce(sum(n) FILTER (fails = c), 0) AS unique_fails, coalesce(sum(good) FILTER (f AND NOT gone), 0) AS good_lost, coalesce(sum(toxic) FILTER (f AND NOT gone), 0) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM r
"""


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang", text: str = "text", range_bytes: int = RANGE) -> DataFrame:
    """The interactions of the five filters on ``docs``, with what good and toxic documents they
    lose by ``labels`` (key, quality, toxic), in which any row of a key counts. Other columns are
    ignored."""
    rows, done = masks_of(docs, key, part, text, range_bytes=range_bytes)
    is_one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("long")).alias(c)
    marked = labels.groupBy(F.col(key).alias("k")).agg(is_one("quality"), is_one("toxic"))
    lost = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"{'good' if c == 'quality' else c}_lost")
    counts = rows.join(marked, F.col("id") == F.col("k"), "left").groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), lost("quality"), lost("toxic"))
    kept = materialize(counts, "audit-masks")
    done()
    return interactions(kept, "ABCDE", ("good_lost", "toxic_lost"))


def op13_radix_audit(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
