"""The filter audit against plain loops, and the SQL."""

import random
from itertools import permutations

import duckdb
import pytest

from loomcorpus.llm import filter_audit as A


def fails(text):
    words = (text or "").encode().split()
    text = text or ""
    out = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), any(c in "#$%&*|" for c in text)]
    return sum(1 << i for i, x in enumerate(out) if x)


def copies(rows):
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    return [i is not None and i > least[t or ""] for i, t in rows]


@pytest.mark.parametrize("seed", range(4))
def test_trie_holds_smallest_ids(seed):
    rng = random.Random(seed)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 1, 2, 3, 40]))) for _ in range(400)]
    ids = [rng.choice([None, rng.randint(0, 99)]) for _ in texts]
    trie = A.Trie()
    ends = [trie.insert(t, i) for t, i in zip(texts, ids)]
    assert len(set(zip(texts, ends))) == len(set(texts)) == len(set(ends)) == len(trie.least)
    for t, e in zip(texts, ends):
        assert trie.least[e] == min((i for x, i in zip(texts, ids) if x == t and i is not None), default=None)


def test_masks(spark):
    long = "Shared beginning of many words " * 3000
    texts = ["", None, "a", "a ", "A" * 300, "word " * 250, " ".join(f"w{i}" for i in range(250)), "a $", "ÄÖÜ" * 10, "É" * 33 + "A", "\x0b\x1c\x85", long, long + "x", long[:-1], "漢 " * 300]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i + 50, t) for i, t in enumerate(texts[2:])] + [(2, "a"), (None, "a"), (None, "alone"), (None, "alone"), (-5, long)] + [(1000 + i, "hot") for i in range(700)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame([(i, t, None if i == 4 else "xy", 1) for i, t in rows], "doc_id long, text string, lang string, mask int").repartition(7)
    got, done = A.masks_of(df, "doc_id", "lang", "text", range_bytes=50_000)
    want = sorted((repr(i), "" if i == 4 else "xy", fails(t) | c << 4) for (i, t), c in zip(rows, copies(rows)))
    assert sorted((repr(r.id), r.part, r["mask"]) for r in got.collect()) == want
    done()


def test_prefixes_grow_where_texts_share_them(spark):
    rows = [(i, bytearray(b"same start of all " * 20 + b"%05d" % i)) for i in range(400)] + [(1000, bytearray(b"other"))]
    df = spark.createDataFrame([(i, i, t, len(t)) for i, t in rows], "node long, least long, text binary, bytes long")
    prefix = A.adaptive_prefix(df, 20_000)
    sizes = {r.p for r in df.select(A.F.octet_length(prefix).alias("p")).collect()}
    assert sizes == {5, 365}
    dealt = df.withColumn("p", prefix).repartitionByRange(8, "p").groupBy(A.F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in dealt) < 150
    same = df.withColumn("text", A.F.lit("one text for all rows of it").cast("binary")).withColumn("bytes", A.F.lit(27))
    assert {r.p for r in same.select(A.F.octet_length(A.adaptive_prefix(same, 100)).alias("p")).collect()} == {27}


def test_interactions_by_hand(spark):
    rng = random.Random(3)
    docs = [(rng.choice(["p", "q", ""]), rng.randint(0, 31), rng.randint(0, 1)) for _ in range(300)] + [("clean", 0, 1)]
    df = spark.createDataFrame(docs, "part string, mask int, good int")
    counts = df.groupBy("part", "mask").agg(A.F.count(A.F.lit(1)).alias("n"), A.F.sum("good").alias("good"))
    got = {(r.part, r.filter_order, r.step): r for r in A.interactions(counts, "ABCDE", ("good",)).collect()}
    assert len(got) == 4 * 120 * 5
    for part in ("p", "q", "", "clean"):
        own = [(m, g) for x, m, g in docs if x == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                bit = 1 << "ABCDE".index(c)
                r = got[part, "".join(order), step]
                gone = [x for x in left if x[0] & bit]
                left = [x for x in left if not x[0] & bit]
                shapley[c] += len(gone)
                assert (r.kept, r.removed, r.good) == (len(left), len(gone), sum(g for _, g in gone))
                assert r.redundant == sum(bool(m & bit) for m, _ in own) - len(gone)
                assert r.unique_fails == sum(m == bit for m, _ in own)
        assert all(r.shapley == shapley[r.filter_order[r.step - 1]] for (p, _, _), r in got.items() if p == part)


def test_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x", 0), (2, "a", "x", 0), (2, "b", "x", 0)], "doc_id long, text string, lang string, good_lost int")
    labels = spark.createDataFrame([(2, 0, 1), (2, 1, None), (9, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): r for r in A.audit(docs, labels).collect()}
    first = got["EABCD", 1]
    assert (first.removed, first.good_lost, first.toxic_lost, first.kept) == (1, 1, 1, 2)
    assert got["ABCDE", 1].removed == 3 and got["ABCDE", 5].redundant == 1
    assert A.audit(docs.limit(0), labels).collect() == []
    assert {r.toxic_lost for r in A.audit(docs, labels.limit(0)).collect()} == {0}


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    found = con.execute(A.OP13_SQL)
    names = [x[0] for x in found.description]
    got = sorted(tuple(r[c] for c in names) for r in A.op13_radix_audit(spark, d).collect())
    assert got == sorted(found.fetchall())
