import gzip

import duckdb

from pyspark.sql import Window

from loomcorpus.llm import warc_fixity as W

DIR = "/root/testdata/sf0.01"


def test_audit_equals_sql(spark):
    got = W.op4_merkle_audit(spark, DIR).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DIR}/pages.parquet'")
    found = con.execute(W.OP4_SQL)
    names = [x[0] for x in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    key = lambda r: (r["page_id"], r["length"], r["status"], r["left_hash"], r["right_hash"] or "")
    assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_equal_replicas_and_empty_ones(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    a = W.leaves(W.archive(pages))
    assert W.audit(a, a).count() == 0
    none = W.leaves(W.archive(pages.limit(0)))
    assert W.audit(none, none).count() == 0
    assert W.audit(a, none).filter("status = 'missing'").count() == pages.count()
    assert W.audit(none, a).filter("status = 'extra'").count() == pages.count()


def test_offsets_are_gapless_in_each_file(spark):
    rows = W.archive(spark.read.parquet(f"{DIR}/pages.parquet")).select("file", "offset", "length").collect()
    files = {}
    for r in rows:
        files.setdefault(r["file"], []).append((r["offset"], r["length"]))
    for places in files.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length


def test_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "h"), (2, "u", "x"), (2, "u", "x")], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "9 AS record", "8 AS offset")
    held = W.leaves(W.archive(pages.select("page_id", "url", "html")))
    assert held.count() == 4 and W.audit(held, held).count() == 0
    assert W.archive(pages).count() == 4
    assert W.audit(held, held.filter("page_id IS NOT NULL")).count() == 1


def test_long_bodies_and_a_page_repeated_very_often(spark):
    rows = [(1, "u", "same")] * 3000 + [(2, "v", "x" * 2_000_000), (3, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    held = W.leaves(W.archive(pages))
    sizes = [r["count"] for r in held.groupBy("file").count().collect()]
    assert sum(sizes) == 3002 and max(sizes) < 2 * W.FILE_RECORDS
    from pyspark.sql import functions as F

    hurt = held.withColumn("hash", F.when(F.col("page_id") == 2, "0").otherwise(F.col("hash")))
    assert [(r["page_id"], r["status"]) for r in W.audit(held, hurt).collect()] == [(2, "corrupt")]


def test_a_lost_record_is_the_only_one_reported(spark):
    rows = [(i, f"https://e.example/{i}", "x" * (i * 37 % 900)) for i in range(100)]
    held = W.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))
    shift = Window.partitionBy("file").orderBy("offset")
    for gone in ([50], [0, 3, 99]):
        left = held.filter(~W.F.col("page_id").isin(gone))
        closed = left.withColumn("offset", W.F.coalesce(W.F.sum("length").over(shift.rowsBetween(Window.unboundedPreceding, -1)), W.F.lit(0)))
        assert {(r.page_id, r.status) for r in W.audit(W.leaves(held), W.leaves(closed)).collect()} == {(i, "missing") for i in gone}
        assert {(r.page_id, r.status) for r in W.audit(W.leaves(closed), W.leaves(held)).collect()} == {(i, "extra") for i in gone}


def warc(bodies):
    return [f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:r:{i}>\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for i, b in enumerate(bodies)]


def test_warc_files_are_read(spark):
    bodies = [b"", b"one", b"\r\n\r\nWARC/1.1\r\n", b"z" * 300_000, bytes(range(256)), b"last"]
    plain = b"".join(warc(bodies))
    packed = b"".join(gzip.compress(r) for r in warc(bodies))
    changed = b"".join(gzip.compress(r) for r in warc([*bodies[:3], b"y" * 300_000, bodies[4]]))
    for data in (plain, packed):
        assert [r for _, r in W.records_of(data)] == warc(bodies)
    assert list(W.records_of(b"")) == [] and [r for _, r in W.records_of(plain[:-2])][:-1] == warc(bodies)[:-1]
    assert [at for at, _ in W.records_of(packed)][1] == len(gzip.compress(warc(bodies)[0]))
    files = lambda *x: spark.createDataFrame([(f"f{i}", bytearray(c) if c is not None else None) for i, c in enumerate(x)], "path string, content binary")
    number = W.F.substring("path", 2, 9)
    leaves = [W.read_leaves(files(data, None, plain), number) for data in (plain, packed, changed)]
    assert W.audit(leaves[0], leaves[1]).collect() == []
    assert {(r.page_id, r.status) for r in W.audit(leaves[1], leaves[2]).collect()} == {("<urn:r:3>", "corrupt"), ("<urn:r:5>", "missing")}
