"""Merkle fixity audit of WARC replicas.

Archives are records with their place, made from pages or read from WARC files.

Records get a digest each; digests are hashed over ordered offset ranges of a file, ranges over
files, and files over groups of files up to one root. Two replicas with equal roots are equal. Else
the audit descends: of each level only the children of nodes that differ are compared, down to the
records.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import numbered
from .scratch import materialize

#: Records of a file, about; bytes of an offset range; files or groups under one node above.
FILE_RECORDS, RANGE_BYTES, FAN = 256, 1 << 18, 16


def record(url: Column, body: Column, page: Column) -> Column:
    """A WARC resource record as text. Nulls are empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.lit("WARC-Type: resource"),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
        F.lit(""), body, F.lit(""), F.lit(""),
    )


_HEADER = re.compile(rb"WARC/1\.\d\r\n((?:[^\r\n]+\r\n)*)\r\n")


def _framed(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the records of uncompressed bytes, each by its own Content-Length."""
    at = 0
    while at < len(data):
        head = _HEADER.match(data, at)
        fields = head and dict(x.split(b":", 1) for x in head[1].lower().split(b"\r\n") if b":" in x)
        size = (fields or {}).get(b"content-length", b"").strip()
        end = head.end() + int(size) + 4 if head and size.isdigit() else 0
        if not end or data[end - 4 : end] != b"\r\n\r\n":
            yield at, data[at:]  # from here on nothing can be told apart: one record that matches no other
            return
        yield at, data[at:end]
        at = end


def _members(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the gzip members of a file; one that can't be unpacked is kept as it is."""
    at = 0
    while at < len(data):
        unpack = zlib.decompressobj(31)
        try:
            body = unpack.decompress(data[at:]) + unpack.flush()
        except zlib.error:
            body = b""
        if not unpack.eof:
            yield at, data[at:]
            return
        yield at, body
        at = len(data) - len(unpack.unused_data)


def records_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, record) of a WARC file's bytes; compressed files have a record a member."""
    if data[:2] != b"\x1f\x8b":
        yield from _framed(data)
        return
    for at, body in _members(data):
        for inner, record in _framed(body):
            yield at + inner, record


_ID = re.compile(rb"(?im)^WARC-Record-ID:\s*(\S+)")


def read_leaves(files: DataFrame, file: Column) -> DataFrame:
    """The leaves of WARC files (path, content), as Spark's binary file source gives them: (page_id,
    file, offset, length, hash), where page_id is the record's id and ``file`` numbers a path, alike in
    all replicas. The digest is of the unpacked record, so replicas may be compressed otherwise. A
    null or empty file has no records; damaged framing makes one record of the rest of its file."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                found = [(m[1].decode("utf-8", "replace") if (m := _ID.search(r[:65536])) else None, at, len(r), sha256(r).hexdigest()) for at, r in records_of(b.column("content")[i].as_py() or b"")]
                ids, places, lengths, digests = zip(*found) if found else [[]] * 4
                number = b.column("file").slice(i, 1).take(pa.array([0] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), number, pa.array(places, pa.int64()), pa.array(lengths, pa.int64()), pa.array(digests, pa.string())], ["page_id", "file", "offset", "length", "hash"])

    return files.select(file.cast("int").alias("file"), "content").mapInArrow(run, "page_id string, file int, offset long, length long, hash string")


def archive(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as records with their place: file, offset, length.

    The pages are written with a row number, from which and its id a page's file is drawn, so pages
    alike are dealt over many files; a file holds about FILE_RECORDS records at every size of the
    corpus. Places within a file follow the order of ids. Repeated pages are records of their own.
    """
    rows = pages.select("page_id", "url", record(F.col("url"), F.col("html"), F.col("page_id")).alias("record"))
    rows, row = numbered(rows.withColumn("length", F.octet_length("record").cast("long")), "warc-records")
    files = max(1, -(-rows.count() // FILE_RECORDS))
    file = F.pmod(F.xxhash64("page_id", row), F.lit(files)).cast("int")
    # lengths alone are put in order; the records don't move
    before = Window.partitionBy("file").orderBy("page_id", "_of").rowsBetween(Window.unboundedPreceding, -1)
    places = rows.select("page_id", F.col(row).alias("_of"), "length", file.alias("file"))
    places = places.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    # the same plan at every size: there is a place for every record, so they outgrow a broadcast
    places = materialize(places.select("_of", "file", "offset"), "warc-places").hint("shuffle_hash")
    return rows.join(places, F.col(row) == F.col("_of")).drop(row, "_of")


def leaves(replica: DataFrame) -> DataFrame:
    """A replica's records without their bytes: place, page and digest."""
    return replica.select("page_id", "file", "offset", "length", F.sha2(F.col("record").cast("binary"), 256).alias("hash"))


def _above(children: DataFrame, keys: dict[str, Column], order: list[str]) -> DataFrame:
    """Nodes over ``children``, with the hash of the children's places and hashes in order."""
    child = F.struct(*order, F.concat_ws(":", *order, "hash").alias("text"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda c: c["text"]), "\n")
    return children.groupBy(*[c.cast("long").alias(k) for k, c in keys.items()]).agg(F.sha2(text, 256).alias("hash"))


def tree(records: DataFrame, files: int) -> list[DataFrame]:
    """Levels from ranges up to the root, each a written table of (file, range, hash)."""
    at, none = F.floor(F.col("offset") / RANGE_BYTES), F.lit(-1)
    level = materialize(_above(records, {"file": F.col("file"), "range": at}, ["offset", "length", "page_id"]), "warc-level")
    levels = [level]
    level = materialize(_above(level, {"file": F.col("file"), "range": none}, ["range"]), "warc-level")
    levels.append(level)
    width = files
    while width > 1:
        level = materialize(_above(level, {"file": F.floor(F.col("file") / FAN), "range": none}, ["file"]), "warc-level")
        levels.append(level)
        width = -(-width // FAN)
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """(page_id, length, status, left_hash, right_hash) of every record in which two replicas'
    leaves differ. Records of a page that are in both copies of a differing range's file are the same
    wherever they stand, so one that was lost or added doesn't count against those after it. Of the
    rest, the n-th of a page in each copy is "corrupt" if both have it, else "missing" or "extra". Null
    ids are equal; repeated records are told apart by their order. Equal or empty replicas give no
    rows. Only digests are compared, so records may be of any length.
    """
    left, right = materialize(left, "warc-left"), materialize(right, "warc-right")
    top = left.unionByName(right).agg(F.max("file")).first()[0]
    if top is None:
        top = -1
    a, b = tree(left, top + 1), tree(right, top + 1)

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.select("file", "range", F.col("hash").alias("_x"))
        y = y.select("file", "range", F.col("hash").alias("_y"))
        return x.join(y, ["file", "range"], "full").filter(~F.col("_x").eqNullSafe(F.col("_y"))).select("file", "range")

    suspects = differing(a[-1], b[-1])
    for i in range(len(a) - 2, -1, -1):
        above = materialize(suspects.select(F.col("file").alias("_f")).distinct(), "warc-suspects")
        key = F.col("file") if i == 0 else F.floor(F.col("file") / FAN)
        below = [t.join(above, key == F.col("_f"), "left_semi") for t in (a[i], b[i])]
        suspects = differing(*below)
    suspects = materialize(suspects.select(F.col("file").alias("_f"), F.col("range").alias("_r")), "warc-suspects")
    at = F.floor(F.col("offset") / RANGE_BYTES)
    inside = (F.col("file") == F.col("_f")) & (at == F.col("_r"))
    x, y = (t.join(suspects, inside, "left_semi") for t in (left, right))
    # a record that has merely moved, since another before it was lost or added, is the same record
    nth = F.row_number().over(Window.partitionBy("file", "page_id", "hash").orderBy("offset"))
    x, y = (t.select("file", "page_id", "offset", "length", "hash").withColumn("nth", nth) for t in (x, y))
    alike = [*(x[c].eqNullSafe(y[c]) for c in ("file", "page_id", "hash")), x["nth"] == y["nth"]]
    left_over, right_over = x.join(y, alike, "left_anti"), y.join(x, alike, "left_anti")
    turn = F.row_number().over(Window.partitionBy("file", "page_id").orderBy("offset"))
    ends = [t.select("file", "page_id", "length", "hash", turn.alias("turn")) for t in (left_over, right_over)]
    p, q = (t.select(*[F.col(c).alias(f"{side}_{c}") for c in t.columns]) for t, side in zip(ends, ("left", "right")))
    same = [F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in ("file", "page_id", "turn")]
    status = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("corrupt")
    return p.join(q, same, "full").select(
        F.coalesce("left_page_id", "right_page_id").alias("page_id"), F.coalesce("left_length", "right_length").alias("length"),
        status.alias("status"), "left_hash", "right_hash",
    )


def worn(replica: DataFrame) -> DataFrame:
    """A replica as a bad copy left it: by the md5 of the url, one record in 16 has its last
    character changed and one in 256 is gone. Urls that are null are spared."""
    mark = F.coalesce(F.md5("url"), F.lit("."))
    rotten = F.concat(F.expr("left(record, length(record) - 1)"), F.lit("\x00"))
    out = replica.filter(~mark.startswith("f0"))
    return out.withColumn("record", F.when(mark.startswith("0"), rotten).otherwise(F.col("record")))


def op4_merkle_audit(spark, sf_dir: str) -> DataFrame:
    """The pages as a WARC archive, against a worn copy of it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    held = archive(pages)
    return audit(leaves(held), leaves(worn(held)))


OP4_SQL = """
WITH r AS (
  SELECT page_id, md5(url) AS mark,
         concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: resource', chr(13), chr(10),
                'WARC-Record-ID: <urn:page:', coalesce(page_id::VARCHAR, ''), '>', chr(13), chr(10),
                'WARC-Target-URI: ', coalesce(url, ''), chr(13), chr(10),
                'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10),
                chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
  FROM pages)
SELECT page_id, strlen(record) AS length,
       CASE WHEN mark LIKE 'f0%' THEN 'missing' ELSE 'corrupt' END AS status,
       sha256(record) AS left_hash,
       CASE WHEN mark LIKE 'f0%' THEN NULL
            ELSE sha256(encode(left(record, length(record) - 1)) || '\\x00'::BLOB) END AS right_hash
FROM r WHERE mark LIKE 'f0%' OR mark LIKE '0%'
"""
