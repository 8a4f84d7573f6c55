"""Reading and writing JSON lines, subtitles, index tables and partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clock_seconds, strip


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped; a line that isn't an object of the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that aren't objects are left out; so is everything if there is no such file."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    row = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    parsed = lines.filter(F.trim("value").startswith("{")).select(row.alias("r"))
    return parsed.filter("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Columns in order of name; the folder is replaced when the job has succeeded."""
    df.select(*sorted(df.columns)).write.mode("overwrite").json(path)


def manual_records(df: DataFrame, key: str, valid: Column, status: str, expected: str) -> DataFrame:
    """Only rows of the expected status, if all rows are valid and no key repeats; else an error
    names how many are bad, when the rows are read."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = df.join(counts, key)
    bad = ~F.coalesce(valid, F.lit(False)) | (F.col("_n") > 1)
    guarded = F.when(bad, F.raise_error(F.concat(F.lit("bad record "), F.col(key).cast("string")))).otherwise(F.col(status))
    return checked.withColumn(status, guarded.cast("string")).filter(F.col(status) == expected).drop("_n")


_TIME = r"(\d{1,2}:\d{2}(?::\d{2})?[.,]\d{1,3})"


def subtitle_scan(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, start_seconds, end_seconds, content) of SRT and VTT files: blocks between
    blank lines that hold a time range."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    blocks = files.select("file", F.posexplode(F.split(F.replace("value", F.lit("\r"), F.lit("")), r"\n\s*\n")).alias("position", "b"))
    pattern = rf"{_TIME}\s*-->\s*{_TIME}[^\n]*\n([\s\S]*)"
    at = lambda i: F.regexp_extract("b", pattern, i)
    cues = blocks.filter(F.col("b").rlike(pattern))
    return cues.select("file", "position", clock_seconds(at(1)).alias("start_seconds"), clock_seconds(at(2)).alias("end_seconds"), strip(at(3)).alias("content"))


def json_cues(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, start_seconds, end_seconds, content) of JSON subtitles: a list of objects, or
    an object whose body is one, with from, to and content or start, end and text. Rows that are no
    object or say nothing are left out; a file that is neither fails."""
    kind = "from double, to double, start double, end double, content string, text string"
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.trim("value").alias("value"))
    listed = F.from_json("value", f"array<struct<{kind.replace(' ', ':')}>>".replace(",:", ","))
    held = F.from_json("value", f"struct<body:array<struct<{kind.replace(' ', ':')}>>>".replace(",:", ","))["body"]
    rows = F.when(F.col("value").startswith("["), listed).otherwise(held)
    checked = F.when(rows.isNull(), F.raise_error(F.concat(F.lit("no list of cues in "), "file"))).otherwise(rows)
    each = files.select("file", F.posexplode(checked).alias("position", "_c")).filter("_c IS NOT NULL")
    said = strip(F.coalesce(F.when(F.col("_c.content") != "", F.col("_c.content")), F.col("_c.text"), F.lit("")))
    at = lambda *names: F.coalesce(*[F.col(f"_c.{n}") for n in names], F.lit(0.0))
    return each.select("file", "position", at("from", "start").alias("start_seconds"), at("to", "end").alias("end_seconds"), said.alias("content")).filter("content <> ''")


def plain_cues(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, start_seconds, end_seconds, content): a cue without times for each line with
    something on it, but for direct repeats."""
    full = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    each = texts.select(key, F.posexplode(F.element_at(F.transform(F.array(full), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))), 1)).alias("position", "content"))
    return each.select(key, "position", F.lit(0.0).alias("start_seconds"), F.lit(0.0).alias("end_seconds"), "content")


def segments_to_cues(records: DataFrame, key: str) -> DataFrame:
    """Reviewed segments (start, end, evidence, summary) as cue rows; the end defaults to the start
    and the content to the summary."""
    each = records.select(key, F.explode("segments").alias("s"))
    return each.select(
        key, clock_seconds(F.col("s.start")).alias("start_seconds"), clock_seconds(F.coalesce("s.end", "s.start")).alias("end_seconds"),
        F.coalesce("s.evidence", "s.summary").alias("content"),
    )


def write_index(df: DataFrame, path: str, model: str, dimensions: int) -> None:
    """An index table and, beside it, its one-row manifest."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    # counted as written: ``df`` isn't made twice
    manifest = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows").agg(F.lit(model).alias("model"), F.lit(dimensions).alias("dimensions"), F.count(F.lit(1)).alias("n"))
    manifest.write.mode("overwrite").parquet(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, model: str, dimensions: int) -> DataFrame:
    """The rows of an index, if its manifest names this model and size and as many rows as it has."""
    m = spark.read.parquet(f"{path}/manifest").first()
    rows = spark.read.parquet(f"{path}/rows")
    if (m["model"], m["dimensions"]) != (model, dimensions) or m["n"] != rows.count():
        raise ValueError(f"the index was made by {m['model']} with {m['dimensions']} dimensions and {m['n']} rows")
    return rows


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Rewrite the partitions that ``df`` has rows for, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


#: What separates exported texts within a file: a sign that texts don't have.
RECORD = "\x1e"


def export_text(chunks: DataFrame, path: str, header: list[str], text: str) -> None:
    """Every chunk rendered with its provenance above it, many to a file with RECORD between them: a
    file for each would be more files than a store can list. A RECORD sign within a text goes."""
    head = F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in header])
    body = F.translate(F.coalesce(F.col(text), F.lit("")), RECORD, "")
    chunks.select(F.concat(head, F.lit("\n\n"), body).alias("value")).write.mode("overwrite").option("lineSep", RECORD).text(path)


def read_exported(spark: SparkSession, path: str) -> DataFrame:
    """(head, body) of exported texts."""
    rows = spark.read.option("lineSep", RECORD).text(path)
    at = F.position(F.lit("\n\n"), F.col("value"))
    return rows.select(F.substr("value", F.lit(1), at - 1).alias("head"), F.substr("value", at + 2).alias("body"))


def embedded_json(html: Column, marker: str, schema: str) -> Column:
    """The object that follows a marker in a page, read by the schema. Spark's parser stops where
    the object's braces balance."""
    after = F.substring_index(html, marker, -1)
    start = F.regexp_extract(after, r"(?s)^[^{]*(\{.*)$", 1)
    return F.when(html.contains(marker), F.from_json(start, schema))
