"""Sources and sinks: tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import retrieval as r
from ..sources import files
from ..sources.html import extract_sections, video_metadata
from ..sources.shared import place
from .registry import query, table


@query("SELECT doc_id, lang, md5(text) AS digest FROM documents")
def s1_read_jsonl_strict(spark, d):
    at = place(spark, "jsonl")
    files.write_jsonl(table(spark, d, "documents"), at)
    back = files.read_jsonl_strict(spark, at, "doc_id long, lang string, text string")
    return back.select("doc_id", "lang", F.md5("text").alias("digest"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def s2_read_jsonl_lenient(spark, d):
    """Of lines that are objects, arrays or broken, the objects."""
    at = place(spark, "lines")
    row = F.to_json(F.struct("doc_id", "lang"))
    line = F.when(F.col("doc_id") % 3 == 0, row).when(F.col("doc_id") % 3 == 1, F.lit("[1, 2]")).otherwise(F.lit("{broken"))
    table(spark, d, "documents").select(line.alias("value")).write.text(at)
    return files.read_jsonl_lenient(spark, at, "doc_id long, lang string").select("doc_id")


@query("SELECT 'doc_id,lang,n_chars,source' AS keys, count(*) AS n FROM documents")
def s4_write_jsonl(spark, d):
    at = place(spark, "sorted")
    files.write_jsonl(table(spark, d, "documents").select("source", "n_chars", "lang", "doc_id"), at)
    keys = F.array_join(F.json_object_keys("value"), ",")
    return spark.read.text(at).groupBy(keys.alias("keys")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id AS chunk_id, len(list_distinct(list_transform(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: ('0x' || substr(sha256(t), 1, 8))::UBIGINT % 2048))) AS buckets FROM documents WHERE regexp_matches(lower(text), '[a-z0-9_]')")
def s9_sparse_index(spark, d):
    at = place(spark, "sparse")
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    files.write_index(r.hashed_vectors(chunks, "chunk_id", text.tokenize(F.col("text"), "words")), at, "hashed-words", 2048)
    return files.load_index(spark, at, "hashed-words", 2048).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("buckets"))


@query("SELECT vec_id, len(embedding)::INT AS size FROM embeddings")
def s10_dense_index(spark, d):
    at = place(spark, "dense")
    vectors = table(spark, d, "embeddings").select("vec_id", r.unit_vector(F.col("embedding")).alias("v"))
    files.write_index(vectors, at, "given", 64)
    return files.load_index(spark, at, "given", 64).select("vec_id", F.size("v").alias("size"))


@query("SELECT doc_id, concat('id: ', doc_id, chr(10), 'lang: ', lang, chr(10), 'source: ', source) AS head, md5(text) AS digest FROM documents")
def s12_export_text(spark, d):
    """Every document rendered, and read back with its head and body."""
    at = place(spark, "export")
    docs = table(spark, d, "documents")
    files.export_text(docs.withColumn("id", F.col("doc_id")), at, ["id", "lang", "source"], "text")
    back = files.read_exported(spark, at)
    return back.select(F.regexp_extract("head", r"^id: (\d+)", 1).cast("long").alias("doc_id"), "head", F.md5("body").alias("digest"))


@query("SELECT conv_id, turn AS position, (turn * 5)::DOUBLE AS start_seconds, turn * 5 + 4.5::DOUBLE AS end_seconds FROM conversations")
def s13_subtitle_scan(spark, d):
    """Conversations as SRT files, five seconds a turn."""
    at = place(spark, "srt")
    stamp = lambda s: F.concat(F.lit("00:"), F.lpad(F.floor(s / 60).cast("string"), 2, "0"), F.lit(":"), F.lpad(F.floor(s % 60).cast("string"), 2, "0"))
    start = F.col("turn") * 5
    cue = F.concat(stamp(start), F.lit(",000 --> "), stamp(start + 4), F.lit(",500\n"), F.regexp_replace("text", "\n+", " "))
    blocks = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", cue.alias("c")))), lambda x: x["c"]), "\n\n").alias("value"))
    blocks.write.partitionBy("conv_id").text(at)
    cues = files.subtitle_scan(spark, at)
    return cues.select(F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.col("position").cast("long").alias("position"), "start_seconds", "end_seconds")


@query("SELECT conv_id, turn AS position, (turn * 5)::DOUBLE AS start_seconds, (turn * 5 + 4.5)::DOUBLE AS end_seconds, trim(text) AS content FROM conversations WHERE trim(text) <> ''")
def s13_subtitle_json(spark, d):
    """Conversations as JSON subtitles: a list, or an object with a body, by turns one or the other."""
    at = place(spark, "subtitles")
    first = F.struct((F.col("turn") * 5).alias("from"), (F.col("turn") * 5 + 4.5).alias("to"), F.col("text").alias("content"))
    other = F.struct((F.col("turn") * 5).alias("start"), (F.col("turn") * 5 + 4.5).alias("end"), F.col("text").alias("text"))
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", first.alias("a"), other.alias("b")))).alias("r"))
    body = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.col("r.a").alias("body")))).otherwise(F.to_json("r.b"))
    g.select("conv_id", body.alias("value")).write.partitionBy("conv_id").text(at)
    cues = files.json_cues(spark, at)
    return cues.select(F.regexp_extract("file", r"conv_id=(\d+)", 1).cast("long").alias("conv_id"), F.col("position").cast("long").alias("position"), "start_seconds", "end_seconds", "content")


@query(r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS a FROM documents)
SELECT doc_id, len(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1])) AS cues, md5(array_to_string(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), chr(10))) AS digest FROM l WHERE len(a) > 0""")
def s13_subtitle_plain(spark, d):
    """Documents as plain subtitles: a cue for each line that isn't that before it again."""
    cues = files.plain_cues(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    g = cues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cues"), F.sort_array(F.collect_list(F.struct("position", "content"))).alias("r"))
    return g.select("doc_id", "cues", F.md5(F.array_join("r.content", "\n")).alias("digest"))


@query(r"""SELECT page_id, 'heading' AS kind, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[123]>[^<]*[^<\s][^<]*</h[123]>')) FROM pages) GROUP BY page_id
UNION ALL SELECT page_id, 'link', count(*) FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]+)"', 1)) FROM pages) GROUP BY page_id
UNION ALL SELECT page_id, 'notice', count(*) FROM (SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">[^<]*[^<\s][^<]*</div>')) FROM pages) GROUP BY page_id""")
def s16_sectioned_extract(spark, d):
    return extract_sections(table(spark, d, "pages")).groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, length(url)::INT AS size, substr(url, 1, 20) AS head FROM pages")
def s17_embedded_json(spark, d):
    """Pages with a state object in a script, as single-page applications have it."""
    state = F.to_json(F.struct(F.length("url").alias("size"), F.struct(F.substring("url", 1, 20).alias("head")).alias("meta")))
    page = F.concat(F.lit("<script>window.state = "), state, F.lit("; run();</script>"), "html")
    found = files.embedded_json(page, "window.state", "size int, meta struct<head: string>")
    return table(spark, d, "pages").select("page_id", found.alias("s")).select("page_id", "s.size", "s.meta.head")


_PARTS = r"""SELECT page_id, title, part, name, seconds FROM (SELECT page_id, substr(url, 1, 20) || ' {"}' AS title, unnest([1, 2]) AS part, unnest(['first } \ "{', url]) AS name, unnest([length(url), page_id % 7])::INT AS seconds FROM pages) WHERE page_id % 5 > 0"""


def state_pages(spark, d):
    """Pages with a video's state in a script, braces, quotes and escapes in its strings; a fifth of
    them have an object that is cut off."""
    url = F.col("url")
    part = lambda n, name, seconds: F.struct(F.lit(n).alias("page"), name.alias("part"), seconds.cast("int").alias("duration"))
    tracks = F.array(*[F.struct(F.lit(x).alias("lan"), F.concat(url, F.lit(f"#{x}}}")).alias("subtitle_url")) for x in ("en", "de")])
    video = F.struct(
        F.concat(F.substring(url, 1, 20), F.lit(' {"}')).alias("title"),
        F.array(part(1, F.lit('first } \\ "{'), F.length(url)), part(2, url, F.col("page_id") % 7)).alias("pages"),
        F.struct(tracks.alias("list")).alias("subtitle"),
    )
    state = F.to_json(F.struct(F.struct(F.lit("}{").alias("x")).alias("other"), video.alias("videoData")))
    state = F.when(F.col("page_id") % 5 > 0, F.concat(state, F.lit(";(function() { run(); })()</script>"))).otherwise(F.substr(state, F.lit(1), F.length(state) - 2))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("<script>window.__INITIAL_STATE__ = "), state, F.when(F.col("page_id") % 5 > 0, F.col("html")).otherwise("")).alias("html"))


@query(_PARTS)
def s17_video_parts(spark, d):
    return video_metadata(state_pages(spark, d))[0]


@query("""SELECT page_id, track, language, url || '#' || language || '}' AS url FROM (SELECT page_id, url, unnest([1, 2]) AS track, unnest(['en', 'de']) AS language FROM pages) WHERE page_id % 5 > 0""")
def s17_subtitle_tracks(spark, d):
    return video_metadata(state_pages(spark, d))[1]


@query("SELECT role, CASE WHEN role = 'user' THEN 0 ELSE count(*) END + CASE WHEN role = 'user' THEN count(*) FILTER (turn = 0) ELSE 0 END AS n FROM conversations GROUP BY role")
def s18_replace_partition(spark, d):
    """Rewriting the rows of one role leaves the others."""
    at = place(spark, "parts")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role")
    files.replace_partitions(turns, at, "role")
    files.replace_partitions(turns.filter("role = 'user' AND turn = 0"), at, "role")
    return spark.read.parquet(at).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, (turn * 60 + 5)::DOUBLE AS start_seconds, CASE WHEN turn % 2 = 0 THEN turn * 60 + 5 ELSE turn * 60 + 9 END::DOUBLE AS end_seconds, CASE WHEN turn % 3 = 0 THEN role ELSE md5(text) END AS content FROM conversations")
def s19_segments_to_cues(spark, d):
    minute = F.format_string("%02d", "turn")
    segment = F.struct(
        F.concat(minute, F.lit(":05")).alias("start"), F.when(F.col("turn") % 2 == 1, F.concat(minute, F.lit(":09"))).alias("end"),
        F.when(F.col("turn") % 3 != 0, F.md5("text")).alias("evidence"), F.col("role").alias("summary"),
    )
    records = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(segment).alias("segments"))
    return files.segments_to_cues(records, "conv_id")


@query("SELECT doc_id, length(text)::DOUBLE AS size, (length(text) - length(replace(text, chr(10), '')))::DOUBLE AS line_ends FROM documents")
def r12_embed(spark, d):
    """A stand-in encoder: length and line ends of a text."""
    out = r.embed(table(spark, d, "documents"), "doc_id", "text", lambda ts: [[len(t), t.count("\n")] for t in ts], 2)
    return out.select("doc_id", F.col("vector")[0].alias("size"), F.col("vector")[1].alias("line_ends"))
