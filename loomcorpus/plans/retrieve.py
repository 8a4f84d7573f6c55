"""Retrieval over documents as chunks, with the benchmark's texts as queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import inverted
from ..operators import retrieval as r
from ..sources.shared import place
from .registry import query, table

#: Buckets of the queries' index: one for some hundred MB of postings is enough.
BUCKETS = 16
_indexes: dict[tuple[str, str], inverted.Index] = {}


def words(c):
    return text.tokenize(c, "words")


def queries_of(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def chunks_of(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source", "n_chars")


def indexed(spark, d):
    """The documents as chunks of the corpora that answers are routed to."""
    source = F.col("source")
    corpus = F.when(source == "src0", "official").when(source == "src3", "navigation").otherwise("dialogue")
    return chunks_of(spark, d).select("chunk_id", "text", corpus.alias("corpus"))


def build_index(spark, d):
    """The index of the documents, written anew; queries of the same tables and session use it."""
    index = inverted.build(indexed(spark, d), words, place(spark, "inverted"), BUCKETS)
    _indexes[spark.sparkContext.applicationId, d] = index
    return index


def index_of(spark, d):
    return _indexes.get((spark.sparkContext.applicationId, d)) or build_index(spark, d)


def best(spark, d, k, method):
    return inverted.search(index_of(spark, d), queries_of(spark, d), words, k, method)


_BASE = r"""
WITH q AS (SELECT item_id AS query_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL),
h AS (SELECT doc_id AS chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM documents),
tf AS (SELECT chunk_id, len AS length, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS len, unnest(t) AS term FROM h) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM h),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(1.0, mean)))), 10) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term), s GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0)
"""
_VECTORS = _BASE.rstrip() + r""",
qb AS (SELECT query_id, ('0x' || substr(sha256(term), 1, 8))::UBIGINT % 2048 AS b, sum(qtf) AS c FROM q GROUP BY ALL),
cb AS (SELECT chunk_id, ('0x' || substr(sha256(term), 1, 8))::UBIGINT % 2048 AS b, sum(tf) AS c FROM tf GROUP BY ALL),
qn AS (SELECT query_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS w FROM qb),
cn AS (SELECT chunk_id, b, c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)) AS w FROM cb),
share AS (SELECT DISTINCT query_id, chunk_id FROM q JOIN tf USING (term)),
hv AS (SELECT query_id, chunk_id, round(sum(qn.w * cn.w), 10) AS score FROM qn JOIN cn USING (b) JOIN share USING (query_id, chunk_id) GROUP BY ALL),
hvr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hv WHERE score > 0)
"""
_FUSED = _VECTORS.rstrip() + r""",
parts AS (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS p FROM bmr WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, 1.0 / (60 + rank) FROM hvr WHERE rank <= 50),
fs AS (SELECT query_id, chunk_id, lang, source, n_chars, text, round(sum(p) + CASE WHEN source = 'src0' THEN 0.002 ELSE 0 END, 10) AS score FROM parts JOIN documents ON doc_id = chunk_id GROUP BY query_id, chunk_id, lang, source, n_chars, text),
fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source = 'src0' DESC, score DESC, chunk_id) AS rank FROM fs)
"""
_RANK = "SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM {} WHERE rank <= {}"


def places(c, n):
    """A positive number to ``n`` places as SQL rounds it: the whole number nearest to the product with
    10 to the n. Decimal digits that end in 5 may be rounded to the other side by F.round."""
    return F.floor(c * 10.0**n + 0.5) / 10.0**n


def _shown(df):
    return df.select("query_id", "chunk_id", places(F.col("score"), 8).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(_BASE + _RANK.format("bmr", 5))
def r1_bm25(spark, d):
    """BM25 from the index: only folders of the queries' terms are read."""
    return _shown(best(spark, d, 5, "bm25"))


@query(_VECTORS + "SELECT chunk_id, b::INT AS bucket, round(w, 8) AS weight FROM cn")
def r2_hashed_vectors(spark, d):
    return r.hashed_vectors(chunks_of(spark, d), "chunk_id", words(F.col("text"))).select("chunk_id", "bucket", F.round("weight", 8).alias("weight"))


@query(_VECTORS + _RANK.format("hvr", 5))
def r3_hashed_rank(spark, d):
    return _shown(best(spark, d, 5, "cosine"))


@query("""SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS norm, round(v[1], 6) AS first FROM (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)""")
def r4_unit_vectors(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", r.unit_vector(F.col("embedding")).alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    return df.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.col("v")[0], 6).alias("first"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.v, b.v), 10) AS score FROM u a, u b WHERE a.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM t WHERE rank <= 5""")
def r5_dense_rank(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    asked = vectors.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    out = r.dense_rank(asked, vectors, 5)
    return out.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def hybrid(spark, d):
    """BM25 and hashed vectors fused; chunks of the preferred source gain and come first."""
    c = chunks_of(spark, d)
    plain = r.rrf([best(spark, d, 50, "bm25"), best(spark, d, 50, "cosine")], 10_000).drop("rank")
    joined = plain.join(c.select("chunk_id", "source", "lang", "n_chars", "text"), "chunk_id")
    first = F.col("source") == "src0"
    joined = joined.withColumn("score", F.round(F.col("score") + F.when(first, 0.002).otherwise(0.0), 10))
    return r.rerank(joined, [first.desc()])


@query(_FUSED + _RANK.format("fused", 5))
def r6_rrf(spark, d):
    return _shown(hybrid(spark, d).filter("rank <= 5"))


_RERANK = _FUSED.rstrip() + r""",
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9_]+'), (SELECT regexp_extract_all(lower(b.text), '[a-z0-9_]+') FROM benchmark b WHERE b.item_id = query_id))) DESC, score DESC, chunk_id) AS place
  FROM fused WHERE rank <= 50)
"""


@query(_RERANK + "SELECT query_id, chunk_id, round(score, 8) AS score, place AS rank FROM rr WHERE place <= 5")
def r7_metadata_rerank(spark, d):
    base = hybrid(spark, d).filter("rank <= 50")
    asked = queries_of(spark, d).select("query_id", F.array_distinct(words(F.col("text"))).alias("_q"))
    overlap = F.size(F.array_intersect("_q", words(F.substring_index("text", "\n", 1))))
    return _shown(r.rerank(base.join(asked, "query_id"), [overlap.desc()]).filter("rank <= 5"))


_DIRECTED = _FUSED.rstrip() + r""",
dt AS (SELECT item_id AS query_id, regexp_extract(trim(text), '^(\S{1,12})\s', 1) AS directed, regexp_extract_all(lower(text), '[a-z0-9_]+') AS asked FROM benchmark),
rr AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY source = 'src0' DESC, directed <> '' AND starts_with(title, directed) DESC, len(list_intersect(regexp_extract_all(lower(title), '[a-z0-9_]+'), asked)) DESC, score DESC, chunk_id) AS place
  FROM (SELECT *, split_part(text, chr(10), 1) AS title FROM fused) JOIN dt USING (query_id) WHERE rank <= 50)
"""


@query(_DIRECTED + "SELECT query_id, chunk_id, round(score, 8) AS score, place AS rank FROM rr WHERE place <= 5")
def r7_directed_rerank(spark, d):
    """Titles that start with the first word of the question come first within their corpus."""
    base = hybrid(spark, d).filter("rank <= 50")
    named = r.directed_title(F.col("text"), r"(?s)^(\S{1,12})\s.*$", "$1").alias("_d")
    asked = queries_of(spark, d).select("query_id", F.array_distinct(words(F.col("text"))).alias("_q"), named)
    title = F.substring_index("text", "\n", 1)
    keys = r.metadata_keys(F.col("source") == "src0", F.col("_d"), title, F.size(F.array_intersect("_q", words(title))))
    return _shown(r.rerank(base.join(asked, "query_id"), keys).filter("rank <= 5"))


_SEMANTIC = r"""WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, (a.label = b.label)::INT AS rel, round(list_dot_product(a.v, b.v), 10) AS score FROM u a, u b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0),
g AS (SELECT query_id, sum(rel) AS n_gold FROM s GROUP BY 1),
p AS (SELECT query_id, sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, sum(CASE WHEN rank <= 3 THEN rel ELSE 0 END) AS h3, sum(rel) AS h5, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg FROM t WHERE rank <= 5 GROUP BY 1),
e AS (SELECT query_id, n_gold, round(coalesce(h1, 0) / n_gold, 6) AS r1, round(coalesce(h3, 0) / n_gold, 6) AS r3, round(coalesce(h5, 0) / n_gold, 6) AS r5, round(coalesce(1.0 / first, 0), 6) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, n_gold)::BIGINT + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg
  FROM g LEFT JOIN p USING (query_id) WHERE n_gold > 0)
SELECT 'semantic' AS run, count(*) AS cases, round(avg(r1), 5) AS recall_1, round(avg(r3), 5) AS recall_3, round(avg(r5), 5) AS recall_5, round(avg(rr), 5)::DOUBLE AS mrr, round(avg(ndcg), 5) AS ndcg_5 FROM e"""


@query(_SEMANTIC)
def r13_semantic_run(spark, d):
    """The run by given vectors, not their words: each twentieth vector asks for the others of its label."""
    held = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")
    asked = held.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    ranking = r.dense_rank(asked, held, 6).filter("query_id <> chunk_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    ranking = ranking.withColumn("rank", F.row_number().over(order)).filter("rank <= 5")
    labels = asked.select("query_id", F.col("label").alias("_l"))
    # the gold of a query is a label's rows: counted, and looked up for the few that were found
    sizes = held.groupBy(F.col("label").alias("_l")).agg((F.count(F.lit(1)) - 1).alias("n_gold"))
    found = ranking.join(labels, "query_id").join(held.select("chunk_id", "label"), "chunk_id").withColumn("rel", (F.col("label") == F.col("_l")).cast("int"))
    each = r.measures(found, labels.join(sizes, "_l").filter("n_gold > 0").select("query_id", "n_gold"))
    mean = lambda c: F.round(F.avg(c), 5)
    return each.agg(
        F.lit("semantic").alias("run"), F.count(F.lit(1)).alias("cases"), mean("recall_1").alias("recall_1"), mean("recall_3").alias("recall_3"),
        mean("recall_5").alias("recall_5"), mean("reciprocal_rank").alias("mrr"), mean("ndcg_5").alias("ndcg_5"),
    )


_DIVERSE = _FUSED.rstrip() + r""",
dv AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY nth > 1, rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS nth FROM fused WHERE rank <= 50)),
pk AS (SELECT *, sum(least(n_chars, 480) + 2) OVER (PARTITION BY query_id ORDER BY position) - 2 AS used FROM dv WHERE position <= 5)
"""


@query(_DIVERSE + "SELECT query_id, chunk_id, position FROM dv WHERE position <= 5")
def f20_diversify(spark, d):
    out = r.diversify(hybrid(spark, d).filter("rank <= 50"), "source", 5)
    return out.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"))


@query(_DIVERSE + "SELECT query_id, chunk_id, position, used::BIGINT AS used FROM pk WHERE used <= 1500")
def f21_pack_context(spark, d):
    first = r.diversify(hybrid(spark, d).filter("rank <= 50"), "source", 5)
    out = r.pack_context(first, F.least(F.col("n_chars"), F.lit(480)), "position", 1500)
    return out.select("query_id", "chunk_id", F.col("position").cast("long").alias("position"), F.col("used").cast("long").alias("used"))


@query(_BASE + """SELECT query_id, string_agg('[' || source || ']', ' ' ORDER BY first) AS citations FROM (
  SELECT query_id, source, min(rank) AS first FROM bmr JOIN documents ON doc_id = chunk_id WHERE rank <= 5 GROUP BY ALL) GROUP BY query_id""")
def r10_citations(spark, d):
    found = best(spark, d, 5, "bm25").join(chunks_of(spark, d).select("chunk_id", "source"), "chunk_id")
    each = found.groupBy("query_id", "source").agg(F.min("rank").alias("first"))
    row = F.sort_array(F.collect_list(F.struct("first", F.concat(F.lit("["), "source", F.lit("]")).alias("s"))))
    return each.groupBy("query_id").agg(F.array_join(row["s"], " ").alias("citations"))


@query("""SELECT source, text_hash, first_id FROM (SELECT source, md5(text) AS text_hash, min(doc_id) AS first_id FROM documents WHERE contains(lower(text), 'ention') GROUP BY source, text)""")
def r11_keyword_search(spark, d):
    hits = table(spark, d, "documents").filter(F.lower("text").contains("ention"))
    one = hits.groupBy("source", "text").agg(F.min("doc_id").alias("first_id"))
    return one.select("source", F.md5("text").alias("text_hash"), "first_id")


@query("SELECT doc_id AS chunk_id FROM documents WHERE doc_id % 10 = 3 OR doc_id % 10 = 7")
def j14_stale_rows(spark, d):
    chunks = chunks_of(spark, d).select("chunk_id", F.sha2("text", 256).alias("fingerprint"))
    index = chunks.filter("chunk_id % 10 <> 3").withColumn("fingerprint", F.when(F.col("chunk_id") % 10 == 7, "old").otherwise(F.col("fingerprint")))
    return r.stale(chunks, index)


_CHANGED = r"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 20 = 7 THEN text || ' zebra zuko' ELSE text END AS text FROM documents WHERE doc_id % 20 <> 3),
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM d)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM t GROUP BY term"""


@query(_CHANGED)
def j14_refreshed_index(spark, d):
    """The terms of an index that was refreshed after a twentieth of the chunks went and another
    changed; the folders their terms aren't in stayed as they were."""
    at = F.col("chunk_id") % 20
    before = indexed(spark, d)
    now = before.filter(at != 3).withColumn("text", F.when(at == 7, F.concat("text", F.lit(" zebra zuko"))).otherwise(F.col("text")))
    index = inverted.build(before, words, place(spark, "refreshed"), BUCKETS)
    return inverted.term_stats(inverted.refresh(index, now, words))


@query(_BASE + "SELECT chunk_id, max(length)::INT AS length, count(*) AS terms, sum(tf)::BIGINT AS tokens FROM tf GROUP BY chunk_id")
def s9_inverted_index(spark, d):
    """The index written, loaded by its manifest, and each chunk's part of it."""
    index = inverted.load(spark, build_index(spark, d).path)
    each = index.postings().select(F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
    g = each.groupBy(F.col("p.ids").alias("chunk_id"))
    return g.agg(F.max("p.lengths").alias("length"), F.count(F.lit(1)).alias("terms"), F.sum("p.tfs").alias("tokens"))


@query(_BASE + "SELECT term, df.df, sum(tf.tf)::BIGINT AS tf, n AS n_chunks, round(mean, 6) AS mean_length FROM df JOIN tf USING (term), s GROUP BY term, df.df, n, mean")
def a20_term_stats(spark, d):
    """Each term's frequencies from the heads of the index's blocks, with the corpus's size beside
    them, which the manifest has."""
    index = index_of(spark, d)
    n, length = index.size()
    return inverted.term_stats(index).select("term", "df", "tf", F.lit(n).alias("n_chunks"), F.round(F.lit(length / max(n, 1)), 6).alias("mean_length"))


@query(_BASE + "SELECT chunk_id, len(t)::INT AS length FROM h")
def a20_chunk_lengths(spark, d):
    return chunks_of(spark, d).select("chunk_id", F.size(words(F.col("text"))).alias("length"))


def _signature_sql():
    levels = ["h8 AS (SELECT substr(h, 1, 8) AS p, sha256(string_agg(h, '' ORDER BY h)) AS x FROM h GROUP BY 1)"]
    levels += [f"h{n} AS (SELECT substr(p, 1, {n}) AS p, sha256(string_agg(x, '' ORDER BY p)) AS x FROM h{n + 2} GROUP BY 1)" for n in (6, 4, 2, 0)]
    return "WITH h AS (SELECT sha256(concat_ws(':', doc_id::VARCHAR, sha256(text))) AS h FROM documents), " + ", ".join(levels) + " SELECT x AS signature FROM h0"


@query(_signature_sql())
def a25_corpus_signature(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("k"), F.sha2("text", 256).alias("h"))
    return r.signature(rows, "k", "h")


_GOLD = _BASE.rstrip() + r""",
gold AS (SELECT b.item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
ng AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1),
hit AS (SELECT query_id, rank, (gold.chunk_id IS NOT NULL)::INT AS rel FROM bmr LEFT JOIN gold USING (query_id, chunk_id) WHERE rank <= 5),
pc AS (SELECT query_id, sum(CASE WHEN rank <= 1 THEN rel ELSE 0 END) AS h1, sum(CASE WHEN rank <= 3 THEN rel ELSE 0 END) AS h3, sum(rel) AS h5, min(CASE WHEN rel = 1 THEN rank END) AS first, sum(rel / log2(rank + 1)) AS dcg FROM hit GROUP BY 1),
ev AS (SELECT item_id AS query_id, coalesce(n_gold, 0) AS n_gold, CASE WHEN n_gold IS NOT NULL THEN round(coalesce(h1, 0) / n_gold, 6) END AS recall_1, CASE WHEN n_gold IS NOT NULL THEN round(coalesce(h3, 0) / n_gold, 6) END AS recall_3,
  CASE WHEN n_gold IS NOT NULL THEN round(coalesce(h5, 0) / n_gold, 6) END AS recall_5, CASE WHEN n_gold IS NOT NULL THEN round(coalesce(1.0 / first, 0), 6) END::DOUBLE AS reciprocal_rank,
  CASE WHEN n_gold IS NOT NULL THEN round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(5, n_gold) + 1), lambda i: 1 / log2(i + 1.0))), 6) END AS ndcg_5
  FROM benchmark LEFT JOIN ng ON item_id = ng.query_id LEFT JOIN pc ON item_id = pc.query_id)
"""


def gold_of(spark, d):
    """Documents in which an item's text stands as a whole."""
    items = queries_of(spark, d).select(F.col("query_id").alias("passage_id"), F.col("text").alias("passage"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return r.passages_in(docs, "chunk_id", "text", items).withColumnRenamed("passage_id", "query_id")


@query(_GOLD + "SELECT * FROM ev")
def a22_retrieval_metrics(spark, d):
    return r.evaluate(best(spark, d, 5, "bm25"), gold_of(spark, d), queries_of(spark, d))


@query("""SELECT length(text) // 100 AS category, count(*) AS n, count(DISTINCT item_id) <> count(*) AS duplicates FROM benchmark GROUP BY 1""")
def a21_case_distribution(spark, d):
    kind = F.floor(F.length("text") / 100).cast("long")
    g = table(spark, d, "benchmark").groupBy(kind.alias("category"))
    return g.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("item_id") != F.count(F.lit(1))).alias("duplicates"))
