"""What callers may put in themselves: rankers, encoders, proposers of relations, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import graph
from ..operators import retrieval as r
from .registry import query, table
from .retrieve import chunks_of, queries_of, words


def shared_words(queries, chunks, terms, k):
    """A ranker of a caller's own: the share of a query's words that a chunk has."""
    q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("w"))
    c = chunks.select("chunk_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("w"))
    size = q.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = q.join(c, "w").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("m")).join(size, "query_id")
    return r.ranked(met.select("query_id", "chunk_id", (F.col("m") / F.col("n")).alias("score")), k)


@query(r"""WITH q AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS a FROM benchmark), c AS (SELECT doc_id AS chunk_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS b FROM documents),
s AS (SELECT query_id, chunk_id, round(len(list_intersect(a, b)) / len(a), 10) AS score FROM q, c), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0)
SELECT query_id, chunk_id, round(score, 8) AS score, rank FROM t WHERE rank <= 5""")
def e1_own_ranker(spark, d):
    """A caller's ranker beside the registered ones, called by its name."""
    r.RANKERS.setdefault("shared words", shared_words)
    out = r.rank_with("shared words", queries_of(spark, d), chunks_of(spark, d), words, 5)
    return out.select("query_id", "chunk_id", F.round("score", 8).alias("score"), F.col("rank").cast("long").alias("rank"))


def letters(texts):
    """An encoder of a caller's own: how often a text has each of three letters."""
    return [[t.count("e"), t.count("n"), t.count("t")] for t in texts]


@query("""WITH v AS (SELECT doc_id, [length(text) - length(replace(text, 'e', '')), length(text) - length(replace(text, 'n', '')), length(text) - length(replace(text, 't', ''))] AS v FROM documents),
u AS (SELECT doc_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM v WHERE list_sum(v) > 0) SELECT doc_id, round(u[1], 8) AS e, round(u[2], 8) AS n, round(u[3], 8) AS t FROM u""")
def e2_own_encoder(spark, d):
    vectors = r.embed(table(spark, d, "documents"), "doc_id", "text", letters, 3)
    unit = vectors.select("doc_id", r.unit_vector(F.col("vector")).alias("u")).filter("u IS NOT NULL")
    return unit.select("doc_id", *[F.round(F.col("u")[i], 8).alias(c) for i, c in enumerate("ent")])


def first_words(docs):
    """A proposer of a caller's own: what a sentence begins with is said to come before what it ends
    with; sentences of one word are proposed too, with evidence that isn't there."""
    each = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", "\n"))).alias("evidence"))
    ends = each.withColumns({"source": F.regexp_extract("evidence", r"^(\p{L}+) ", 1), "target": F.regexp_extract("evidence", r" (\p{L}+)\.$", 1)})
    forged = F.when(F.col("target") == "", F.concat("evidence", F.lit(" (sic)"))).otherwise(F.col("evidence"))
    return ends.select("doc_id", "source", F.lit("BEFORE").alias("relation"), "target", forged.alias("evidence"), F.lit(0.5).alias("confidence"))


@query(r"""WITH l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), e AS (SELECT doc_id, x, regexp_extract(x, '^(\p{L}+) ', 1) AS source, regexp_extract(x, ' (\p{L}+)\.$', 1) AS target FROM l)
SELECT doc_id, source, target, min(x) AS evidence, 'pending' AS review FROM e WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL""")
def e3_own_proposer(spark, d):
    """Proposed relations that their document's words bear out, to be reviewed."""
    return graph.proposed(table(spark, d, "documents"), "doc_id", "text", first_words).select("doc_id", "source", "target", "evidence", "review")


@query("""SELECT doc_id, ((source = 'src1')::INT * 4 + (contains(source, '2'))::INT * 7 - (n_chars < 200)::INT * 9)::INT AS score, CASE WHEN (source = 'src1')::INT * 4 + (contains(source, '2'))::INT * 7 - (n_chars < 200)::INT * 9 >= 5 THEN 'include' ELSE 'exclude' END AS decision FROM documents""")
def e4_own_weights(spark, d):
    """A score under a caller's weights."""
    w = rules.Weights(lead_in_title=4, concept_in_title=7, too_short=-9, least_chars=200, include_from=5)
    parts = [(F.col("source") == "src1", w.lead_in_title, "lead"), (F.col("source").contains("2"), w.concept_in_title, "concept"), (F.col("n_chars") < w.least_chars, w.too_short, "short")]
    out = table(spark, d, "documents").select("doc_id", rules.scored(parts)[0].alias("score"))
    return out.withColumn("decision", F.when(F.col("score") >= w.include_from, "include").otherwise("exclude"))
