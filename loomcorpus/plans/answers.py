"""Answers from routed corpora, their measures and reviews, with the benchmark's texts as questions.

A document is a chunk; its source makes it official, navigation or dialogue; its first line is its
title, and its source stands for the document that chunks are parts of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..operators import answers as a
from ..operators import retrieval as r
from ..sources.shared import written
from .registry import query, table
from .retrieve import index_of
from .scalars import INJECTION

POOLS = {"navigation": ("navigation",), "dialogue": ("dialogue", "official"), "official_fact": ("official", "dialogue"), "mixed": ("official", "dialogue")}
#: Official facts are looked for where there is nothing, as before such a corpus is collected.
UNFILLED = POOLS | {"official_fact": ("lexicon",)}
RUNS = {"none": None, "bm25": a.Recipe(POOLS, "bm25", unsafe=INJECTION), "hybrid": a.Recipe(POOLS, "hybrid", unsafe=INJECTION)}
FIXTURES = ("###",)


def words(c):
    return text.tokenize(c, "words")


def questions(spark, d):
    kind = rules.route(F.col("text"), deny=("worthless",), navigation=("Que",), topic=("e ",), dialogue=("tion ", "keit"), fact=("ing", "que "))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text", kind.alias("route"))


def corpus(spark, d):
    source = F.col("source")
    kind = F.when(source == "src0", "official").when(source == "src3", "navigation").otherwise("dialogue")
    scheme = F.when(F.col("lang") == "fr", "http://").otherwise("https://")
    url = F.concat(scheme, "source", F.lit(".example/"), F.coalesce(F.col("n_chars").cast("string"), F.lit("")))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", "lang", kind.alias("corpus"), source.alias("document"), url.alias("url"),
        rules.first_match([(kind == "official", "A"), (kind == "dialogue", "B")], "C").alias("tier"), F.substring_index("text", "\n", 1).alias("title"),
        F.sha2("text", 256).alias("fingerprint"),
    )


def gold(spark, d):
    """Chunks in which a question's text stands as a whole."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    items = questions(spark, d).select(F.col("query_id").alias("passage_id"), F.col("text").alias("passage"))
    return r.passages_in(docs, "chunk_id", "text", items).withColumnRenamed("passage_id", "query_id")


def ranker(spark, d):
    """Rankings from the index; routes read the folders of their corpora only."""
    return a.searching(index_of(spark, d), words, RUNS["hybrid"].wide)


def results_of(spark, d, recipe, index=None, rank=None):
    return a.answer(questions(spark, d), corpus(spark, d), words, recipe, index, rank or ranker(spark, d))


_RESULT = "query_id long, position long, chunk_id long, score double, document string, url string, tier string, title string, excerpt string, used long"


def measured(spark, d, run, rank=None, found=None):
    """(results, measures per case) of a run; the run "none" answers nothing."""
    found = gold(spark, d) if found is None else found
    tiers = found.join(corpus(spark, d).select("chunk_id", "tier"), "chunk_id").groupBy("query_id").agg(F.min("tier").alias("expected_tier"))
    cases = questions(spark, d).select("query_id").join(tiers, "query_id", "left")
    results = spark.createDataFrame([], _RESULT) if RUNS[run] is None else results_of(spark, d, RUNS[run], rank=rank)[0]
    return results, a.case_measures(results, cases, found, urls.is_safe_url, INJECTION, FIXTURES)


_QUESTIONS = r"""WITH q0 AS (SELECT item_id AS query_id, text, CASE WHEN trim(text) = '' OR contains(text, 'worthless') THEN 'none' WHEN contains(text, 'Que') THEN 'navigation'
  WHEN contains(trim(text), 'e ') AND (contains(text, 'tion ') OR contains(text, 'keit')) THEN 'dialogue' WHEN contains(trim(text), 'e ') AND (contains(text, 'ing') OR contains(text, 'que ')) THEN 'official_fact'
  WHEN contains(trim(text), 'e ') THEN 'mixed' ELSE 'none' END AS route FROM benchmark),
qp AS (SELECT *, CASE route WHEN 'none' THEN NULL WHEN 'navigation' THEN 1 ELSE 2 END AS pool, CASE route WHEN 'navigation' THEN 'navigation' WHEN 'dialogue' THEN 'dialogue' ELSE 'official' END AS preferred FROM q0),
c0 AS (SELECT doc_id AS chunk_id, text, source AS document, lang, CASE source WHEN 'src0' THEN 'official' WHEN 'src3' THEN 'navigation' ELSE 'dialogue' END AS corpus, CASE WHEN lang = 'fr' THEN 'http://' ELSE 'https://' END || source || '.example/' || n_chars AS url,
  CASE source WHEN 'src0' THEN 'A' WHEN 'src3' THEN 'C' ELSE 'B' END AS tier, split_part(text, chr(10), 1) AS title, CASE source WHEN 'src3' THEN 1 ELSE 2 END AS pool FROM documents),
ex AS (SELECT *, CASE WHEN length(b) > 480 THEN rtrim(substr(b, 1, 480), ' ' || chr(10)) || '…' ELSE b END AS excerpt FROM (SELECT *, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
  lambda x: x <> '' AND NOT regexp_matches(x, '(?i)ignore (all|previous)') AND NOT starts_with(x, 'The and ')), chr(10)) AS b FROM c0)),
q AS (SELECT query_id, pool, term, count(*) AS qtf FROM (SELECT query_id, pool, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM qp WHERE pool IS NOT NULL) GROUP BY ALL),
h AS (SELECT chunk_id, pool, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM c0),
tf AS (SELECT chunk_id, pool, len AS length, term, count(*) AS tf FROM (SELECT chunk_id, pool, len(t) AS len, unnest(t) AS term FROM h) GROUP BY ALL),
df AS (SELECT pool, term, count(*) AS df FROM tf GROUP BY ALL), s AS (SELECT pool, count(*) AS n, avg(len(t)) AS mean FROM h GROUP BY pool),
bm AS (SELECT query_id, chunk_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(1.0, mean)))), 10) AS score
  FROM q JOIN df USING (pool, term) JOIN tf USING (pool, term) JOIN s USING (pool) GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM bm WHERE score > 0),
qb AS (SELECT query_id, pool, ('0x' || substr(sha256(term), 1, 8))::UBIGINT % 2048 AS b, sum(qtf) AS c FROM q GROUP BY ALL),
cb AS (SELECT chunk_id, pool, ('0x' || substr(sha256(term), 1, 8))::UBIGINT % 2048 AS b, sum(tf) AS c FROM tf GROUP BY ALL),
qn AS (SELECT query_id, pool, b, c / sqrt(sum(c * c) OVER (PARTITION BY query_id)) AS w FROM qb), cn AS (SELECT chunk_id, pool, b, c / sqrt(sum(c * c) OVER (PARTITION BY chunk_id)) AS w FROM cb),
share AS (SELECT DISTINCT query_id, chunk_id FROM q JOIN tf USING (pool, term)),
hv AS (SELECT query_id, chunk_id, round(sum(qn.w * cn.w), 10) AS score FROM qn JOIN cn USING (pool, b) JOIN share USING (query_id, chunk_id) GROUP BY ALL),
hvr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hv WHERE score > 0),
fs AS (SELECT query_id, chunk_id, sum(p) AS score FROM (SELECT query_id, chunk_id, 1.0 / (60 + rank) AS p FROM bmr WHERE rank <= 50 UNION ALL SELECT query_id, chunk_id, 1.0 / (60 + rank) FROM hvr WHERE rank <= 50) GROUP BY ALL),
merged AS (SELECT 'hybrid' AS run, query_id, chunk_id, score, true AS fused FROM fs UNION ALL SELECT 'bm25', query_id, chunk_id, score, false FROM bmr WHERE rank <= 50),
"""
#: The path from rankings, ``used``, to results.
_RESULTS = r"""first AS (SELECT run, query_id, chunk_id, fused AND corpus = preferred AS p, round(used.score + CASE WHEN fused AND corpus = preferred THEN 0.002 ELSE 0 END, 10) AS score, document, url, tier, title, excerpt, qp.text AS asked
  FROM used JOIN ex USING (chunk_id) JOIN qp USING (query_id)),
wide AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY p DESC, score DESC, chunk_id) AS r0 FROM first),
rr AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY len(list_intersect(list_distinct(regexp_extract_all(lower(asked), '[a-z0-9_]+')), regexp_extract_all(lower(title), '[a-z0-9_]+'))) DESC, score DESC, chunk_id) AS rank FROM wide WHERE r0 <= 50),
dv AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY nth > 1, rank) AS position FROM (SELECT *, row_number() OVER (PARTITION BY run, query_id, document ORDER BY rank) AS nth FROM rr)),
res AS (SELECT * FROM (SELECT *, sum(length(excerpt) + 2) OVER (PARTITION BY run, query_id ORDER BY position) - 2 AS used FROM dv WHERE position <= 5 AND excerpt <> '') WHERE used <= 1500),
"""
_SQL = _QUESTIONS + "used AS (SELECT * FROM merged),\n" + _RESULTS
_ANSWERS = r"""g AS (SELECT query_id, count(*) AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY position) AS chunks, string_agg('[' || document || '/' || chunk_id || ']', ' ' ORDER BY position) AS citations, max(used)::BIGINT AS used FROM res WHERE run = 'hybrid' GROUP BY 1)
SELECT query_id, route, {method} AS method, {reason} AS reason, coalesce(n, 0) AS n, coalesce(chunks, '') AS chunks, coalesce(citations, '') AS citations, coalesce(g.used, 0) AS used FROM qp LEFT JOIN g USING (query_id)"""


@query(_SQL + _ANSWERS.format(method="CASE route WHEN 'none' THEN 'none' ELSE 'hybrid' END", reason="CASE route WHEN 'none' THEN 'not a question for a corpus' END"))
def r8_retrieve(spark, d):
    """Routed, pruned to the route's corpora, ranked both ways, fused, reranked, diversified, packed."""
    results, states = results_of(spark, d, RUNS["hybrid"])
    return a.rendered(results, states)


_DEGRADED = _QUESTIONS + "used AS (SELECT 'hybrid' AS run, query_id, chunk_id, score, fused FROM merged JOIN qp USING (query_id) WHERE route <> 'official_fact' AND run = CASE route WHEN 'navigation' THEN 'bm25' ELSE 'hybrid' END),\n" + _RESULTS


@query(_DEGRADED + _ANSWERS.format(
    method="CASE route WHEN 'none' THEN 'none' WHEN 'official_fact' THEN 'none' WHEN 'navigation' THEN 'bm25' ELSE 'hybrid' END",
    reason="CASE route WHEN 'none' THEN 'not a question for a corpus' WHEN 'official_fact' THEN 'no eligible corpus' WHEN 'navigation' THEN 'index is stale' END",
).replace("FROM qp LEFT", ", route = 'mixed' OR route = 'dialogue' AS fused FROM qp LEFT"))
def r9_degrade(spark, d):
    """An index without the navigation chunks, and a route whose corpus is empty."""
    chunks = corpus(spark, d)
    index = chunks.filter("corpus <> 'navigation'").select("chunk_id", "fingerprint")
    recipe = a.Recipe(UNFILLED | {"mixed": ("official", "dialogue")}, "hybrid", unsafe=INJECTION)
    results, states = results_of(spark, d, recipe, index)
    return a.rendered(results, states).withColumn("fused", F.col("method") == "hybrid")


_CASES = r"""gold AS (SELECT b.item_id AS query_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''),
ng AS (SELECT query_id, count(DISTINCT chunk_id) AS n_gold, min(tier) AS expected FROM gold JOIN c0 USING (chunk_id) GROUP BY 1),
runs AS (SELECT unnest(['none', 'bm25', 'hybrid']) AS run),
hit AS (SELECT res.*, row_number() OVER (PARTITION BY run, res.query_id ORDER BY position) AS k, (gold.chunk_id IS NOT NULL)::INT AS rel FROM res LEFT JOIN gold ON gold.query_id = res.query_id AND gold.chunk_id = res.chunk_id),
pc AS (SELECT run, query_id, count(*) AS n_results, count(*) - count(DISTINCT url) AS repeats, sum(CASE WHEN k <= 1 THEN rel ELSE 0 END) AS h1, sum(CASE WHEN k <= 3 THEN rel ELSE 0 END) AS h3, sum(rel) AS h5, min(CASE WHEN rel = 1 THEN k END) AS first,
  sum(rel / log2(k + 1)) AS dcg, bool_and(starts_with(url, 'https://')) AS all_safe, max(CASE WHEN k = 1 THEN tier END) AS top_tier, count_if(contains(lower(concat_ws(chr(10), chunk_id::VARCHAR, title, url)), '###')) AS fixtures,
  bool_or(regexp_matches(excerpt, '(?i)ignore (all|previous)') OR starts_with(excerpt, 'The and ')) AS injected FROM hit GROUP BY ALL),
ev AS (SELECT run, query_id, coalesce(n_gold, 0) AS n_gold, coalesce(n_results, 0) AS n_results, coalesce(h1, 0) / n_gold AS recall_1, coalesce(h3, 0) / n_gold AS recall_3, coalesce(h5, 0) / n_gold AS recall_5,
  CASE WHEN n_gold IS NOT NULL THEN coalesce(1.0 / first, 0) END::DOUBLE AS rr, coalesce(dcg, 0) / CASE WHEN n_gold IS NOT NULL THEN list_sum(list_transform(range(1, least(5, n_gold) + 1), lambda i: 1 / log2(i + 1.0))) END AS ndcg,
  CASE WHEN n_gold IS NOT NULL THEN coalesce(n_results, 0) > 0 END AS cited, CASE WHEN n_gold IS NOT NULL THEN coalesce(n_results, 0) > 0 AND coalesce(all_safe, false) END AS cited_safely,
  CASE WHEN n_gold IS NOT NULL THEN coalesce(top_tier = expected, false) END AS right_tier, CASE WHEN n_gold IS NULL THEN coalesce(n_results, 0) = 0 END AS abstained,
  coalesce(fixtures, 0) AS fixtures, coalesce(injected, false) AS injected, coalesce(repeats, 0) AS repeats
  FROM qp CROSS JOIN runs LEFT JOIN ng USING (query_id) LEFT JOIN pc USING (run, query_id)),
me AS (SELECT run, count(*) AS cases, round(avg(recall_1), 6) AS recall_1, round(avg(recall_3), 6) AS recall_3, round(avg(recall_5), 6) AS recall_5, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_5,
  round(100.0 * count_if(cited) / count(cited), 3) AS cited_percent, round(100.0 * count_if(cited_safely) / count(cited_safely), 3) AS cited_safely_percent, round(100.0 * count_if(right_tier) / count(right_tier), 3) AS right_tier_percent,
  round(100.0 * count_if(abstained) / count(abstained), 3) AS no_answer_percent, sum(fixtures)::BIGINT AS fixtures, count_if(injected) AS injected, round(sum(repeats) / greatest(1, sum(n_results)), 6) AS repeat_rate FROM ev GROUP BY run),
rev AS (SELECT query_id, list_filter([CASE WHEN n_gold > 0 AND n_results = 0 THEN 'no results' END, CASE WHEN n_gold > 0 AND n_results > 0 AND recall_5 = 0 THEN 'gold missed' END, CASE WHEN n_gold > 0 AND recall_1 = 0 AND recall_5 > 0 THEN 'gold below rank 1' END,
  CASE WHEN n_gold > 0 AND NOT right_tier THEN 'other tier first' END, CASE WHEN NOT abstained THEN 'should abstain' END], lambda x: x IS NOT NULL) AS errors FROM ev WHERE run = 'hybrid'),
tops AS (SELECT run, query_id, list(chunk_id ORDER BY position) AS top FROM res GROUP BY ALL)
"""


@query(_SQL + _CASES + "SELECT * EXCLUDE (run) REPLACE (round(recall_1, 6) AS recall_1, round(recall_3, 6) AS recall_3, round(recall_5, 6) AS recall_5, round(ndcg, 6) AS ndcg, round(rr, 6) AS rr) FROM ev WHERE run = 'hybrid'")
def a22_case_measures(spark, d):
    out = measured(spark, d, "hybrid")[1].withColumnsRenamed({"reciprocal_rank": "rr", "ndcg_5": "ndcg"})
    return out.withColumns({c: F.round(c, 6) for c in ("recall_1", "recall_3", "recall_5", "ndcg", "rr")})


@query("""SELECT event_type AS run, round(quantile_cont(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(arg_min(value, event_id), 3) AS first FROM events GROUP BY 1""")
def a22_latencies(spark, d):
    """The events' values as times, their types as runs."""
    times = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("case"), "value")
    return a.latencies(times, "run", "value")


@query(_SQL + _CASES + "SELECT * FROM me")
def r13_compare_runs(spark, d):
    """All runs by the same rankings and gold, which are written once."""
    rank, found = ranker(spark, d), written(gold(spark, d), "gold")
    rows = [a.run_measures(measured(spark, d, run, rank, found)[1], run) for run in RUNS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(_SQL + _CASES + """SELECT run, coalesce(recall_5 >= 0.8, false) AS recall_met, coalesce(cited_percent = 100, false) AS citations_met, coalesce(right_tier_percent = 100, false) AS tier_met, fixtures = 0 AS no_fixtures, injected = 0 AS no_injections,
  coalesce(recall_5 >= 0.8, false) AND coalesce(cited_percent = 100, false) AND coalesce(right_tier_percent = 100, false) AND fixtures = 0 AND injected = 0 AS passed FROM me WHERE run = 'hybrid'""")
def a23_quality_gate(spark, d):
    return a.quality_gate(a.run_measures(measured(spark, d, "hybrid")[1], "hybrid"))


@query(_SQL + _CASES + "SELECT query_id, array_to_string(errors, ';') AS errors, coalesce(array_to_string(top, ','), '') AS top, CASE WHEN len(errors) > 0 THEN 'review' ELSE 'fine' END AS status FROM rev LEFT JOIN tops USING (query_id) WHERE coalesce(run, 'hybrid') = 'hybrid'")
def a24_review_rows(spark, d):
    results, cases = measured(spark, d, "hybrid")
    out = a.review_rows(cases, results)
    return out.select("query_id", F.array_join("errors", ";").alias("errors"), F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"), "status")


@query(_SQL + _CASES + """SELECT count(*) AS cases, count_if(len(errors) > 0) AS to_review, count_if(list_contains(errors, 'gold missed')) AS missed,
  CASE WHEN count(DISTINCT len(errors) > 0) = 1 THEN min(CASE WHEN len(errors) > 0 THEN 'review' ELSE 'fine' END) ELSE 'mixed' END AS status FROM rev""")
def a24_review_summary(spark, d):
    results, cases = measured(spark, d, "hybrid")
    return a.review_summary(a.review_rows(cases, results))


@query(_SQL + _CASES + "SELECT query_id, count(*) AS hits FROM hit WHERE rel = 1 AND run = 'hybrid' GROUP BY query_id")
def j8_gold_hits(spark, d):
    hits = results_of(spark, d, RUNS["hybrid"])[0].join(gold(spark, d), ["query_id", "chunk_id"], "left_semi")
    return hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))


@query(_SQL + _CASES + """SELECT n.query_id, coalesce(n.top = b.top, false) AND n.query_id IN (SELECT query_id FROM qp WHERE contains(text, 'e ')) AS carried,
  CASE WHEN n.top = b.top AND contains(qp.text, 'e ') THEN 'reviewed: ' || route END AS note FROM (SELECT * FROM tops WHERE run = 'hybrid') n JOIN qp USING (query_id) LEFT JOIN (SELECT * FROM tops WHERE run = 'bm25') b ON b.query_id = n.query_id""")
def j9_carry_forward_review(spark, d):
    """Notes made on BM25's first five are kept where fusion left those five as they were."""
    rank = ranker(spark, d)
    now, before = (a.top_results(results_of(spark, d, RUNS[run], rank=rank)[0]) for run in ("hybrid", "bm25"))
    notes = questions(spark, d).filter(F.col("text").contains("e ")).select("query_id", F.concat(F.lit("reviewed: "), "route").alias("note"))
    return a.carry_forward(now, before, notes, ["note"]).select("query_id", "carried", "note")


@query(_SQL + _CASES + """SELECT n.query_id, n.chunk_id, n.position, CASE WHEN tn.top = tb.top AND n.chunk_id % 2 = 0 THEN 'seen ' || n.chunk_id END AS note FROM res n JOIN (SELECT * FROM tops WHERE run = 'hybrid') tn USING (query_id) LEFT JOIN (SELECT * FROM tops WHERE run = 'bm25') tb USING (query_id) WHERE n.run = 'hybrid'""")
def j9_result_fields(spark, d):
    """Notes on single results of BM25 stay with their chunks where fusion left a case as it was."""
    rank = ranker(spark, d)
    now, before = (results_of(spark, d, RUNS[run], rank=rank)[0].select("query_id", "chunk_id", "position") for run in ("hybrid", "bm25"))
    notes = before.filter("chunk_id % 2 = 0").select("query_id", "chunk_id", F.concat(F.lit("seen "), F.col("chunk_id").cast("string")).alias("note"))
    return a.carry_results(now, before, notes, ["note"])
