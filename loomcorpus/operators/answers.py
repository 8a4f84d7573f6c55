"""Answering batches of queries from routed corpora, and measuring the answers.

``answer`` is the whole path from a query to the excerpts that a prompt holds: route, choose the
corpora, rank, fuse, rerank, diversify, cut, pack. Tables of results have one row per query and place
and are never wider than a query's few best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import safe_excerpt
from . import inverted
from . import retrieval as r

#: Ranks queries by "bm25" or "cosine" in some corpora: (method, queries, chunks of those, corpora).
Ranker = Callable[[str, DataFrame, DataFrame, Sequence[str]], DataFrame]
_RANKED = "query_id long, chunk_id long, score double"
RANK_AT = (1, 3, 5)


@dataclass(frozen=True)
class Recipe:
    """How queries are answered. ``pools`` names each route's corpora, the preferred one first; a
    route without corpora is not answered."""

    pools: Mapping[str, Sequence[str]]
    method: str = "hybrid"
    k: int = 5
    excerpt: int = 480
    budget: int = 1500
    bonus: float = 0.002
    unsafe: Sequence[str] = ()

    @property
    def wide(self) -> int:
        """How many a ranking has before it is reranked."""
        return max(10 * self.k, 50)


def _one(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def scanning(terms: Callable[[Column], Column], k: int) -> Ranker:
    """Reads every text of the corpora."""
    return lambda method, asked, pool, corpora: {"bm25": r.bm25, "cosine": r.hashed_rank}[method](asked, pool, terms, k)


def searching(index: inverted.Index, terms: Callable[[Column], Column], k: int) -> Ranker:
    """Searches an index whose corpora these are. A ranking is written when it is first asked for, so
    several recipes share it; the queries of a set of corpora must be the same in all of them."""
    held: dict[tuple, DataFrame] = {}

    def rank(method: str, asked: DataFrame, pool: DataFrame, corpora: Sequence[str]) -> DataFrame:
        key = (method, tuple(corpora))
        if key not in held:
            held[key] = inverted.search(index, asked, terms, k, method, corpora)
        return held[key]

    return rank


def ranked_by_route(
    queries: DataFrame, chunks: DataFrame, terms: Callable[[Column], Column], recipe: Recipe, index: DataFrame | None = None, rank: Ranker | None = None
) -> tuple[DataFrame, DataFrame]:
    """The ranking of ``queries`` (query_id, text, route) over ``chunks`` (chunk_id, text, corpus and,
    if there is an index, fingerprint), and each query's (method, reason).

    Each set of corpora is ranked by itself. If a set has no chunks its queries have no answer; if
    ``index`` (chunk_id, fingerprint) lacks one of its chunks, or holds another version, its queries
    are ranked by BM25 alone.
    """
    spark = queries.sparkSession
    rank = rank or scanning(terms, recipe.wide)
    rankings, methods = [], []
    for corpora in dict.fromkeys(tuple(c) for c in recipe.pools.values()):
        asked = queries.filter(F.col("route").isin([x for x, c in recipe.pools.items() if tuple(c) == corpora]))
        pool = chunks.filter(F.col("corpus").isin(list(corpora)))
        method, reason = recipe.method, None
        if not corpora:
            method, reason = "none", "not a question for a corpus"
        elif pool.isEmpty():
            method, reason = "none", "no eligible corpus"
        elif method != "bm25" and index is not None and not r.stale(pool.select("chunk_id", "fingerprint"), index).isEmpty():
            method, reason = "bm25", "index is stale"
        methods.append(asked.select("query_id", F.lit(method).alias("method"), F.lit(reason).cast("string").alias("reason")))
        if method == "none":
            continue
        each = [rank(m, asked, pool, corpora) for m in {"bm25": ("bm25",), "vector": ("cosine",)}.get(method, ("bm25", "cosine"))]
        if len(each) == 1:
            rankings.append(each[0].select("query_id", "chunk_id", "score", F.lit(False).alias("fused")))
        else:
            rankings.append(r.rrf(each, 2 * recipe.wide).select("query_id", "chunk_id", "score", F.lit(True).alias("fused")))
    unrouted = queries.filter(~F.col("route").isin(list(recipe.pools)) | F.col("route").isNull())
    methods.append(unrouted.select("query_id", F.lit("none").alias("method"), F.lit("not a question for a corpus").alias("reason")))
    ranking = reduce(DataFrame.unionByName, rankings) if rankings else _one(spark, _RANKED + ", fused boolean")
    return ranking, reduce(DataFrame.unionByName, methods)


def answer(
    queries: DataFrame, chunks: DataFrame, terms: Callable[[Column], Column], recipe: Recipe, index: DataFrame | None = None, rank: Ranker | None = None
) -> tuple[DataFrame, DataFrame]:
    """Results (query_id, position, chunk_id, score, document, url, tier, title, excerpt, used) and
    each query's (query_id, route, method, reason).

    ``chunks`` has chunk_id, text, corpus, document, url, tier and title. In a fused ranking, chunks
    of the route's first corpus gain a bonus and come first. Then words shared with the title count,
    one chunk of each document comes before its second, and the excerpts are taken that fit the
    budget, up to the first that doesn't.
    """
    ranking, methods = ranked_by_route(queries, chunks, terms, recipe, index, rank)
    asked = queries.select("query_id", "route", F.array_distinct(terms(F.col("text"))).alias("_words"))
    about = chunks.select("chunk_id", "corpus", "document", "url", "tier", "title", "text")
    # excerpts of the chunks that were found, not of all
    found = ranking.join(about, "chunk_id").withColumn("excerpt", safe_excerpt(F.col("text"), recipe.unsafe, recipe.excerpt)).drop("text")
    held = found.join(asked, "query_id")
    first = reduce(lambda a, x: a | ((F.col("route") == x[0]) & (F.col("corpus") == x[1][0])), [p for p in recipe.pools.items() if p[1]], F.lit(False))
    first = first & F.col("fused")
    held = held.withColumn("score", F.round(F.col("score") + F.when(first, recipe.bonus).otherwise(0.0), 10))
    by_score = Window.partitionBy("query_id").orderBy(first.desc(), F.col("score").desc(), "chunk_id")
    held = held.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= recipe.wide)
    shared = F.size(F.array_intersect("_words", terms(F.col("title"))))
    best = r.diversify(r.rerank(held, [shared.desc()]), "document", recipe.k)
    packed = r.pack_context(best.filter("excerpt <> ''"), F.length("excerpt"), "position", recipe.budget)
    results = packed.select("query_id", F.col("position").cast("long").alias("position"), "chunk_id", "score", "document", "url", "tier", "title", "excerpt", F.col("used").cast("long").alias("used"))
    return results, queries.select("query_id", "route").join(methods, "query_id", "left")


def rendered(results: DataFrame, states: DataFrame) -> DataFrame:
    """Each query's answer in one row: how many results, their ids, citations and characters."""
    row = F.sort_array(F.collect_list(F.struct(
        "position", F.col("chunk_id").cast("string").alias("c"), F.concat(F.lit("["), "document", F.lit("/"), F.col("chunk_id").cast("string"), F.lit("]")).alias("s"),
    )))
    g = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), row.alias("r"), F.max("used").alias("used"))
    g = g.select("query_id", "n", F.array_join("r.c", ",").alias("chunks"), F.array_join("r.s", " ").alias("citations"), "used")
    out = states.join(g, "query_id", "left")
    return out.na.fill({"n": 0, "chunks": "", "citations": "", "used": 0})


def case_measures(results: DataFrame, cases: DataFrame, gold: DataFrame, safe_url: Callable[[Column], Column], unsafe: Iterable[str], fixtures: Iterable[str]) -> DataFrame:
    """Per case of ``cases`` (query_id, expected_tier): measures of its results against ``gold``
    (query_id, chunk_id). A case without gold should have no answer, and has nulls for the others."""
    wanted = gold.groupBy("query_id").agg(F.count_distinct("chunk_id").alias("n_gold"))
    hit = results.join(gold.distinct().withColumn("_hit", F.lit(1)), ["query_id", "chunk_id"], "left")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("position"))
    hit = hit.withColumns({"rank": rank, "rel": F.coalesce("_hit", F.lit(0))})
    marked = lambda c, words, f: reduce(lambda a, w: a | f(c, w), words, F.lit(False))
    place = F.lower(F.concat_ws("\n", F.col("chunk_id").cast("string"), "title", "url"))
    each = hit.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_results"), (F.count(F.lit(1)) - F.count_distinct("url")).alias("repeats"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0)).alias(f"hits_{k}") for k in RANK_AT],
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"),
        F.every(safe_url(F.col("url"))).alias("all_safe"), F.max(F.when(F.col("rank") == 1, F.col("tier"))).alias("top_tier"),
        F.count_if(marked(place, fixtures, lambda c, w: c.contains(w))).alias("fixtures"),
        F.max(marked(F.col("excerpt"), unsafe, lambda c, w: c.rlike(w))).alias("injected"),
    )
    out = cases.join(wanted, "query_id", "left").join(each, "query_id", "left")
    has, none = F.col("n_gold").isNotNull(), F.lit(0)
    n_gold = F.col("n_gold")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(5), n_gold).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    any_result = F.coalesce("n_results", none) > 0
    return out.select(
        "query_id", F.coalesce("n_gold", none).alias("n_gold"), F.coalesce("n_results", none).alias("n_results"),
        *[F.when(has, F.coalesce(f"hits_{k}", none) / n_gold).alias(f"recall_{k}") for k in RANK_AT],
        F.when(has, F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(has, F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg_5"),
        F.when(has, any_result).alias("cited"), F.when(has, any_result & F.coalesce("all_safe", F.lit(False))).alias("cited_safely"),
        F.when(has, F.coalesce(F.col("top_tier") == F.col("expected_tier"), F.lit(False))).alias("right_tier"),
        F.when(~has, ~any_result).alias("abstained"), F.coalesce("fixtures", none).alias("fixtures"),
        F.coalesce("injected", F.lit(False)).alias("injected"), F.coalesce("repeats", none).alias("repeats"),
    )


def run_measures(measured: DataFrame, run: str) -> DataFrame:
    """One row of a run's measures: means over the cases with gold, percentages, and counts. A mean or
    percentage over no case is null, as where every case has gold, or none."""
    percent = lambda c: F.round(F.try_divide(100.0 * F.count_if(F.col(c)), F.count(c)), 3)
    mean = lambda c: F.round(F.avg(c), 6)
    return measured.groupBy(F.lit(run).alias("run")).agg(
        F.count(F.lit(1)).alias("cases"), *[mean(f"recall_{k}").alias(f"recall_{k}") for k in RANK_AT],
        mean("reciprocal_rank").alias("mrr"), mean("ndcg_5").alias("ndcg_5"), percent("cited").alias("cited_percent"),
        percent("cited_safely").alias("cited_safely_percent"), percent("right_tier").alias("right_tier_percent"),
        percent("abstained").alias("no_answer_percent"), F.sum("fixtures").alias("fixtures"), F.count_if("injected").alias("injected"),
        F.round(F.sum("repeats") / F.greatest(F.lit(1), F.sum("n_results")), 6).alias("repeat_rate"),
    )


def quality_gate(measures: DataFrame) -> DataFrame:
    """The conditions that a run must meet, and whether it meets all."""
    conditions = {
        "recall_met": F.col("recall_5") >= 0.8, "citations_met": F.col("cited_percent") == 100.0, "tier_met": F.col("right_tier_percent") == 100.0,
        "no_fixtures": F.col("fixtures") == 0, "no_injections": F.col("injected") == 0,
    }
    out = measures.select("run", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in conditions.items()])
    return out.withColumn("passed", reduce(Column.__and__, [F.col(k) for k in conditions]))


def latencies(times: DataFrame, run: str, elapsed: str) -> DataFrame:
    """Median (interpolated), 95th percentile (nearest rank) and first time of each run; ``times``
    has the run, ``case`` to order by, and the time."""
    return times.groupBy(run).agg(
        F.round(F.percentile(elapsed, 0.5), 3).alias("p50"),
        F.round(F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {elapsed})"), 3).alias("p95"),
        F.round(F.min_by(elapsed, "case"), 3).alias("first"),
    )


def top_results(results: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, top): the first ``k`` chunks in order, as an array."""
    row = F.sort_array(F.collect_list(F.struct("position", "chunk_id")))
    return results.groupBy("query_id").agg(F.slice(row["chunk_id"], 1, k).alias("top"))


def review_rows(measured: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: what is wrong with its results, as far as a rule can say, its five first chunks,
    and whether a person should look."""
    gold = F.col("n_gold") > 0
    errors = F.array_compact(F.array(
        F.when(gold & (F.col("n_results") == 0), "no results"), F.when(gold & (F.col("n_results") > 0) & (F.col("recall_5") == 0), "gold missed"),
        F.when(gold & (F.col("recall_1") == 0) & (F.col("recall_5") > 0), "gold below rank 1"), F.when(gold & ~F.col("right_tier"), "other tier first"),
        F.when(~F.col("abstained"), "should abstain"),
    ))
    out = measured.join(top_results(results), "query_id", "left")
    top = F.coalesce("top", F.array().cast("array<bigint>"))
    return out.select("query_id", errors.alias("errors"), top.alias("top"), F.when(F.size(errors) > 0, "review").otherwise("fine").alias("status"))


def review_summary(rows: DataFrame) -> DataFrame:
    """One row: how many cases there are of each kind, and the status they share, or mixed."""
    one = F.count_distinct("status") == 1
    return rows.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col("status") == "review").alias("to_review"),
        F.count_if(F.array_contains("errors", "gold missed")).alias("missed"), F.when(one, F.min("status")).otherwise("mixed").alias("status"),
    )


def carry_forward(now: DataFrame, before: DataFrame, reviews: DataFrame, human: Sequence[str]) -> DataFrame:
    """``now`` (query_id, top) with the human columns of ``reviews`` where the case had the same first
    chunks ``before``, in the same order; they are null elsewhere. Also ``carried``."""
    old = before.select(F.col("query_id").alias("_q"), F.col("top").alias("_top"))
    said = reviews.select(F.col("query_id").alias("_r"), *[F.col(c).alias(f"_{c}") for c in human])
    out = now.join(old, F.col("query_id") == F.col("_q"), "left").join(said, F.col("query_id") == F.col("_r"), "left")
    same = F.col("top").eqNullSafe(F.col("_top")) & F.col("_r").isNotNull()
    return out.select(*now.columns, same.alias("carried"), *[F.when(same, F.col(f"_{c}")).alias(c) for c in human])


def carry_results(now: DataFrame, before: DataFrame, reviewed: DataFrame, human: Sequence[str]) -> DataFrame:
    """``now`` (query_id, chunk_id, position) with the human columns of ``reviewed`` (query_id,
    chunk_id), result by result, where the case had the same chunks in the same order ``before``;
    elsewhere they are null."""
    tops = lambda t: t.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("position", "chunk_id")))["chunk_id"].alias("top"))
    same = tops(now).join(tops(before).withColumnRenamed("top", "_old"), "query_id").filter("top = _old").select(F.col("query_id").alias("_q"))
    said = reviewed.select(F.col("query_id").alias("_r"), F.col("chunk_id").alias("_c"), *[F.col(c).alias(f"_{c}") for c in human])
    out = now.join(same, F.col("query_id") == F.col("_q"), "left").join(said, (F.col("_q") == F.col("_r")) & (F.col("chunk_id") == F.col("_c")), "left")
    return out.select(*now.columns, *[F.col(f"_{c}").alias(c) for c in human])
