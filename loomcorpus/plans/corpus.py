"""Documents and pages: dedup, selection, inventories, entities, relations, coverage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import rules, text, urls
from ..functions.rules import any_of
from ..operators import graph, keyed, matching, ordered
from ..sources.html import extract_html
from .registry import query, table

TOPICS = ("tion", "ention", "there", "keit", "que")
_TP = ", ".join(f"'{t}'" for t in TOPICS)


def docs_of(spark, d):
    return table(spark, d, "documents")


@query("""SELECT doc_id, concat_ws(',', CASE WHEN NOT length(text) >= 20 THEN 'too short' END, CASE WHEN NOT lang IN ('en', 'de', 'fr') THEN 'language' END, CASE WHEN n_chars IS NULL OR n_chars <> length(text) THEN 'length' END) AS violations FROM documents""")
def s3_validated_scan(spark, d):
    checks = [(F.length("text") >= 20, "too short"), (F.col("lang").isin("en", "de", "fr"), "language"), (F.col("n_chars") == F.length("text"), "length")]
    return keyed.validated(docs_of(spark, d), checks).select("doc_id", F.array_join("violations", ",").alias("violations"))


@query("""SELECT d.doc_id, d.doc_id <> f.first AS is_duplicate, CASE WHEN d.doc_id <> f.first THEN f.first END AS duplicate_of FROM documents d JOIN (SELECT sha256(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1) f ON sha256(d.text) = f.h""")
def f1_first_seen_dedup(spark, d):
    df = docs_of(spark, d).select("doc_id", F.sha2("text", 256).alias("h"))
    return keyed.first_seen(df, "h", "doc_id").select("doc_id", "is_duplicate", "duplicate_of")


@query("""SELECT min(CASE source WHEN 'src0' THEN 0 ELSE 1 END * 100000000000 + doc_id) % 100000000000 AS doc_id FROM documents GROUP BY text""")
def f2_tiered_dedup(spark, d):
    df = docs_of(spark, d).select("doc_id", F.when(F.col("source") == "src0", 0).otherwise(1).alias("tier"), F.sha2("text", 256).alias("digest"))
    return keyed.tiered_dedup(df, "tier", "doc_id", "digest").select("doc_id")


@query("""SELECT doc_id, row_number() OVER (ORDER BY lang, n_chars DESC, doc_id) AS place FROM documents WHERE quality IS NULL OR quality = 1""".replace("documents", "documents LEFT JOIN labels USING (doc_id)"))
def f3_rank_candidates(spark, d):
    """Global ranks by ranges of the order: no window holds all rows or a language's."""
    df = docs_of(spark, d).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").filter("quality IS NULL OR quality = 1")
    return ordered.rank_all(df.select("doc_id", "lang", "n_chars"), [F.col("lang"), F.col("n_chars").desc(), F.col("doc_id")]).select("doc_id", "place")


@query("""WITH p AS (SELECT doc_id, CASE WHEN contains(text, 'ention') AND n_chars > 500 THEN 0 WHEN n_chars > 2000 THEN 1 WHEN lang <> 'en' THEN 2 ELSE 3 END AS pr FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY pr ORDER BY doc_id) AS n FROM p) SELECT doc_id, pr::INT AS predicate FROM r WHERE (pr = 0 AND n <= 5) OR (pr = 1 AND n <= 7) OR (pr = 2 AND n <= 9)""")
def f6_predicate_quota(spark, d):
    kind = rules.first_match([(F.col("text").contains("ention") & (F.col("n_chars") > 500), "0"), (F.col("n_chars") > 2000, "1"), (F.col("lang") != "en", "2")]).cast("int")
    df = docs_of(spark, d).withColumn("predicate", kind).filter("predicate IS NOT NULL").select("doc_id", "predicate")
    quotas = spark.createDataFrame([(0, 5, 0), (1, 7, 1), (2, 9, 2)], "predicate int, quota int, priority int")
    return keyed.quota(df, "predicate", quotas, [F.col("doc_id")]).select("doc_id", "predicate")


_F6 = (("contains(text, 'ention') AND n_chars > 500", 5), ("n_chars > 2000", 7), ("lang <> 'en'", 9), ("n_chars > 900", 3))


def _carried_sql():
    """Each predicate takes what it still lacks; what was taken for earlier ones counts."""
    marks = ", ".join(f"coalesce({p}, false) AS p{i}" for i, (p, _) in enumerate(_F6))
    steps = [f"d AS (SELECT doc_id, n_chars, {marks} FROM documents)"]
    for i, (_, n) in enumerate(_F6):
        taken = " UNION ALL ".join(f"SELECT doc_id FROM t{j}" for j in range(i)) or "SELECT doc_id FROM d WHERE false"
        steps.append(f"t{i} AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM d WHERE p{i} AND doc_id NOT IN ({taken})) WHERE n <= {n} - (SELECT count(*) FROM d WHERE p{i} AND doc_id IN ({taken})))")
    every = " UNION ALL ".join(f"SELECT doc_id, {i} AS reason FROM t{i}" for i in range(len(_F6)))
    return f"WITH {', '.join(steps)}, a AS ({every}), f AS (SELECT doc_id FROM d WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n_chars DESC, doc_id LIMIT 40 - (SELECT count(*) FROM a)) SELECT doc_id, reason::INT AS reason FROM a UNION ALL SELECT doc_id, NULL FROM f"


@query(_carried_sql())
def f6_carried_quotas(spark, d):
    """Quotas of predicates that overlap: a row taken for one counts for all it meets; then the
    largest of the rest, 40 in all."""
    predicates = [(F.expr(p), n) for p, n in _F6]
    return keyed.predicate_quotas(docs_of(spark, d), predicates, [F.col("n_chars").desc(), F.col("doc_id")], 40).select("doc_id", "reason")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 6")
def f7_stratified_sample(spark, d):
    """The first step: each language's quota of the longest."""
    out = keyed.cap_per_key(docs_of(spark, d), "lang", 6, [F.col("n_chars").desc(), F.col("doc_id")])
    return out.filter("NOT over_cap").select("doc_id")


FLAGS = {"table": 6, "official": 4, "long": 1}
_QUOTAS = {"en": 4, "de": 3, "fr": 3, "es": 2}


def _swaps_sql():
    """The sample as a state that a step of a recursive query changes: the flag in hand, and who is in."""
    flags = list(FLAGS)
    per = ", ".join(f"('{g}', {n})" for g, n in _QUOTAS.items())
    least = ", ".join(f"({i}, {n})" for i, n in enumerate(FLAGS.values()))
    return f"""WITH RECURSIVE quota(lang, quota) AS (VALUES {per}), least(f, least) AS (VALUES {least}),
d AS (SELECT doc_id, lang, n_chars AS score, [contains(text, '|'), source = 'src0', n_chars > 3000] AS fl FROM documents JOIN quota USING (lang)),
s(step, f, chosen) AS (
  SELECT 0, 0, (SELECT list(doc_id) FROM (SELECT doc_id, quota, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS n FROM d JOIN quota USING (lang)) WHERE n <= quota)
  UNION ALL
  SELECT step + 1, CASE WHEN pair IS NULL THEN f + 1 ELSE f END, CASE WHEN pair IS NULL THEN chosen ELSE list_append(list_filter(chosen, lambda x: x <> pair[1]), pair[2]) END FROM (
    SELECT step, f, chosen, CASE WHEN (SELECT count(*) FROM d WHERE list_contains(chosen, doc_id) AND fl[f + 1]) < (SELECT least FROM least WHERE least.f = s.f) THEN (
      SELECT [v.doc_id, b.doc_id] FROM (SELECT lang, arg_min(doc_id, (score, doc_id)) AS doc_id, min(score) AS score FROM d WHERE list_contains(chosen, doc_id) AND NOT fl[f + 1] GROUP BY lang) v
      JOIN (SELECT lang, arg_min(doc_id, (-score, doc_id)) AS doc_id, max(score) AS score FROM d WHERE NOT list_contains(chosen, doc_id) AND fl[f + 1] GROUP BY lang) b USING (lang)
      ORDER BY b.score - v.score DESC, list_position({list(_QUOTAS)}, lang) LIMIT 1) END AS pair
    FROM s WHERE f < {len(flags)}))
SELECT lang, doc_id FROM (SELECT unnest(chosen) AS doc_id FROM s ORDER BY step DESC LIMIT 1) JOIN d USING (doc_id)"""


@query(_swaps_sql().replace("FROM (SELECT unnest(chosen) AS doc_id FROM s ORDER BY step DESC LIMIT 1)", "FROM (SELECT unnest(chosen) AS doc_id FROM (SELECT arg_max(chosen, step) AS chosen FROM s))"))
def f7_swapped_sample(spark, d):
    """Both steps: swaps within a language until enough have a bar, are official and are long."""
    df = docs_of(spark, d).select(
        "doc_id", "lang", F.col("n_chars").alias("score"),
        F.struct(F.col("text").contains("|").alias("table"), (F.col("source") == "src0").alias("official"), (F.col("n_chars") > 3000).alias("long")).alias("flags"),
    )
    return keyed.stratified_sample(df, "lang", "doc_id", "score", "flags", _QUOTAS, FLAGS)


@query("""WITH a AS (SELECT conv_id, min(turn) FILTER (contains(text, 'tion')) AS anchor FROM conversations GROUP BY 1) SELECT conv_id, turn FROM conversations JOIN a USING (conv_id) WHERE turn BETWEEN anchor - 2 AND anchor + 2""")
def f8_sample_turns(spark, d):
    t = table(spark, d, "conversations")
    anchor = t.groupBy("conv_id").agg(F.min(F.when(F.col("text").contains("tion"), F.col("turn"))).alias("anchor"))
    near = F.col("turn").between(F.col("anchor") - 2, F.col("anchor") + 2)
    return t.join(anchor, "conv_id").filter(near).select("conv_id", "turn")


@query("SELECT sha256(text) AS digest, count(DISTINCT doc_id) AS n_ids, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY text HAVING count(DISTINCT doc_id) > 1")
def a2_duplicate_groups(spark, d):
    return keyed.duplicate_groups(docs_of(spark, d).select("doc_id", F.sha2("text", 256).alias("digest")), "digest", "doc_id")


@query("SELECT sha256(text) AS digest, count(DISTINCT source) AS corpora FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def a3_cross_corpus_duplicates(spark, d):
    return docs_of(spark, d).groupBy(F.sha2("text", 256).alias("digest")).agg(F.count_distinct("source").alias("corpora")).filter("corpora > 1")


@query("""SELECT source, sum(n)::BIGINT AS documents, string_agg(lang || '=' || n, ',' ORDER BY lang) AS langs, bool_and(ok) AS all_long FROM (SELECT source, lang, count(*) AS n, bool_and(n_chars > 10) AS ok FROM documents GROUP BY ALL) GROUP BY source""")
def a4_corpus_summary(spark, d):
    df = docs_of(spark, d)
    counts = keyed.value_counts(df, "source", "lang").withColumnRenamed("counts", "langs")
    g = df.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.every(F.col("n_chars") > 10).alias("all_long"))
    return g.join(counts, "source").select("source", "documents", "langs", "all_long")


@query("""SELECT lang, count_if(n_chars < 100) AS short, count_if(n_chars >= 100 AND n_chars < 1000) AS middle, count_if(n_chars >= 1000) AS long, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, sum(n_chars)::BIGINT AS total FROM documents GROUP BY lang""")
def a6_quality_report(spark, d):
    n = F.col("n_chars")
    return docs_of(spark, d).groupBy("lang").agg(
        F.count_if(n < 100).alias("short"), F.count_if((n >= 100) & (n < 1000)).alias("middle"), F.count_if(n >= 1000).alias("long"),
        F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.sum(n).alias("total"),
    )


@query("""SELECT k.lang, coalesce(n, 0) AS n, n IS NULL AS missing FROM (SELECT unnest(['en', 'de', 'it', 'zh']) AS lang) k LEFT JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) c USING (lang)""")
def a7_core_counts(spark, d):
    catalog = spark.createDataFrame([(x,) for x in ("en", "de", "it", "zh")], "lang string")
    counts = docs_of(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return catalog.join(counts, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"))


@query("""SELECT 'documents' AS name, count_if(lang = 'en') AS first, count_if(lang <> 'en') AS rest FROM documents UNION ALL SELECT 'conversations', count_if(role = 'user'), count_if(role <> 'user') FROM conversations UNION ALL SELECT 'events', count_if(event_type = 'view'), count_if(event_type <> 'view') FROM events""")
def a8_status_counts(spark, d):
    parts = [("documents", "lang", "en"), ("conversations", "role", "user"), ("events", "event_type", "view")]
    tagged = None
    for name, column, value in parts:
        one = table(spark, d, name).select(F.lit(name).alias("name"), F.when(F.col(column) == value, "first").otherwise("rest").alias("status"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("name").pivot("status", ["first", "rest"]).count().na.fill(0)


@query("""SELECT lang, count(*) AS n, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM documents GROUP BY lang""")
def a35_chapter_counts(spark, d):
    return docs_of(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


_MATCH = f"""m AS (SELECT doc_id, source, lang, text, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM documents, (SELECT unnest([{_TP}]) AS term) WHERE contains(text, term))"""


@query(f"WITH {_MATCH} SELECT doc_id, term, n::INT AS n FROM m")
def j5_dictionary_match(spark, d):
    return graph.dictionary_match(docs_of(spark, d), "doc_id", "text", TOPICS)


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS term FROM benchmark),
m AS (SELECT doc_id, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n, text FROM documents JOIN t ON contains(text, term))
SELECT doc_id, term, n::BIGINT AS n FROM m WHERE length(term) > 1 OR regexp_matches(text, '(^|[^A-Za-z0-9])' || term || '($|[^A-Za-z0-9])')""")
def j5_catalog_match(spark, d):
    """The words of the benchmark as a catalog that is a table of any size, in the documents."""
    terms = table(spark, d, "benchmark").select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)))).alias("term"))
    return matching.term_matches(docs_of(spark, d), "doc_id", "text", terms)


@query(f"WITH {_MATCH} SELECT term, count(DISTINCT doc_id) AS documents, count(DISTINCT source) AS places, sum(n)::BIGINT AS mentions, min(doc_id) AS first FROM m GROUP BY term")
def a1_entity_rollup(spark, d):
    df = docs_of(spark, d)
    return graph.entity_rollup(graph.dictionary_match(df, "doc_id", "text", TOPICS), df, "doc_id", "source")


_PAIRS = r"""s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^。！？!?；;.\n]*[。！？!?；;.]|[^。！？!?；;.\n]+')) AS x FROM documents),
k AS (SELECT doc_id, trim(x) AS x FROM s WHERE length(trim(x)) >= 2), e AS (SELECT unnest(['tion', 'keit', 'ther', 'that']) AS t),
p AS (SELECT doc_id, x, a.t AS source, b.t AS target FROM k, e a, e b WHERE a.t <> b.t AND contains(x, a.t) AND contains(x, b.t))"""
NAMES = ("tion", "keit", "ther", "that")


def pairs_of(spark, d):
    return graph.sentence_pairs(docs_of(spark, d), "doc_id", "text", NAMES)


@query(f"WITH {_PAIRS} SELECT source, target, count(*) AS n, count(DISTINCT doc_id) AS documents FROM p GROUP BY ALL")
def j6_sentence_entity_pairs(spark, d):
    return pairs_of(spark, d).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


_REL = _PAIRS + r""", r AS (SELECT doc_id, x, source, target, CASE WHEN regexp_matches(x, source || '[a-z]* of [a-z]*' || target) THEN 'MEMBER_OF' WHEN regexp_matches(x, source || '[a-z]* [a-z]{1,12} [a-z]*' || target) THEN 'KNOWS' END AS relation FROM p)"""
RULES = (("MEMBER_OF", "[a-z]* of [a-z]*", 0.9), ("KNOWS", "[a-z]* [a-z]{1,12} [a-z]*", 0.6))


NAME_KINDS = {"tion": "character", "that": "character", "ther": "faction", "keit": "event"}
_NEAR = "{s}.{0,40}{t}|{t}.{0,40}{s}"
TYPED = tuple(
    graph.RelationRule(*x)
    for x in (
        ("MEMBER_OF", "{s}.{0,24}(?: of | is ).{0,20}{t}|{t}.{0,30}(?: by | with ).{0,30}{s}", 0.82, None, "faction"),
        ("HOLDS_ROLE_IN", "{s}.{0,20} as .{0,20}{t}", 0.76, "character", "faction"),
        ("CREATED_BY", "{s}.{0,20} from .{0,20}{t}", 0.8, "character", "faction", None, None, True),
        ("ALLY_OF", _NEAR, 0.72, "character", "character", "and|with", "bond"),
        ("ENEMY_OF", _NEAR, 0.72, "character", "character", "was|not", "bond"),
        ("KNOWS", _NEAR, 0.68, "character", "character", "to|in", "bond"),
        ("SIBLING_OF", "{s}.{0,12} is {t}", 0.82, "character", "character"),
        ("COMPANION_OF", "{s}.{0,12} of {t}", 0.78, "character", "character"),
        ("LEADS", "{s}.{0,12} to {t}", 0.8, "character", "character"),
        ("ALIAS_OF", "{s}.{0,12} a {t}", 0.84, "character", "character"),
        ("PARTICIPATED_IN", "{s}.{0,30}(?: in | und ).{0,30}{t}", 0.76, "character", "event"),
        ("RELATED_TO", "{s}.{0,30}(?: it | der ).{0,30}{t}|{t}.{0,30}(?: it | der ).{0,30}{s}", 0.65),
    )
)


def _typed_sql() -> str:
    kind = lambda c: f"CASE {c} " + " ".join(f"WHEN '{n}' THEN '{k}'" for n, k in NAME_KINDS.items()) + " END"
    parts, taken = [], {}
    for rule in TYPED:
        pattern = "'" + rule.pattern.replace("{s}", "' || source || '").replace("{t}", "' || target || '") + "'"
        holds = [f"regexp_matches(x, {pattern})"]
        holds += [f"{kind(c)} = '{k}'" for c, k in (("source", rule.source_kind), ("target", rule.target_kind)) if k]
        holds += [f"regexp_matches(x, '{rule.also}')"] if rule.also else []
        mine = "(" + " AND ".join(holds) + ")"
        before = taken.setdefault(rule.family, []) if rule.family else []
        where = " AND ".join([mine, *[f"NOT {x}" for x in before]])
        if rule.family:
            before.append(mine)
        ends = "target AS source, source AS target" if rule.flipped else "source, target"
        parts.append(f"SELECT doc_id, {ends}, '{rule.relation}' AS relation, {rule.confidence}::DOUBLE AS confidence FROM p WHERE {where}")
    return f"WITH {_PAIRS}, y AS (" + " UNION ALL ".join(parts) + ") SELECT doc_id, source, relation, target, max(confidence) AS confidence, 'rel_' || substr(sha256(concat_ws('|', doc_id::VARCHAR, source, relation, target)), 1, 20) AS relation_id FROM y GROUP BY ALL"


_TIMES = (("before", ("was", "war")), ("now", ("is", "ist")))
_UNIVERSES = (("bubble", ("nd ",)), ("proper", ("the", "der")))
_SCOPE = ", ".join("CASE " + " ".join(f"WHEN {' OR '.join(f"contains(x, '{w}')" for w in words)} THEN '{n}'" for n, words in scopes) + f" ELSE '' END AS {name}" for name, scopes in (("time_scope", _TIMES), ("universe", _UNIVERSES)))


@query(f"WITH {_REL} SELECT doc_id, source, relation, target, time_scope, universe, count(*) AS n FROM (SELECT *, {_SCOPE} FROM r WHERE relation IS NOT NULL) GROUP BY ALL")
def c8_scoped_relations(spark, d):
    """Relations with the time and the universe that their sentence speaks of."""
    made = graph.scoped(graph.rule_relations(pairs_of(spark, d), RULES), "evidence", _TIMES, _UNIVERSES)
    return made.groupBy("doc_id", "source", "relation", "target", "time_scope", "universe").agg(F.count(F.lit(1)).alias("n"))


@query(_typed_sql())
def c8_rule_relations(spark, d):
    """Twelve typed rules with most gaps; of the three bonds between characters the first that holds."""
    out = graph.typed_relations(pairs_of(spark, d), NAME_KINDS, TYPED, "doc_id")
    key = urls.stable_id("rel", F.concat_ws("|", F.col("doc_id").cast("string"), "source", "relation", "target"))
    return out.select("doc_id", "source", "relation", "target", "confidence", key.alias("relation_id"))


@query(r"""WITH s AS (SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^。！？!?；;.\n]*[。！？!?；;.]|[^。！？!?；;.\n]+'))) AS x FROM documents), n AS (SELECT unnest(['tion', 'keit', 'ther', 'that']) AS source)
SELECT DISTINCT doc_id, source, 'ALIAS_OF' AS relation, regexp_extract(x, source || '(?:.{0,12} (?:for|und) )(ention|the|der)', 1) AS target, 0.84::DOUBLE AS confidence FROM s, n WHERE length(x) >= 2 AND regexp_matches(x, source || '(?:.{0,12} (?:for|und) )(ention|the|der)')""")
def c8_named_aliases(spark, d):
    return graph.named_aliases(docs_of(spark, d), "doc_id", "text", NAMES, r".{0,12} (?:for|und) ", ("ention", "the", "der"), 0.84)


@query(f"WITH {_REL} SELECT source, target, string_agg(DISTINCT relation, ',' ORDER BY relation) AS relations, count(DISTINCT relation) AS n FROM r WHERE relation IS NOT NULL GROUP BY ALL HAVING count(DISTINCT relation) > 1")
def a14_relation_conflicts(spark, d):
    return graph.conflicts(graph.rule_relations(pairs_of(spark, d), RULES))


@query(f"WITH {_REL} SELECT doc_id, count(*) AS kept FROM r WHERE relation IS NOT NULL AND doc_id % 2 = 0 GROUP BY doc_id")
def c9_validate_candidates(spark, d):
    """Candidate rows, of which those of odd documents cite words that aren't there."""
    made = graph.rule_relations(pairs_of(spark, d), RULES)
    forged = F.when(F.col("doc_id") % 2 == 0, F.col("evidence")).otherwise(F.concat("evidence", F.lit(" (sic)")))
    return graph.verbatim(made.withColumn("evidence", forged), docs_of(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH {_REL}, u AS (SELECT 'rule' AS origin, source, target, relation FROM r WHERE relation IS NOT NULL UNION ALL SELECT 'model', source, target, relation FROM r WHERE relation IS NOT NULL AND doc_id % 3 = 0)
SELECT 'rel_' || substr(sha256(concat_ws('|', source, relation, target)), 1, 20) AS relation_id, max(origin = 'rule')::VARCHAR = 'true' AS by_rule, max(origin = 'model')::VARCHAR = 'true' AS by_model FROM u GROUP BY source, relation, target""")
def c10_relation_dedup(spark, d):
    made = graph.rule_relations(pairs_of(spark, d), RULES).select("doc_id", "source", "relation", "target")
    both = made.withColumn("origin", F.lit("rule")).unionByName(made.filter("doc_id % 3 = 0").withColumn("origin", F.lit("model")))
    key = urls.stable_id("rel", F.concat_ws("|", "source", "relation", "target"))
    return both.groupBy(key.alias("relation_id")).agg(F.bool_or(F.col("origin") == "rule").alias("by_rule"), F.bool_or(F.col("origin") == "model").alias("by_model"))


def evidence_of(spark, d):
    df = docs_of(spark, d)
    each = None
    for t in ("ention", "keit", "que"):
        kind = graph.evidence_kind(F.col("source"), F.col("text"), t, "The ")
        one = df.select("doc_id", "source", "lang", F.lit(t).alias("topic"), kind.alias("kind")).filter("kind IS NOT NULL")
        each = one if each is None else each.unionByName(one)
    return each


_EVIDENCE = r"""ev AS (SELECT doc_id, source, lang, topic, CASE WHEN n >= 3 AND contains(text, 'The ') OR list_contains(list_transform(string_split(text, chr(10))[1:8], lambda x: trim(x)), topic) THEN 'direct'
  WHEN len(seg) >= 2 OR coalesce(list_sum(list_transform(seg, lambda x: length(x))), 0) >= 120 THEN 'substantial' ELSE 'mention_only' END AS kind
  FROM (SELECT doc_id, source, lang, text, topic, (length(text) - length(replace(text, topic, ''))) // length(topic) AS n,
    list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;.\n]*[。！？!?；;.]|[^。！？!?；;.\n]+'), lambda x: trim(x)), lambda x: contains(x, topic) AND length(x) BETWEEN 2 AND 300) AS seg
    FROM documents, (SELECT unnest(['ention', 'keit', 'que']) AS topic) WHERE contains(text, topic)))"""


@query(f"WITH {_EVIDENCE} SELECT doc_id, topic, kind FROM ev")
def p14_evidence_kind(spark, d):
    return evidence_of(spark, d).select("doc_id", "topic", "kind")


EV_TOPICS = ("ention", "keit", "que")
_COVER = f"""WITH {_EVIDENCE}, tt AS (SELECT doc_id, split_part(text, chr(10), 1) AS title FROM documents), c AS (SELECT topic, CASE WHEN source = 'src0' THEN 'official' ELSE 'other' END AS layer, title, * EXCLUDE (topic) FROM ev JOIN tt USING (doc_id)),
cov AS (SELECT topic, layer, count_if(kind = 'direct') AS direct, count_if(kind = 'substantial') AS substantial, count_if(kind = 'mention_only') AS mentions, count(DISTINCT doc_id) AS documents,
  count(DISTINCT CASE WHEN source = 'src0' THEN doc_id END) AS official_documents, coalesce(bool_or(contains(title, topic)), false) AS dedicated, count(DISTINCT source || '/' || lang) AS urls, min(source || '/' || lang) AS first_url FROM c GROUP BY GROUPING SETS ((topic, layer), (topic))),
en AS (SELECT topic, count(*) AS confirmed_entities FROM (SELECT unnest(['ention', 'keit', 'que']) AS topic) JOIN (SELECT item_id, text FROM benchmark) ON contains(text, topic) GROUP BY 1),
rl AS (SELECT topic, count(*) AS confirmed_relations FROM (SELECT unnest(['ention', 'keit', 'que']) AS topic) JOIN (SELECT conv_id, role, text FROM conversations WHERE role = 'system' OR turn = 1) ON contains(role, topic) OR contains(text, topic) GROUP BY 1),
cf AS (SELECT topic, coalesce(confirmed_entities, 0) AS confirmed_entities, coalesce(confirmed_relations, 0) AS confirmed_relations FROM (SELECT unnest(['ention', 'keit', 'que']) AS topic) LEFT JOIN en USING (topic) LEFT JOIN rl USING (topic)),
mx AS (SELECT * FROM cov LEFT JOIN cf USING (topic))"""


def coverage_of(spark, d):
    """Benchmark items are the confirmed entities, first replies the confirmed relations."""
    layer = F.when(F.col("source") == "src0", "official").otherwise("other")
    titles = docs_of(spark, d).select("doc_id", F.substring_index("text", "\n", 1).alias("title"))
    evidence = evidence_of(spark, d).withColumn("layer", layer).join(titles, "doc_id")
    made = graph.coverage(evidence, "layer", F.col("source") == "src0", F.col("title"), F.concat_ws("/", "source", "lang"))
    entities = table(spark, d, "benchmark").select(F.col("text").alias("name"))
    relations = table(spark, d, "conversations").filter("role = 'system' OR turn = 1").select(F.col("role").alias("source"), F.col("text").alias("target"))
    return made.join(graph.confirmed(EV_TOPICS, entities, relations), "topic", "left")


def _status_of():
    c = F.col
    return graph.coverage_status(c("direct"), c("substantial"), c("documents"), c("official_documents"), c("dedicated"), c("confirmed_entities") + c("confirmed_relations"))


@query(_COVER + " SELECT topic, coalesce(layer, 'all') AS layer, direct, substantial, mentions, documents, official_documents, dedicated, urls, first_url, confirmed_entities, confirmed_relations FROM mx")
def a9_coverage_matrix(spark, d):
    return coverage_of(spark, d).withColumn("layer", F.coalesce("layer", F.lit("all")))


_STATUS = """CASE WHEN official_documents >= 3 AND direct >= 5 AND confirmed_entities + confirmed_relations >= 1 THEN 'strong' WHEN (direct >= 2 AND documents >= 2) OR (dedicated AND direct >= 3) THEN 'usable' WHEN direct + substantial = 0 THEN 'missing' ELSE 'thin' END"""
_NEEDS = """concat_ws(';', CASE WHEN direct = 0 THEN 'direct evidence' END, CASE WHEN direct < 2 OR documents < 2 THEN 'two direct chunks of two documents' END, CASE WHEN NOT dedicated AND direct < 3 THEN 'a page of its own' END,
  CASE WHEN substantial = 0 THEN 'whole passages elsewhere' END, CASE WHEN official_documents = 0 THEN 'an official document' END, CASE WHEN confirmed_entities + confirmed_relations = 0 THEN 'confirmation' END)"""


@query(_COVER + f" SELECT topic, coalesce(layer, 'all') AS layer, {_STATUS} AS status, {_NEEDS} AS missing FROM mx")
def a10_coverage_status(spark, d):
    needs = [
        (F.col("direct") == 0, "direct evidence"), ((F.col("direct") < 2) | (F.col("documents") < 2), "two direct chunks of two documents"),
        (~F.col("dedicated") & (F.col("direct") < 3), "a page of its own"), (F.col("substantial") == 0, "whole passages elsewhere"),
        (F.col("official_documents") == 0, "an official document"), (F.col("confirmed_entities") + F.col("confirmed_relations") == 0, "confirmation"),
    ]
    c = coverage_of(spark, d)
    return c.select("topic", F.coalesce("layer", F.lit("all")).alias("layer"), _status_of().alias("status"), F.array_join(rules.reasons(needs), ";").alias("missing"))


@query(_COVER + f" SELECT count_if({_STATUS} = 'strong') AS strong, count_if({_STATUS} = 'usable') AS usable, count_if({_STATUS} IN ('thin', 'missing')) AS weak, bool_and(documents > 0) AS all_seen FROM mx WHERE layer IS NULL")
def a11_coverage_targets(spark, d):
    c = coverage_of(spark, d).filter("layer IS NULL").withColumn("status", _status_of())
    return c.agg(
        F.count_if(F.col("status") == "strong").alias("strong"), F.count_if(F.col("status") == "usable").alias("usable"),
        F.count_if(F.col("status").isin("thin", "missing")).alias("weak"), F.every(F.col("documents") > 0).alias("all_seen"),
    )


@query(r"""SELECT doc_id, len(g)::INT AS n, md5(array_to_string(g, ',')) AS signature FROM (SELECT doc_id, list_sort(list_distinct(list_transform(list_transform(range(1, greatest(2, length(p) - 3)), lambda i: substr(p, i::BIGINT, 5)), lambda x: substr(sha256(x), 1, 16))))[1:64] AS g
FROM (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS p FROM documents))""")
def c12_shingle_signature(spark, d):
    return docs_of(spark, d).select("doc_id", graph.shingle_signature(F.col("text")).alias("g")).select("doc_id", F.size("g").alias("n"), F.md5(F.array_join("g", ",")).alias("signature"))


@query(r"""WITH sig AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_transform(range(1, greatest(2, length(p) - 3)), lambda i: substr(p, i::BIGINT, 5)), lambda x: substr(sha256(x), 1, 16))))[1:64] AS g
FROM (SELECT doc_id, regexp_replace(text, '\s+', '', 'g') AS p FROM documents)),
gr AS (SELECT g, min(doc_id) AS lead FROM sig GROUP BY g), ex AS (SELECT lead, len(g) AS n, unnest(g) AS h FROM gr),
pr AS (SELECT a.lead AS a, b.lead AS b, a.n AS n, b.n AS m, count(*) AS c FROM ex a JOIN ex b ON a.h = b.h AND a.lead < b.lead GROUP BY ALL)
SELECT lead AS a, doc_id AS b, 1.0::DOUBLE AS similarity FROM sig JOIN gr USING (g) WHERE doc_id <> lead UNION ALL SELECT a, b, round(c / least(n, m), 4) FROM pr WHERE c / least(n, m) >= 0.5""")
def c13_near_duplicates(spark, d):
    return graph.near_duplicates(docs_of(spark, d).select("doc_id", graph.shingle_signature(F.col("text")).alias("signature")), "doc_id")


@query(f"""SELECT doc_id, array_to_string(list_filter([{_TP}], lambda t: contains(concat(source, ' ', text), t)), ',') AS topics FROM documents""")
def c17_metadata_topics(spark, d):
    return docs_of(spark, d).select("doc_id", F.array_join(text.context_flags(F.concat_ws(" ", "source", "text"), TOPICS), ",").alias("topics"))


@query("""SELECT doc_id, corpus, tier FROM (SELECT doc_id, 'official' AS corpus, 'A' AS tier FROM documents WHERE source = 'src0' AND text <> '' UNION ALL SELECT doc_id, 'dialogue', 'B' FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' UNION ALL SELECT doc_id, 'navigation', 'C' FROM documents WHERE source = 'src3' AND n_chars > 100)""")
def o1_unify_corpora(spark, d):
    df = docs_of(spark, d)
    kinds = [("official", "A", (F.col("source") == "src0") & (F.col("text") != "")), ("dialogue", "B", F.col("source").isin("src1", "src2") & (F.col("lang") == "en")), ("navigation", "C", (F.col("source") == "src3") & (F.col("n_chars") > 100))]
    out = None
    for corpus, tier, keep in kinds:
        one = df.filter(keep).select("doc_id", F.lit(corpus).alias("corpus"), F.lit(tier).alias("tier"))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


@query("""SELECT doc_id, array_to_string(list_sort(list_intersect(h, ['ention', 'tion', 'that'])), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(h, ['x']))), ',') AS either, array_to_string(list_sort(list_filter(h, lambda x: x <> 'tion')), ',') AS less
FROM (SELECT doc_id, list_filter(['tion', 'ention', 'there', 'keit', 'que'], lambda t: contains(text, t)) AS h FROM documents)""")
def o3_array_sets(spark, d):
    h = text.context_flags(F.col("text"), TOPICS)
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return docs_of(spark, d).select(
        "doc_id", join(F.array_intersect(h, arr("ention", "tion", "that"))).alias("both"), join(F.array_union(h, arr("x"))).alias("either"), join(F.array_except(h, arr("tion"))).alias("less")
    )


@query("""SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND n_chars > 30""")
def s11_manual_records(spark, d):
    from ..sources.files import manual_records

    status = F.when((F.col("doc_id") % 3 == 0) & (F.col("n_chars") > 30), "accepted").otherwise("pending")
    return manual_records(docs_of(spark, d).withColumn("status", status), "doc_id", F.col("text").isNotNull(), "status", "accepted").select("doc_id")


_NORMAL = r"""u AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)"""
SOURCES = {"www.ththhe.example.org": [("/en", "W-en"), ("/", "W")], "therea.example.net": [("/en", "T-en"), ("/", "T")], "ththin.example.net": [("/de", "N-de")]}


@query(f"""WITH {_NORMAL} SELECT page_id, CASE WHEN host = 'www.ththhe.example.org' THEN CASE WHEN starts_with(path || '/', '/en/') THEN 'W-en' ELSE 'W' END WHEN host = 'therea.example.net' THEN CASE WHEN starts_with(path || '/', '/en/') THEN 'T-en' ELSE 'T' END
  WHEN host = 'ththin.example.net' AND starts_with(path || '/', '/de/') THEN 'N-de' END AS source FROM u""")
def j1_identify_source(spark, d):
    return graph.longest_prefix(table(spark, d, "pages"), "page_id", urls.host(F.col("url")), urls.path(F.col("url")), SOURCES)


_CATALOG = rf"""{_NORMAL}, c AS (SELECT host || ':' || seg AS source, host, CASE seg WHEN '' THEN '/' ELSE '/' || seg END AS prefix, CASE WHEN seg = 'en' THEN 'single' ELSE 'many' END AS kind FROM (SELECT DISTINCT host, unnest(['', regexp_extract(path, '^/([^/]+)', 1)]) AS seg FROM u WHERE page_id % 2 = 0)),
s AS (SELECT source, CASE WHEN source = (SELECT min(source) FROM c WHERE kind = 'single') THEN 'single' WHEN kind = 'single' THEN 'many' ELSE kind END AS kind, host, prefix FROM c)"""


def catalog(spark, d):
    """Sources as a table: each host and first segment of every second page; one is alone of its kind."""
    host, path = urls.host(F.col("url")), urls.path(F.col("url"))
    seg = F.explode(F.array(F.lit(""), F.regexp_extract(path, "^/([^/]+)", 1))).alias("seg")
    each = table(spark, d, "pages").filter("page_id % 2 = 0").select(host.alias("host"), seg).distinct()
    each = each.select(F.concat_ws(":", "host", "seg").alias("source"), "host", F.when(F.col("seg") == "", "/").otherwise(F.concat(F.lit("/"), "seg")).alias("prefix"), "seg")
    first = each.filter("seg = 'en'").agg(F.min("source").alias("_first"))
    return each.join(first).select("source", F.when(F.col("source") == F.col("_first"), "single").otherwise("many").alias("kind"), "host", "prefix")


@query(f"""WITH {_CATALOG}, p AS (SELECT *, CASE WHEN page_id % 7 = 0 THEN 'single' ELSE 'many' END AS kind FROM u),
o AS (SELECT kind, min(source) AS sole FROM s GROUP BY kind HAVING count(DISTINCT source) = 1),
b AS (SELECT page_id, arg_min(source, (-length(rtrim(prefix, '/')), source)) AS best FROM p JOIN s ON p.host = s.host WHERE rtrim(prefix, '/') = '' OR path = rtrim(prefix, '/') OR starts_with(path, rtrim(prefix, '/') || '/') GROUP BY page_id)
SELECT page_id, coalesce(sole, best) AS source, CASE WHEN sole IS NOT NULL THEN 'kind' WHEN best IS NOT NULL THEN 'prefix' END AS "by" FROM p LEFT JOIN o ON o.kind = p.kind LEFT JOIN b USING (page_id)""")
def j1_catalog_source(spark, d):
    """A kind that one source alone has decides before hosts and prefixes do."""
    pages = table(spark, d, "pages").withColumn("kind", F.when(F.col("page_id") % 7 == 0, "single").otherwise("many"))
    return graph.identify(pages, "page_id", "kind", urls.host(F.col("url")), urls.path(F.col("url")), catalog(spark, d))


@query("""WITH r AS (SELECT page_id AS document, url FROM pages WHERE page_id % 4 = 0), m AS (SELECT url, page_id - page_id % 4 AS document, page_id AS place FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT url, page_id + 1, page_id + 100000 FROM pages WHERE page_id % 8 = 3),
a AS (SELECT url, arg_max(document, place) AS document FROM m WHERE document IN (SELECT document FROM r) GROUP BY url), o AS (SELECT url, min(document) AS document FROM r GROUP BY url), c AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 = 2)
SELECT page_id, CASE WHEN coalesce(a.document, o.document) IS NOT NULL THEN 'raw' WHEN c.url IS NOT NULL THEN 'audit' ELSE 'inspect' END AS origin, coalesce(a.document, o.document) AS document FROM pages LEFT JOIN a USING (url) LEFT JOIN o USING (url) LEFT JOIN c USING (url)""")
def j3_manifest_alias(spark, d):
    """Raw documents of their own address or, by a manifest, of another one; cached audits; the rest."""
    pages = table(spark, d, "pages").select("page_id", "url")
    at, page = F.col("page_id") % 4, F.col("page_id")
    raw = pages.filter(at == 0).select(page.alias("document"), "url")
    manifest = pages.filter(at == 1).select("url", (page - at).alias("document"), page.alias("place"))
    manifest = manifest.unionByName(pages.filter(page % 8 == 3).select("url", (page + 1).alias("document"), (page + 100000).alias("place")))
    return graph.coalesced(pages, "url", raw, pages.filter(at == 2).select("url", page.alias("record")), manifest).select("page_id", "origin", "document")


@query("""WITH a AS (SELECT page_id AS audit, unnest([url, regexp_replace(url, '[?#].*$', '')]) AS u FROM pages WHERE page_id % 3 = 0), l AS (SELECT u, max(audit) AS audit FROM a GROUP BY u) SELECT page_id, audit FROM pages LEFT JOIN l ON u = url""")
def j2_audit_lookup(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    both = F.explode(F.array("url", F.regexp_replace("url", r"[?#].*$", ""))).alias("u")
    audits = pages.filter("page_id % 3 = 0").select(F.col("page_id").alias("a"), both).groupBy("u").agg(F.max("a").alias("audit"))
    return pages.join(audits, F.col("url") == F.col("u"), "left").select("page_id", "audit")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'raw' WHEN page_id % 3 = 0 THEN 'audit' ELSE 'inspect' END AS origin FROM pages""")
def j3_coalesce_sources(spark, d):
    pages = table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("u"))
    raw = pages.filter("page_id % 2 = 0").select("page_id", F.lit("raw").alias("r"))
    audit = pages.filter("page_id % 3 = 0").select("page_id", F.lit("audit").alias("a"))
    return pages.join(raw, "page_id", "left").join(audit, "page_id", "left").select("page_id", F.coalesce("r", "a", F.lit("inspect")).alias("origin"))


@query(f"""WITH {_NORMAL} SELECT page_id FROM u WHERE regexp_extract(path, '^/([a-z]+)/', 1) IN (SELECT lang FROM documents WHERE source = 'src0' GROUP BY lang HAVING count(*) > 2)""")
def j12_left_semi(spark, d):
    """Pages in a language that has over two official documents."""
    counts = docs_of(spark, d).filter("source = 'src0'").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    chosen = counts.filter("n > 2").select("lang")
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract(urls.path(F.col("url")), "^/([a-z]+)/", 1).alias("lang"))
    return pages.join(chosen, "lang", "left_semi").select("page_id")


@query(f"""WITH {_NORMAL} SELECT DISTINCT host FROM u WHERE host NOT IN (SELECT host FROM u WHERE page_id % 4 = 0)""")
def j13_frontier(spark, d):
    hosts = table(spark, d, "pages").select("page_id", urls.host(F.col("url")).alias("host"))
    known = hosts.filter("page_id % 4 = 0").select("host").distinct()
    return hosts.select("host").join(known, "host", "left_anti").dropDuplicates()


@query(f"""WITH {_NORMAL}, s AS (SELECT host, min(page_id) AS page_id, bool_or(contains(host, 'spam')) AS bad FROM u GROUP BY host), r AS (SELECT *, row_number() OVER (PARTITION BY bad ORDER BY page_id) AS n FROM s)
SELECT host, CASE WHEN bad THEN 'blocked' WHEN n > 20 THEN 'over cap' ELSE 'accepted' END AS decision FROM r""")
def j18_frontier_plan(spark, d):
    seeds = table(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"))
    seeds = seeds.withColumn("bad", any_of(F.col("host"), ("spam",)))
    out = keyed.cap_per_key(seeds, "bad", 20, [F.col("page_id")])
    return out.select("host", F.when(F.col("bad"), "blocked").when(F.col("over_cap"), "over cap").otherwise("accepted").alias("decision"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g') AS title,
  len(list_distinct(regexp_extract_all(html, '<a href="([^"]+)"', 1)))::INT AS n_links FROM pages""")
def s14_html_extract(spark, d):
    out = extract_html(table(spark, d, "pages"))
    return out.select("page_id", "title", F.size("links").alias("n_links"))


@query(f"""WITH {_MATCH}, sn AS (SELECT m.*, list_filter(list_transform(regexp_extract_all(text, '[^。！？!?；;.\\n]*[。！？!?；;.]|[^。！？!?；;.\\n]+'), lambda x: trim(x)), lambda x: contains(x, term) AND length(x) >= 2)[1] AS sentence FROM m),
so AS (SELECT term, string_agg(source, ',' ORDER BY k) AS sources FROM (SELECT term, source, row_number() OVER (PARTITION BY term ORDER BY min(doc_id)) AS k FROM m GROUP BY term, source) WHERE k <= 3 GROUP BY term)
SELECT term, count(*) AS documents, sum(n)::BIGINT AS mentions, any_value(sources) AS sources, arg_min(CASE WHEN length(flat) > 120 THEN substr(flat, 1, 119) || '…' ELSE flat END, doc_id) AS snippet
FROM (SELECT *, replace(trim(regexp_replace(sentence, '\\s+', ' ', 'g')), '|', '\\|') AS flat FROM sn) JOIN so USING (term) GROUP BY term""")
def a30_entity_review(spark, d):
    """One row per term for a person to decide on: counts, three sources, the first sentence, short."""
    docs = docs_of(spark, d)
    found = graph.dictionary_match(docs, "doc_id", "text", TOPICS)
    return graph.review_rows(found, docs, "doc_id", "text", "source", sources=3, short=120)


@query(_typed_sql().replace("SELECT doc_id, source, relation, target, max(confidence) AS confidence, 'rel_' || substr(sha256(concat_ws('|', doc_id::VARCHAR, source, relation, target)), 1, 20) AS relation_id FROM y GROUP BY ALL", "SELECT source, relation, target, max(confidence) AS confidence, count(DISTINCT doc_id) AS documents, min(doc_id) AS first, 'pending' AS review FROM y GROUP BY ALL"))
def a30_relation_review(spark, d):
    out = graph.typed_relations(pairs_of(spark, d), NAME_KINDS, TYPED, "doc_id").groupBy("source", "relation", "target")
    return out.agg(F.max("confidence").alias("confidence"), F.count_distinct("doc_id").alias("documents"), F.min("doc_id").alias("first"), F.lit("pending").alias("review"))


@query("""WITH f AS (SELECT url, min(page_id) AS first FROM pages GROUP BY url) SELECT page_id, first FROM pages JOIN f USING (url)""")
def j15_first_navigation(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    first = graph.first_per_key(pages, ["url"], [F.col("page_id")]).select("url", F.col("page_id").alias("first"))
    return pages.join(first, "url").select("page_id", "first")


@query(f"""WITH {_MATCH} SELECT term, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (k <= 3) AS first_documents, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS k FROM m) GROUP BY term""")
def a30_review_tables(spark, d):
    m = graph.dictionary_match(docs_of(spark, d), "doc_id", "text", TOPICS)
    k = m.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("doc_id"))).filter("k <= 3")
    firsts = k.groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("first_documents"))
    return m.groupBy("term").agg(F.count(F.lit(1)).alias("n")).join(firsts, "term")
