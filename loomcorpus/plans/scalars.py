"""URL, text and rule columns over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules, text, urls
from .registry import query, table

# The tables' texts are invented, so the catalogs here are frequent pieces of theirs.
TERMS = ("that", "with", "this", "from", "tion", "ther", "than", "there", "ention")
INJECTION = (r"(?i)ignore (all|previous)", r"^The and ")
_T = ", ".join(f"'{t}'" for t in TERMS)
_NORMAL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '^([a-z]+)://', 1)) AS scheme,
         lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host,
         regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') AS path,
         regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages),
n AS (
  SELECT page_id, host, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END AS path, scheme,
         array_to_string(list_sort(list_filter(string_split(query, '&'),
           lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ('from', 'source', 'spm', 'timestamp', 'key', 'sign', 'token')
                     AND NOT starts_with(x, 'utm_'))), '&') AS query FROM p),
u AS (SELECT page_id, host, path, scheme,
             concat(scheme, '://', host, path, CASE WHEN query = '' THEN '' ELSE '?' || query END) AS url FROM n)
"""
HOSTS = {"example.com": "trade", "example.org": "club", "blog.thernd.example.net": "blog"}
ALLOWED = {f"{h}.example.{t}": ("/en", "/de") for h in ("www.ththhe", "therea", "ththin", "therin", "blog.tionsh") for t in ("com", "net", "org")}
_PLACES = ", ".join(f"'{h}'" for h in ALLOWED)


@query(_NORMAL + "SELECT page_id, url FROM u")
def u1_normalize_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.normalize_url(F.col("url")).alias("url"))


@query(_NORMAL + """SELECT p.page_id, CASE WHEN u.scheme = 'https' THEN u.url ELSE p.url END AS url
FROM pages p JOIN u USING (page_id)""")
def u2_canonical_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


@query("SELECT page_id, regexp_matches(url, '^https://[^/]+') AS safe FROM pages")
def u3_is_safe_url(spark, d):
    return table(spark, d, "pages").select("page_id", urls.is_safe_url(F.col("url")).alias("safe"))


@query(_NORMAL + f"""SELECT page_id, host IN ({_PLACES}) AND NOT contains(lower(path), '.html')
  AND (path = '/en' OR path = '/de' OR starts_with(lower(path), '/en/') OR starts_with(lower(path), '/de/')) AS allowed FROM u""")
def u4_is_allowed_url(spark, d):
    allowed = urls.is_allowed_url(F.col("url"), ALLOWED, (".html",))
    return table(spark, d, "pages").select("page_id", allowed.alias("allowed"))


@query(_NORMAL + """SELECT page_id, CASE WHEN host = 'blog.thernd.example.net' THEN 'blog' WHEN host = 'example.com' OR suffix(host, '.example.com') THEN 'trade'
  WHEN host = 'example.org' OR suffix(host, '.example.org') THEN 'club' ELSE 'other' END AS kind FROM u""")
def u5_source_type(spark, d):
    return table(spark, d, "pages").select("page_id", urls.source_type(F.col("url"), HOSTS, "other").alias("kind"))


@query("SELECT doc_id, 'doc_' || substr(sha256(text), 1, 20) AS stable_id, sha256(text) AS content_hash FROM documents")
def u6_stable_id(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", urls.stable_id("doc", c).alias("stable_id"), urls.content_hash(c).alias("content_hash"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[\s\p{Z}]+', '', 'g')) AS digest FROM documents")
def u7_normalized_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", urls.normalized_content_hash(F.col("text")).alias("digest"))


@query(r"""SELECT page_id, CASE WHEN regexp_matches(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', ''), '/[a-z]{2}/[0-9]+')
  THEN 'https://item.example/' || regexp_extract(url, '/[a-z]{2}/([0-9]+)', 1) END AS item_url FROM pages""")
def u8_id_from_url(spark, d):
    found = urls.id_from_url(F.col("url"), r"/[a-z]{2}/([0-9]+)", "https://item.example/%s")
    return table(spark, d, "pages").select("page_id", found.alias("item_url"))


@query(r"""SELECT page_id, CASE WHEN path LIKE '/en/%' THEN 'english' WHEN regexp_matches(path, '^/(de|fr)/') THEN 'continental' ELSE 'other' END AS label
FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def u9_label_for_url(spark, d):
    rule = [("^/en/", "english"), ("^/(de|fr)/", "continental")]
    return table(spark, d, "pages").select("page_id", urls.label_for_path(F.col("url"), rule, "other").alias("label"))


_COMPACT = r"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)),
             lambda x: trim(regexp_replace(x, '[\t\f\v ]+', ' ', 'g'))), lambda x: x <> '') AS a FROM documents),
c AS (SELECT doc_id, list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]) AS a FROM l)
"""


@query(_COMPACT + "SELECT doc_id, array_to_string(a, chr(10)) AS text FROM c")
def t1_compact_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compact_text(F.col("text")).alias("text"))


@query(_COMPACT + r""", h AS (SELECT doc_id, a, coalesce(list_position(list_transform(a, lambda x: starts_with(x, 'Licensed under')), true), 0) AS tail FROM c),
g AS (SELECT doc_id, a, CASE WHEN tail > 0 THEN a[1:tail - 1] ELSE a END AS b FROM h),
k AS (SELECT doc_id, a, b, list_filter(b, lambda x: NOT regexp_matches(x, '^Released under')) AS t FROM g),
m AS (SELECT doc_id, a, b, t, list_filter(t, lambda x, i: list_position(t, x) = i) AS q FROM k)
SELECT doc_id, array_to_string(q, chr(10)) AS content, (len(t) - len(q))::INT AS duplicates,
  round(least(1.0, (length(regexp_replace(array_to_string(b, ''), '\s+', '', 'g')) - length(regexp_replace(array_to_string(q, ''), '\s+', '', 'g')))::DOUBLE
    / greatest(1, length(regexp_replace(array_to_string(a, ''), '\s+', '', 'g')))), 4) AS noise FROM m""")
def t2_clean_document(spark, d):
    clean = text.clean_document(F.col("text"), tails=("Licensed under",), patterns=("^Released under",))
    return table(spark, d, "documents").select("doc_id", clean.alias("c")).select("doc_id", "c.content", "c.duplicates", "c.noise")


@query(_COMPACT + r"""SELECT doc_id, array_to_string(list_filter(a, lambda x: NOT contains(x, '###') AND NOT contains(x, '!!') AND NOT regexp_matches(x, '[0-9]+%')), chr(10)) AS text FROM c""")
def t3_filter_promo_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", text.without_lines(F.col("text"), ("###", "!!"), "[0-9]+%").alias("text"))


@query(r"""SELECT doc_id, length(regexp_replace(text, '[\s\p{Z}]+', '', 'g'))::INT AS effective,
  (length(text) - length(regexp_replace(text, '[\x{4E00}-\x{9FFF}]', '', 'g')))::INT AS cjk FROM documents""")
def t4_lengths(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.effective_length(c).alias("effective"), text.count_cjk(c).alias("cjk"))


@query(r"""SELECT doc_id, count(*) AS n, sum(length(s))::BIGINT AS chars FROM (
  SELECT doc_id, trim(unnest(regexp_extract_all(text, '[^。！？!?；;.\n]*[。！？!?；;.]|[^。！？!?；;.\n]+'))) AS s FROM documents)
  WHERE length(s) BETWEEN 2 AND 300 GROUP BY doc_id""")
def t5_split_sentences(spark, d):
    each = table(spark, d, "documents").select("doc_id", F.explode(text.sentences(F.col("text"), 2, 300)).alias("s"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("s")).alias("chars"))


@query(r"""SELECT doc_id, substr(f, 1, 260) AS excerpt, CASE WHEN length(g) > 80 THEN substr(g, 1, 79) || '…' ELSE g END AS short
FROM (SELECT doc_id, f, replace(f, '|', '\|') AS g FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM documents))""")
def t6_excerpts(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.excerpt(c, 260).alias("excerpt"), text.short(c, 80).alias("short"))


@query(r"""SELECT doc_id, CASE WHEN length(b) > 480 THEN rtrim(substr(b, 1, 480), ' ' || chr(10)) || '…' ELSE b END AS excerpt FROM (
  SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)),
    lambda x: x <> '' AND NOT regexp_matches(x, '(?i)ignore (all|previous)') AND NOT starts_with(x, 'The and ')), chr(10)) AS b FROM documents)""")
def t7_safe_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", text.safe_excerpt(F.col("text"), INJECTION).alias("excerpt"))


@query(r"""SELECT p_partkey, CASE WHEN n = '' THEN 'document' ELSE lower(n) END AS file FROM (
  SELECT p_partkey, substr(regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[^0-9A-Za-z\x{4E00}-\x{9FFF}_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g'), 1, 80) AS n FROM part)""")
def t8_safe_filename(spark, d):
    name = F.concat_ws(" ", "p_name", "p_brand")
    return table(spark, d, "part").select("p_partkey", text.safe_filename(name).alias("file"))


@query("""SELECT event_id, '***REDACTED***' AS token, json_extract_string(props, '$.k') AS k, user_id::VARCHAR AS who FROM events""")
def t9_redact(spark, d):
    kind = T.MapType(T.StringType(), T.StringType())
    props = F.map_concat(F.from_json("props", kind), F.create_map(F.lit("Token"), F.col("event_type"), F.lit("who"), F.col("user_id").cast("string")))
    shown = text.redact(props, kind, ("token", *text.SENSITIVE))
    df = table(spark, d, "events").select("event_id", shown.alias("p"))
    return df.select("event_id", F.col("p")["Token"].alias("token"), F.col("p")["k"].alias("k"), F.col("p")["who"].alias("who"))


@query("""SELECT doc_id, contains(text, 'ention') AS many, regexp_matches(text, '(^|[^A-Za-z0-9])a([^A-Za-z0-9]|$)') AS one FROM documents""")
def t10_term_present(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.term_present(c, "ention").alias("many"), text.term_present(c, "a").alias("one"))


@query(r"""SELECT doc_id, nullif(trim(regexp_extract(text, 'token[ \t]*[:：]?[ \t]*([^\n]{1,80})', 1)), '') AS value,
  CASE WHEN regexp_matches(text, '[0-9]') THEN floor(regexp_extract(replace(text, ',', ''), '([0-9]+(\.[0-9]+)?)', 1)::DOUBLE % 1000000)::INT END AS number FROM documents""")
def t11_labelled_value(spark, d):
    first = F.regexp_extract(F.replace("text", F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    number = F.when(first != "", F.floor(first.cast("double") % 1000000).cast("int"))
    return table(spark, d, "documents").select("doc_id", text.labelled_value(F.col("text"), ("token",)).alias("value"), number.alias("number"))


@query("""SELECT p_partkey, replace(replace(lower(regexp_replace(p_name || '—' || p_type, '[\\s\\p{P}\\p{S}]+', '', 'g')), 'red', '1'), 'blue', '2') AS title FROM part""")
def t12_normalized_title(spark, d):
    title = text.normalized_title(F.concat_ws("—", "p_name", "p_type"), {"red": "1", "blue": "2"})
    return table(spark, d, "part").select("p_partkey", title.alias("title"))


@query("""SELECT event_id, round(hour(ts) * 3600 + minute(ts) * 60 + second(ts) + (microsecond(ts) % 1000000 // 1000) / 1000.0, 3)::DOUBLE AS seconds,
  epoch(date_trunc('second', ts))::BIGINT AS at FROM events""")
def t13_clock_seconds(spark, d):
    clock = F.date_format("ts", "HH:mm:ss,SSS")
    stamp = text.as_timestamp(F.unix_timestamp("ts").cast("string"))
    return table(spark, d, "events").select("event_id", F.round(text.clock_seconds(clock), 3).alias("seconds"), F.unix_timestamp(stamp).alias("at"))


@query(f"""WITH h AS (SELECT doc_id, list_sort(list_distinct(list_transform(list_filter([{_T}], lambda t: contains(text, t)), lambda t: CASE WHEN t = 'this' THEN 'that' ELSE t END))) AS a FROM documents)
SELECT doc_id, array_to_string(list_filter(a, lambda x: len(list_filter(a, lambda y: y <> x AND contains(y, x))) = 0), ',') AS terms FROM h""")
def t14_canonical_terms(spark, d):
    found = text.context_flags(F.col("text"), TERMS)
    return table(spark, d, "documents").select("doc_id", F.array_join(text.canonical_terms(found, {"this": "that"}), ",").alias("terms"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+'))::INT AS n_words, len(regexp_extract_all(regexp_replace(lower(text), '[\s\p{Z}]+', '', 'g'), '[a-z0-9_]+'))::INT AS n_terms,
  md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) AS words FROM documents""")
def t15_tokenize(spark, d):
    c = F.col("text")
    words = text.tokenize(c, "words")
    return table(spark, d, "documents").select(
        "doc_id", F.size(words).alias("n_words"), F.size(text.tokenize(c)).alias("n_terms"), F.md5(F.array_join(words, " ")).alias("words")
    )


@query("SELECT doc_id, sha256(concat(source, chr(10), source, chr(10), lang, chr(10), text)) AS fingerprint FROM documents")
def t16_searchable_text(spark, d):
    whole = text.searchable_text(F.col("source"), F.col("text"), F.col("lang"))
    return table(spark, d, "documents").select("doc_id", urls.content_hash(whole).alias("fingerprint"))


@query(f"""SELECT doc_id, array_to_string(a, ',') AS flags, a[1] AS first_flag FROM (SELECT doc_id, list_filter([{_T}], lambda t: contains(text, t)) AS a FROM documents)""")
def t17_context_flags(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", F.array_join(text.context_flags(c, TERMS), ",").alias("flags"), text.context_flags(c, TERMS, True).alias("first_flag")
    )


_HITS = f"""list_filter(list_filter(['ention', 'there', 'from', 'than', 'that', 'ther', 'this', 'tion', 'with'], lambda t: contains(text, t)), lambda x:
  len(list_filter(list_filter([{_T}], lambda t: contains(text, t)), lambda y: length(y) > length(x) AND contains(y, x))) = 0)"""


@query(f"SELECT doc_id, array_to_string({_HITS}, ',') AS hits FROM documents")
def p1_keyword_hits(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(rules.keyword_hits(F.col("text"), TERMS), ",").alias("hits"))


HARD, GAME, LORE, CORE = ("%%%", "!!"), ("ing ", "ed ", "er "), (" that ", "tion"), ("with", "from", "this")
_CLASS = """CASE WHEN contains(t, '%%%') OR contains(t, '!!') THEN 'gameplay'
  WHEN contains(t, 'ing ')::INT + contains(t, 'ed ')::INT + contains(t, 'er ')::INT >= 3 THEN 'gameplay'
  WHEN contains(t, 'ing ')::INT + contains(t, 'ed ')::INT + contains(t, 'er ')::INT >= 2 AND (contains(t, ' that ') OR contains(t, 'tion')) THEN 'mixed'
  WHEN contains(t, ' that ') OR contains(t, 'tion') OR contains(t, 'with')::INT + contains(t, 'from')::INT + contains(t, 'this')::INT >= 2 THEN 'lore'
  ELSE 'unknown' END"""


@query(f"SELECT doc_id, {_CLASS} AS class FROM (SELECT doc_id, concat(source, chr(10), substr(text, 1, 1200)) AS t FROM documents)")
def p2_classify_page(spark, d):
    kind = rules.page_class(F.col("source"), F.col("text"), hard=HARD, game=GAME, lore=LORE, core=CORE)
    return table(spark, d, "documents").select("doc_id", kind.alias("class"))


@query(f"""WITH b AS (SELECT doc_id, source, text, n_chars, {_CLASS} AS class FROM (SELECT doc_id, source, text, n_chars, concat(source, chr(10), substr(text, 1, 1200)) AS t FROM documents)),
s AS (SELECT *, (source = 'src1')::INT * 10 + (contains(source, '2'))::INT * 8 + (class IN ('lore', 'mixed'))::INT * 3 - (class = 'gameplay')::INT * 8 - (n_chars < 80)::INT * 5 AS score FROM b)
SELECT doc_id, score::INT AS score, CASE WHEN n_chars < 80 THEN 'too short' WHEN class = 'gameplay' THEN 'game page' WHEN score < 3 THEN 'low score' ELSE 'direct match' END AS reason,
  CASE WHEN n_chars < 80 OR class = 'gameplay' OR score < 3 THEN 'exclude' ELSE 'include' END AS decision,
  concat_ws(';', CASE WHEN source = 'src1' THEN 'lead +10' END, CASE WHEN contains(source, '2') THEN 'concept +8' END, CASE WHEN class IN ('lore', 'mixed') THEN 'story +3' END,
    CASE WHEN class = 'gameplay' THEN 'game -8' END, CASE WHEN n_chars < 80 THEN 'short -5' END) AS breakdown FROM s""")
def p3_score_candidate(spark, d):
    w = rules.Weights()
    kind = rules.page_class(F.col("source"), F.col("text"), hard=HARD, game=GAME, lore=LORE, core=CORE)
    df = table(spark, d, "documents").withColumn("class", kind)
    score, lines = rules.scored([
        (F.col("source") == "src1", w.lead_in_title, "lead"), (F.col("source").contains("2"), w.concept_in_title, "concept"),
        (F.col("class").isin("lore", "mixed"), w.story_page, "story"), (F.col("class") == "gameplay", w.game_page, "game"),
        (F.col("n_chars") < w.least_chars, w.too_short, "short"),
    ])
    out = rules.first_match([(F.col("n_chars") < w.least_chars, "too short"), (F.col("class") == "gameplay", "game page"), (F.col("score") < 3, "low score")])
    return df.withColumn("score", score).select(
        "doc_id", "score", F.coalesce(out, F.lit("direct match")).alias("reason"),
        F.when(out.isNull(), "include").otherwise("exclude").alias("decision"), F.array_join(lines, ";").alias("breakdown"),
    )


@query("SELECT doc_id FROM documents WHERE contains(lower(source || ' ' || text), 'ention') OR contains(lower(source || ' ' || text), 'src7')")
def p4_scope_filter(spark, d):
    scope = rules.any_of(F.lower(F.concat_ws(" ", "source", "text")), ("ention", "src7"))
    return table(spark, d, "documents").filter(scope).select("doc_id")


@query("""SELECT doc_id, CASE WHEN n_chars < 40 OR quality = 0 THEN 'rejected' WHEN n_chars < 200 OR toxic = 1 OR quality IS NULL THEN 'needs_review' ELSE 'accepted' END AS status,
  CASE WHEN n_chars < 40 OR quality = 0 THEN concat_ws(',', CASE WHEN n_chars < 40 THEN 'too short' END, CASE WHEN quality = 0 THEN 'bad label' END)
  ELSE concat_ws(',', CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'no label' END) END AS reasons
FROM documents LEFT JOIN labels USING (doc_id)""")
def p5_quality_gate(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    gate = rules.quality_gate(
        [(F.col("n_chars") < 40, "too short"), (F.col("quality") == 0, "bad label")],
        [(F.col("n_chars") < 200, "short"), (F.col("toxic") == 1, "toxic"), (F.col("quality").isNull(), "no label")],
    )
    return df.select("doc_id", gate.alias("g")).select("doc_id", "g.status", F.array_join("g.reasons", ",").alias("reasons"))


@query("""SELECT page_id, regexp_matches(url, '/(en|de)/[0-9]+') AND NOT contains(url, 'page=') AS candidate, contains(url, 'page=') OR contains(url, '#top') AS navigation FROM pages""")
def p6_link_predicates(spark, d):
    u = F.col("url")
    page = u.contains("page=")
    return table(spark, d, "pages").select("page_id", (u.rlike("/(en|de)/[0-9]+") & ~page).alias("candidate"), (page | u.contains("#top")).alias("navigation"))


@query("""SELECT event_id, CASE WHEN user_id IN (8, 46, 7) THEN 'official' WHEN event_type IN ('purchase', 'signup') THEN 'trade' WHEN contains(event_type, 'ie') THEN 'look' ELSE 'other' END AS class,
  CASE WHEN user_id IN (8, 46, 7) THEN 'A' ELSE 'C' END AS tier FROM events""")
def p7_allowlist_class(spark, d):
    known = spark.createDataFrame([(8,), (46,), (7,)], "user_id long").withColumn("verified", F.lit(True))
    df = table(spark, d, "events").join(F.broadcast(known), "user_id", "left")
    kind = rules.type_map(F.col("event_type"), {"trade": ("purchase", "signup"), "look": ("ie",)}, "other")
    return df.select("event_id", F.when(F.col("verified"), "official").otherwise(kind).alias("class"), F.when(F.col("verified"), "A").otherwise("C").alias("tier"))


@query("""SELECT item_id, CASE WHEN trim(text) = '' OR contains(text, 'worthless') THEN 'none' WHEN contains(text, 'Que') THEN 'navigation'
  WHEN contains(text, ' the ') AND contains(text, 'tion ') THEN 'dialogue' WHEN contains(text, ' the ') AND contains(text, 'ing') THEN 'official_fact'
  WHEN contains(text, ' the ') THEN 'mixed' ELSE 'none' END AS route FROM benchmark""")
def p8_route_query(spark, d):
    kind = rules.route(F.col("text"), deny=("worthless",), navigation=("Que",), topic=(" the ",), dialogue=("tion ",), fact=("ing",))
    return table(spark, d, "benchmark").select("item_id", kind.alias("route"))


@query("""SELECT doc_id, ((source = 'src0')::INT * 5 + contains(text, 'ention')::INT * 3 + (n_chars > 1000)::INT * 2)::INT AS score,
  concat_ws('；', CASE WHEN source = 'src0' THEN 'main' END, CASE WHEN contains(text, 'ention') THEN 'topic' END, CASE WHEN n_chars > 1000 THEN 'long' END) AS reason FROM documents""")
def p9_scene_score(spark, d):
    parts = [(F.col("source") == "src0", 5, "main"), (F.col("text").contains("ention"), 3, "topic"), (F.col("n_chars") > 1000, 2, "long")]
    why = F.array_join(rules.reasons([(c, label) for c, _, label in parts]), "；")
    return table(spark, d, "documents").select("doc_id", rules.scored(parts)[0].alias("score"), why.alias("reason"))


@query("""SELECT p_partkey, CASE WHEN contains(p_name, 'ring') OR contains(p_name, 'gear') THEN 'round' WHEN contains(p_name, 'bolt') THEN 'long' ELSE 'other' END AS kind FROM part""")
def p10_material_type(spark, d):
    return table(spark, d, "part").select("p_partkey", rules.type_map(F.col("p_name"), {"round": ("ring", "gear"), "long": ("bolt",)}, "other").alias("kind"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT (contains(text, '?') OR contains(text, 'or ') OR contains(text, ' if '))")
def p11_certain_turns(spark, d):
    return table(spark, d, "conversations").filter(~rules.any_of(F.col("text"), ("?", "or ", " if "))).select("conv_id", "turn")


@query("""SELECT conv_id, turn, CASE WHEN contains(text, 'tion') THEN 'glad' WHEN contains(text, 'less') THEN 'low' WHEN turn >= 4 THEN 'steady' ELSE 'mild' END AS mood,
  CASE WHEN length(text) >= 400 THEN 'close' WHEN length(text) >= 100 THEN 'known' ELSE 'new' END AS stage FROM conversations""")
def p12_mood_and_stage(spark, d):
    mood = rules.first_match([(F.col("text").contains("tion"), "glad"), (F.col("text").contains("less"), "low"), (F.col("turn") >= 4, "steady")], "mild")
    level = rules.stage(F.length("text"), ((0, "new"), (100, "known"), (400, "close")))
    return table(spark, d, "conversations").select("conv_id", "turn", mood.alias("mood"), level.alias("stage"))


@query("""SELECT doc_id, o AS overall, CASE WHEN o >= 88 THEN 'excellent' WHEN o >= 72 THEN 'good' WHEN o >= 55 THEN 'fair' ELSE 'poor' END AS verdict
FROM (SELECT doc_id, round((least(100, quality * 120) + greatest(0, 90 - toxic * 200) + 70) / 3.0, 1)::DOUBLE AS o FROM labels)""")
def p13_clamped_scores(spark, d):
    a = rules.clamp(F.col("quality") * 120)
    b = rules.clamp(90 - F.col("toxic") * 200)
    c = rules.clamp(F.lit("n/a"))
    df = table(spark, d, "labels").select("doc_id", F.round((a + b + c) / 3, 1).alias("overall"))
    return df.select("doc_id", "overall", rules.verdict(F.col("overall")).alias("verdict"))


@query(r"""SELECT doc_id, contains(text, 'example.com') AS leak, regexp_matches(text, '[\x{FFFD}\x{0000}-\x{0008}]') AS abnormal, contains(text, ' | ') AS residue FROM documents""")
def p15_residue(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id", c.contains("example.com").alias("leak"), c.rlike(r"[\x{FFFD}\x{0000}-\x{0008}]").alias("abnormal"), c.contains(" | ").alias("residue")
    )


@query("""SELECT conv_id, bool_or(contains(text, 'tion')) AS mentions, count(DISTINCT role) >= 2 AS two_speakers, count(*) >= 8 AS long,
  (bool_or(contains(text, 'tion'))::INT * 3 + (count(DISTINCT role) >= 2)::INT * 2 + (count(*) >= 8)::INT * 2)::INT AS score FROM conversations GROUP BY conv_id""")
def p16_document_flags(spark, d):
    flags = table(spark, d, "conversations").groupBy("conv_id").agg(
        F.bool_or(F.col("text").contains("tion")).alias("mentions"), (F.count_distinct("role") >= 2).alias("two_speakers"),
        (F.count(F.lit(1)) >= 8).alias("long"),
    )
    score = F.col("mentions").cast("int") * 3 + F.col("two_speakers").cast("int") * 2 + F.col("long").cast("int") * 2
    return flags.withColumn("score", score)


@query("""SELECT r.k AS requested, concat_ws(',', CASE WHEN n_name IS NULL THEN 'unknown' END, CASE WHEN n_regionkey = 0 THEN 'not enabled' END, CASE WHEN n_nationkey % 2 = 1 THEN 'not automated' END) AS violations
FROM (SELECT unnest([1, 2, 3, 6, 20, 99]) AS k) r LEFT JOIN nation ON n_nationkey = r.k""")
def p17_eligible_sources(spark, d):
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3, 6, 20, 99)], "requested int")
    df = asked.join(table(spark, d, "nation"), F.col("requested") == F.col("n_nationkey"), "left")
    bad = rules.reasons([(F.col("n_name").isNull(), "unknown"), (F.col("n_regionkey") == 0, "not enabled"), (F.col("n_nationkey") % 2 == 1, "not automated")])
    return df.select("requested", F.array_join(bad, ",").alias("violations"))
