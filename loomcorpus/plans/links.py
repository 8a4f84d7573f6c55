"""Pages and documents as linked sources: titles, duplicates, link graph, gaps, repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, urls
from ..functions.rules import any_of
from ..operators import graph, links
from ..sources import html
from ..sources.html import extract_html
from ..sources.shared import written
from .registry import query, table

#: What a title keeps for comparison.
_KEPT = r"[^\p{L}0-9]+"


def tidy(title):
    return F.lower(F.regexp_replace(title, _KEPT, ""))


def read(spark, d):
    """Pages with their title, links and the first number of their path as chapter number."""
    out = extract_html(table(spark, d, "pages")).select("page_id", "title", "links")
    number = F.regexp_extract(urls.path(F.col("url")), r"/(\d{4,})", 1)
    return out.join(table(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"), number.alias("number")), "page_id")


def _shingles(c):
    return graph.shingle_signature(c)


def duplicates_of(spark, d, pages=None):
    pages = written(read(spark, d).drop("links"), "pages-read") if pages is None else pages
    left = pages.select(F.col("page_id").alias("id"), tidy(F.col("title")).alias("title"), "number", _shingles(F.col("title")).alias("signature"))
    docs = written(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.substring_index("text", "\n", 1).alias("first")), "first-lines")
    right = docs.select("id", tidy(F.col("first")).alias("title"), _shingles(F.col("first")).alias("signature"))
    return links.title_duplicates(left, right.filter("title <> ''"))


#: A reference counts without its semicolon too, as HTML reads it: titles are cut anywhere.
_READ = r"""pg AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/([0-9]{4,})', 1) AS number,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', '''', 'g'), '&amp;?', '&', 'g') AS title, regexp_extract_all(html, '<a href="([^"]+)"', 1) AS hrefs, regexp_extract_all(html, '<a href="[^"]+">([^<]*)</a>', 1) AS labels FROM pages)"""
_SIG = r"""list_sort(list_distinct(list_transform(list_transform(range(1, greatest(2, length({p}) - 3)), lambda i: substr({p}, i::BIGINT, 5)), lambda x: substr(sha256(x), 1, 16))))[1:64]"""
_DUPLICATES = (
    "WITH " + _READ + ", lt AS (SELECT page_id AS id, lower(regexp_replace(title, '[^\\p{L}0-9]+', '', 'g')) AS title, number, " + _SIG.format(p="p")
    + " AS sig FROM (SELECT *, regexp_replace(title, '\\s+', '', 'g') AS p FROM pg)), rt AS (SELECT doc_id AS id, lower(regexp_replace(f, '[^\\p{L}0-9]+', '', 'g')) AS title, " + _SIG.format(p="p")
    + r""" AS sig FROM (SELECT doc_id, f, regexp_replace(f, '\s+', '', 'g') AS p FROM (SELECT doc_id, split_part(text, chr(10), 1) AS f FROM documents))),
mt AS (SELECT l.id AS lid, r.id AS rid, l.title <> '' AND (contains(r.title, l.title) OR contains(l.title, r.title)) AS by_title, l.number <> '' AND contains(r.title, l.number) AS by_number, l.sig AS ls, r.sig AS rs
  FROM lt l JOIN rt r ON r.title <> '' AND ((l.title <> '' AND (contains(r.title, l.title) OR contains(l.title, r.title))) OR (l.number <> '' AND contains(r.title, l.number)))),
fm AS (SELECT *, len(list_intersect(ls, rs)) / least(len(ls), len(rs)) AS alike FROM mt QUALIFY row_number() OVER (PARTITION BY lid ORDER BY rid) = 1),
dup AS (SELECT lid AS "left", rid AS "right", concat_ws(',', CASE WHEN by_number THEN 'chapter_number' END, CASE WHEN by_title THEN 'normalized_title' END, CASE WHEN alike >= 0.5 THEN 'text_similarity' END) AS basis,
  round(greatest(CASE WHEN by_title AND by_number THEN 0.95 ELSE 0.9 END, alike), 4) AS similarity FROM fm)"""
)


@query(_DUPLICATES + ' SELECT "left", "right", basis, similarity::DOUBLE AS similarity FROM dup')
def j7_title_duplicates(spark, d):
    """The document whose first line is a page's title, or holds it or is held by it."""
    return duplicates_of(spark, d).withColumn("basis", F.array_join("basis", ","))


_ARCHIVE = ("the", "que")


def tables(spark, d, pages=None):
    """Navigation, outbound links and archives of the pages."""
    pages = read(spark, d) if pages is None else pages
    navigation = pages.select(F.col("page_id").alias("id"), "url", F.col("host").alias("group"), F.when(~F.col("url").contains("?"), F.col("page_id")).alias("place"))
    each = pages.select(F.col("url").alias("found_on"), F.explode(F.array_distinct("links.href")).alias("target"))
    archive = any_of(F.lower("target"), _ARCHIVE)
    return navigation, each.filter(~archive), each.filter(archive)


_GRAPH = _DUPLICATES + r""", f AS (SELECT url, min(page_id) AS id FROM pg GROUP BY url),
lk AS (SELECT DISTINCT f.id, target, regexp_matches(lower(target), 'the|que') AS archive FROM (SELECT url, unnest(hrefs) AS target FROM pg) JOIN f USING (url)),
od AS (SELECT page_id, lead(page_id) OVER (PARTITION BY host ORDER BY page_id) AS next FROM pg WHERE NOT contains(url, '?')),
ed AS (SELECT 'root' AS source, 'GUIDES_TO' AS relation, page_id::VARCHAR AS target, 1.0 AS confidence FROM pg UNION ALL SELECT id::VARCHAR, CASE WHEN archive THEN 'ARCHIVE_AVAILABLE_AT' ELSE 'LINKS_TO' END, target, 0.8 FROM lk
UNION ALL SELECT "left"::VARCHAR, unnest(['TRANSCRIPT_AVAILABLE_AT', 'POSSIBLE_DUPLICATE_OF']), "right"::VARCHAR, similarity FROM dup
UNION ALL SELECT page_id::VARCHAR, 'PRECEDES', next::VARCHAR, 0.8 FROM od WHERE next IS NOT NULL UNION ALL SELECT next::VARCHAR, 'FOLLOWS', page_id::VARCHAR, 0.8 FROM od WHERE next IS NOT NULL)
"""


@query(_GRAPH + "SELECT DISTINCT 'source_edge_' || substr(sha256(concat_ws('|', source, relation, target)), 1, 20) AS edge_id, source, relation, target, confidence::DOUBLE AS confidence FROM ed")
def c11_link_graph(spark, d):
    """All seven kinds of edge; pages of a host follow one another, unless their address has a query.
    Pages are taken apart once, and the duplicates, which two kinds are made of, are written once."""
    pages = written(read(spark, d), "pages-read")
    return links.link_graph("root", *tables(spark, d, pages), written(duplicates_of(spark, d, pages), "duplicates"))


@query(_GRAPH + "SELECT pg.page_id, f.id AS first, count(DISTINCT target) FILTER (NOT archive) AS outbound, count(DISTINCT target) FILTER (archive) AS archives, max(\"right\") AS duplicate FROM pg JOIN f USING (url) LEFT JOIN lk ON lk.id = f.id LEFT JOIN dup ON \"left\" = f.id GROUP BY ALL")
def j15_link_joins(spark, d):
    """Each page with the first page of its address, and how many links, archives and duplicates that has.
    Pages are taken apart once."""
    pages = written(read(spark, d), "pages-read")
    navigation, outbound, archives = tables(spark, d, pages)
    first = links.first_by(navigation, "url", "id").select(F.col("url").alias("found_on"), F.col("id").alias("first"))
    count = lambda df, name: df.groupBy("found_on").agg(F.count_distinct("target").alias(name))
    held = first.join(count(outbound, "outbound"), "found_on", "left").join(count(archives, "archives"), "found_on", "left").na.fill(0)
    held = held.join(duplicates_of(spark, d, pages).select(F.col("left").alias("first"), F.col("right").alias("duplicate")), "first", "left")
    return navigation.join(held, F.col("url") == F.col("found_on")).select(F.col("id").alias("page_id"), "first", "outbound", "archives", "duplicate")


@query("WITH " + _READ + """, e AS (SELECT page_id, unnest(hrefs) AS href, unnest(labels) AS label, unnest(range(len(hrefs))) AS place FROM pg),
k AS (SELECT *, replace(replace(replace(replace(replace(trim(label), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS said FROM e)
SELECT page_id, href, said AS label FROM k WHERE contains(lower(href), 'th') OR contains(lower(said), 'th') QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY place DESC) = 1""")
def c15_link_records(spark, d):
    return links.link_records(read(spark, d), "page_id", F.col("links"), ("th",)).select("page_id", "href", "label")


@query(r"""WITH h AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents), a AS (SELECT *, list_position(l, 'All rights reserved.') AS place FROM h WHERE list_contains(l, 'All rights reserved.')
UNION ALL SELECT *, list_position(l, 'Of.') FROM h WHERE list_contains(l, 'Of.') AND NOT list_contains(l, 'All rights reserved.')),
p AS (SELECT doc_id, substr(array_to_string(list_filter(l[place + 1:], lambda x: x <> '' AND NOT regexp_matches(x, '^[0-9\s.,:;%/+-]+$') AND NOT regexp_matches(x, '[:：]\s*[0-9]')), chr(10)), 1, 600) AS profile FROM a)
SELECT doc_id, md5(profile) AS profile, md5(substr(profile, 1, 300)) AS summary FROM p WHERE length(regexp_replace(profile, '[^a-zà-ÿ]', '', 'g')) >= 20""")
def c14_profile_blocks(spark, d):
    """What stands below one of two headings, the second where the first is missing."""
    docs = table(spark, d, "documents")
    first = links.profile_blocks(docs, "doc_id", "text", "All rights reserved.", "[a-zà-ÿ]")
    plain = docs.filter(~F.array_contains(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), "All rights reserved."))
    both = first.unionByName(links.profile_blocks(plain, "doc_id", "text", "Of.", "[a-zà-ÿ]"))
    return both.select("doc_id", F.md5("profile").alias("profile"), F.md5("summary").alias("summary"))


@query("""WITH w AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM documents), v AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS u FROM benchmark),
s AS (SELECT doc_id, item_id, len(list_intersect(t, u)) AS score, len(list_filter(list_intersect(t, u), lambda x: regexp_matches(x, 'tion|keit'))) > 0 AS m FROM w, v)
SELECT doc_id AS "left", arg_max(item_id, score * 1000000 - item_id) AS "right", max(score) AS score FROM s WHERE score >= 5 AND m GROUP BY doc_id""")
def j11_best_hint(spark, d):
    """The benchmark item that shares most words with a document, one of them a chapter's word."""
    tokens = text.tokenize(F.col("text"), "words")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return links.best_hint(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text"), tokens, 5, "tion|keit")


TOPICS = {"ention": ("ention", "attion"), "keit": ("keit", "heit"), "que": ("que",), "ing": ("ing",), "zzz": ("zzz", "zzzz")}
_TERMS = "tm AS (SELECT unnest(['ention', 'ention', 'keit', 'keit', 'que', 'ing', 'zzz', 'zzz']) AS topic, unnest(['ention', 'attion', 'keit', 'heit', 'que', 'ing', 'zzz', 'zzzz']) AS term)"


def topic_table(spark, d):
    """Topics with their terms, and how well official documents cover them."""
    topics = spark.createDataFrame([(t, list(x)) for t, x in TOPICS.items()], "topic string, terms array<string>")
    official = table(spark, d, "documents").filter("source = 'src0'")
    found = graph.dictionary_match(official, "doc_id", "text", [t for x in TOPICS.values() for t in x])
    each = topics.select("topic", F.explode("terms").alias("term")).join(found, "term").groupBy("topic").agg(F.count_distinct("doc_id").alias("n"))
    n = F.coalesce("n", F.lit(0))
    level = F.when(n == 0, "missing").when(n < F.lit(40), "thin").otherwise("usable")
    return topics.join(each, "topic", "left").withColumn("status", level)


@query("WITH " + _READ + ", " + _TERMS + r""", st AS (SELECT topic, CASE WHEN count(DISTINCT doc_id) = 0 THEN 'missing' WHEN count(DISTINCT doc_id) < 40 THEN 'thin' ELSE 'usable' END AS status FROM tm LEFT JOIN documents ON source = 'src0' AND contains(text, term) GROUP BY topic),
mp AS (SELECT DISTINCT topic, status, url FROM st JOIN tm USING (topic) JOIN pg ON contains(title, term) WHERE status <> 'usable'),
lk AS (SELECT DISTINCT url, target, regexp_matches(lower(target), 'the|que') AS archive FROM (SELECT url, unnest(hrefs) AS target FROM pg)),
su AS (SELECT topic, count(DISTINCT url) AS pages, count(DISTINCT (url, target)) FILTER (NOT archive) AS links, coalesce(bool_or(archive AND contains(lower(target), 'the')), false) AS has_film, coalesce(bool_or(archive AND NOT contains(lower(target), 'the')), false) AS has_text FROM mp LEFT JOIN lk USING (url) GROUP BY topic)
SELECT topic, status, coalesce(pages, 0) AS pages, coalesce(links, 0) AS links, coalesce(has_film, false) AS has_film, coalesce(has_text, false) AS has_text,
  CASE WHEN has_film THEN 'ask for the film' WHEN has_text THEN 'ask for the text' WHEN pages > 0 AND links = 0 THEN 'read the pages' WHEN links > 0 THEN 'follow the links' ELSE 'search for more sources' END AS next_step
FROM st LEFT JOIN su USING (topic) WHERE status <> 'usable'""")
def j17_gap_report(spark, d):
    """Topics that official documents cover badly, and what pages with their terms in the title offer."""
    terms = [t for x in TOPICS.values() for t in x]
    navigation = read(spark, d).select("url", text.context_flags(F.col("title"), terms).alias("words"))
    _, outbound, archives = tables(spark, d)
    kind = F.when(F.lower("target").contains("the"), "film").otherwise("text")
    return links.gap_report(topic_table(spark, d), navigation, archives.withColumn("kind", kind), outbound, {"has_film": "film", "has_text": "text"})


@query("WITH " + _TERMS + ", c AS (SELECT item_id, text FROM benchmark) SELECT DISTINCT topic, item_id FROM tm JOIN c ON contains(text, term)")
def j10_topic_matches(spark, d):
    """Topics of confirmed rows, here the benchmark's, through all the names that a topic has."""
    names = {t: topic for topic, terms in TOPICS.items() for t in terms}
    found = text.context_flags(F.col("text"), names)
    pairs = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    each = table(spark, d, "benchmark").select("item_id", F.explode(found).alias("t"))
    return each.select(pairs[F.col("t")].alias("topic"), "item_id").distinct()


_REPAIRED = "WITH " + _READ + r""", rp AS (SELECT page_id, regexp_extract(url, '^([a-z]+://)', 1) || host || regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(.)/+$', '\1') AS fixed, trim(regexp_replace(title, '\s+', ' ', 'g')) AS tidy,
  host <> regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host_fixed, contains(url, '#') OR contains(url, '?') AS tail_cut, regexp_matches(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), './+$') AS slash_cut,
  trim(regexp_replace(title, '\s+', ' ', 'g')) <> title AS title_tidied FROM pg)"""
KINDS = ("host_fixed", "tail_cut", "slash_cut", "title_tidied")


def repaired_pages(spark, d):
    return links.repaired(read(spark, d), "page_id", F.col("url"), F.col("title"))


@query(_REPAIRED + " SELECT page_id, fixed AS url, tidy AS title, host_fixed, tail_cut, slash_cut, title_tidied FROM rp")
def a27_repaired_rows(spark, d):
    return repaired_pages(spark, d)


@query(_REPAIRED + " SELECT count_if(host_fixed) AS host_fixed, count_if(tail_cut) AS tail_cut, count_if(slash_cut) AS slash_cut, count_if(title_tidied) AS title_tidied, count_if(host_fixed OR tail_cut OR slash_cut OR title_tidied) AS changed FROM rp")
def a27_metadata_repair(spark, d):
    return links.repairs(repaired_pages(spark, d), KINDS)


@query("WITH " + _READ + """, f AS (SELECT host, count(*) AS pages, count_if(page_id % 4 = 0) AS existing, count_if(page_id % 4 <> 0) AS fresh, count_if(number = '' AND contains(url, '?')) AS unreadable, count_if(NOT starts_with(url, 'https://')) AS unsafe FROM pg GROUP BY host)
SELECT host, pages, existing, fresh, unreadable + unsafe AS failures, concat_ws(';', CASE WHEN unreadable > 0 THEN 'unreadable=' || unreadable END, CASE WHEN unsafe > 0 THEN 'unsafe=' || unsafe END) AS why FROM f""")
def a31_discovery_report(spark, d):
    """Candidates of each host that are new or known, and what failed."""
    pages = read(spark, d)
    kinds = {"unreadable": (F.col("number") == "") & F.col("url").contains("?"), "unsafe": ~F.col("url").startswith("https://")}
    g = pages.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("page_id") % 4 == 0).alias("existing"), F.count_if(F.col("page_id") % 4 != 0).alias("fresh"), *[F.count_if(c).alias(k) for k, c in kinds.items()]
    )
    why = F.array_join(F.array_compact(F.array(*[F.when(F.col(k) > 0, F.concat(F.lit(f"{k}="), F.col(k).cast("string"))) for k in kinds])), ";")
    return g.select("host", "pages", "existing", "fresh", sum((F.col(k) for k in kinds), F.lit(0)).alias("failures"), why.alias("why"))


def sectioned(spark, d):
    return html.sections(table(spark, d, "pages")).join(table(spark, d, "pages").select("page_id", "url"), "page_id")


_PLAIN = "replace(replace(replace(replace(replace(trim(regexp_replace({}, '\\s+', ' ', 'g')), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
_NAMES = (
    "lb AS (SELECT page_id, title, list_transform(range(1, len(hrefs) + 1), lambda i: coalesce(nullif(" + _PLAIN.format("labels[i]") + ", ''), hrefs[i])) AS names, hrefs FROM pg), "
    "el AS (SELECT page_id, title, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM lb)"
)


@query("WITH " + _READ + ", " + _NAMES + """ SELECT page_id, title, CASE WHEN contains(title, 'tion') THEN array_to_string(names, ',') ELSE '' END AS prerequisites, CASE WHEN contains(title, 'que') THEN array_to_string(names, ',') ELSE '' END AS followups FROM el""")
def s16_navigation(spark, d):
    """The pages' links stand before any heading, so in the section that the title names."""
    out = html.navigation(sectioned(spark, d), "page_id", {"version": ("Version:",)}, ("tion",), ("que",))
    return out.select("page_id", "title", F.array_join("prerequisites", ",").alias("prerequisites"), F.array_join("followups", ",").alias("followups"))


@query("WITH " + _READ + """, e AS (SELECT DISTINCT page_id, unnest(hrefs) AS h FROM pg WHERE host IN ('www.ththhe.example.org', 'therea.example.net', 'ththin.example.net')) SELECT page_id, count(*) AS n FROM e WHERE starts_with(h, '/') GROUP BY page_id""")
def s16_outbound(spark, d):
    """Links to allowed hosts; those of these pages lead to their own."""
    allowed = {h: ("/",) for h in ("www.ththhe.example.org", "therea.example.net", "ththin.example.net")}
    return html.outbound(sectioned(spark, d), "page_id", "url", allowed).groupBy("page_id").agg(F.count_distinct("href").alias("n"))


@query(r"""SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<h[123]>([^<]*)</h[123]>', 1)) AS h FROM pages) WHERE contains(h, 'tion') OR contains(h, 'que') GROUP BY page_id""")
def s16_headings(spark, d):
    return html.keyword_headings(sectioned(spark, d), "page_id", ("tion", "que")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH n AS (SELECT page_id, unnest(regexp_extract_all(html, '<div class="ad">([^<]*)</div>', 1)) AS t FROM pages) SELECT page_id, md5(""" + _PLAIN.format("t") + """) AS digest FROM n WHERE trim(t) <> ''""")
def s16_notices(spark, d):
    return html.notices(sectioned(spark, d), "page_id").select("page_id", F.md5("notice").alias("digest"))
