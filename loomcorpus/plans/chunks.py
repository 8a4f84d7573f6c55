"""Chunking of documents, and what is made from chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunking
from .registry import query, table


def chunks_of(spark, d):
    return chunking.chunk_documents(table(spark, d, "documents"), "doc_id", "text")


@query(r"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s)(?:.{1,300}\z|.{150,299}[。！？；，.,;]|.{300})'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)
SELECT doc_id, i AS position, length(l[i])::INT AS chars, md5(l[i]) AS digest FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM p)""")
def c1_split_long_units(spark, d):
    """Texts cut at 300 characters, after the last soft mark past the middle where there is one."""
    each = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.split_long_units(F.col("text"), 300)).alias("i", "x"))
    return each.select("doc_id", (F.col("i") + 1).cast("long").alias("position"), F.length("x").alias("chars"), F.md5("x").alias("digest"))


_MARKS = "。！？!?；;."
#: Units, then chunks as steps: where a chunk starts, what is new in it, whether what it shares is one too.
_CHUNKS = rf"""WITH RECURSIVE ln AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(regexp_split_to_array(text, '\r\n|[\n\r]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), 1) AS i FROM documents),
se AS (SELECT doc_id, i, CASE WHEN regexp_matches(line, '^(#|- |\* |• )') THEN [line] ELSE list_filter(list_transform(regexp_extract_all(line, '[^{_MARKS}]*[{_MARKS}]|[^{_MARKS}]+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS s FROM ln),
pc AS (SELECT doc_id, i, flatten(list_transform(s, lambda x: CASE WHEN length(x) <= 900 THEN [x] ELSE list_transform(regexp_extract_all(x, '(?s)\s*((?:.{{1,900}}\z|.{{450,899}}[。！？；，.,;]|.{{900}}))', 1), lambda y: regexp_replace(y, '^\s+|\s+$', '', 'g')) END)) AS s FROM se),
un AS (SELECT doc_id, flatten(list(s ORDER BY i)) AS u FROM pc GROUP BY doc_id),
d AS (SELECT doc_id, u, len(u) AS n, list_prepend(0, list_transform(range(1, len(u) + 1), lambda k: length(array_to_string(u[1:k], chr(10))) + 1)) AS j, list_prepend(0, list_transform(range(1, len(u) + 1), lambda k: length(array_to_string(u[1:k], '')))) AS p FROM un),
r AS (SELECT doc_id, 0 AS k, NULL::BIGINT AS s, NULL::BIGINT AS e, 0::BIGINT AS start, 0::BIGINT AS new, false AS again FROM d
  UNION ALL SELECT doc_id, k + 1, start, e, nxt, e, filled AND e < n AND j[e + 2] - j[nxt + 1] - 1 > 900 FROM (
    SELECT *, nd AS e, NOT again AND j[nd + 1] - j[start + 1] - 1 >= 700 AS filled, greatest(start, least(nd - 1, len(list_filter(p, lambda x: x < p[nd + 1] - 100)))) AS nxt FROM (
      SELECT r.doc_id, k, start, n, j, p, CASE WHEN again THEN new ELSE list_min(list_filter(range(new + 1, n + 1), lambda f: j[f + 1] - j[start + 1] - 1 >= 700 OR (f < n AND j[f + 2] - j[start + 1] - 1 > 900))) END AS nd, again
        FROM r JOIN d ON d.doc_id = r.doc_id WHERE again OR new < n) WHERE nd IS NOT NULL)),
f AS (SELECT doc_id, list(array_to_string(u[s + 1:e], chr(10)) ORDER BY k) FILTER (s IS NOT NULL) AS filled, array_to_string(any_value(u)[arg_max(start, k) + 1:], chr(10)) AS rest FROM r JOIN d USING (doc_id) GROUP BY doc_id),
t AS (SELECT doc_id, CASE WHEN rest = '' THEN filled WHEN filled IS NULL THEN [rest] WHEN length(rest) < 500 THEN CASE WHEN length(filled[-1]) + 1 + length(rest) <= 900 THEN list_append(filled[:-2], filled[-1] || chr(10) || rest) WHEN contains(filled[-1], rest) THEN filled ELSE list_append(filled, rest) END
  WHEN filled[-1] = rest THEN filled ELSE list_append(filled, rest) END AS l FROM f),
x AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS position FROM (SELECT doc_id, c, min(ix) AS ix FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS ix FROM t) GROUP BY doc_id, c))
"""


@query(_CHUNKS + "SELECT doc_id, position::INT AS position, length(c)::INT AS chars, md5(c) AS digest FROM x")
def c2_split_text(spark, d):
    return chunks_of(spark, d).select("doc_id", "position", F.length("chunk").alias("chars"), F.md5("chunk").alias("digest"))


_CATALOG = {"names": ("tion", "keit", "que"), "era": ("was", "war"), "universe": ("the", "der", "la")}
_HAS = ", ".join(f"array_to_string(list_filter([{', '.join(repr(t) for t in terms)}], lambda y: contains(c, y)), ',') AS {n}" for n, terms in _CATALOG.items())


@query(_CHUNKS + f"""SELECT 'chunk_' || substr(sha256(doc_id || ':' || position || ':' || md5(c)), 1, 20) AS chunk_id, doc_id, position::INT AS position, CASE source WHEN 'src0' THEN 'A' ELSE 'C' END AS tier, {_HAS}
FROM x JOIN documents USING (doc_id) WHERE n_chars >= 20 OR n_chars IS NULL""")
def c3_build_chunks(spark, d):
    """Chunks of accepted documents, with ids, tier, names and the era and universe they speak of."""
    docs = table(spark, d, "documents")
    status = F.when(F.col("n_chars") < 20, "rejected").otherwise("accepted")
    held = docs.select("doc_id", "text", "source", "lang", status.alias("status"))
    tier = F.when(F.col("source") == "src0", "A").otherwise("C")
    made = chunking.build_chunks(held, "doc_id", "text", tier, "status", _CATALOG)
    return made.select("chunk_id", "doc_id", "position", "tier", *[F.array_join(c, ",").alias(c) for c in _CATALOG])


@query("SELECT doc_id, 'web' AS origin FROM documents WHERE source <> 'src0' UNION ALL SELECT doc_id, 'manual' FROM documents WHERE source = 'src0'")
def o2_union_chunks(spark, d):
    docs = table(spark, d, "documents")
    web = docs.filter("source <> 'src0'").select("doc_id", F.lit("web").alias("origin"))
    return web.unionByName(docs.filter("source = 'src0'").select("doc_id", F.lit("manual").alias("origin")))
