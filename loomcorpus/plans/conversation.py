"""Conversations as dialogue and chat history."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.rules import stage
from ..functions.urls import stable_id
from ..operators import chunking, dialogue
from ..sources.html import dialogue_turns
from .registry import query, table


def turns_of(spark, d):
    """Turns of users and assistants; system turns are no part of a chat."""
    return table(spark, d, "conversations").filter("role IN ('user', 'assistant')")


_T = "t AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant'))"
LABELS = {"user": "玩家", "assistant": "角色"}


@query(f"""WITH {_T}, e AS (SELECT *, contains(text, 'less') AS ex FROM t),
s AS (SELECT *, coalesce(last_value(CASE WHEN ex THEN role = 'user' WHEN role = 'user' THEN false END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND role <> 'user' AS hidden FROM e),
v AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM s WHERE NOT ex AND NOT hidden)
SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN '玩家' ELSE '角色' END || '：' || text, chr(10) ORDER BY turn) AS transcript FROM v WHERE n <= 4 GROUP BY conv_id""")
def f9_prompt_history(spark, d):
    seen = dialogue.visible_history(turns_of(spark, d), F.col("text").contains("less"), "conv_id", "turn", 2, LABELS)
    return dialogue.rendered(seen, "conv_id", "turn")


_SCORE = f"""WITH {_T}, l AS (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS reply FROM t),
s AS (SELECT conv_id, turn, text, least(100, 20 + sum(1 + CASE WHEN contains(text, 'tion') OR contains(text, 'que') THEN 2 ELSE 0 END + CASE WHEN contains(text, 'he') AND contains(coalesce(reply, ''), 'the') THEN 1 ELSE 0 END)
  OVER (PARTITION BY conv_id ORDER BY turn))::INT AS score FROM l WHERE role = 'user')
"""


def scored(spark, d):
    return dialogue.engagement(turns_of(spark, d), "conv_id", "turn", positive=("tion", "que"), low=("he",), comfort=("the",))


@query(_SCORE + "SELECT conv_id, turn, score FROM s")
def f12_engagement_score(spark, d):
    return scored(spark, d).select("conv_id", "turn", "score")


@query(f"""WITH {_T} SELECT conv_id, turn, last_value(CASE WHEN length(text) > 20 AND (contains(text, 'less') OR contains(text, 'tion')) THEN substr(text, 1, 120) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS important FROM t WHERE role = 'user'""")
def f13_last_important(spark, d):
    users = turns_of(spark, d).filter("role = 'user'")
    return dialogue.last_important(users, "conv_id", "turn", ("less", "tion")).select("conv_id", "turn", "important")


@query(_SCORE + ", m AS (SELECT conv_id, turn, unnest([21, 23, 25, 28]) AS threshold, score FROM s) SELECT conv_id, threshold, min(turn) AS first FROM m WHERE score >= threshold GROUP BY ALL")
def f14_milestones(spark, d):
    return dialogue.milestones(scored(spark, d), "conv_id", "turn", (21, 23, 25, 28))


@query(f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t) SELECT conv_id, turn FROM r WHERE n <= 3")
def f15_first_turns(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns_of(spark, d).withColumn("n", n).filter("n <= 3").select("conv_id", "turn")


@query(f"WITH {_T} SELECT conv_id, turn FROM t WHERE NOT (role = 'assistant' AND turn = (SELECT max(turn) FROM t u WHERE u.conv_id = t.conv_id AND u.role = 'assistant'))")
def f16_drop_last_reply(spark, d):
    turns = turns_of(spark, d)
    last = turns.filter("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return turns.join(last, ["conv_id", "turn"], "left_anti").select("conv_id", "turn")


@query(f"WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM t WHERE role = 'user') SELECT conv_id, turn FROM r WHERE n % 2 = 0")
def f17_every_n_turns(spark, d):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns_of(spark, d).filter("role = 'user'").withColumn("n", n).filter("n % 2 = 0").select("conv_id", "turn")


@query("""WITH l AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations)
SELECT conv_id, role AS source, target, max(turn) AS evidence FROM l WHERE target IS NOT NULL AND target <> role GROUP BY ALL""")
def f18_speaks_to(spark, d):
    return dialogue.adjacency(table(spark, d, "conversations"), "conv_id", "turn", "role")


_CLEAN = r"""l AS (SELECT conv_id, turn, list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[\t\f\v ]+', ' ', 'g'))), lambda x: x <> '') AS a FROM {cues}),
cl AS (SELECT conv_id, turn, array_to_string(list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]), chr(10)) AS content FROM l)"""


@query("WITH cues AS (SELECT conv_id, turn * 2 + i AS turn, CASE WHEN i = 1 AND turn % 2 = 0 THEN '[sound]' ELSE replace(text, 'the', '&lt;&amp;') END AS text FROM conversations, range(0, 2) r(i)), "
       + _CLEAN.format(cues="(SELECT conv_id, turn, replace(text, '&lt;&amp;', '<&') AS text FROM cues)")
       + ", k AS (SELECT *, lag(content) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM cl WHERE content <> '' AND NOT regexp_matches(content, '^\\[[a-z]+\\]$')) SELECT conv_id, turn, md5(content) AS digest FROM k WHERE before IS NULL OR content <> before")
def f19_clean_cues(spark, d):
    """Each turn as two cues, the second a sound or the same again, with signs by name."""
    cue = F.when((F.col("i") == 1) & (F.col("turn") % 2 == 0), "[sound]").otherwise(F.replace("text", F.lit("the"), F.lit("&lt;&amp;")))
    twice = table(spark, d, "conversations").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(1))))
    cues = twice.select("conv_id", (F.col("turn") * 2 + F.col("i")).alias("turn"), cue.alias("content"))
    return dialogue.cleaned_cues(cues, "conv_id", "turn", "content", r"^\[[a-z]+\]$").select("conv_id", "turn", F.md5("content").alias("digest"))


@query(f"""WITH {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t)
SELECT conv_id, string_agg(role || '：' || text, chr(10) ORDER BY turn) AS transcript FROM r WHERE n <= 40 GROUP BY conv_id HAVING count(*) >= 2""")
def f22_recent_transcript(spark, d):
    recent = dialogue.visible_history(turns_of(spark, d), F.lit(False), "conv_id", "turn", 20, {})
    return dialogue.rendered(recent, "conv_id", "turn", least=2)


@query("""SELECT conv_id, turn, i::INT AS line, regexp_extract(x, '^([^：:\\n]{1,30})[：:](.*)$', 1) AS speaker, regexp_extract(x, '^([^：:\\n]{1,30})[：:](.*)$', 2) AS said
FROM (SELECT conv_id, turn, unnest(string_split(role || '：' || text, chr(10))) AS x, generate_subscripts(string_split(role || '：' || text, chr(10)), 1) - 1 AS i FROM conversations) WHERE regexp_matches(x, '^[^：:\\n]{1,30}[：:]')""")
def s15_dialogue_lines(spark, d):
    whole = F.concat(F.col("role"), F.lit("："), F.col("text"))
    each = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(whole, "\n")).alias("line", "x"))
    pattern = r"^([^：:\n]{1,30})[：:](.*)$"
    hit = each.filter(F.col("x").rlike(pattern))
    return hit.select("conv_id", "turn", "line", F.regexp_extract("x", pattern, 1).alias("speaker"), F.regexp_extract("x", pattern, 2).alias("said"))


@query(r"""WITH t AS (SELECT conv_id, turn, role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS said FROM conversations)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn, CASE WHEN role <> 'system' THEN role END AS speaker, CASE WHEN role = 'system' THEN 'narration' ELSE 'dialogue' END AS kind, said FROM t WHERE said <> ''""")
def s15_dialogue_markup(spark, d):
    """Conversations as pages: a stage of lines with actor and content, or paragraphs with labels."""
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    line = F.concat(F.lit('<div class="dialog-line x"><b class="dialog-actor">'), F.col("role"), F.lit('：</b><p class="dialog-content">'), said, F.lit("</p></div>"))
    label = F.concat(F.lit("<p>"), F.col("role"), F.lit("："), F.regexp_replace(said, r"\s+", " "), F.lit("</p>"))
    held = table(spark, d, "conversations").withColumn("part", F.when(F.col("conv_id") % 3 > 0, line).otherwise(label))
    lines = F.array_join(F.sort_array(F.collect_list(F.struct("turn", "part")))["part"], "\n")
    page = F.when(F.col("conv_id") % 3 > 0, F.concat(F.lit('<p>aside: no turn</p><section class="stage">'), lines, F.lit("</section>"))).otherwise(F.concat(F.lit("<main>"), lines, F.lit("<p>nothing that is said by anyone</p></main>")))
    pages = held.groupBy("conv_id").agg(page.alias("html"))
    return dialogue_turns(pages, "conv_id", narrators=("system",))


@query("""SELECT conv_id, count(*) AS turns, max(turn) + 1 = count(*) AND min(turn) = 0 AS complete, count(*) - count(DISTINCT turn) AS duplicates, bool_and(length(text) > 0 AND role IN ('user', 'assistant', 'system')) AS valid
FROM conversations GROUP BY conv_id""")
def a5_structural_gate(spark, d):
    n = F.count(F.lit(1))
    good = (F.length("text") > 0) & F.col("role").isin("user", "assistant", "system")
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        n.alias("turns"), ((F.max("turn") + 1 == n) & (F.min("turn") == 0)).alias("complete"),
        (n - F.count_distinct("turn")).alias("duplicates"), F.every(good).alias("valid"),
    )


@query("""WITH s AS (SELECT role AS speaker, count(*) AS n FROM (SELECT CASE WHEN turn % 3 = 0 THEN role || '2' ELSE role END AS role FROM conversations) GROUP BY 1)
SELECT r.root, s.speaker, s.n FROM (SELECT unnest(['user', 'assistant']) AS root) r JOIN s ON contains(s.speaker, r.root) AND s.speaker <> r.root""")
def a26_speaker_variants(spark, d):
    named = F.when(F.col("turn") % 3 == 0, F.concat("role", F.lit("2"))).otherwise(F.col("role"))
    speakers = table(spark, d, "conversations").groupBy(named.alias("speaker")).agg(F.count(F.lit(1)).alias("n"))
    roots = spark.createDataFrame([("user",), ("assistant",)], "root string")
    found = F.col("speaker").contains(F.col("root")) & (F.col("speaker") != F.col("root"))
    return F.broadcast(roots).join(speakers, found).select("root", "speaker", "n")


@query(f"""WITH {_T} SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS day_text, count(*) AS n FROM t GROUP BY conv_id HAVING count(*) >= 2""")
def a29_daily_rollup(spark, d):
    row = F.sort_array(F.collect_list(F.struct("turn", "text")))
    g = turns_of(spark, d).groupBy("conv_id").agg(row.alias("r"), F.count(F.lit(1)).alias("n")).filter("n >= 2")
    return g.select("conv_id", F.array_join("r.text", "\n").alias("day_text"), "n")


#: A title names who speaks and of whom, as its first two words; "la" and "the" stand for oneself.
ABOUT, ITSELF = r"^(\p{L}+) (\p{L}+)", "la"


@query(r"""WITH l AS (SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS target FROM conversations WHERE role <> 'system'),
st AS (SELECT conv_id, 'SPEAKS_TO' AS relation, role AS source, target FROM l WHERE target IS NOT NULL AND target <> role GROUP BY ALL),
sp AS (SELECT DISTINCT conv_id, role FROM conversations WHERE role <> 'system'),
aw AS (SELECT a.conv_id, 'APPEARS_WITH' AS relation, a.role AS source, b.role AS target FROM sp a JOIN sp b ON a.conv_id = b.conv_id AND a.role < b.role),
ti AS (SELECT conv_id, split_part(arg_min(text, turn), chr(10), 1) AS title FROM conversations GROUP BY 1),
sa AS (SELECT conv_id, 'SPEAKS_ABOUT' AS relation, regexp_extract(title, '^(\p{L}+) (\p{L}+)', 1) AS source, CASE regexp_extract(title, '^(\p{L}+) (\p{L}+)', 2) WHEN 'la' THEN regexp_extract(title, '^(\p{L}+) (\p{L}+)', 1) ELSE regexp_extract(title, '^(\p{L}+) (\p{L}+)', 2) END AS target
  FROM ti WHERE regexp_matches(title, '^(\p{L}+) (\p{L}+)')),
u AS (SELECT * FROM st UNION ALL SELECT * FROM aw UNION ALL SELECT * FROM sa)
SELECT conv_id, relation, source, target, 'edge_' || substr(sha256(concat_ws('|', conv_id::VARCHAR, relation, source, target)), 1, 20) AS edge_id FROM u""")
def c6_dialogue_edges(spark, d):
    """The first line of a conversation is its title."""
    turns = table(spark, d, "conversations")
    titles = turns.groupBy("conv_id").agg(F.substring_index(F.min_by("text", "turn"), "\n", 1).alias("title"))
    edges = dialogue.evidence_edges(turns.filter("role <> 'system'"), titles, "conv_id", "turn", "role", ABOUT, ITSELF)
    return edges.withColumn("edge_id", stable_id("edge", F.concat_ws("|", F.col("conv_id").cast("string"), "relation", "source", "target")))


NAMES = ("the", "der", "des", "que", "la", "of", "and", "tion", "und", "le")
PATTERNS = tuple(
    dialogue.Assertion(*x)
    for x in (
        ("MEMBER_OF", r"(?: is| of) ", 0.82, r"(?: of)?"), ("MEMBER_OF", " to ", 0.78), ("ALIAS_OF", r"(?: en| et) ", 0.85), ("PARTICIPATED_IN", r" in(?: a| it)? ", 0.8),
        ("CREATED_BY", r" (?:by|from) ", 0.82), ("LEADER_OF", r" (?:was|are) ", 0.82, r"(?: that| in)?"), ("FRIEND_OF", " with ", 0.78), ("TRUSTS", " de ", 0.76), ("KNOWS", " ", 0.72),
    )
)
DOUBTS = ("?", " or ", " if ")


def _assertions_sql() -> str:
    either = "|".join(sorted(NAMES, key=lambda n: (-len(n), n)))
    parts = []
    for i, p in enumerate(PATTERNS):
        whole = f"({either}|he)(?:{p.cue})({either}){p.after}".replace("'", "''")
        parts.append(f"SELECT conv_id, turn, role, unnest(regexp_extract_all(text, '{whole}', 1)) AS source, '{p.relation}' AS relation, unnest(regexp_extract_all(text, '{whole}', 2)) AS target, {p.confidence}::DOUBLE AS confidence, {i} AS i FROM t")
    return ("WITH t AS (SELECT * FROM conversations WHERE role <> '' AND NOT (contains(text, '?') OR contains(text, ' or ') OR contains(text, ' if '))), m AS (" + " UNION ALL ".join(parts)
            + "), s AS (SELECT conv_id, turn, CASE WHEN source = 'he' THEN role ELSE source END AS source, relation, target, confidence FROM m) "
            "SELECT conv_id, turn, source, relation, target, count(*) > 0 AS found FROM s WHERE source <> target GROUP BY ALL")  # fmt: skip


@query(_assertions_sql().replace("relation, target, count(*) > 0 AS found", "relation, target, max(confidence) >= 0.7 AS sure"))
def c7_assertions(spark, d):
    """Nine patterns; "he" stands for the speaker."""
    out = dialogue.assertions(table(spark, d, "conversations"), "conv_id", "turn", "role", "text", NAMES, "he", PATTERNS, DOUBTS)
    return out.select("conv_id", "turn", "source", "relation", "target", (F.col("confidence") >= 0.7).alias("sure"))


_SIZES = "n AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS total, sum(length(text)) OVER (PARTITION BY conv_id) AS chars, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM conversations)"


@query(f"""WITH RECURSIVE {_SIZES},
e AS (SELECT s.conv_id, s.i AS s, min(x.i) + 1 AS e FROM n s JOIN n x ON s.conv_id = x.conv_id AND x.i >= s.i LEFT JOIN n y ON y.conv_id = x.conv_id AND y.i = x.i + 1
  WHERE x.i = x.total - 1 OR x.upto - s.upto + s.size >= 1000 OR (x.upto - s.upto + s.size >= 600 AND y.upto - s.upto + s.size > 1000) GROUP BY s.conv_id, s.i, s.total),
g AS (SELECT conv_id, 0 AS grp, 0::BIGINT AS s FROM n WHERE i = 0 UNION ALL SELECT g.conv_id, grp + 1, greatest(g.s + 1, e.e - 3) FROM g JOIN e ON e.conv_id = g.conv_id AND e.s = g.s JOIN n ON n.conv_id = g.conv_id AND n.i = 0 WHERE e.e < n.total AND n.chars >= 1200),
b AS (SELECT g.conv_id, grp, g.s, CASE WHEN n.chars < 1200 THEN n.total ELSE e.e END AS e FROM g JOIN e ON e.conv_id = g.conv_id AND e.s = g.s JOIN n ON n.conv_id = g.conv_id AND n.i = 0)
SELECT b.conv_id, grp AS "group", min(turn) AS first, max(turn) AS last, sum(size)::BIGINT AS chars FROM b JOIN n ON n.conv_id = b.conv_id AND n.i >= b.s AND n.i < b.e GROUP BY b.conv_id, grp""")
def c4_chunk_turns(spark, d):
    """Groups of 600 to 1000 characters with three turns in common, whole where under 1200."""
    turns = table(spark, d, "conversations")
    held = chunking.chunk_turns(turns, "conv_id", "turn", F.length("text"))
    return held.groupBy("conv_id", "group").agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.sum(F.length("text")).alias("chars"))


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role <> 'system'),
f AS (SELECT conv_id, turn, text, i, 0 AS grp, length(text) AS sum FROM n WHERE i = 1 UNION ALL SELECT n.conv_id, n.turn, n.text, n.i, CASE WHEN f.sum >= 450 THEN grp + 1 ELSE grp END, CASE WHEN f.sum >= 450 THEN 0 ELSE f.sum END + length(n.text) FROM f JOIN n ON n.conv_id = f.conv_id AND n.i = f.i + 1)
SELECT conv_id, grp AS "group", min(turn) * 5.0::DOUBLE AS start_seconds, max(turn) * 5.0::DOUBLE + 5 AS end_seconds, sum(length(text))::BIGINT AS chars, 'https://video.example/' || conv_id || '?t=' || (min(turn) * 5)::INT AS link, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest
FROM f WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1) GROUP BY conv_id, grp""")
def c5_chunk_cues(spark, d):
    """Turns as cues of five seconds each, flushed from 450 characters on, with a link to the first
    second. Conversations of one turn are of a tier that yields none."""
    turns = table(spark, d, "conversations")
    official = turns.groupBy("conv_id").agg((F.count(F.lit(1)) > 1).alias("good")).filter("good").select("conv_id")
    cues = turns.filter("role <> 'system'").join(official, "conv_id", "left_semi")
    held = chunking.chunk_cues(cues, "conv_id", "turn", F.length("text"))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("turn", "text")))["text"], "\n")
    start = F.min("turn") * 5
    return held.groupBy("conv_id", "group").agg(
        (start * 1.0).alias("start_seconds"), (F.max("turn") * 5.0 + 5).alias("end_seconds"), F.sum(F.length("text")).alias("chars"),
        F.concat(F.lit("https://video.example/"), F.first("conv_id").cast("string"), F.lit("?t="), start.cast("string")).alias("link"), F.md5(text).alias("digest"),
    )


@query("""WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'preference' WHEN turn % 3 = 1 THEN 'event' ELSE 'gossip' END AS kind, trim(text) AS content, greatest(1, least(5, coalesce(try_cast(substr(text, 1, 1) AS INT), 3))) AS importance FROM conversations WHERE role = 'assistant')
SELECT c.conv_id, c.turn, kind, importance FROM c JOIN u ON u.conv_id = c.conv_id AND u.turn = c.turn - 1 AND u.n <= 12 WHERE kind <> 'gossip' AND content <> ''""")
def c16_memory_candidates(spark, d):
    turns = table(spark, d, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    users = turns.filter("role = 'user'").withColumn("n", n).filter("n <= 12").select("conv_id", (F.col("turn") + 1).alias("turn"))
    kind = F.when(F.col("turn") % 3 == 0, "preference").when(F.col("turn") % 3 == 1, "event").otherwise("gossip")
    number = F.substring("text", 1, 1).try_cast("int")
    importance = F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(number, F.lit(3))))
    made = turns.filter("role = 'assistant'").select("conv_id", "turn", kind.alias("kind"), F.trim("text").alias("content"), importance.alias("importance"))
    good = made.filter("kind <> 'gossip' AND content <> ''")
    return good.join(users, ["conv_id", "turn"], "left_semi").select("conv_id", "turn", "kind", "importance")


@query("""SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id""")
def s8_backfill_json(spark, d):
    """Nested JSON rows, as another store would hand them over, back to long rows."""
    row = F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("messages")))
    nested = table(spark, d, "conversations").groupBy("conv_id").agg(row.alias("body"))
    parsed = F.from_json("body", "messages array<struct<turn:bigint,role:string,text:string>>")
    return nested.select("conv_id", F.explode(parsed["messages"]).alias("m")).groupBy("conv_id").agg(F.count("m.turn").alias("n"))


@query("""SELECT conv_id, turn, role || ' to ' || target AS pair, CASE WHEN s >= 300 THEN 'close' WHEN s >= 100 THEN 'known' ELSE 'new' END AS stage FROM (
  SELECT conv_id, turn, role, lead(role) OVER w AS target, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE target IS NOT NULL""")
def p12_stage_so_far(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    total = F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = table(spark, d, "conversations").withColumns({"target": F.lead("role").over(w), "s": total}).filter("target IS NOT NULL")
    level = stage(F.col("s"), ((0, "new"), (100, "known"), (300, "close")))
    return df.select("conv_id", "turn", F.concat("role", F.lit(" to "), "target").alias("pair"), level.alias("stage"))
