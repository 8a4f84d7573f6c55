"""Tables keyed by customers, orders and users: snapshots, quotas, memory and feedback state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import stage
from ..operators import dialogue, keyed
from .registry import query, table


@query("""WITH n AS (SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_custkey % 10 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_custkey % 50 = 0)
SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, coalesce(n.c_name, c.c_name) AS c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal,
  n.c_custkey IS NOT NULL AND (c.c_custkey IS NULL OR n.c_acctbal <> c.c_acctbal) AS changed FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey""")
def s5_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    raised = F.col("c_acctbal") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)
    new = old.filter("c_custkey % 5 = 0").withColumn("c_acctbal", raised)
    more = old.filter("c_custkey % 50 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000)
    return keyed.upsert(old, new.unionByName(more), "c_custkey")


@query("""SELECT user_id, event_type, event_id, round(value, 2) AS value, created FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n,
  epoch(date_trunc('second', min(ts) OVER (PARTITION BY user_id, event_type)))::BIGINT AS created FROM events) WHERE n = 1""")
def s6_latest_wins(spark, d):
    df = table(spark, d, "events").withColumn("created", F.unix_timestamp("ts"))
    out = keyed.latest(df, ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()], {"created": "ts"})
    return out.select("user_id", "event_type", "event_id", F.round("value", 2).alias("value"), "created")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error') GROUP BY user_id")
def s7_insert_if_absent(spark, d):
    e = table(spark, d, "events")
    known = e.filter("event_type = 'error'").select("user_id").distinct()
    return keyed.insert_if_absent(e.filter("event_type = 'signup'"), known, "user_id", "event_id").select("user_id", "event_id")


@query("SELECT user_id, min(event_id) AS event_id FROM events WHERE event_type = 'signup' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND event_id % 50 = 0) GROUP BY user_id")
def s7_insert_of_some(spark, d):
    """Signups of the users that the target, one in fifty of the errors, doesn't have."""
    e = table(spark, d, "events")
    known = e.filter("event_type = 'error' AND event_id % 50 = 0").select("user_id").distinct()
    return keyed.insert_if_absent(e.filter("event_type = 'signup'"), known, "user_id", "event_id").select("user_id", "event_id")


@query("""SELECT event_id, over FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, ts DESC, event_id) > 30 AS over FROM events)""")
def f10_cap_per_type(spark, d):
    out = keyed.cap_per_key(table(spark, d, "events"), "user_id", 30, [F.col("value").desc(), F.col("ts").desc(), F.col("event_id")])
    return out.select("event_id", F.col("over_cap").alias("over"))


@query("""WITH v AS (SELECT DISTINCT user_id, ts::DATE AS day FROM events WHERE event_type IN ('purchase', 'signup')), i AS (SELECT *, day - (row_number() OVER (PARTITION BY user_id ORDER BY day))::INT AS isl FROM v)
SELECT user_id, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS days FROM i GROUP BY user_id, isl""")
def f11_visit_streaks(spark, d):
    visits = table(spark, d, "events").filter("event_type IN ('purchase', 'signup')").select("user_id", F.to_date("ts").alias("date"))
    out = dialogue.streaks(visits, "user_id", "date")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("""SELECT user_id, count_if(event_type = 'view') AS likes, count_if(event_type = 'error') AS errors, count(*) AS total, round(100.0 * count_if(event_type = 'view') / count(*), 1)::DOUBLE AS satisfaction,
  string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC) FILTER (n <= 5) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) GROUP BY user_id""")
def a15_feedback_stats(spark, d):
    e = table(spark, d, "events")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    is_view, total = F.count_if(F.col("event_type") == "view"), F.count(F.lit(1))
    late = F.sort_array(F.collect_list(F.when(F.col("n") <= 5, F.struct("n", F.col("event_id").cast("string").alias("e")))))
    return e.withColumn("n", n).groupBy("user_id").agg(
        is_view.alias("likes"), F.count_if(F.col("event_type") == "error").alias("errors"), total.alias("total"),
        F.round(100.0 * is_view / total, 1).alias("satisfaction"), F.array_join(late["e"], ",").alias("recent"),
    )


@query("""SELECT quality, round(avg(toxic), 1)::DOUBLE AS toxic, count(*) AS n, max(doc_id) AS latest, arg_max(toxic, doc_id) AS latest_toxic FROM labels GROUP BY quality""")
def a16_score_averages(spark, d):
    return table(spark, d, "labels").groupBy("quality").agg(
        F.round(F.avg("toxic"), 1).alias("toxic"), F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("latest"), F.max_by("toxic", "doc_id").alias("latest_toxic")
    )


@query("""WITH n AS (SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'pages', count(*) FROM pages)
SELECT *, CASE WHEN s >= 100000 THEN 'close' WHEN s >= 1000 THEN 'known' ELSE 'new' END AS stage FROM n, (SELECT count_if(event_type = 'signup') AS pending, floor(sum(value))::BIGINT AS s, max(ts)::VARCHAR AS last FROM events)""".replace("SELECT *, CASE", "SELECT name, n, pending, s AS score, CASE").replace(", max(ts)::VARCHAR AS last", ""))
def a17_db_stats(spark, d):
    """Rows of each table, and beside them the state: what is pending, the score and its stage."""
    names = ("documents", "conversations", "events", "labels", "pages")
    counts = reduce(DataFrame.unionByName, [table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name in names])
    state = table(spark, d, "events").agg(F.count_if(F.col("event_type") == "signup").alias("pending"), F.floor(F.sum("value")).alias("score")).first()
    level = stage(F.lit(state["score"]), ((0, "new"), (1000, "known"), (100_000, "close")))
    return counts.select("name", "n", F.lit(state["pending"]).alias("pending"), F.lit(state["score"]).alias("score"), level.alias("stage"))


_LOG = """WITH l AS (SELECT user_id, event_type, event_id AS seq, (value::INT % 5 + 1) AS importance, event_id % 7 AS source, event_type = 'error' AND event_id % 4 = 0 AS deleted, event_id % 3 = 0 AS confirmed, event_id % 100 AS memory FROM events),
d AS (SELECT user_id, memory, max(seq) FILTER (deleted) AS gone FROM l GROUP BY ALL),
a AS (SELECT l.*, gone, min(seq) FILTER (confirmed) OVER (PARTITION BY l.user_id, l.memory) AS since FROM l JOIN d USING (user_id, memory) WHERE gone IS NULL OR seq > gone),
k AS (SELECT user_id, memory, max(importance) AS importance, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, max(seq) AS updated FROM a WHERE gone IS NULL OR seq >= since GROUP BY ALL)
"""


def memory_log(spark, d):
    """The events as a log of memory events."""
    return table(spark, d, "events").select(
        "user_id", F.col("event_id").alias("seq"), (F.round("value").cast("int") % 5 + 1).alias("importance"), (F.col("event_id") % 7).alias("source"),
        ((F.col("event_type") == "error") & (F.col("event_id") % 4 == 0)).alias("deleted"), (F.col("event_id") % 3 == 0).alias("confirmed"),
        (F.col("event_id") % 100).alias("memory"),
    )


def memories(spark, d):
    return dialogue.merge_memories(memory_log(spark, d), ["user_id", "memory"], "seq", "deleted", "confirmed")


@query(_LOG.replace("value::INT % 5", "round(value)::INT % 5") + """SELECT user_id, memory, importance, sources, updated, 'active' AS status FROM k
UNION ALL SELECT user_id, memory, NULL, NULL, NULL, 'deleted' FROM d WHERE gone IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = d.user_id AND k.memory = d.memory)""")
def a18_memory_merge(spark, d):
    return memories(spark, d).withColumn("sources", F.array_join("sources", ","))


@query("""SELECT DISTINCT user_id, unnest(range(0, event_id % 4)) AS message FROM events WHERE event_type = 'error'""")
def a19_deleted_exclusions(spark, d):
    ids = F.to_json(F.when(F.col("event_id") % 4 > 0, F.sequence(F.lit(0), F.col("event_id") % 4 - 1)).otherwise(F.array().cast("array<bigint>")))
    stored = table(spark, d, "events").filter("event_type = 'error'").select("user_id", ids.alias("ids"))
    return stored.select("user_id", F.explode(F.from_json("ids", "array<bigint>")).alias("message")).distinct()


@query("""WITH m AS (SELECT user_id, event_type, props, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events WHERE event_type <> 'error'),
b AS (SELECT user_id, event_type, string_agg('- ' || props, chr(10) ORDER BY event_id) AS body FROM m WHERE k <= 30 GROUP BY user_id, event_type),
s AS (SELECT user_id, event_type, '[' || CASE event_type WHEN 'purchase' THEN 'Bought' WHEN 'signup' THEN 'Joined' WHEN 'view' THEN 'Seen' ELSE 'Clicked' END || ']' || chr(10) || body AS t FROM b),
o AS (SELECT unnest(['signup', 'purchase', 'view', 'click']) AS event_type, unnest([1, 2, 3, 4]) AS place)
SELECT u.user_id, coalesce(d.digest, '(nothing yet)') AS digest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, string_agg(t, chr(10) || chr(10) ORDER BY place) AS digest FROM s JOIN o USING (event_type) GROUP BY 1) d USING (user_id)""")
def a28_memory_digest(spark, d):
    """Each user's memories as sections in a fixed order, the last thirty of a kind as lines."""
    events = table(spark, d, "events")
    titles = {"signup": "Joined", "purchase": "Bought", "view": "Seen", "click": "Clicked"}
    kept = events.filter("event_type <> 'error'").select("user_id", F.col("event_type").alias("kind"), F.col("event_id").alias("at"), F.col("props").alias("content"))
    return dialogue.digests(events.select("user_id").distinct(), kept, "user_id", titles, 30, "(nothing yet)")


@query("""SELECT r.id AS event_id, CASE WHEN e.event_id IS NULL THEN 'not_found' WHEN e.event_type = 'error' THEN 'already_deleted' ELSE 'deleted' END AS outcome
FROM (SELECT event_id * 3 AS id FROM events) r LEFT JOIN events e ON e.event_id = r.id""")
def j19_apply_deletes(spark, d):
    e = table(spark, d, "events")
    state = e.select("event_id", (F.col("event_type") == "error").alias("deleted"))
    return dialogue.apply_deletes(e.select((F.col("event_id") * 3).alias("event_id")), state, "event_id")


@query("""WITH l AS (SELECT user_id, event_id AS seq, CASE event_type WHEN 'signup' THEN 'create' WHEN 'click' THEN 'edit' WHEN 'view' THEN 'edit' WHEN 'purchase' THEN 'confirm' ELSE 'reject' END AS action, value::VARCHAR AS content FROM events),
e AS (SELECT user_id, min(seq) FILTER (action IN ('confirm', 'reject')) AS stop FROM l GROUP BY 1)
SELECT user_id, CASE max(CASE WHEN seq = stop THEN action END) WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' ELSE 'pending' END AS status,
  (arg_max(seq, seq) FILTER (action IN ('create', 'edit')))::BIGINT AS content FROM l JOIN e USING (user_id) WHERE stop IS NULL OR seq <= stop GROUP BY user_id""")
def j20_pending_transitions(spark, d):
    kind = F.col("event_type")
    action = F.when(kind == "signup", "create").when(kind.isin("click", "view"), "edit").when(kind == "purchase", "confirm").otherwise("reject")
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), action.alias("action"), F.col("event_id").alias("content"))
    return dialogue.transitions(log, "user_id", "seq", "action", "content")


@query("""WITH q AS (SELECT unnest(['P', 'F', 'O']) AS s, unnest([5, 10, 7]) AS quota, unnest([2, 1, 3]) AS pr),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
p AS (SELECT *, row_number() OVER (ORDER BY pr, rank, o_totalprice DESC, o_orderkey) AS n FROM r JOIN q ON s = o_orderstatus AND rank <= quota)
SELECT o_orderkey, o_orderstatus, rank::INT AS rank FROM p WHERE n <= 18""")
def f4_quota_topn(spark, d):
    quotas = spark.createDataFrame([("P", 5, 2), ("F", 10, 1), ("O", 7, 3)], "o_orderstatus string, quota int, priority int")
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return keyed.quota(table(spark, d, "orders"), "o_orderstatus", quotas, order, 18).select("o_orderkey", "o_orderstatus", "rank")


@query("""WITH t AS (SELECT unnest(['1-URGENT', '2-HIGH', '5-LOW']) AS g, unnest([4, 2, 1]) AS target, unnest([2, 1, 3]) AS pr),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), x AS (SELECT o_orderkey, o_totalprice, coalesce(k <= target + 10, false) AS reserved, pr, k FROM r LEFT JOIN t ON g = o_orderpriority),
n AS (SELECT *, row_number() OVER (ORDER BY reserved DESC, CASE WHEN reserved THEN pr END, CASE WHEN reserved THEN k END, o_totalprice DESC, o_orderkey) AS n FROM x) SELECT o_orderkey, reserved FROM n WHERE n <= 60""")
def f5_reserve_then_fill(spark, d):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    targets = spark.createDataFrame([("1-URGENT", 4, 2), ("2-HIGH", 2, 1), ("5-LOW", 1, 3)], "o_orderpriority string, target int, priority int")
    return keyed.reserve_then_fill(table(spark, d, "orders"), "o_orderpriority", targets, 10, 60, order, order).select("o_orderkey", "reserved")


@query("""WITH c AS (SELECT o_orderpriority AS g, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), t AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '9-NONE']) AS g, unnest([10, 100000, 50, 7]) AS target)
SELECT t.g AS group_id, coalesce(n, 0) AS have, target, greatest(0, target - coalesce(n, 0)) AS remaining, CASE WHEN coalesce(n, 0) >= target THEN 'satisfied' ELSE 'gap' END AS status FROM t LEFT JOIN c USING (g)""")
def a12_group_gap(spark, d):
    targets = spark.createDataFrame([("1-URGENT", 10), ("2-HIGH", 100000), ("3-MEDIUM", 50), ("9-NONE", 7)], "group_id string, target int")
    have = table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("group_id")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return targets.join(have, "group_id", "left").select(
        "group_id", n.alias("have"), "target", F.greatest(F.lit(0), F.col("target") - n).alias("remaining"), F.when(n >= F.col("target"), "satisfied").otherwise("gap").alias("status")
    )


@query("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'O'")
def j4_inner_join(spark, d):
    orders = table(spark, d, "orders").filter("o_orderstatus <> 'O'").select("o_orderkey", "o_orderstatus")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_orderstatus")


@query("""SELECT n_nationkey, n_name, coalesce(c.customers, '') AS customers, coalesce(s.suppliers, '') AS suppliers FROM nation
LEFT JOIN (SELECT c_nationkey, string_agg(c_mktsegment, ',' ORDER BY c_mktsegment) AS customers FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, string_agg(s_name, ',' ORDER BY s_name) AS suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def j16_navigation_rollup(spark, d):
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("customers"))
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("suppliers"))
    n = table(spark, d, "nation")
    out = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").join(s, n["n_nationkey"] == s["s_nationkey"], "left")
    none = F.lit("")
    return out.select("n_nationkey", "n_name", F.coalesce("customers", none).alias("customers"), F.coalesce("suppliers", none).alias("suppliers"))


@query("""SELECT c_custkey, concat_ws('；', CASE WHEN c_custkey % 2 = 0 THEN 'name: ' || c_name END, CASE WHEN c_custkey % 3 <> 0 THEN 'segment: ' || c_mktsegment END) AS profile FROM customer""")
def o4_fields_minus_excluded(spark, d):
    key = F.col("c_custkey")
    fields = F.concat_ws("；", F.when(key % 2 == 0, F.concat(F.lit("name: "), "c_name")), F.when(key % 3 != 0, F.concat(F.lit("segment: "), "c_mktsegment")))
    return table(spark, d, "customer").select("c_custkey", fields.alias("profile"))


@query("""SELECT c_custkey, kind, content FROM (SELECT c_custkey, 'name' AS kind, c_name AS content, true AS ok FROM customer UNION ALL SELECT c_custkey, 'segment', c_mktsegment, c_custkey % 2 = 0 FROM customer
UNION ALL SELECT c_custkey, 'balance', 'rich', c_acctbal > 5000 FROM customer) WHERE ok AND c_custkey % 4 <> 0""")
def c18_profile_candidates(spark, d):
    row = lambda kind, content: F.struct(F.lit(kind).alias("kind"), content.alias("content"))
    made = F.array_compact(F.array(
        row("name", F.col("c_name")), F.when(F.col("c_custkey") % 2 == 0, row("segment", F.col("c_mktsegment"))),
        F.when(F.col("c_acctbal") > 5000, row("balance", F.lit("rich"))),
    ))
    consented = table(spark, d, "customer").filter("c_custkey % 4 <> 0")
    return consented.select("c_custkey", F.explode(made).alias("m")).select("c_custkey", "m.kind", "m.content")


@query("""WITH v AS (SELECT user_id, arg_max(event_type, event_id) AS access, bool_or(event_type = 'view') AS has_subtitles FROM events GROUP BY 1), c AS (SELECT user_id, count(*) AS pending FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT access, count(*) AS videos, count_if(has_subtitles) AS with_subtitles, count_if(pending IS NULL) AS without_chunks, sum(coalesce(pending, 0))::BIGINT AS pending_chunks FROM v LEFT JOIN c USING (user_id) GROUP BY access""")
def a33_media_audit(spark, d):
    """Users stand for videos: the last event is the access status, clicks are pending chunks."""
    e = table(spark, d, "events")
    videos = e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("access"), F.bool_or(F.col("event_type") == "view").alias("has_subtitles"))
    chunks = e.filter("event_type = 'click'").select("user_id")
    return dialogue.media_audit(videos, chunks, "user_id")


@query("""WITH v AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, count(*) AS pending FROM events WHERE event_type = 'click' GROUP BY 1) SELECT user_id, coalesce(pending, 0) AS pending FROM v LEFT JOIN c USING (user_id)""")
def a33_pending_chunks(spark, d):
    e = table(spark, d, "events")
    return dialogue.pending_chunks(e.select("user_id").distinct(), e.filter("event_type = 'click'").select("user_id"), "user_id")


@query("""SELECT user_id % 3 AS location, count_if(event_type = 'signup') AS pending, count_if(event_type = 'purchase') AS accepted, count_if(event_type NOT IN ('signup', 'purchase')) AS misplaced FROM events GROUP BY 1""")
def a34_inbox_review(spark, d):
    status = F.when(F.col("event_type") == "signup", "pending").when(F.col("event_type") == "purchase", "accepted").otherwise("misplaced")
    df = table(spark, d, "events").withColumns({"location": F.col("user_id") % 3, "status": status})
    return df.groupBy("location").pivot("status", ["pending", "accepted", "misplaced"]).count().na.fill(0)


@query("""WITH r AS (SELECT count(*) AS reviewed, count_if(quality = 1) AS matches, count_if(toxic = 1) AS critical FROM labels), b AS (SELECT count_if(contains(text, 'bulk accepted')) AS bulk, count_if(source = 'src3') AS main_documents, count(*) AS chunks, bool_and(source <> '') AS all_have_source, count_if(contains(lower(source || chr(10) || text), 'fixture')) AS fixtures FROM documents),
c AS (SELECT *, reviewed >= 10 AS enough_reviewed, matches >= 8 AS enough_matches, critical = 0 AS no_critical, main_documents >= 8 AS enough_documents, chunks >= 120 AS enough_chunks, fixtures = 0 AS no_fixtures, bulk = 0 AS compared_singly FROM r, b)
SELECT reviewed, matches, critical, main_documents, chunks, fixtures, bulk, concat_ws(';', CASE WHEN NOT enough_reviewed THEN 'enough_reviewed' END, CASE WHEN NOT enough_matches THEN 'enough_matches' END, CASE WHEN NOT no_critical THEN 'no_critical' END, CASE WHEN NOT enough_documents THEN 'enough_documents' END,
  CASE WHEN NOT enough_chunks THEN 'enough_chunks' END, CASE WHEN NOT all_have_source THEN 'all_have_source' END, CASE WHEN NOT no_fixtures THEN 'no_fixtures' END, CASE WHEN NOT compared_singly THEN 'compared_singly' END) AS unmet,
  enough_reviewed AND enough_matches AND no_critical AND enough_documents AND enough_chunks AND all_have_source AND no_fixtures AND compared_singly AS ready,
  CASE WHEN NOT compared_singly THEN 'accepted in bulk, not compared one by one' WHEN enough_reviewed AND enough_matches AND no_critical AND enough_documents AND enough_chunks AND all_have_source AND no_fixtures THEN 'all conditions are met' ELSE 'review or data are not complete' END AS reason FROM c""")
def a13_readiness_gate(spark, d):
    labels, docs = table(spark, d, "labels"), table(spark, d, "documents")
    reviews = labels.agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("quality") == 1).alias("matches"), F.count_if(F.col("toxic") == 1).alias("critical"))
    data = docs.agg(
        F.count_if(F.col("text").contains("bulk accepted")).alias("bulk"), F.count_if(F.col("source") == "src3").alias("main_documents"), F.count(F.lit(1)).alias("chunks"),
        F.every(F.col("source") != "").alias("all_have_source"), F.count_if(F.lower(F.concat("source", F.lit("\n"), "text")).contains("fixture")).alias("fixtures"),
    )
    return dialogue.readiness(reviews, data, reviewed=10, matches=8, documents=8, chunks=120)


@query("""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'thin' WHEN quality = 1 THEN 'usable' ELSE 'missing' END AS old, CASE WHEN quality = 1 THEN 'usable' ELSE 'missing' END AS new FROM labels)
SELECT doc_id, old, new, CASE WHEN new = 'missing' THEN 'collect' ELSE 'review' END AS action FROM b WHERE old <> new""")
def a32_status_drift(spark, d):
    new = F.when(F.col("quality") == 1, "usable").otherwise("missing")
    labels = table(spark, d, "labels").select("doc_id", new.alias("new"))
    baseline = labels.select(F.col("doc_id").alias("_d"), F.when(F.col("doc_id") % 3 == 0, "thin").otherwise(F.col("new")).alias("old"))
    out = labels.join(baseline, F.col("doc_id") == F.col("_d"), "left").filter(~F.col("new").eqNullSafe(F.col("old")))
    return out.select("doc_id", "old", "new", F.when(F.col("new") == "missing", "collect").otherwise("review").alias("action"))
