"""Conversations: history, state folded over turns, streaks, milestones, memory events."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import any_of
from ..functions.text import compact_text, unescape

_UP_TO = (Window.unboundedPreceding, 0)


def visible_history(turns: DataFrame, excluded: Column, key: str, order: str, keep: int, labels: dict[str, str]) -> DataFrame:
    """The last ``2 * keep`` turns of each key without excluded ones. An excluded user turn hides
    the replies after it up to the next user turn; an excluded reply ends the hiding."""
    setter = F.when(excluded, F.col("role") == "user").when(F.col("role") == "user", F.lit(False))
    so_far = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    hidden = F.coalesce(F.last(setter, ignorenulls=True).over(so_far), F.lit(False)) & (F.col("role") != "user")
    seen = turns.withColumn("_e", excluded).withColumn("_h", hidden).filter(~F.col("_e") & ~F.col("_h"))
    late = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc()))
    label = F.coalesce(*[F.when(F.col("role") == r, F.lit(x)) for r, x in labels.items()], F.col("role"))
    return seen.withColumn("_n", late).filter(F.col("_n") <= 2 * keep).withColumn("label", label).drop("_e", "_h", "_n")


def rendered(turns: DataFrame, key: str, order: str, least: int = 1) -> DataFrame:
    """One text of "label：text" lines for each key with at least so many turns."""
    row = F.struct(order, F.concat(F.col("label"), F.lit("："), F.col("text")).alias("t"))
    g = turns.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("_r"))
    return g.filter(F.size("_r") >= least).select(key, F.array_join("_r.t", "\n").alias("transcript"))


def engagement(turns: DataFrame, key: str, order: str, *, positive: Iterable[str], low: Iterable[str], comfort: Iterable[str], start: int = 20) -> DataFrame:
    """The score after each user turn: one point a turn, two for a positive one, one if a low one
    was answered with comfort; at most 100, which a running sum gives as no step is negative."""
    w = Window.partitionBy(key).orderBy(order)
    reply = F.lead("text").over(w)
    delta = (
        F.lit(1)
        + F.when(any_of(F.col("text"), positive), 2).otherwise(0)
        + F.when(any_of(F.col("text"), low) & any_of(F.coalesce(reply, F.lit("")), comfort), 1).otherwise(0)
    )
    user = turns.withColumn("_d", delta).filter("role = 'user'")
    score = F.least(F.lit(100), start + F.sum("_d").over(w.rowsBetween(*_UP_TO)))
    return user.withColumn("score", score.cast("int")).drop("_d")


def last_important(turns: DataFrame, key: str, order: str, words: Iterable[str], least: int = 20, cut: int = 120) -> DataFrame:
    """Each turn with the last one so far that is long and has a word that matters."""
    hit = F.when((F.length("text") > least) & any_of(F.col("text"), words), F.substring("text", 1, cut))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(*_UP_TO)
    return turns.withColumn("important", F.last(hit, ignorenulls=True).over(w))


def milestones(scored: DataFrame, key: str, order: str, thresholds: Sequence[int]) -> DataFrame:
    """The first place at which each key's score reaches each threshold."""
    steps = F.explode(F.array(*[F.lit(t) for t in thresholds]))
    reached = scored.withColumn("threshold", steps).filter("score >= threshold")
    return reached.groupBy(key, "threshold").agg(F.min(order).alias("first"))


def streaks(visits: DataFrame, key: str, day: str) -> DataFrame:
    """Runs of consecutive days of each key: first day, last day, length."""
    days = visits.select(key, F.col(day).alias("day")).distinct()
    island = F.date_sub("day", F.row_number().over(Window.partitionBy(key).orderBy("day")))
    runs = days.withColumn("_i", island).groupBy(key, "_i")
    return runs.agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("days")).drop("_i")


def merge_memories(events: DataFrame, keys: list[str], order: str, deleted: str, confirmed: str) -> DataFrame:
    """The state of memories from a log of events. What comes after a memory's last deletion counts
    only from its next confirmation on; of that, importance is the largest and sources the union."""
    by_time = Window.partitionBy(*keys).orderBy(order)
    log = events.withColumn("_d", F.max(F.when(F.col(deleted), F.col(order))).over(Window.partitionBy(*keys)))
    after = log.filter(F.col("_d").isNull() | (F.col(order) > F.col("_d")))
    since = F.min(F.when(F.col(confirmed), F.col(order))).over(Window.partitionBy(*keys))
    live = after.withColumn("_c", since).filter(F.col("_d").isNull() | (F.col(order) >= F.col("_c")))
    kept = live.groupBy(*keys).agg(
        F.max("importance").alias("importance"), F.array_sort(F.collect_set("source")).alias("sources"), F.max(order).alias("updated")
    )
    gone = events.filter(F.col(deleted)).select(*keys).distinct().join(kept.select(*keys), keys, "left_anti")
    return kept.withColumn("status", F.lit("active")).unionByName(gone.withColumn("status", F.lit("deleted")), allowMissingColumns=True)


def transitions(log: DataFrame, key: str, order: str, action: str, content: str) -> DataFrame:
    """Pending rows by key: the first terminal action decides, and the last edit before it is the
    content; later actions change nothing."""
    end = F.min(F.when(F.col(action).isin("confirm", "reject"), F.col(order))).over(Window.partitionBy(key))
    upto = log.withColumn("_e", end).filter(F.col("_e").isNull() | (F.col(order) <= F.col("_e")))
    last = F.struct(order, content)
    g = upto.groupBy(key).agg(
        F.max(F.when(F.col(action).isin("create", "edit"), last)).alias("_c"),
        F.max(F.when(F.col(order) == F.col("_e"), F.col(action))).alias("_a"),
    )
    status = F.when(F.col("_a") == "confirm", "confirmed").when(F.col("_a") == "reject", "rejected").otherwise("pending")
    return g.select(key, status.alias("status"), F.col("_c")[content].alias(content))


def apply_deletes(requests: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """What each request (key, scope) does to ``state`` (key, deleted): deleted, already_deleted or
    not_found."""
    s = state.select(F.col(key).alias("_k"), "deleted")
    out = requests.join(s, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_k").isNull(), "not_found").when(F.col("deleted"), "already_deleted").otherwise("deleted")
    return out.select(*requests.columns, status.alias("outcome"))


def adjacency(turns: DataFrame, key: str, order: str, speaker: str) -> DataFrame:
    """Who speaks to whom next, with the last place where that happened."""
    after = F.lead(speaker).over(Window.partitionBy(key).orderBy(order))
    pairs = turns.withColumn("target", after).filter(F.col("target").isNotNull() & (F.col("target") != F.col(speaker)))
    return pairs.groupBy(key, F.col(speaker).alias("source"), "target").agg(F.max(order).alias("evidence"))


def cleaned_cues(cues: DataFrame, key: str, order: str, content: str, sound: str) -> DataFrame:
    """Cues with single blanks and named signs as characters, without empty ones, sounds and direct
    repeats of the cue before."""
    body = compact_text(unescape(F.col(content)))
    real = cues.withColumn(content, body).filter((F.col(content) != "") & ~F.col(content).rlike(sound))
    before = F.lag(content).over(Window.partitionBy(key).orderBy(order))
    return real.withColumn("_b", before).filter(~F.col(content).eqNullSafe(F.col("_b"))).drop("_b")


@dataclass(frozen=True)
class Assertion:
    """What a turn may assert: a source, the words between, a target and what follows it."""

    relation: str
    cue: str
    confidence: float
    after: str = ""


def assertions(turns: DataFrame, key: str, order: str, speaker: str, text: str, names: Sequence[str], me: str, patterns: Sequence[Assertion], doubts: Iterable[str]) -> DataFrame:
    """(key, order, speaker, source, relation, target, confidence, evidence): every match of every
    pattern in turns without a sign of doubt. The word ``me`` stands for the speaker; nothing is
    asserted of itself; a relation that a turn asserts twice is one row."""
    either = "|".join(rf"\Q{n}\E" for n in sorted(names, key=lambda n: (-len(n), n)))
    certain = turns.filter(F.col(speaker).isNotNull() & (F.col(speaker) != "") & ~any_of(F.col(text), doubts))

    def matches(p: Assertion) -> Column:
        whole = F.lit(rf"({either}|\Q{me}\E)(?:{p.cue})({either}){p.after}")
        sources, targets = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2))
        row = lambda s, t: F.struct(s.alias("source"), F.lit(p.relation).alias("relation"), t.alias("target"), F.lit(p.confidence).alias("confidence"))
        return F.zip_with(sources, targets, row)

    found = [matches(p) for p in patterns]
    each = certain.select(key, order, speaker, F.substring(text, 1, 300).alias("evidence"), F.explode(F.array_distinct(F.concat(*found))).alias("_x"))
    source = F.when(F.col("_x.source") == me, F.col(speaker)).otherwise(F.col("_x.source"))
    out = each.select(key, order, speaker, source.alias("source"), "_x.relation", "_x.target", "_x.confidence", "evidence")
    return out.filter(F.col("source") != F.col("target")).dropDuplicates([key, order, "source", "relation", "target"])


def evidence_edges(turns: DataFrame, titles: DataFrame, key: str, order: str, speaker: str, about: str, itself: str) -> DataFrame:
    """Edges (key, relation, source, target) that the text itself shows: who speaks to whom, who
    appears with whom, and of whom a title (key, title) says that one speaks about the other."""
    named = turns.filter(F.col(speaker).isNotNull() & (F.col(speaker) != ""))
    to = adjacency(named, key, order, speaker).select(key, F.lit("SPEAKS_TO").alias("relation"), "source", "target")
    who = named.groupBy(key).agg(F.array_sort(F.collect_set(speaker)).alias("_w"))
    pair = F.flatten(F.transform("_w", lambda a: F.transform(F.filter("_w", lambda b: a < b), lambda b: F.struct(a.alias("source"), b.alias("target")))))
    beside = who.select(key, F.lit("APPEARS_WITH").alias("relation"), F.explode(pair).alias("_p")).select(key, "relation", "_p.*")
    source, target = (F.trim(F.regexp_extract("title", about, i)) for i in (1, 2))
    says = titles.filter(F.col("title").rlike(about)).select(key, F.lit("SPEAKS_ABOUT").alias("relation"), source.alias("source"), F.when(target == itself, source).otherwise(target).alias("target"))
    return to.unionByName(beside).unionByName(says).distinct()


def digests(users: DataFrame, memories: DataFrame, key: str, titles: Mapping[str, str], most: int, empty: str) -> DataFrame:
    """(key, digest): the memories (key, kind, at, content) of each of ``users`` as text, a section
    for each kind in the order of ``titles`` with its last ``most`` as lines, or ``empty``."""
    late = F.row_number().over(Window.partitionBy(key, "kind").orderBy(F.col("at").desc()))
    held = memories.filter(F.col("kind").isin(list(titles))).withColumn("_n", late).filter(F.col("_n") <= most)
    line = F.struct("at", F.concat(F.lit("- "), "content").alias("t"))
    sections = held.groupBy(key, "kind").agg(F.array_join(F.sort_array(F.collect_list(line))["t"], "\n").alias("body"))
    place = F.create_map(*[F.lit(x) for i, kind in enumerate(titles) for x in (kind, i)])
    title = F.create_map(*[F.lit(x) for item in titles.items() for x in item])
    text = F.concat(F.lit("["), title[F.col("kind")], F.lit("]\n"), "body")
    whole = F.array_join(F.sort_array(F.collect_list(F.struct(place[F.col("kind")].alias("p"), text.alias("t"))))["t"], "\n\n")
    return users.join(sections.groupBy(key).agg(whole.alias("digest")), key, "left").select(key, F.coalesce("digest", F.lit(empty)).alias("digest"))


def pending_chunks(videos: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """How many chunks each video has pending, none included."""
    return videos.join(chunks.groupBy(key).agg(F.count(F.lit(1)).alias("pending")), key, "left").na.fill({"pending": 0})


def media_audit(videos: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Per access status of ``videos`` (key, access, has_subtitles): videos, those with subtitles,
    those without chunks, and pending chunks."""
    return pending_chunks(videos, chunks, key).groupBy("access").agg(
        F.count(F.lit(1)).alias("videos"), F.count_if("has_subtitles").alias("with_subtitles"),
        F.count_if(F.col("pending") == 0).alias("without_chunks"), F.sum("pending").alias("pending_chunks"),
    )


def readiness(reviews: DataFrame, data: DataFrame, *, reviewed: int, matches: int, documents: int, chunks: int) -> DataFrame:
    """One row from two of one row each: the counts, which conditions are not met, whether all are,
    and why. What was accepted in bulk was not compared one by one, whatever else is met."""
    row = reviews.join(data, F.lit(True))
    met = {
        "enough_reviewed": F.col("reviewed") >= reviewed, "enough_matches": F.col("matches") >= matches, "no_critical": F.col("critical") == 0,
        "enough_documents": F.col("main_documents") >= documents, "enough_chunks": F.col("chunks") >= chunks, "all_have_source": F.coalesce("all_have_source", F.lit(True)),
        "no_fixtures": F.col("fixtures") == 0, "compared_singly": F.col("bulk") == 0,
    }
    unmet = F.array_compact(F.array(*[F.when(~c, k) for k, c in met.items()]))
    reason = F.when(F.col("bulk") > 0, "accepted in bulk, not compared one by one").when(F.size(unmet) == 0, "all conditions are met").otherwise("review or data are not complete")
    return row.select("reviewed", "matches", "critical", "main_documents", "chunks", "fixtures", "bulk", F.array_join(unmet, ";").alias("unmet"), (F.size(unmet) == 0).alias("ready"), reason.alias("reason"))
