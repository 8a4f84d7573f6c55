"""Rule columns: keyword classifiers, scores with their reasons, gates."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(text: Column, terms: Iterable[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return out


def hit_count(text: Column, terms: Iterable[str]) -> Column:
    return sum((text.contains(t).cast("int") for t in terms), F.lit(0))


def keyword_hits(text: Column, terms: Iterable[str]) -> Column:
    """Terms that occur, the longest first, without any that lies inside a longer hit."""
    ordered = sorted(set(terms), key=lambda t: (-len(t), t))
    found = F.filter(F.array(*[F.lit(t) for t in ordered]), lambda t: F.contains(text, t))
    return F.element_at(
        F.transform(
            F.array(found),
            lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: (F.length(y) > F.length(x)) & y.contains(x))),
        ),
        1,
    )


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The label of the first rule that holds."""
    out = F.lit(default).cast("string")
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return out


def reasons(rules: Sequence[tuple[Column, str]]) -> Column:
    """The labels of all rules that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(label)) for c, label in rules]))


def page_class(title: Column, content: Column, *, hard: Iterable[str], game: Iterable[str], lore: Iterable[str], core: Iterable[str], n: int = 1200) -> Column:
    """gameplay, mixed, lore or unknown, by markers in the title and the first ``n`` characters."""
    text = F.concat_ws("\n", title, F.substring(content, 1, n))
    games, lores = hit_count(text, game), hit_count(text, lore)
    return first_match(
        [
            (any_of(text, hard), "gameplay"),
            (games >= 3, "gameplay"),
            ((games >= 2) & (lores > 0), "mixed"),
            ((lores > 0) | (F.size(keyword_hits(text, core)) >= 2), "lore"),
        ],
        "unknown",
    )


@dataclass(frozen=True)
class Weights:
    """Weights of a candidate's score; fixed values where results must agree."""

    lead_in_title: int = 10
    concept_in_title: int = 8
    core_in_title: int = 6
    many_in_summary: int = 5
    story_page: int = 3
    game_page: int = -8
    index_page: int = -10
    too_short: int = -5
    summary_hits: int = 2
    least_chars: int = 80
    include_from: int = 6


def scored(parts: Sequence[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """An additive score and the breakdown that explains it."""
    score = sum((F.when(c, w).otherwise(0) for c, w, _ in parts), F.lit(0))
    lines = F.array_compact(F.array(*[F.when(c, F.lit(f"{label} {w:+d}")) for c, w, label in parts]))
    return score, lines


def quality_gate(rejecting: Sequence[tuple[Column, str]], doubting: Sequence[tuple[Column, str]]) -> Column:
    """Struct of status and reasons: any rejecting rule rejects, else any doubting one asks for a
    review; the reasons are those of the tier that decides."""
    bad, odd = reasons(rejecting), reasons(doubting)
    return F.struct(
        F.when(F.size(bad) > 0, "rejected").when(F.size(odd) > 0, "needs_review").otherwise("accepted").alias("status"),
        F.when(F.size(bad) > 0, bad).otherwise(odd).alias("reasons"),
    )


def route(query: Column, *, deny: Iterable[str], navigation: Iterable[str], topic: Iterable[str], dialogue: Iterable[str], fact: Iterable[str]) -> Column:
    """none, navigation, dialogue, official_fact or mixed; terms that deny come first."""
    text = F.trim(query)
    on_topic = any_of(text, topic)
    return first_match(
        [
            ((text == "") | any_of(text, deny), "none"),
            (any_of(text, navigation), "navigation"),
            (on_topic & any_of(text, dialogue), "dialogue"),
            (on_topic & any_of(text, fact), "official_fact"),
            (on_topic, "mixed"),
        ],
        "none",
    )


def stage(score: Column, bands: Sequence[tuple[int, str]]) -> Column:
    """The label of the highest band that a score reaches."""
    out = F.lit(None).cast("string")
    for least, label in sorted(bands):
        out = F.when(score >= least, F.lit(label)).otherwise(out)
    return out


def clamp(value: Column, low: int = 0, high: int = 100, default: int = 70) -> Column:
    """A number within bounds; what isn't one is the default."""
    number = value.cast("string").try_cast("double")
    bounded = F.least(F.lit(high), F.greatest(F.lit(low), number.cast("int")))
    return F.when(number.isNotNull(), bounded).otherwise(F.lit(default))


def verdict(overall: Column, bands: Sequence[tuple[int, str]] = ((88, "excellent"), (72, "good"), (55, "fair"), (0, "poor"))) -> Column:
    return stage(overall, [(n, label) for n, label in bands])


def type_map(text: Column, kinds: Mapping[str, Iterable[str]], default: str) -> Column:
    """The first kind of which a keyword occurs."""
    return first_match([(any_of(text, words), kind) for kind, words in kinds.items()], default)
