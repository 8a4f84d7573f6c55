"""Text columns: cleaning, sentences, excerpts, terms and tokens."""

from __future__ import annotations

import html
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"(?U)\s"


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    """Named and numbered signs as characters; Spark has no function for all of them, so texts with
    an ampersand go to Python."""
    return F.when(text.contains("&"), _unescaped(text)).otherwise(text)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def compact_lines(text: Column) -> Column:
    """Lines with single blanks and no ends, without empty ones and direct repeats."""
    clean = F.filter(
        F.transform(lines(F.replace(text, F.lit("\r"), F.lit("\n"))), lambda x: strip(F.regexp_replace(x, r"[\t\f\x0B ]+", " "))),
        lambda x: x != "",
    )
    return bound(clean, lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def compact_text(text: Column) -> Column:
    return F.array_join(compact_lines(text), "\n")


def effective_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, rf"{SPACE}+", ""))


def count_cjk(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{4E00}-\x{9FFF}]"))


def clean_document(
    text: Column, *, tails: Iterable[str] = (), navigation: Iterable[str] = (), patterns: Iterable[str] = ()
) -> Column:
    """Struct of content, cjk_chars, duplicates and noise: the compact text up to the first line
    that starts like a tail, without navigation lines and repeats. Noise is the share of removed
    characters, to 4 places."""
    tails, navigation, patterns = list(tails), list(navigation), list(patterns)

    def is_navigation(x: Column) -> Column:
        found = x.isin(*navigation) if navigation else F.lit(False)
        for p in patterns:
            found = found | x.rlike(p)
        return found

    def result(all_lines: Column) -> Column:
        ends = F.lit(False)

        def is_tail(x: Column) -> Column:
            out = ends
            for t in tails:
                out = out | x.startswith(t)
            return out

        tail = F.array_position(F.transform(all_lines, is_tail), True) if tails else F.lit(0)
        head = F.when(tail > 0, F.slice(all_lines, 1, (tail - 1).cast("int"))).otherwise(all_lines)

        def after(head: Column) -> Column:
            text_lines = F.filter(head, lambda x: ~is_navigation(x))
            size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + effective_length(x))

            def kept(body: Column) -> Column:
                unique = F.array_distinct(body)
                removed = size(head) - size(unique)
                whole = F.greatest(F.lit(1), size(all_lines))
                return F.struct(
                    F.array_join(unique, "\n").alias("content"),
                    count_cjk(F.array_join(unique, "\n")).alias("cjk_chars"),
                    (F.size(body) - F.size(unique)).alias("duplicates"),
                    F.round(F.least(F.lit(1.0), removed / whole), 4).alias("noise"),
                )

            return bound(text_lines, kept)

        return bound(head, after)

    return bound(compact_lines(text), result)


def without_lines(text: Column, markers: Iterable[str], pattern: str | None = None) -> Column:
    """The compact text without lines that hold a marker or match."""
    markers = list(markers)

    def drop(x: Column) -> Column:
        out = x.rlike(pattern) if pattern else F.lit(False)
        for m in markers:
            out = out | x.contains(m)
        return out

    return F.array_join(F.filter(compact_lines(text), lambda x: ~drop(x)), "\n")


def sentences(text: Column, least: int = 1, most: int = 1 << 30) -> Column:
    """Sentences with their end marks, stripped, of some lengths only."""
    parts = F.transform(F.split(text, r"(?<=[。！？!?；;.])|\n+"), strip)
    return F.filter(parts, lambda x: F.length(x).between(least, most))


def excerpt(text: Column, n: int) -> Column:
    return F.substring(strip(F.regexp_replace(text, rf"{SPACE}+", " ")), 1, n)


def short(text: Column, n: int) -> Column:
    """For a table cell: single blanks, no bar, an ellipsis where cut."""
    flat = F.replace(strip(F.regexp_replace(text, rf"{SPACE}+", " ")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n - 1), F.lit("…"))).otherwise(flat)


def safe_excerpt(text: Column, patterns: Iterable[str], n: int = 480) -> Column:
    """Without blank lines and lines that look like instructions, cut at ``n``."""
    patterns = list(patterns)

    def keep(x: Column) -> Column:
        out = x != ""
        for p in patterns:
            out = out & ~x.rlike(p)
        return out

    body = F.array_join(F.filter(F.transform(lines(text), strip), keep), "\n")
    cut = F.concat(F.regexp_replace(F.substring(body, 1, n), rf"{SPACE}+$", ""), F.lit("…"))
    return F.when(F.length(body) > n, cut).otherwise(body)


def safe_filename(value: Column, fallback: str = "document") -> Column:
    clean = F.regexp_replace(F.regexp_replace(value, r"[^0-9A-Za-z\x{4E00}-\x{9FFF}_-]+", "-"), r"^[-_]+|[-_]+$", "")
    cut = F.substring(clean, 1, 80)
    return F.lower(F.when(cut == "", F.lit(fallback)).otherwise(cut))


# Keys whose values are never shown.
SENSITIVE = (
    "api_key", "apikey", "authorization", "access_token", "refresh_token", "password", "secret",
    "cookie", "set-cookie",
)
MASK = "***REDACTED***"


def redact(c: Column, kind: T.DataType, keys: Iterable[str] = SENSITIVE) -> Column:
    """Mask the values of sensitive keys at any depth of structs, arrays and maps."""
    keys = [k.lower() for k in keys]
    if isinstance(kind, T.StructType):
        return F.struct(*[
            (F.lit(MASK) if f.name.lower() in keys else redact(c[f.name], f.dataType, keys)).alias(f.name)
            for f in kind.fields
        ])
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: redact(x, kind.elementType, keys))
    if isinstance(kind, T.MapType):
        masked = lambda k, v: F.when(F.lower(k).isin(*keys), F.lit(MASK).cast(kind.valueType)).otherwise(
            redact(v, kind.valueType, keys)
        )
        return F.transform_values(c, masked)
    return c


def term_present(text: Column, term: str) -> Column:
    """A term of one character must stand alone; a longer one may be part of a word."""
    if len(term) == 1:
        edge = r"[\x{4E00}-\x{9FFF}A-Za-z0-9]"
        return text.rlike(rf"(?<!{edge})\Q{term}\E(?!{edge})")
    return text.contains(term)


def labelled_value(text: Column, labels: Iterable[str], most: int = 80) -> Column:
    """What follows the first label that has something after it on its line."""
    found = [F.regexp_extract(text, rf"(?m)\Q{label}\E[ \t]*[:：]?[ \t]*([^\n]{{1,{most}}})", 1) for label in labels]
    return F.coalesce(*[F.when(x != "", strip(x)) for x in found])


def word_count(value: Column) -> Column:
    """A number with an optional 万 or 千 behind it."""
    number = F.regexp_extract(F.replace(value, F.lit(","), F.lit("")), r"(\d+(?:\.\d+)?)", 1)
    times = F.when(value.contains("万"), 10000).when(value.contains("千"), 1000).otherwise(1)
    return F.when(number != "", F.floor(number.cast("double") * times).cast("int"))


def normalized_title(value: Column, numerals: Mapping[str, str] | None = None) -> Column:
    """Lower case, no punctuation or blanks, numerals as digits."""
    out = F.lower(F.regexp_replace(value, r"[\s\p{P}\p{S}]+", ""))
    for word, digit in sorted((numerals or {}).items(), key=lambda x: -len(x[0])):
        out = F.replace(out, F.lit(word), F.lit(digit))
    return out


def clock_seconds(value: Column) -> Column:
    """Seconds of mm:ss.mmm or hh:mm:ss,mmm."""
    parts = F.reverse(F.split(F.replace(value, F.lit(","), F.lit(".")), ":"))
    at = lambda i: F.coalesce(F.get(parts, F.lit(i)).cast("double"), F.lit(0.0))
    return at(0) + 60 * at(1) + 3600 * at(2)


def as_timestamp(value: Column) -> Column:
    """Of epoch seconds or an ISO text; null if neither."""
    number = F.when(value.rlike(r"^\d{9,11}$"), value).cast("long")
    return F.coalesce(F.timestamp_seconds(number), F.try_to_timestamp(value))


def canonical_terms(found: Column, variants: Mapping[str, str]) -> Column:
    """Surface forms mapped, without repeats and without names inside longer ones, sorted."""
    if variants:
        table = F.create_map(*[F.lit(x) for pair in variants.items() for x in pair])
        found = F.transform(found, lambda x: F.coalesce(F.try_element_at(table, x), x))
    return bound(
        F.array_sort(F.array_distinct(found)),
        lambda a: F.filter(a, lambda x: ~F.exists(a, lambda y: (y != x) & y.contains(x))),
    )


def tokenize(text: Column, mode: str = "reference", aliases: Mapping[str, str] | None = None, entities: Iterable[str] = ()) -> Column:
    """Terms of a text for retrieval.

    "words" gives runs of [a-z0-9_] of the lower-case text. "reference" first takes out all white
    space, so Latin words that only blanks part become one term, and adds pairs and triples of
    neighbouring CJK characters. Aliases found in the text add their expansion; entities of one
    character that stand alone add a term of their own.
    """
    for alias, more in (aliases or {}).items():
        text = F.when(text.contains(alias), F.concat(text, F.lit(" " + more))).otherwise(text)
    low = F.lower(text)
    latin = r"[a-z0-9_]+"
    if mode == "words":
        terms = F.regexp_extract_all(low, F.lit(latin), F.lit(0))
    else:
        packed = F.regexp_replace(low, rf"{SPACE}+", "")
        grams = lambda n: lambda r: F.when(
            F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.substr(r, i, F.lit(n)))
        ).otherwise(F.array().cast("array<string>"))
        runs = F.regexp_extract_all(packed, F.lit(r"[\x{4E00}-\x{9FFF}]+"), F.lit(0))
        both = F.transform(runs, lambda r: F.concat(grams(2)(r), grams(3)(r)))
        terms = F.concat(F.regexp_extract_all(packed, F.lit(latin), F.lit(0)), F.flatten(both))
    for name in entities:
        terms = F.when(term_present(text, name), F.array_append(terms, F.lit(f"entity:{name}"))).otherwise(terms)
    return terms


def searchable_text(title: Column, content: Column, *extra: Column) -> Column:
    """Title twice, further fields, content; nulls are empty."""
    none = F.lit("")
    return F.concat_ws("\n", F.coalesce(title, none), F.coalesce(title, none), *[F.coalesce(x, none) for x in extra], F.coalesce(content, none))


def context_flags(text: Column, keywords: Iterable[str], first: bool = False) -> Column:
    """The keywords that a text holds, in their order, or the first of them."""
    hits = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))
    return F.get(hits, F.lit(0)) if first else hits
