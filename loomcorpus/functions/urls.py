"""URL columns: normal forms, allowlists and content addresses."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query keys that never identify a page.
TRACKING_KEYS = ("from", "source", "spm", "timestamp", "share_code", "share_from")
SENSITIVE_KEYS = (
    "access_token", "api_key", "apikey", "auth", "authorization", "cookie", "key", "password",
    "secret", "sign", "signature", "token",
)

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(F.trim(url), _PARTS, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def host(url: Column) -> Column:
    """Lower-case host without login, port or a final dot."""
    bare = F.regexp_replace(_part(url, 2), r"^.*@", "")
    return F.regexp_replace(F.lower(F.regexp_replace(bare, r":[0-9]*$", "")), r"\.+$", "")


def path(url: Column) -> Column:
    return _part(url, 3)


def _pairs(query: Column, ignored: Iterable[str]) -> Column:
    """The query's decoded (key, value) pairs that count, sorted; a key alone has an empty value."""
    decode = lambda c: F.coalesce(F.try_url_decode(c), c)
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            decode(F.substring_index(p, "=", 1)).alias("k"),
            decode(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")).alias("v"),
        ),
    )
    kept = F.filter(
        pairs, lambda p: ~F.lower(p["k"]).startswith("utm_") & ~F.lower(p["k"]).isin(*ignored)
    )
    return F.array_sort(kept)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def absolute(url: Column, base: Column) -> Column:
    """``url`` seen from ``base``: absolute, scheme-relative, root-relative or relative to the
    base's folder."""
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), url)
        .when(url.startswith("//"), F.concat(_part(base, 1), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(origin, url))
        .otherwise(F.concat(origin, F.regexp_replace(path(base), r"[^/]*$", ""), url))
    )


def normalize_url(url: Column, ignored: Iterable[str] = TRACKING_KEYS + SENSITIVE_KEYS) -> Column:
    """The one form of a public URL: http or https, lower-case host, no default port, single
    slashes, no final slash, no tracking or sensitive keys, sorted query, no fragment. Anything
    else is an empty string."""
    ignored = list(ignored)
    port = F.regexp_extract(_part(url, 2), r":([0-9]+)$", 1)
    default = ((scheme(url) == "http") & (port == "80")) | ((scheme(url) == "https") & (port == "443"))
    place = F.concat(host(url), F.when((port == "") | default, F.lit("")).otherwise(F.concat(F.lit(":"), port)))
    squeezed = F.regexp_replace(path(url), "/{2,}", "/")
    trimmed = F.when(squeezed.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(squeezed, "/+$", ""))
    pairs = F.transform(_pairs(_part(url, 4), ignored), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"])))
    query = F.array_join(pairs, "&")
    good = scheme(url).isin("http", "https") & (host(url) != "")
    full = F.concat(scheme(url), F.lit("://"), place, trimmed, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(good, full).otherwise(F.lit(""))


def canonical_url(url: Column, kept_schemes: Iterable[str] = ("manual-official",)) -> Column:
    """Normal form of https URLs without tracking keys; everything else as it is."""
    own = F.lit(False)
    for s in kept_schemes:
        own = own | url.startswith(f"{s}://")
    return F.when(~own & (scheme(url) == "https"), normalize_url(url, TRACKING_KEYS)).otherwise(url)


def is_safe_url(url: Column, kept_schemes: Iterable[str] = ("manual-official",)) -> Column:
    safe = url.rlike("^https://[^/]+")
    for s in kept_schemes:
        safe = safe | url.startswith(f"{s}://")
    return safe


def under_prefix(route: Column, prefix: Column) -> Column:
    """Whether a path is a prefix or lies below it, at a boundary between segments."""
    bare = F.regexp_replace(F.lower(prefix), "/+$", "")
    return (F.lower(route) == bare) | F.lower(route).startswith(F.concat(bare, F.lit("/")))


def is_allowed_url(url: Column, allowed: Mapping[str, Iterable[str]], blocked: Iterable[str] = ()) -> Column:
    """Whether the host is listed, one of its path prefixes holds and no blocked part occurs."""
    normal = normalize_url(url)
    route = path(normal)
    good = F.lit(False)
    for name, prefixes in allowed.items():
        for prefix in prefixes:
            good = good | ((host(normal) == name) & under_prefix(route, F.lit(prefix)))
    for part in blocked:
        good = good & ~F.lower(route).contains(part)
    return good


def source_type(url: Column, hosts: Mapping[str, str], default: str) -> Column:
    """The type of the longest listed host that the URL's is, or lies under: a suffix that begins at
    a dot."""
    out = F.lit(default)
    for name, kind in sorted(hosts.items(), key=lambda x: len(x[0])):
        out = F.when((host(url) == name) | host(url).endswith(f".{name}"), F.lit(kind)).otherwise(out)
    return out


def content_hash(text: Column) -> Column:
    return F.sha2(F.encode(text, "utf-8"), 256)


def stable_id(prefix: str, value: Column, length: int = 20) -> Column:
    return F.concat(F.lit(f"{prefix}_"), F.substring(content_hash(value), 1, length))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark has no function for it."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalized_content_hash(text: Column) -> Column:
    return content_hash(F.regexp_replace(nfkc(text), r"(?U)\s+", ""))


def id_from_url(url: Column, pattern: str, form: str) -> Column:
    """``form`` with the id that ``pattern`` finds in the URL's path, or null."""
    found = F.regexp_extract(path(url), pattern, 1)
    return F.when(found != "", F.format_string(form, found))


def label_for_path(url: Column, rules: Iterable[tuple[str, str]], default: str | None = None) -> Column:
    """The label of the first rule whose regex matches the path."""
    out = F.lit(default).cast("string")
    for pattern, label in reversed(list(rules)):
        out = F.when(path(url).rlike(pattern), F.lit(label)).otherwise(out)
    return out
