"""Secret scans with corpus-wide ownership of what they find.

A scan finds spans of fixed kinds and further candidates: marked credentials and long tokens that
mix letters and digits. Over the whole corpus each candidate's hash is counted by distinct
repositories and distinct owners. A value that many owners hold is a copied example; one that few
hold and that looks drawn at random is taken to be live. Candidates of the further kinds become
spans only if live.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

BASE = ("assign", "access", "hex")
EXTRA = ("private_key", "jwt", "github", "slack", "google", "stripe", "url_login", "mixed")
KINDS = BASE + EXTRA
#: At most so many owners, and repositories, for a value to count as its owner's own: an owner may
#: have it in several repositories, but what is in many is a copied example whoever owns them.
MAX_OWNERS, MAX_REPOSITORIES = 2, 4
#: Bits per character from which a value looks drawn at random.
MIN_ENTROPY = 3.0

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MARKED = {
    "private_key": ("PRIVATE KEY", re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "google": ("AIza", re.compile(r"AIza[A-Za-z0-9_-]{35}")),
    "stripe": ("k_live_", re.compile(r"[sr]k_live_[A-Za-z0-9]{16,}")),
    "url_login": ("://", re.compile(r"(?<=://)[^\s/:@]+:[^\s/:@]{4,}(?=@)")),
}
_MIXED = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
_DIGIT = re.compile(r"[0-9]")

_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]
)
_SPANS = pa.list_(_SPAN)


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of all base spans and candidates, in code points. A null text
    has none. Each kind's own matches don't overlap; a candidate never overlaps a base span."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    # what is taken, as intervals that don't meet
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e, _ in found):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    marks = [(k, pattern) for k, (word, pattern) in _MARKED.items() if word in text]
    if _DIGIT.search(text):
        marks.append(("mixed", _MIXED))
    for kind, pattern in marks:
        for m in pattern.finditer(text):
            at = bisect_left(starts, m.end())  # of intervals that start before the match ends, the last ends last
            if at == 0 or ends[at - 1] <= m.start():
                found.append((kind, m.start(), m.end(), m[0]))
                starts.insert(at, m.start())
                ends.insert(at, m.end())
    return found


def scan(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """One row per row of ``docs``: its doc_id, ``_row`` (unique), repository, owner and the spans
    with the hash of their value. The table is written, as two later jobs read it.

    Nulls and empty texts have no spans; a text of any length is read whole; repeated rows have
    spans of their own; an empty table gives an empty one. Other columns of ``docs`` are ignored,
    whatever their names.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            spans = [
                [
                    {"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(),
                     "random": _entropy(v) >= MIN_ENTROPY and len(v) >= 12}
                    for k, s, e, v in find(t)
                ]
                for t in b.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("repository"), b.column("owner"), pa.array(spans, _SPANS)],
                ["doc_id", "repository", "owner", "spans"],
            )

    out = docs.select(
        "doc_id", F.col("text").cast("string").alias("text"),
        F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
    ).mapInArrow(
        batches,
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, repository string, owner string, "
        "spans array<struct<kind:string,start:bigint,end:bigint,hash:string,random:boolean>>",
    )
    return materialize(out.withColumn("_row", F.monotonically_increasing_id()), "secret-spans")


def ownership(scanned: DataFrame) -> DataFrame:
    """Every value's hash with its distinct repositories and owners in the whole corpus. A null
    owner or repository counts as one of its own."""
    each = scanned.select("repository", "owner", F.explode("spans").alias("s")).select(
        F.col("s.hash").alias("hash"),
        F.coalesce("repository", F.lit("\x00")).alias("repository"),
        F.coalesce("owner", F.lit("\x00")).alias("owner"),
    )
    pairs = each.groupBy("hash", "repository", "owner").agg(F.count(F.lit(1)).alias("n"))
    return pairs.groupBy("hash").agg(
        F.count_distinct("repository").alias("n_repositories"),
        F.count_distinct("owner").alias("n_owners"),
        F.sum("n").alias("n_places"),
    )


def owned_spans(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """One row per span that stays: ``_row``, doc_id, kind, start, end, hash, counts and ``live``.
    A value is live if it looks drawn at random and few owners and few repositories have it."""
    each = scanned.select("_row", "doc_id", F.explode("spans").alias("s")).select("_row", "doc_id", "s.*")
    joined = each.join(ownership(scanned), "hash")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repositories") <= max_repositories)
    live = F.col("random") & few
    return joined.withColumn("live", live).filter(F.col("kind").isin(*BASE) | F.col("live"))


def op7_owned_secrets(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its spans; nulls, repeats and an empty table as in ``scan``.
    The documents name a source only, so it is the owner, and its part in one language the
    repository; a null source or language counts as a name of its own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.concat_ws("/", *[F.coalesce(c, F.lit("\x00")) for c in ("source", "lang")])
    scanned = scan(docs.select("doc_id", "text", "source", name.alias("repository")), "repository", "source")
    rank = F.element_at(F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))]), F.col("kind"))
    spans = owned_spans(scanned).select(
        "_row", "kind", "live",
        F.struct("start", rank.alias("rank"), F.concat_ws(":", "kind", "start", "end").alias("text")).alias("s"),
    )
    base = F.col("kind").isin(*BASE)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda s: s["text"]), ",")
    per_row = spans.groupBy("_row").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE],
        joined(F.when(base, F.col("s"))).alias("base"),
        joined(F.col("s")).alias("spans"),
        F.count_if("live").alias("n_live"),
    )
    out = scanned.select("_row", "doc_id").join(per_row, "_row", "left")
    return out.select(
        "doc_id",
        *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )
