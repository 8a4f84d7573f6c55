"""Fill-in-middle: a text is cut into prefix, middle and suffix between its units and rearranged.

``regexp_count`` gives the number of units; a pattern of the row's own, with possessive groups of so
many units each, captures the three parts in one match, and its replacement writes them in the order
of the row's form. Possessive counts keep no places to go back to, so a match runs in a loop and
never goes deeper, however many units a text has. Everything stays in Spark's own expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import fresh

#: A line with its end, or what follows the last one.
LINE = r"[^\n]*+\n|[^\n]++"


@dataclass(frozen=True)
class Marks:
    """What stands before the prefix, the suffix and the middle. They must be found again in an
    output, so no mark holds another one or starts with what one ends with."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        every = (self.prefix, self.suffix, self.middle)
        if not all(every):
            raise ValueError("marks can't be empty")
        for i, a in enumerate(every):
            for j, b in enumerate(every):
                if (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b) - (i == j)) + 1)):
                    raise ValueError(f"{a!r} and {b!r} can't be told apart")


def _quoted(mark: str) -> str:
    """A mark as part of a replacement."""
    return mark.replace("\\", "\\\\").replace("$", "\\$")


def _literal(mark: str) -> str:
    """A mark as part of a pattern."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in mark)


def draws(key: Column, seed: int) -> list[Column]:
    """Four whole numbers below 2**32, from the sha256 of the seed and the key; a null key is an
    empty one."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    df: DataFrame, key: str, text: str, seed: int, unit: str = LINE, marks: Marks = Marks(), rate: int = 100, spm: int = 50
) -> DataFrame:
    """``df`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` percent of the rows are rearranged, ``spm`` percent of those with the suffix first. The
    cuts are drawn from the key, so rows of one key and text are cut alike. A null or empty text, or
    one that holds a mark, stays ``plain`` and has null counts of characters; its output is the text,
    null being empty. ``unit`` must match any text from end to end without an empty match. Texts are
    read whole. Columns of ``df`` named like an output are replaced, all others kept; an empty table
    gives an empty one.
    """
    own, h, pattern = fresh(df, "_text", "_h", "_pattern")
    outputs = ("n", "form", "prefix_chars", "middle_chars", "output")
    df = df.withColumns({own: F.coalesce(F.col(text), F.lit("")), h: F.array(*draws(F.col(key), seed))})
    df = df.drop(*[c for c in outputs if c != text])
    df = df.withColumn("n", F.regexp_count(own, F.lit(unit)).cast("long"))
    cuts = [F.col(h)[i] % (F.col("n") + 1) for i in (0, 1)]
    first, last = F.least(*cuts), F.greatest(*cuts)
    group = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    marked = F.lit(False)
    for m in (marks.prefix, marks.suffix, marks.middle):
        marked = marked | F.col(own).contains(m)
    plain = (F.col(own) == "") | marked | (F.col(h)[2] % 100 >= rate)
    form = F.when(plain, "plain").when(F.col(h)[3] % 100 < spm, "spm").otherwise("psm")
    df = df.withColumns({"form": form, pattern: F.concat(F.lit(r"\A"), group(first), group(last - first), F.lit(r"([\s\S]*)\z"))})
    p, s, m = (_quoted(x) for x in (marks.prefix, marks.suffix, marks.middle))
    order = F.when(F.col("form") == "psm", f"{p}$1{s}$3{m}$2").otherwise(f"{s}$3{p}$1{m}$2")
    df = df.withColumn("output", F.when(F.col("form") == "plain", F.col(own)).otherwise(F.regexp_replace(own, F.col(pattern), order)))
    at = {x: F.instr("output", x) for x in (marks.prefix, marks.suffix, marks.middle)}
    past = F.when(F.col("form") == "psm", at[marks.suffix]).otherwise(at[marks.middle])
    cut = F.col("form") != "plain"
    counts = {
        "prefix_chars": F.when(cut, past - at[marks.prefix] - len(marks.prefix)).cast("long"),
        "middle_chars": F.when(cut, F.length("output") + 1 - at[marks.middle] - len(marks.middle)).cast("long"),
    }
    return df.withColumns(counts).drop(own, h, pattern)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text that an output was made from."""
    p, s, m = (_literal(x) for x in (marks.prefix, marks.suffix, marks.middle))
    lazy, rest = r"([\s\S]*?)", r"([\s\S]*)\z"
    psm = F.regexp_replace(output, rf"\A{p}{lazy}{s}{lazy}{m}{rest}", "$1$3$2")
    spm = F.regexp_replace(output, rf"\A{s}{lazy}{p}{lazy}{m}{rest}", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l, [('0x' || substr(h, 8 * i + 1, 8))::UBIGINT FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, len(l) AS n, least(r[1] % (len(l) + 1), r[2] % (len(l) + 1))::BIGINT AS a, greatest(r[1] % (len(l) + 1), r[2] % (len(l) + 1))::BIGINT AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(l[1:a], '') AS prefix, array_to_string(l[a + 1:b], '') AS middle, array_to_string(l[b + 1:], '') AS suffix,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""


def op12_counted_fim(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    made = fill_in_middle(docs, "doc_id", "text", seed=7)
    back = restored(F.col("output"), F.col("form"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
