"""Quality rules: robust multivariate outliers of documents, per language and source.

Native: DataFrame functions only. A document's statistics become a vector; each pair of language and
source has minimum-covariance-determinant estimates of centre and scatter; a document goes when its
squared Mahalanobis distance from its pair's exceeds a chi-square quantile.

Estimates are made for pairs, for languages and for all rows. A pair's is drawn to its language's,
and that to the one of all rows, as if PRIOR_ROWS rows of the wider kind had been among its own: at
every size, a large pair is judged by itself and a pair of a few rows nearly by its language.

The determinant is brought down by concentration steps from two starts, the medians and quartiles
and the plain mean and scatter, until no group's changes, and of all steps the least determinant
counts. The vectors are fixed-point integers, so every sum is exact and no verdict depends on the
order in which tasks end. A step keeps the nearest ``support`` share of a group; the cut between near
and far is found from counts and sums by distance bucket (32 an octave), of which a group has some
hundreds at most, so no group is ever sorted or gathered.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .expressions import WORD, let
from .scratch import discard, materialize

FEATURES = ("x_symbols", "x_length", "x_repeats", "x_capitals", "x_lines")
#: Spread that any group is granted, in feature units times 1000: a group that is all alike must
#: not reject a document for one odd sign.
FLOORS = {"x_symbols": 250, "x_length": 60, "x_repeats": 140, "x_capitals": 90, "x_lines": 150}
#: Words added to each document's counts at the usual rates, which steadies short documents.
PRIOR_WORDS, PRIOR_CHARS, PRIOR_CAPITALS = 50, 250, 8
SUPPORT, QUANTILE, WINDOW = 0.75, 0.99999, 8
#: Rows of its language that a pair's estimates hold besides its own, and most concentration steps.
PRIOR_ROWS, STEPS = 100, 12


def _repeated(words: Column) -> Column:
    """Words that stand in windows of 8 found twice or more, the first included. Windows are
    compared by 64-bit hashes."""
    n = F.size(words)
    hashes = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW))
    )

    def count(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twins(r: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(r, a)["h"] == b["h"], F.lit(False))
            found = F.filter(r, lambda p, j: same(j - 1, p) | same(j + 1, p))
            return F.sort_array(F.transform(found, lambda p: p["i"]))

        covered = F.aggregate(
            let(ranked, twins),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, p: F.struct(
                p.alias("last"), (a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n")
            ),
            lambda a: a["n"],
        )
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered)

    return F.when(n > WINDOW, let(hashes, count)).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and
    the feature columns. A null text has no words; columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    def lines(split: Column) -> Column:
        return F.struct(
            F.size(split).cast("long").alias("n"),
            (F.size(split) - F.size(F.array_distinct(split))).cast("long").alias("dup"),
        )

    worded = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns(
        {
            "_w": let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counted),
            "_l": let(worded, lines),
            "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
            "_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        }
    )
    df = df.withColumns(
        {k: F.col("_w")[k] for k in ("n_words", "word_chars", "n_repeat_words")}
        | {"n_dup_lines": F.col("_l")["dup"]}
    )
    n, steady = F.col("n_words"), F.col("n_words") + F.lit(PRIOR_WORDS)
    raw = {
        "x_symbols": F.log1p(20 * F.col("n_symbols") / steady),
        "x_length": F.log((F.col("word_chars") + PRIOR_CHARS) / steady),
        "x_repeats": F.sqrt(F.col("n_repeat_words") / steady),
        "x_capitals": F.sqrt((F.col("_capitals") + PRIOR_CAPITALS) / (F.col("word_chars") + PRIOR_CHARS)),
        "x_lines": F.sqrt(F.col("n_dup_lines") / (F.col("_l")["n"] + 5)),
    }
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return df.withColumns(
        {k: F.round(1000 * v).cast("long") for k, v in raw.items()} | {"base_failed": failed}
    ).drop("_w", "_l", "_capitals")


def _chi_square_cdf(x: float, d: int) -> float:
    """By the series of the incomplete gamma function."""
    term = total = 2 / d
    for i in range(1, 400):
        term *= (x / 2) / (d / 2 + i)
        total += term
    return total * math.exp(-x / 2 + d / 2 * math.log(x / 2) - math.lgamma(d / 2))


@lru_cache
def chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution, by bisection."""
    lo, hi = 1e-9, 300.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _chi_square_cdf(mid, d) < p else (lo, mid)
    return lo


def _consistency(share: float, d: int) -> float:
    """Factor that makes the scatter of a share of nearest normal rows the scatter of them all."""
    return share / _chi_square_cdf(chi_square(share, d), d + 2)


_D = len(FEATURES)
_PAIRS = list(combinations_with_replacement(range(_D), 2))
_SUMS = ["n"] + [f"s{i}" for i in range(_D)] + [f"p{i}_{j}" for i, j in _PAIRS]
_CENTRE = [f"m{i}" for i in range(_D)]
_SCATTER = [f"c{i}_{j}" for i, j in _PAIRS]
_LEVELS = ("pair", "language", "all")


def _sums() -> list[Column]:
    x = [F.col(f) for f in FEATURES]
    return (
        [F.count(F.lit(1)).alias("n")]
        + [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
        + [F.sum(x[i] * x[j]).alias(f"p{i}_{j}") for i, j in _PAIRS]
    )


def _floor(i: int, j: int) -> Column:
    return F.lit(float(FLOORS[FEATURES[i]] ** 2 if i == j else 0))


def _moments(sums: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Sums to each group's number of rows, centre m_i and scatter c_i_j."""
    n = F.col("n").cast("double")
    mean = [F.col(f"s{i}") / n for i in range(_D)]
    scatter = [
        (factor * (F.col(f"p{i}_{j}") / n - mean[i] * mean[j]) + _floor(i, j)).alias(f"c{i}_{j}") for i, j in _PAIRS
    ]
    return sums.select(*keys, "n", *[m.alias(f"m{i}") for i, m in enumerate(mean)], *scatter)


def _inverted(df: DataFrame, keys: list[str]) -> DataFrame:
    """The scatter c_i_j inverted to q_i_j by sweeping each of its pivots in turn, over a flat
    array, with the logarithm of its determinant, the pivots' product."""
    flat = F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for i in range(_D) for j in range(_D)])

    def sweep(state: Column, k: Column) -> Column:
        m = state["m"]
        at = lambda i, j: F.get(m, (i * _D + j).cast("int"))

        def entry(v: Column, x: Column) -> Column:
            i, j = F.floor(x / _D), x % _D
            pivot = at(k, k)
            return (
                F.when((i == k) & (j == k), -1.0 / pivot)
                .when((i == k) | (j == k), v / pivot)
                .otherwise(v - at(i, k) * at(k, j) / pivot)
            )

        return F.struct(F.transform(m, entry).alias("m"), (state["logdet"] + F.log(at(k, k))).alias("logdet"))

    start = F.struct(flat.alias("m"), F.lit(0.0).alias("logdet"))
    swept = F.aggregate(F.sequence(F.lit(0), F.lit(_D - 1)), start, sweep)
    inverse = [(-F.col("_q")["m"][i * _D + j]).alias(f"q{i}_{j}") for i, j in _PAIRS]
    return df.select("*", swept.alias("_q")).select(*keys, *_CENTRE, *inverse, F.col("_q")["logdet"].alias("logdet"))


def _distance(df: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``d2``, the squared distance from the group's centre. The table of groups is
    joined as Spark sees fit, which knows its size when it has been made."""
    named = model.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)], *[c for c in model.columns if c[0] in "mq"])
    same = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    out = df.join(named, same, "left")
    x = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    terms = [F.lit(1.0 if i == j else 2.0) * F.col(f"q{i}_{j}") * x[i] * x[j] for i, j in _PAIRS]
    return out.withColumn("d2", sum(terms, F.lit(0.0))).drop(*named.columns)


def levels(rows: DataFrame) -> DataFrame:
    """Each row of ``rows`` (lang, source, the features) in its three groups (level, lang, source)."""
    each = [
        F.struct(
            F.lit(name).alias("level"),
            (F.col("lang") if name != "all" else F.lit(None).cast("string")).alias("lang"),
            (F.col("source") if name == "pair" else F.lit(None).cast("string")).alias("source"),
        )
        for name in _LEVELS
    ]
    return rows.select(F.explode(F.array(*each)).alias("_k"), *FEATURES).select("_k.*", *FEATURES)


_KEYS = ["level", "lang", "source"]


def _starts(rows: DataFrame) -> DataFrame:
    """Two models of each group: by medians and quartiles, and by the plain mean and scatter."""
    quartiles = rows.groupBy(*_KEYS).agg(*[F.percentile(f, [0.25, 0.5, 0.75]).alias(f"q{i}") for i, f in enumerate(FEATURES)])
    spread = lambda i: ((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.349) ** 2 + _floor(i, i)
    robust = quartiles.select(
        *_KEYS, F.lit(0).alias("start"), *[F.col(f"q{i}")[1].alias(f"m{i}") for i in range(_D)],
        *[(spread(i) if i == j else F.lit(0.0)).alias(f"c{i}_{j}") for i, j in _PAIRS],
    )
    plain = _moments(rows.groupBy(*_KEYS).agg(*_sums()), _KEYS, 1.0).withColumn("start", F.lit(1)).drop("n")
    return _inverted(robust.unionByName(plain), [*_KEYS, "start"])


def _concentrated(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: the estimates of the SUPPORT share of each group that is nearest by ``model``."""
    keys = [*_KEYS, "start"]
    near = _distance(rows, model, keys)
    near = near.withColumn("_b", F.floor(32 * F.log2(F.lit(1.0) + 16 * F.col("d2"))).cast("int"))
    table = near.groupBy(*keys, "_b").agg(*_sums())
    through = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    inside = table.withColumns(
        {"_before": F.coalesce(F.sum("n").over(through), F.lit(0)), "_all": F.sum("n").over(Window.partitionBy(*keys))}
    ).filter(F.col("_before") < SUPPORT * F.col("_all"))
    sums = inside.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])
    return _inverted(_moments(sums, keys, _consistency(SUPPORT, _D)), keys)


def fit(rows: DataFrame) -> DataFrame:
    """Rows, centre and scatter of each group (level, lang, source) of ``rows``, by the least
    determinant that the concentration steps reach and one reweighting step."""
    keys = [*_KEYS, "start"]
    model = materialize(_starts(rows), "quality-start")
    twice = rows.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    steps = []
    for _ in range(STEPS):
        after = materialize(_concentrated(twice, model), "quality-step")
        if steps:  # the model before was a step too, so its determinant can be held against this one's
            old = model.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("logdet").alias("_logdet"))
            same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
            moved = after.join(old, same).filter(F.abs(F.col("logdet") - F.col("_logdet")) > 1e-9)
            if moved.isEmpty():
                break
        steps.append(after)
        model = after
    every = steps[0]
    for step in steps[1:]:
        every = every.unionByName(step)
    columns = [c for c in every.columns if c not in keys]
    least = every.groupBy(*_KEYS).agg(F.min(F.struct("logdet", "start", *[c for c in columns if c != "logdet"])).alias("_m"))
    model = materialize(least.select(*_KEYS, "_m.*"), "quality-least")
    discard(*steps)
    good = _distance(rows, model, _KEYS).filter(F.col("d2") <= chi_square(0.975, _D))
    return _moments(good.groupBy(*_KEYS).agg(*_sums()), _KEYS, _consistency(0.975, _D))


def pair_models(estimates: DataFrame) -> DataFrame:
    """The model of each (lang, source): its own estimates drawn to its language's, and those to
    the ones of all rows, in proportion to the rows they rest on."""
    estimates = materialize(estimates, "quality-estimates")
    values = [*_CENTRE, *_SCATTER]

    def level(name: str) -> DataFrame:
        return estimates.filter(F.col("level") == name)

    def drawn(df: DataFrame, towards: dict[str, Column]) -> DataFrame:
        mixed = [((F.col("n") * F.col(c) + PRIOR_ROWS * x) / (F.col("n") + PRIOR_ROWS)).alias(c) for c, x in towards.items()]
        return df.select("lang", "source", "n", *mixed)

    top = level("all").first()  # one row, or none of an empty table
    languages = drawn(level("language"), {c: F.lit(top[c] if top else 0.0) for c in values})
    wide = languages.select(F.col("lang").alias("_lang"), *[F.col(c).alias(f"_{c}") for c in values])
    joined = level("pair").join(wide, F.col("lang").eqNullSafe(F.col("_lang")))
    return _inverted(drawn(joined, {c: F.col(f"_{c}") for c in values}), ["lang", "source"])


def fitted(rows: DataFrame) -> DataFrame:
    """The pairs' models from ``rows`` (lang, source, base_failed and the features)."""
    return materialize(pair_models(fit(levels(rows.filter(~F.col("base_failed"))))), "quality-model")


def judge(rows: DataFrame, model: DataFrame) -> DataFrame:
    """``rows`` with ``d2`` and ``kept``: false where base_failed, else whether the distance is
    within the quantile. A pair all of whose rows fail has no model, and no other verdict."""
    out = _distance(rows, model, ["lang", "source"])
    limit = F.lit(chi_square(QUANTILE, _D))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= limit, F.lit(True))
    return out.withColumn("kept", kept)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns only.

    A null or empty text fails the base rule; null languages and sources are values like others;
    repeated rows, and rows at equal distances, are judged alike; an empty table stays empty. Texts
    are read whole, and once: the rows are written with their statistics.
    """
    wide = docs.select(F.struct(*docs.columns).alias("_row"), "text", "lang", "source")
    held = statistics(wide).select("_row", "lang", "source", "base_failed", *FEATURES)
    held = materialize(held, "quality-rows")
    model = fitted(held.select("lang", "source", "base_failed", *FEATURES))
    return judge(held, model).filter("kept").select("_row.*")


def op6_robust_outliers(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its counts and the verdict; nulls, repeats and an empty
    table as in ``quality_filter``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = materialize(statistics(docs).drop("text"), "quality-statistics")
    return judge(rows, fitted(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("d2", 6).alias("distance"),
    )
