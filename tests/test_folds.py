"""Places, running sums and folds of any length against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from loomcorpus.operators import folds, ordered
from loomcorpus.operators.folds import Rule, folded


def plain(sizes, rule, whole=0):
    """(start, end) of groups, row by row."""
    if sizes and sum(sizes) < whole:
        return [(0, len(sizes))]
    out, start = [], 0
    while start < len(sizes):
        end, total = start + 1, sizes[start]
        while end < len(sizes) and total < rule.most and (total < rule.least or total + sizes[end] <= rule.most):
            total += sizes[end]
            end += 1
        out.append((start, end))
        if end == len(sizes):
            break
        start = max(start + 1, end - rule.overlap)
    return out


def groups(df, rule, whole=0):
    got = {}
    for r in folded(df, "k", "i", F.col("n"), rule, whole).collect():
        got.setdefault((r.k, r.group), []).append(r.i)
    return {x: sorted(v) for x, v in got.items()}


RULES = [Rule(6, 10, 3), Rule(10, 10, 0), Rule(1, 4, 1), Rule(20, 50, 5), Rule(3, 9, 2)]


@pytest.mark.parametrize("rule", RULES)
@pytest.mark.parametrize("part,fan", [(4096, 256), (7, 256), (6, 2)])
def test_equals_a_plain_fold(spark, monkeypatch, rule, part, fan):
    monkeypatch.setattr(folds, "PART", part)
    monkeypatch.setattr(folds, "FAN", fan)
    rng = random.Random(part * 100 + rule.most)
    keys = {k: [rng.choice([0, 0, 1, 2, 3, 5, 9, 40]) for _ in range(n)] for k, n in enumerate((1, 2, 6, 7, 8, 13, 60, 150))}
    keys |= {100: [0] * 40, 101: [50] * 20, None: [2] * 30, 102: [1, None, 2]}
    rows = [(k, i, n, "x") for k, sizes in keys.items() for i, n in enumerate(sizes)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, n int, state string")
    want = {(k, g): list(range(s, e)) for k, sizes in keys.items() for g, (s, e) in enumerate(plain([n or 0 for n in sizes], rule, 12))}
    assert groups(df, rule, 12) == want
    assert folded(df.limit(0), "k", "i", F.col("n"), rule).collect() == []


def test_one_conversation_of_a_million_turns(spark):
    df = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.pmod(F.xxhash64("id"), F.lit(200))).cast("int").alias("n"))
    df = df.unionByName(spark.createDataFrame([(2, 0, 500), (2, 1, 600), (2, 2, 700)], "k int, i long, n int"))
    sizes = [r.n for r in df.filter("k = 1").orderBy("i").collect()]
    rule = Rule(600, 1000, 3)
    made = folded(df, "k", "i", F.col("n"), rule, 1200).groupBy("k", "group").agg(F.min("i").alias("s"), F.max("i").alias("e"), F.count(F.lit(1)).alias("n")).collect()
    assert all(r.e - r.s + 1 == r.n for r in made)
    assert sorted((r.s, r.e + 1) for r in made if r.k == 1) == plain(sizes, rule)
    assert sorted((r.s, r.e + 1) for r in made if r.k == 2) == plain([500, 600, 700], rule)


def test_rank_with_a_hot_key(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 10 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    df = df.unionByName(df.limit(0)).withColumn("_range", F.lit(5))
    out = ordered.rank_all(df, [F.col("k"), F.col("id").desc()])
    got = [(r.k, r.id) for r in sorted(out.collect(), key=lambda r: r.place)]
    assert got == sorted(((r.k, r.id) for r in df.collect()), key=lambda x: (x[0], -x[1]))
    assert sorted(r.place for r in out.collect()) == list(range(1, 20_001)) and ordered.rank_all(df.limit(0), [F.col("id")]).count() == 0
    held = ordered._sorted(df, [F.col("k"), F.col("id")], "part", "nth").groupBy("part").count().collect()
    assert max(r["count"] for r in held) < 12_000


def test_running_sums_of_a_hot_key(spark):
    rows = [("hot", i, i % 7) for i in range(3000)] + [("a", 1, 5), ("a", 0, 4), (None, 3, 1), (None, 9, 2)]
    df = spark.createDataFrame(rows, "k string, i int, n int")
    got = sorted((repr(r.k), r.place, r.before, r.i) for r in ordered.running(df, "k", [F.col("i")], F.col("n")).collect())
    want, at = [], {}
    for k, i, n in sorted(rows, key=lambda r: (repr(r[0]), r[1])):
        p, b = at.get(k, (0, 0))
        want.append((repr(k), p, b, i))
        at[k] = (p + 1, b + n)
    assert got == sorted(want)
