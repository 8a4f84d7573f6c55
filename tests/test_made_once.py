"""What is taken apart, moved or made once only."""

from collections import Counter
from math import sqrt

from pyspark.sql import functions as F

from loomcorpus.functions.text import tokenize
from loomcorpus.operators import answers as a
from loomcorpus.operators import inverted as I
from loomcorpus.operators import retrieval as r
from loomcorpus.sources import files


def words(c):
    return tokenize(c, "words")


def plan_of(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_a_build_takes_texts_apart_once(spark, tmp_path):
    taken = []
    rows = [(i, f"w{i % 7} w{i % 5} same same") for i in range(100)] + [(200, None), (201, "")]
    index = I.build(spark.createDataFrame(rows, "chunk_id long, text string"), lambda c: taken.append(1) or words(c), f"file://{tmp_path}/i", buckets=4, span=20)
    assert len(taken) == 1
    assert index.size() == (102, 400) and index.entries().filter("length = 0 AND size(buckets) = 0").count() == 2
    assert {x.term: (x.df, x.tf) for x in I.term_stats(index).collect()}["same"] == (100, 200)


def test_hashed_vectors_are_moved_once(spark):
    """Rows that share a key count as one, wherever they lie; null keys and texts have no vector."""
    rows = [(i % 40, f"w{i} w{i % 3} w{i % 3}") for i in range(100)] + [(None, "x"), (90, None), (91, "")]
    found = r.hashed_vectors(spark.createDataFrame(rows, "k long, text string").repartition(5), "k", words(F.col("text")), 64)
    assert plan_of(found).count("Exchange hashpartitioning") == 1
    want = {}
    for k, text in rows:
        if k is not None and text:
            t = text.split()
            for term, d in zip(t, r.buckets_of(I.pa.array(t), 64)):
                want.setdefault(k, Counter())[int(d)] += 1
    got = {(x.k, x.bucket): x.weight for x in found.collect()}
    norm = {k: sqrt(sum(n * n for n in c.values())) for k, c in want.items()}
    assert set(got) == {(k, d) for k, c in want.items() for d in c}
    assert all(abs(got[k, d] - n / norm[k]) < 1e-12 for k, c in want.items() for d, n in c.items())


def test_an_index_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(it):
        for b in it:
            made.add(b.num_rows)
            yield b

    files.write_index(spark.range(10).mapInArrow(count, "id long"), f"file://{tmp_path}/x", "m", 1)
    assert made.value == 10 and files.load_index(spark, f"file://{tmp_path}/x", "m", 1).count() == 10


def test_dense_rank_is_one_join_whatever_the_queries(spark, monkeypatch):
    monkeypatch.setattr(r, "QUERY_BLOCK", 3)
    rows = [(i, [float((i * 7) % 5 - 2), float(i % 3), 1.0]) for i in range(30)] + [(50, [0.0, 0.0, 0.0]), (51, [float("nan"), 1.0, 1.0]), (52, None)]
    held = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    asked = held.filter("chunk_id % 2 = 0").withColumnRenamed("chunk_id", "query_id")
    whole = r.dense_rank(asked, held, 4)
    assert "Union" not in plan_of(whole)
    unit = {i: [x / sqrt(sum(y * y for y in v)) for x in v] for i, v in rows[:30]}
    want = set()
    for q in range(0, 30, 2):
        scores = sorted((-round(sum(x * y for x, y in zip(unit[q], v)), 10), i) for i, v in unit.items())
        want |= {(q, i, n + 1) for n, (s, i) in enumerate(scores[:4]) if s < 0}
    assert {(x.query_id, x.chunk_id, x["rank"]) for x in whole.collect()} == want
    monkeypatch.setattr(r, "DENSE_QUERIES", 4)
    monkeypatch.setattr(r, "DENSE_BLOCK", 7)
    assert {(x.query_id, x.chunk_id, x["rank"]) for x in r.dense_rank(asked, held, 4).collect()} == want


def test_excerpts_are_made_of_what_was_found(spark):
    chunks = spark.createDataFrame([(1, "one two", "c", "d", "u", "A", "one"), (2, "three", "c", "d", "u", "A", "three")], "chunk_id long, text string, corpus string, document string, url string, tier string, title string")
    asked = spark.createDataFrame([(7, "one", "x")], "query_id long, text string, route string")
    ranking = spark.createDataFrame([(7, 1, 1.0, 1)], "query_id long, chunk_id long, score double, rank int")
    results, _ = a.answer(asked, chunks, words, a.Recipe({"x": ("c",)}), rank=lambda *x: ranking)
    assert [x.excerpt for x in results.collect()] == ["one two"]
    plan = plan_of(results, "analyzed")
    assert plan[: plan.index("AS excerpt")].count("Join ") == 1
