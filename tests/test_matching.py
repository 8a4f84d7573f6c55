"""Terms in texts and titles in titles against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from loomcorpus.functions.text import term_present
from loomcorpus.operators import graph, links, matching


def count(text, term):
    return (text or "").count(term)


@pytest.mark.parametrize("lot", [16 << 20, 40])
def test_matches_equal_plain_counts(spark, monkeypatch, lot):
    monkeypatch.setattr(matching.lots, "__defaults__", (lot,))
    monkeypatch.setattr(matching, "SLICE", 50)
    rng = random.Random(1)
    pieces = ["a", "b", "ab", "aa", "漢", "字", "é", " ", "\n", "1", "term", "termite", "x" * 30, "Ä"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None, "", "aaaaaaa", "漢", "b"]
    terms = ["a", "b", "aa", "aaa", "ab", "term", "termite", "rm", "漢", "漢字", "é", "x" * 9, "x" * 31, "absent", "", None, "aa", "\na", "b漢", "1"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, term string").repartition(3)
    catalog = spark.createDataFrame([(t,) for t in terms], "term string")
    got = {(r.doc_id, r.term): r.n for r in matching.term_matches(docs, "doc_id", "text", catalog).collect()}
    few = sorted({t for t in terms if t})
    shown = docs.select("doc_id", *[term_present(F.col("text"), t).alias(f"t{i}") for i, t in enumerate(few)]).collect()
    want = {(r.doc_id, t): count(texts[r.doc_id], t) for r in shown for i, t in enumerate(few) if r[f"t{i}"]}
    assert got == want
    plain = {(r.doc_id, r.term): r.n for r in graph.dictionary_match(docs, "doc_id", "text", few).collect()}
    assert got == plain
    every = matching.term_matches(docs, "doc_id", "text", catalog, standalone=False).count()
    assert every == sum(count(t, x) > 0 for t in texts for x in few)
    assert matching.term_matches(docs.limit(0), "doc_id", "text", catalog).collect() == []
    assert matching.term_matches(docs, "doc_id", "text", catalog.limit(0)).collect() == []


def test_a_hundred_thousand_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    few = ["tion", "keit", "que", "the", "a", "ention "]
    many = spark.range(100_000).select(F.concat(F.lit("zq"), F.sha2(F.col("id").cast("string"), 256)).alias("term"))
    catalog = many.unionByName(spark.createDataFrame([(t,) for t in few], "term string"))
    got = sorted(map(tuple, matching.term_matches(docs, "doc_id", "text", catalog).collect()))
    assert got == sorted(map(tuple, graph.dictionary_match(docs, "doc_id", "text", few).collect())) and got


def test_titles_in_titles(spark):
    rng = random.Random(2)
    titles = lambda n: ["".join(rng.choice("abcd ") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 20]))) for _ in range(n)]
    small, large = titles(150) + ["common abc", None], titles(150) + ["common " + x for x in titles(100)] + [None]
    frame = lambda x: spark.createDataFrame([(t,) for t in x], "title string")
    got = {(r.small, r.large) for r in links.containing(frame(small), frame(large)).collect()}
    assert got == {(a, b) for a in small if a for b in large if b is not None and a in b}
    assert links.containing(frame([]), frame(large)).collect() == [] and links.containing(frame(small), frame([])).collect() == []


def test_the_rarest_run_is_looked_up(spark):
    large = spark.createDataFrame([(f"The chapter {i}",) for i in range(500)], "title string")
    small = spark.createDataFrame([("The chapter 123",)], "title string")
    found = links.containing(small, large)
    assert [tuple(r) for r in found.collect()] == [("The chapter 123", "The chapter 123")]
