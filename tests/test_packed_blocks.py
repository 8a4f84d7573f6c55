"""What a search moves."""

from loomcorpus.functions.text import tokenize
from loomcorpus.operators import inverted as I
from loomcorpus.plans import retrieve


def words(c):
    return tokenize(c, "words")


def test_many_queries_are_scored_in_one_pass(spark, tmp_path, monkeypatch):
    """Where the first shards of all queries are about all shards, blocks are moved once, not twice;
    packed blocks are read as they were, and copies in different shards have equal scores."""
    rows = [(i, f"common w{i % 7} w{i % 11} w{i % 13} w{i % 5}") for i in range(2000)]
    index = I.build(spark.createDataFrame(rows, "chunk_id long, text string"), words, f"file://{tmp_path}/i", buckets=4, span=50)
    asked = spark.createDataFrame([(q, f"w{q} w{q % 11} common w3") for q in range(12)], "query_id long, text string")
    passes, own = [], I._scored
    monkeypatch.setattr(I, "_scored", lambda *a: passes.append(1) or own(*a))
    found = I.search(index, asked, words, 5).collect()
    assert index.shards == 40 and len(passes) == 1
    plain = retrieve.r.bm25(asked, spark.createDataFrame(rows, "chunk_id long, text string"), words, 5).collect()
    key = lambda x: (x.query_id, x.chunk_id, x.rank, round(x.score, 8))
    assert sorted(map(key, found)) == sorted(map(key, plain))
