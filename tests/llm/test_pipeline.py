import corpus_pipeline as C
import pytest

from loomcorpus.llm import line_dedup, packing


@pytest.fixture(scope="module")
def stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(C.materialize(stage(spark, out[-1], d), "test-stage"))
    return out


def test_stages_keep_the_columns_and_take_effect(stages):
    counts = [x.count() for x in stages]
    assert all(x.columns == stages[0].columns for x in stages[1:-1])
    assert counts[1] < counts[0] and counts[2] == counts[1] and counts[3] < counts[2] and counts[4] <= counts[3]


def test_stages_agree_with_brute_force(stages, spark):
    """Each stage on its own input: line dedup and components by dictionaries, packing whole."""
    from test_line_dedup import brute_passages
    from test_ngram_join import brute as components

    before = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    assert {r["doc_id"]: r["text"] for r in stages[2].collect()} == brute_passages(before)
    docs = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert {r["doc_id"] for r in stages[3].collect()} == {i for i, (_, c) in components(docs, 5, 80).items() if i == c}
    assert {r["doc_id"] for r in stages[5].collect()} == {r["doc_id"] for r in stages[4].collect()}
    assert line_dedup.LEAST == 2 and packing.tokenizer_path()


def test_run_gives_the_last_stage(spark, stages):
    got = C.run(spark, "/root/testdata/sf0.001")
    assert got.columns == stages[-1].columns and got.count() == stages[-1].count()


CLASHES = ["_id", "_row", "row", "key", "places", "pairs", "block", "cls", "sig", "part", "_c", "_s", "kept", "g", "d2", "term", "words", "item_id", "n_words", "component_id"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty and very long texts, ties, repeated rows with the same text and
    with others, and columns named like internal ones."""
    plain = [" ".join(f"w{i}x{k}" for i in range(60)) for k in range(6)]
    rows = [(None, plain[0], None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, plain[1], "en", "s", 1), (3, plain[2], "en", "s", 1), (4, plain[3], "en", None, 1),
            (4, plain[3], "en", None, 1), (5, plain[1] + " end", "en", "s", 1), (6, " ".join(f"v{i}" for i in range(150_000)), "de", "s", 9), (7, plain[4] + "\n" + plain[5], None, "s", 2)]
    d = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *[f"7 AS {c}" for c in CLASHES])
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, plain[5]), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_every_stage_of_odd_documents(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, odd)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == 7 for r in rows for c in CLASHES), name
        assert stage(spark, docs.limit(0), odd).count() == 0, name
    kept = {r["doc_id"] for r in C.quality_rules(spark, docs, odd).collect()}
    assert {1, 2}.isdisjoint(kept) and {None, 3, 4} <= kept
    texts = sorted((r["doc_id"], len(r["text"])) for r in C.line_dedup(spark, docs, odd).collect() if r["doc_id"] in (3, 4))
    assert texts[2] == (4, 0) and texts[3][1] > 0 and texts[0][1] > 0 and texts[1][1] > 0
    assert sorted(str(r["doc_id"]) for r in C.near_copies(spark, docs, odd).collect()) == sorted(map(str, [1, 2, 3, 3, 4, 4, 6, 7, None]))
    assert 7 not in {r["doc_id"] for r in C.decontamination(spark, docs, odd).collect()}
    packed = C.packing(spark, docs, odd)
    assert packed.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len(packed.filter("piece = 0").collect()) == 10 and C.packing(spark, docs.limit(0), odd).count() == 0


def test_run_of_odd_and_empty_documents(spark, odd, tmp_path):
    assert {r["doc_id"] for r in C.run(spark, odd).collect()} >= {None, 3, 4}
    spark.read.parquet(f"{odd}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{odd}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0
