"""Exact values of single columns, and chunking by brute force."""

import pytest
from pyspark.sql import functions as F

from loomcorpus.functions import rules, text, urls
from loomcorpus.operators import chunking, graph, keyed
from loomcorpus.sources import files, html


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


@pytest.mark.parametrize("url,want", [
    ("HTTPS://Example.COM:443//a//b/?utm_x=1&b=2&a=1&token=9#top", "https://example.com/a/b?a=1&b=2"),
    ("http://example.com:8080", "http://example.com:8080/"),
    ("ftp://example.com/x", ""),
    ("https://e.com/p?k", "https://e.com/p?k="),
    ("https://e.com/p?q=a%20b~*", "https://e.com/p?q=a+b~%2A"),
    ("not a url", ""),
])
def test_normalize_url(spark, url, want):
    assert one(spark, url, urls.normalize_url) == want


def test_prefix_ends_at_a_segment(spark):
    allowed = {"e.com": ("/news",)}
    f = lambda c: urls.is_allowed_url(c, allowed, ("/private",))
    assert one(spark, "https://e.com/news/1", f)
    assert not one(spark, "https://e.com/newsletter", f)
    assert not one(spark, "https://e.com/news/private/1", f)


def test_compact_and_clean(spark):
    raw = "a  b\r\r a b \nmenu\nx\ny\nx\nTHE END\nz"
    assert one(spark, raw, text.compact_text) == "a b\nmenu\nx\ny\nx\nTHE END\nz"
    got = one(spark, raw, lambda c: text.clean_document(c, tails=("THE END",), navigation=("menu",)))
    assert got["content"] == "a b\nx\ny" and got["duplicates"] == 1


def test_single_character_terms_stand_alone(spark):
    assert one(spark, "see 华 there", lambda c: text.term_present(c, "华"))
    assert not one(spark, "中华", lambda c: text.term_present(c, "华"))


def test_tokens_of_cjk(spark):
    assert one(spark, "Ab c 一二三", text.tokenize) == ["abc", "一二", "二三", "一二三"]
    assert one(spark, "Ab c", lambda c: text.tokenize(c, "words")) == ["ab", "c"]


def test_clamp(spark):
    assert [one(spark, v, rules.clamp) for v in ("150", "-4", "x", None, "50")] == [100, 0, 70, 70, 50]


@pytest.mark.parametrize("counts,want", [
    ((0, 0, 0, 0, False, 0), "missing"), ((1, 0, 1, 1, False, 0), "thin"), ((0, 2, 2, 2, False, 0), "thin"),
    ((2, 0, 1, 1, False, 0), "thin"), ((2, 0, 2, 2, False, 0), "usable"), ((3, 0, 1, 1, True, 0), "usable"),
    ((5, 0, 3, 3, False, 0), "usable"), ((5, 0, 3, 3, False, 1), "strong"),
])
def test_coverage_status(spark, counts, want):
    column = graph.coverage_status(*[F.lit(c) for c in counts])
    assert spark.range(1).select(column.alias("s")).first()["s"] == want


def test_chunks_keep_their_sizes(spark):
    body = "".join(f"Sentence number {i} of the text. " for i in range(200))
    df = spark.createDataFrame([(body,), (None,), ("",)], "t string")
    chunks, null, empty = (r.c for r in chunking.with_chunks(df, "t", "c").collect())
    assert all(500 <= len(c) <= 900 for c in chunks[:-1]) and len(chunks) > 5
    assert all(f"number {i} " in "\n".join(chunks) for i in range(200))
    assert null == [] and empty == []
    with pytest.raises(ValueError):
        chunking.with_chunks(df, "t", overlap=0)


def test_folded_groups_split_between_turns(spark):
    rows = [(1, i, "x" * n) for i, n in enumerate((5, 6, 7, 20, 1))]
    df = spark.createDataFrame(rows, "k int, i int, t string")
    got = {r["i"]: r["group"] for r in chunking.chunk_cues(df, "k", "i", F.length("t"), 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 2}


def test_upsert_says_what_changed(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    got = {r["k"]: (r["v"], r["changed"]) for r in keyed.upsert(old, new, "k").collect()}
    assert got == {1: ("a", False), 2: ("b", False), 3: ("c", True)}


def test_html_page():
    page = html.parse('<title>t</title><meta property="og:title" content="O"><nav>menu</nav><script>var a="</p>";</script>'
                      '<article><p>One long paragraph of text.<p>Two <a href="/x">link</a></article>')  # fmt: skip
    assert page["title"] == "O" and page["links"] == [{"href": "/x", "label": "link"}]
    assert page["text"] == "One long paragraph of text.\nTwo link" and page["needs_render"]
    assert html.parse(None)["needs_render"]


def test_subtitles(spark, tmp_path):
    (tmp_path / "a.srt").write_text("1\n00:00:01,500 --> 00:00:03,000\nHello\n\n2\n00:01:00,000 --> 00:01:02,250\nyou\nthere\n")
    got = files.subtitle_scan(spark, f"file://{tmp_path}/a.srt").orderBy("start_seconds").collect()
    assert [(r["start_seconds"], r["end_seconds"], r["content"]) for r in got] == [(1.5, 3.0, "Hello"), (60.0, 62.25, "you\nthere")]


def test_lenient_and_strict_json(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\nnope\n{"a": 2}\n')
    path = f"file://{tmp_path}/a.jsonl"
    assert sorted(r["a"] for r in files.read_jsonl_lenient(spark, path, "a int").collect()) == [1, 2]
    assert files.read_jsonl_lenient(spark, path + ".none", "a int").count() == 0
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_jsonl_strict(spark, path, "a int").collect()


def test_index_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "chunk_id int, weight double")
    files.write_index(df, f"file://{tmp_path}/i", "m", 8)
    assert files.load_index(spark, f"file://{tmp_path}/i", "m", 8).count() == 1
    with pytest.raises(ValueError):
        files.load_index(spark, f"file://{tmp_path}/i", "other", 8)


def test_embedded_json(spark):
    page = 'x <script>window.state = {"a": {"b": [1, 2]}, "c": "}"}; more {</script>'
    got = one(spark, page, lambda c: files.embedded_json(c, "window.state", "a struct<b: array<int>>, c string"))
    assert got["a"]["b"] == [1, 2] and got["c"] == "}"


def test_redaction_at_depth(spark):
    df = spark.createDataFrame([({"token": "s", "in": [{"Password": "p", "n": 1}]},)], "r struct<token: string, in: array<struct<Password: string, n: int>>>")
    got = df.select(text.redact(F.col("r"), df.schema["r"].dataType).alias("r")).first()["r"]
    assert got["token"] == "s" and got["in"][0]["Password"] == text.MASK and got["in"][0]["n"] == 1
