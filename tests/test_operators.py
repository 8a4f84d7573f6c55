"""Operators whose rules SQL does not say, beside plain versions of them."""

import random
import re
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomcorpus.operators import answers, chunking, dialogue, graph, keyed, links
from loomcorpus.operators import retrieval as r
from loomcorpus.sources import files, html


def plain_units(text, most):
    units = []
    for line in [x.strip() for x in text.splitlines()]:
        whole = line.startswith(("#", "- ", "* ", "• "))
        for part in [line] if whole else re.split(r"(?<=[。！？!?；;.])\s*", line):
            part = part.strip()
            while len(part) > most:
                cut = max((k + 1 for k in range(most) if part[k] in "。！？；，.,;"), default=0)
                cut = cut if cut > most // 2 else most
                units.append(part[:cut].strip())
                part = part[cut:].strip()
            units.append(part)
    return [u for u in units if u]


def plain_chunks(text, target, least, most, overlap):
    """The rule as a list of units that start and end a chunk, joined at the end."""
    units = plain_units(text, most)
    size = lambda a, b: sum(len(u) for u in units[a:b]) + max(0, b - a - 1)

    def back(a, b):
        start = b - 1
        while start > a and sum(len(u) for u in units[start:b]) < overlap and sum(len(u) for u in units[start - 1 : b]) <= overlap:
            start -= 1
        return start

    spans, start, i = [], 0, 0
    while i < len(units):
        if i > start and size(start, i + 1) > most:
            spans.append((start, i))
            start = back(start, i)
        i += 1
        if size(start, i) >= target:
            spans.append((start, i))
            start = back(start, i)
    out = ["\n".join(units[a:b]) for a, b in spans]
    tail = "\n".join(units[start:])
    if tail and not out:
        out.append(tail)
    elif tail and len(tail) < least:
        if len(out[-1]) + 1 + len(tail) <= most:
            out[-1] += "\n" + tail
        elif tail not in out[-1]:
            out.append(tail)
    elif tail and out[-1] != tail:
        out.append(tail)
    seen = []
    for c in out:
        if c not in seen:
            seen.append(c)
    return seen


@pytest.mark.parametrize("sizes", [(700, 500, 900, 100), (200, 100, 300, 60), (80, 50, 120, 30), (3, 2, 4, 1)])
def test_text_chunks_equal_a_plain_fold(spark, sizes):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(150)
    odd = [None, "", " \n ", "x" * 5000, "one. two! # three\n# a heading. with more\n- item; item", "A. " * 3000, "no marks at all " * 200, "。！？" * 300, "\x1c a\x85b\u2028c", "same.\n" * 400]
    docs = docs.unionByName(spark.createDataFrame([(x,) for x in odd], "text string"))
    names = dict(zip(("target", "least", "most", "overlap"), sizes))
    for r in chunking.with_chunks(docs, "text", "c", **names).collect():
        assert r.c == plain_chunks(r.text or "", *sizes)


def test_built_chunks_are_of_accepted_documents_only(spark):
    text = "A sentence about tion and the rest. " * 60
    docs = spark.createDataFrame([(1, text, "accepted", "src0"), (2, text, "rejected", "src0"), (3, "short one", "accepted", "src1")], "doc_id int, text string, status string, source string")
    tier = F.when(F.col("source") == "src0", "A").otherwise("C")
    rows = chunking.build_chunks(docs, "doc_id", "text", tier, "status", {"names": ("tion", "keit"), "era": ("rest",)}).collect()
    assert {x["doc_id"] for x in rows} == {1, 3} and len({x["chunk_id"] for x in rows}) == len(rows)
    assert all(x["tier"] == ("A" if x["doc_id"] == 1 else "C") for x in rows)
    assert all(x["names"] == (["tion"] if "tion" in x["chunk"] else []) and x["era"] == (["rest"] if "rest" in x["chunk"] else []) for x in rows)


def test_quotas_count_what_was_taken_before(spark):
    rng = random.Random(4)
    rows = [(i, rng.randint(0, 9), rng.random() < 0.3, rng.random() < 0.2, rng.random() < 0.5) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, s int, a boolean, b boolean, c boolean")
    for quotas, total in (((5, 4, 60), 40), ((0, 3, 2), 10), ((200, 5, 5), 500)):
        ranked = sorted(rows, key=lambda r: (-r[1], r[0]))
        want = {}
        for i, n in enumerate(quotas):
            for r in ranked:
                if sum(x[2 + i] for x in rows if x[0] in want) >= n:
                    break
                if r[2 + i]:
                    want.setdefault(r[0], i)
        for r in ranked:
            if len(want) < total:
                want.setdefault(r[0], None)
        predicates = [(F.col(c), n) for c, n in zip("abc", quotas)]
        got = keyed.predicate_quotas(df, predicates, [F.col("s").desc(), F.col("k")], total).collect()
        assert {r.k: r.reason for r in got} == want and len(got) == len(want)


def test_swaps_reach_the_least_flags_at_the_least_loss(spark):
    rows = [(i, "ab"[i % 2], 100 - i, (i in (9, 13), i in (10, 12))) for i in range(16)]
    df = spark.createDataFrame(rows, "k int, s string, score int, f struct<x: boolean, y: boolean>")
    got = {x["k"] for x in keyed.stratified_sample(df, "s", "k", "score", "f", {"a": 3, "b": 2}, {"x": 1, "y": 1}).collect()}
    # of b, row 9 has x: it takes the place of 3; of a, row 10 has y: it takes that of 4
    assert got == {0, 2, 10, 1, 9}
    none = {x["k"] for x in keyed.stratified_sample(df, "s", "k", "score", "f", {"a": 3}, {"x": 1}).collect()}
    assert none == {0, 2, 4}


def test_reserved_places_come_first(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 100 - i) for i in range(20)], "k int, g string, score int")
    targets = spark.createDataFrame([("b", 1, 1)], "g string, target int, priority int")
    order = [F.col("score").desc()]
    got = [(x["k"], x["reserved"]) for x in keyed.reserve_then_fill(df, "g", targets, 2, 6, order, order).collect()]
    assert sorted(got) == [(0, False), (1, True), (2, False), (3, True), (4, False), (5, True)]


def test_first_seen_keeps_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "k int, v string")
    got = {x["k"]: x["duplicate_of"] for x in keyed.first_seen(df, "v", "k").collect()}
    assert got == {1: None, 2: 1, 3: None}


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    base = [[f"h{rng.randint(0, 60)}" for _ in range(rng.randint(1, 12))] for _ in range(60)]
    rows = [(i, sorted(set(x))) for i, x in enumerate([*base, *base[:5]])]
    got = {(x["a"], x["b"]): x["similarity"] for x in graph.near_duplicates(spark.createDataFrame(rows, "k int, signature array<string>"), "k").collect()}
    firsts = {}
    for i, s in rows:
        firsts.setdefault(tuple(s), i)
    want = {(firsts[tuple(s)], i): 1.0 for i, s in rows if firsts[tuple(s)] != i}
    groups = list(firsts.items())
    for n, (s, i) in enumerate(groups):
        for t, j in groups[n + 1 :]:
            share = len(set(s) & set(t)) / min(len(s), len(t))
            if share >= 0.5:
                want[(min(i, j), max(i, j))] = round(share, 4)
    assert got == want


def test_signature_of_any_order(spark):
    rows = [(str(i), f"d{i}") for i in range(500)]
    one = lambda x: r.signature(spark.createDataFrame(x, "k string, d string"), "k", "d").first()[0]
    assert one(rows) == one(rows[::-1]) != one(rows[1:])


def words(c):
    return F.split(c, " ")


def test_local_best_equals_all_pairs(spark, monkeypatch):
    """Small batches and blocks of queries, against scores of every pair."""
    import math
    from collections import Counter

    monkeypatch.setattr(r, "BATCH", 7)
    monkeypatch.setattr(r, "QUERY_BLOCK", 3)
    rng = random.Random(5)
    draw = lambda n: " ".join(f"w{rng.randint(0, 40)}" for _ in range(n))
    docs, asked = [draw(rng.randint(1, 30)) for _ in range(60)], [draw(4) for _ in range(8)]
    got = r.bm25(spark.createDataFrame(list(enumerate(asked)), "query_id long, text string"), spark.createDataFrame(list(enumerate(docs)), "chunk_id long, text string"), words, 4)
    df = Counter(w for t in docs for w in set(t.split()))
    mean = sum(len(t.split()) for t in docs) / len(docs)
    for q, text in enumerate(asked):
        scores = []
        for i, t in enumerate(docs):
            tf, n = Counter(t.split()), len(t.split())
            s = sum(math.log(1 + (60 - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * n / mean)) for w in text.split() if w in tf)
            if s > 0:
                scores.append((-round(s, 10), i))
        want = [i for _, i in sorted(scores)[:4]]
        assert [x["chunk_id"] for x in got.filter(f"query_id = {q}").orderBy("rank").collect()] == want


def test_passages_are_found_wherever_they_stand(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "two"), (3, None), (4, "")], "k int, text string")
    asked = spark.createDataFrame([("a", "two"), ("b", "two"), ("c", "e t"), ("d", "")], "passage_id string, passage string")
    got = sorted((x["passage_id"], x["k"]) for x in r.passages_in(docs, "k", "text", asked).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("b", 2), ("c", 1)]


def test_a_stale_pool_is_ranked_by_words_alone(spark):
    chunks = spark.createDataFrame([(1, "red apple", "x", "d1", "https://a", "A", "red", "f1"), (2, "green pear", "y", "d2", "https://b", "B", "green", "f2")],
                                   "chunk_id long, text string, corpus string, document string, url string, tier string, title string, fingerprint string")
    queries = spark.createDataFrame([(1, "apple", "fruit"), (2, "pear", "other"), (3, "pear", "none"), (4, "pear", "empty")], "query_id long, text string, route string")
    recipe = answers.Recipe({"fruit": ("x",), "other": ("y",), "empty": ("z",)})
    index = spark.createDataFrame([(1, "f1"), (2, "old")], "chunk_id long, fingerprint string")
    results, states = answers.answer(queries, chunks, words, recipe, index)
    assert {x["query_id"]: (x["method"], x["reason"]) for x in states.collect()} == {
        1: ("hybrid", None), 2: ("bm25", "index is stale"), 3: ("none", "not a question for a corpus"), 4: ("none", "no eligible corpus"),
    }
    assert sorted((x["query_id"], x["chunk_id"]) for x in results.collect()) == [(1, 1), (2, 2)]


def test_title_duplicates(spark):
    kind = "id long, title string, number string, signature array<string>"
    left = spark.createDataFrame([(1, "thestory", "", ["a", "b"]), (2, "x", "", []), (3, "other", "31", ["q"]), (4, "nothing", "", [])], kind)
    right = spark.createDataFrame([(7, "afterthestoryends", ["a"]), (8, "thestory", ["z"]), (9, "chapter31", ["q", "r"]), (10, "xylophone", [])], "id long, title string, signature array<string>")
    got = {x["left"]: (x["right"], x["basis"], x["similarity"]) for x in links.title_duplicates(left, right).collect()}
    assert got == {1: (7, ["normalized_title", "text_similarity"], 1.0), 2: (10, ["normalized_title"], 0.9), 3: (9, ["chapter_number", "text_similarity"], 1.0)}


def test_role_relations_are_no_links():
    assert not set(links.ROLE_RELATIONS) & {"LINKS_TO", "PRECEDES", "FOLLOWS", "GUIDES_TO"}


def test_typed_rules(spark):
    pairs = spark.createDataFrame([(1, 0, "Ann is a friend and foe of Bo", "Ann", "Bo"), (1, 1, "Ann founded the Club", "Ann", "Club"), (1, 2, "Ann founded the Club", "Ann", "Club")],
                                  "k int, sentence int, evidence string, source string, target string")
    near = "{s}.{0,40}{t}"
    rules = [graph.RelationRule("ALLY", near, 0.7, "person", "person", "friend", "bond"), graph.RelationRule("FOE", near, 0.7, "person", "person", "foe", "bond"),
             graph.RelationRule("CREATED_BY", "{s} founded .{0,9}{t}", 0.8, "person", "group", flipped=True)]
    got = sorted((x["source"], x["relation"], x["target"]) for x in graph.typed_relations(pairs, {"Ann": "person", "Bo": "person", "Club": "group"}, rules, "k").collect())
    assert got == [("Ann", "ALLY", "Bo"), ("Club", "CREATED_BY", "Ann")]


def test_assertions(spark):
    turns = spark.createDataFrame([(1, 0, "Kim", "I trust Bo. I trust Bo, and Ann trusts Bo"), (1, 1, "Bo", "maybe I trust Ann"), (1, 2, "Bo", "I trust Bo")], "k int, t int, who string, text string")
    rule = dialogue.Assertion("TRUSTS", " trusts? ", 0.7)
    got = sorted((x["t"], x["source"], x["target"]) for x in dialogue.assertions(turns, "k", "t", "who", "text", ["Ann", "Bo"], "I", [rule], ["maybe"]).collect())
    assert got == [(0, "Ann", "Bo"), (0, "Kim", "Bo")]


def test_cues_of_json_and_plain_text(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"body": [{"from": 1, "to": 2.5, "content": " hi "}, {"start": 3, "end": 4, "text": "ho"}, {"content": ""}]}')
    got = sorted((x["start_seconds"], x["end_seconds"], x["content"]) for x in files.json_cues(spark, f"file://{tmp_path}/a.json").collect())
    assert got == [(1.0, 2.5, "hi"), (3.0, 4.0, "ho")]
    (tmp_path / "b.json").write_text('{"other": 1}')
    with pytest.raises(Exception, match="no list of cues"):
        files.json_cues(spark, f"file://{tmp_path}/b.json").collect()
    texts = spark.createDataFrame([("a\n\na\nb\na",)], "t string").withColumn("k", F.lit(1))
    assert [x["content"] for x in files.plain_cues(texts, "k", "t").orderBy("position").collect()] == ["a", "b", "a"]


def test_cleaned_cues(spark):
    rows = [(1, i, t) for i, t in enumerate(["a &amp; b", "a  & b", "[noise]", "a & b", "&#99;"])]
    cues = spark.createDataFrame(rows, "k int, t int, c string")
    assert [x["c"] for x in dialogue.cleaned_cues(cues, "k", "t", "c", r"^\[.*\]$").orderBy("t").collect()] == ["a & b", "c"]


def test_digest_and_readiness(spark):
    users = spark.createDataFrame([(1,), (2,)], "u int")
    kept = spark.createDataFrame([(1, "pref", 1, "tea"), (1, "name", 2, "Kim"), (1, "pref", 3, "rain"), (1, "odd", 4, "x")], "u int, kind string, at int, content string")
    got = {x["u"]: x["digest"] for x in dialogue.digests(users, kept, "u", {"pref": "Likes", "name": "Names"}, 1, "(none)").collect()}
    assert got == {1: "[Likes]\n- rain\n\n[Names]\n- Kim", 2: "(none)"}
    reviews = spark.createDataFrame([(10, 8, 0)], "reviewed long, matches long, critical long")
    data = "bulk long, main_documents long, chunks long, all_have_source boolean, fixtures long"
    ask = lambda *x: dialogue.readiness(reviews, spark.createDataFrame([x], data), reviewed=10, matches=8, documents=8, chunks=120).first()
    assert ask(0, 8, 120, True, 0)["ready"] and ask(0, 7, 120, True, 1)["unmet"] == "enough_documents;no_fixtures"
    assert "one by one" in ask(1, 8, 120, True, 0)["reason"]


def test_exported_texts_come_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a\n\nb\x1ec", "x"), (2, None, None)], "id int, text string, lang string")
    files.export_text(docs, f"file://{tmp_path}/out", ["id", "lang"], "text")
    got = sorted((x["head"], x["body"]) for x in files.read_exported(spark, f"file://{tmp_path}/out").collect())
    assert got == [("id: 1\nlang: x", "a\n\nbc"), ("id: 2\nlang: ", "")]


def test_sections_of_a_page(spark):
    page = ('<title>Start</title><a href="/a">first</a><h2>Read before</h2><a href="/b">Bee</a><a href="/b">again</a><div class="ad">Buy <b>now</b></div>'
            '<h2>Read after</h2><a href="https://ok.org/c">Sea</a><a href="https://no.org/d"></a><article>Version: 1.2 and a long enough text</article>')  # fmt: skip
    pages = spark.createDataFrame([(1, "https://ok.org/x", page), (2, "https://ok.org/y", None)], "page_id long, url string, html string")
    rows = html.sections(pages).join(pages.select("page_id", "url"), "page_id")
    first = html.navigation(rows, "page_id", {"version": ("Version",)}, ("before",), ("after",)).filter("page_id = 1").first()
    assert (first["prerequisites"], first["followups"]) == (["Bee"], ["Sea", "https://no.org/d"]) and first["version"].startswith("1.2")
    out = html.outbound(rows, "page_id", "url", {"ok.org": ("/",)}).collect()
    assert sorted(x["href"] for x in out) == ["https://ok.org/a", "https://ok.org/b", "https://ok.org/c"]
    assert [x["heading"] for x in html.keyword_headings(rows, "page_id", ("after",)).collect()] == ["Read after"]
    assert [x["notice"] for x in html.notices(rows, "page_id").collect()] == ["Buy now"]


def test_signatures_of_short_and_missing_texts(spark):
    rows = [(1, "ab cd\u00a0efg"), (2, "xy"), (3, ""), (4, None), (5, "aaaa aaaa")]
    got = {r.k: r.g for r in spark.createDataFrame(rows, "k int, t string").select("k", graph.shingle_signature(F.col("t"), size=2).alias("g")).collect()}
    of = lambda *runs: sorted(sha256(x.encode()).hexdigest()[:16] for x in runs)[:2]
    assert got == {1: of("abcde", "bcdef", "cdefg"), 2: of("xy"), 3: of(""), 4: [], 5: of("aaaaa")}


def test_common_hashes_make_no_rows_of_pairs(spark):
    """Signatures with one half in common that is too small, so that every two would be compared."""
    common = [f"c{i}" for i in range(20)]
    rows = [(i, sorted([*common, *(f"o{i}-{j}" for j in range(44))])) for i in range(600)] + [(600, sorted(common[:8])), (601, sorted(["x", "y"])), (602, ["x"]), (603, [])]
    made = graph.near_duplicates(spark.createDataFrame(rows, "k int, signature array<string>"), "k")
    got = {(r.a, r.b): r.similarity for r in made.collect()}
    assert got == {(i, 600): 1.0 for i in range(600)} | {(601, 602): 1.0}
    assert "Join" not in made._jdf.queryExecution().analyzed().toString().split("FlatMapCoGroupsInArrow", 1)[1]
