import numpy as np
import pytest

from loomcorpus.llm import decontamination as D
from loomcorpus.llm.words import word_hashes


def words(t):
    return t.lower().split()


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_subsequence_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        assert D.common_subsequence(a, b) == lcs(a.tolist(), b.tolist())


def test_planted_items_are_found_and_nothing_else(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = {r["doc_id"]: " ".join(r["text"].split()) for r in small.collect()}
    items = {r["item_id"]: " ".join(r["text"].split()) for r in bench.collect()}
    want = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(small, bench).collect()}
    assert want <= got
    # whatever else is found shares most words of the item in order
    for d, i in got - want:
        assert lcs(words(items[i]), words(docs[d])) >= D.LIKELY * len(items[i].split())


def test_recall_of_the_search_against_brute_force(spark, small):
    """Paraphrases: each item with every eighth word replaced, in the middle of a document."""
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    rows = small.collect()
    made = []
    for k, r in enumerate(bench.collect()):
        w = r["text"].split()
        w[::8] = [f"swap{j}" for j in range(len(w[::8]))]
        host = rows[k % len(rows)]["text"].split()
        made.append((k, " ".join(host[:80] + w + host[80:200])))
    docs = spark.createDataFrame(made, "doc_id long, text string")
    ids = [r["item_id"] for r in bench.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    found = sum((k, i) in got for k, i in enumerate(ids))
    assert found >= 0.9 * len(ids)


def paraphrased(rng, words, kind):
    out = list(words)
    if kind == "inserted":
        for k in range(0, len(out), 5):
            out.insert(k + k // 5, f"more{rng.integers(1000)}")
    elif kind == "reordered":
        k = len(out) // 5
        out = out[k:] + out[:k]
    else:
        out[::8] = [f"swap{j}" for j in range(len(out[::8]))]
    return out


@pytest.mark.parametrize("n_items,low,high", [(40, 20, 60), (300, 10, 16)])
def test_recall_against_every_stretch_of_every_document(spark, n_items, low, high):
    """Swapped, inserted and reordered paraphrases among prose of common words, for few long items
    and for more short ones than one space takes. Brute force tries every stretch of every pair."""
    rng = np.random.default_rng(n_items)
    lexicon = [f"w{k}" for k in range(3000)]
    draw = lambda n: [lexicon[int(3000 * rng.random() ** 2)] for _ in range(n)]
    items = [draw(int(rng.integers(low, high))) for _ in range(n_items)]
    texts = []
    for k, item in enumerate(items):
        kind = ("inserted", "reordered", "swapped", "none")[k % 4]
        texts.append(draw(60) + (paraphrased(rng, item, kind) if kind != "none" else []) + draw(60))
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, bench).collect()}
    hashes = [word_hashes(" ".join(t)) for t in items]
    want = set()
    for d, t in enumerate(texts):
        h = word_hashes(" ".join(t))
        for i, item in enumerate(hashes):
            n = len(item)
            if sum(np.isin(item, h)) < D.LIKELY * n:
                continue
            for s in range(0, len(h) - n + 1):
                part = h[s : s + n + n // 4]
                share = D.common_subsequence(item, part) / n
                answer = D.common_subsequence(item[-D.ANSWER_WORDS :], part) >= 0.8 * D.ANSWER_WORDS
                if share >= D.SURE or (share >= D.LIKELY and answer):
                    want.add((d, i))
                    break
    assert len(want) >= n_items // 2
    assert len(got & want) >= 0.9 * len(want), (len(got & want), len(want))


def test_extra_columns_long_texts_and_ties(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item)] * 2, "item_id int, text string").selectExpr("*", "1 AS doc_id", "2 AS cosine")
    long = "filler " * 200_000
    docs = spark.createDataFrame([(1, f"x {item} y {item} z"), (2, long), (3, f"{long} {item}"), (4, "x" * 300_000)], "doc_id int, text string")
    docs = docs.selectExpr("*", "1 AS _id", "2 AS item_id", "3 AS term", "4 AS words")
    got = sorted((r["doc_id"], r["item_id"], r["covered"], r["first_word"]) for r in D.find_leaks(docs, bench).collect())
    assert [x[:3] for x in got] == [(1, 1, 1.0)] * 2 + [(3, 1, 1.0)] * 2 and all(x[3] <= 1 for x in got[:2])
    kept = D.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4]


def test_answer_decides_between_thresholds(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item, "iota kappa"), (2, None, None), (3, "", "x")], "item_id long, text string, answer string")
    filler = " ".join(f"f{i}" for i in range(50))
    docs = spark.createDataFrame([
        (1, f"{filler} alpha beta gamma x1 x2 x3 x4 theta iota kappa {filler}"),
        (2, f"{filler} alpha beta gamma delta epsilon zeta x5 x6 x7 x8 {filler}"),
        (3, filler), (4, None), (5, ""), (6, item), (6, item),
    ] + [(k, f"only g{k} h{k}") for k in range(10, 300)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["answer_found"]) for r in D.find_leaks(docs, bench).collect())
    assert got == [(1, 1, True), (6, 1, True), (6, 1, True)]
    assert sorted(r["doc_id"] for r in D.without_leaks(docs, bench).filter("doc_id < 10").collect()) == [2, 3, 4, 5]


def test_empty_tables(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    assert D.find_leaks(small.limit(0), bench).count() == 0
    assert D.find_leaks(small, bench.limit(0)).count() == 0


def test_lots_are_bounded_by_items_and_characters(make, monkeypatch):
    assert list(D.lots([3, 3, 3, 9, 1, 1, 1], 2, 6, int)) == [[3, 3], [3], [9], [1, 1], [1]]
    assert list(D.lots([], 2, 6, int)) == []
