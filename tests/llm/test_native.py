"""Quality rules and sharding."""

import numpy as np
import pytest

from loomcorpus.llm import quality as Q
from loomcorpus.llm import sharding as S
from loomcorpus.llm.scratch import materialize


def facts(t):
    """The base counts, by plain loops."""
    w = (t or "").encode().split()
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {j for places in windows.values() if len(places) > 1 for i in places for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    chars = sum(len(x.decode()) for x in w)
    symbols = sum((t or "").count(c) for c in "#*$%&|<>")
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), chars, symbols, len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(small):
    want = {r["doc_id"]: facts(r["text"]) for r in small.collect()}
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in Q.statistics(small).collect()}
    assert got == want


@pytest.mark.parametrize("text", ["", None, "a " * 9, "x y z " * 30, "a b c d e f g h a b c d e f g h", " \n\t ", "one\none\n\none", "w " * 20000])
def test_counts_of_odd_texts(make, text):
    r = Q.statistics(make(text)).first()
    assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == facts(text)


def test_clean_documents_stay_and_junk_goes(spark):
    d = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [r for r in Q.op6_robust_outliers(spark, d).collect() if r["doc_id"] in labels]
    clean = [r for r in rows if labels[r["doc_id"]] == 1 and not r["base_failed"]]
    junk = [r for r in rows if labels[r["doc_id"]] == 0]
    assert sum(r["kept"] for r in clean) == len(clean)
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)


def test_chi_square_and_inverse(spark):
    assert Q.chi_square(0.95, 2) == pytest.approx(5.991465, abs=1e-5)
    assert Q.chi_square(0.975, 5) == pytest.approx(12.832502, abs=1e-5)
    rng = np.random.default_rng(0)
    a = rng.normal(size=(5, 5))
    scatter = a @ a.T + np.eye(5)
    from pyspark.sql import functions as F

    row = spark.range(1).select(F.lit("g").alias("g"), *[F.lit(0.0).alias(f"m{i}") for i in range(5)],
                                *[F.lit(float(scatter[i, j])).alias(f"c{i}_{j}") for i, j in Q._PAIRS])
    got = Q._inverted(row, ["g"]).first()
    inverse = np.linalg.inv(scatter)
    assert all(got[f"q{i}_{j}"] == pytest.approx(inverse[i, j], rel=1e-9, abs=1e-12) for i, j in Q._PAIRS)
    assert got["logdet"] == pytest.approx(np.linalg.slogdet(scatter)[1])


_VECTORS = "lang string, source string, " + ", ".join(f"{f} long" for f in Q.FEATURES)


def test_estimates_resist_a_quarter_of_outliers(spark):
    """The fitted centre is that of the clean three quarters, as the plain mean is not."""
    rng = np.random.default_rng(2)
    good, bad = rng.normal(100, 20, (3000, 5)), rng.normal(4000, 20, (700, 5))
    df = spark.createDataFrame([("en", "s", *map(int, r)) for r in np.vstack([good, bad])], _VECTORS)
    for m in Q.fit(Q.levels(df)).collect():
        assert all(abs(m[f"m{i}"] - 100) < 5 for i in range(5))


def test_pairs_of_few_rows_lean_on_their_language(spark):
    """A hot source beside rare ones: junk of a source of its own is no centre."""
    rng = np.random.default_rng(3)
    rows = [("en", "hot", *map(int, r)) for r in rng.normal(1000, 60, (400, 5))]
    rows += [("en", "rare", *[1000 + k] * 5) for k in range(5)] + [("en", "junk", *[9000 + k] * 5) for k in range(5)]
    rows += [("fr", "lone", *[9000] * 5), ("de", None, *[1000] * 5)]  # languages of one row: all rows weigh more
    df = spark.createDataFrame(rows, _VECTORS).selectExpr("*", "false AS base_failed")
    judged = Q.judge(df, Q.fitted(df)).filter("source IS NULL OR source <> 'hot'").collect()
    kept = {(r["source"] or "none", r["kept"]) for r in judged}
    assert kept == {("rare", True), ("junk", False), ("lone", False), ("none", True)}


def plain_fit(x):
    """(rows, centre, scatter) of one group, by the rules of the module in plain numpy."""
    floor = np.diag([float(Q.FLOORS[f] ** 2) for f in Q.FEATURES])
    d = x.shape[1]
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)

    def moments(part, factor):
        m = part.mean(0)
        return m, factor * ((part[:, :, None] * part[:, None, :]).mean(0) - np.outer(m, m)) + floor

    q = np.percentile(x, [25, 50, 75], axis=0)
    models = [(q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor), moments(x, 1.0)]
    least = None
    for _ in range(Q.STEPS):
        after = []
        for m, c in models:
            bucket = np.floor(32 * np.log2(1 + 16 * d2(m, c)))
            values, counts = np.unique(bucket, return_counts=True)
            before = np.cumsum(counts) - counts
            after.append(moments(x[np.isin(bucket, values[before < Q.SUPPORT * len(x)])], Q._consistency(Q.SUPPORT, d)))
        same = all(np.allclose(a[1], b[1]) for a, b in zip(after, models))
        models = after
        for m, c in models:
            if least is None or np.linalg.slogdet(c)[1] < np.linalg.slogdet(least[1])[1] - 1e-9:
                least = (m, c)
        if same:
            break
    good = x[d2(*least) <= Q.chi_square(0.975, d)]
    return len(good), *moments(good, Q._consistency(0.975, d))


@pytest.mark.parametrize("table", ["sf0.001", "sf0.1"])
def test_verdicts_equal_plain_numpy(spark, table):
    """On a table of small pairs, and on one with pairs of thousands of rows."""
    docs = spark.read.parquet(f"/root/testdata/{table}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = materialize(Q.statistics(docs).drop("text"), "test-statistics")
    got = {r["doc_id"]: r["kept"] for r in Q.judge(rows, Q.fitted(rows)).collect()}
    held = rows.toPandas()
    good = held[~held["base_failed"]]
    draw = lambda own, wide: [(own[0] * a + Q.PRIOR_ROWS * b) / (own[0] + Q.PRIOR_ROWS) for a, b in zip(own[1:], wide)]
    top = plain_fit(good[list(Q.FEATURES)].to_numpy(float))
    want = {i: False for i in held["doc_id"]}
    for _, of_lang in good.groupby("lang", dropna=False):
        lang = draw(plain_fit(of_lang[list(Q.FEATURES)].to_numpy(float)), top[1:])
        for _, pair in of_lang.groupby("source", dropna=False):
            x = pair[list(Q.FEATURES)].to_numpy(float)
            m, c = draw(plain_fit(x), lang)
            d2 = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            want |= dict(zip(pair["doc_id"], d2 <= Q.chi_square(Q.QUANTILE, len(Q.FEATURES))))
    assert sum(got[i] != want[i] for i in want) <= len(want) // 2000, [i for i in want if got[i] != want[i]][:20]
    assert 0 < sum(got.values()) < len(got)


def test_filter_edges(make, spark):
    docs = make(None, "", *["some words of a plain text that goes on for a while with more than twenty words in it so it is kept"] * 3, lang=None, source=None)
    docs = docs.selectExpr("*", "1 AS g", "2 AS kept", "3 AS n_words")
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]
    assert Q.quality_filter(docs.limit(0)).count() == 0


def test_shards_slots_and_growth(spark):
    rows = S.op9_hash_tree_shards(spark, "/root/testdata/sf0.01").collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert 0 < sum(r["grown_shard"] == 16 for r in rows) < 2 * len(rows) / 17


def test_weights_move_rows_only_within_their_subtrees(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    before = S.topology(16)
    after = [S.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 5 else 1.0) for x in before]
    a = {r["doc_id"]: r["shard"] for r in S.assign(keys, "doc_id", before).collect()}
    b = {r["doc_id"]: r["shard"] for r in S.assign(keys, "doc_id", after).collect()}
    place = {x.shard: (x.region, x.rack) for x in before}
    for k in a:
        if a[k] != b[k]:  # a row that moves comes into the region, the rack or the shard that grew
            old, new = place[a[k]], place[b[k]]
            assert new[0] == "r0" and (old[0] != "r0" or (new == place[5] and (old != new or b[k] == 5)))
    share = sum(v == 5 for v in b.values()) / len(b)
    assert abs(share - 3 / 18) < 0.03


def descent(key, leaves, spark):
    """The shard of one key: each level's draws compared one by one."""
    from pyspark.sql import functions as F

    def draw(child, weight):
        bits = (spark.range(1).select(F.xxhash64(F.lit(0), F.lit(child), F.lit(str(key)))).first()[0] & (1 << 64) - 1) >> 12
        return -np.log((bits + 0.5) / (1 << 52)) / weight

    at, path = list(leaves), "/"
    for level in ("region", "rack", "shard"):
        weights = {}
        for x in at:
            weights[str(getattr(x, level))] = weights.get(str(getattr(x, level)), 0.0) + x.weight
        name = min(weights, key=lambda n: draw(f"{path}{n}" + ("/" if level != "shard" else ""), weights[n]))
        at, path = [x for x in at if str(getattr(x, level)) == name], f"{path}{name}/"
    return at[0].shard


def test_shards_equal_a_descent_by_hand(spark):
    leaves = [S.Leaf(x.region, x.rack, x.shard, 1.0 + x.shard % 3) for x in S.topology(16)]
    got = {r["doc_id"]: r["shard"] for r in S.assign(spark.range(25).withColumnRenamed("id", "doc_id"), "doc_id", leaves).collect()}
    assert got == {k: descent(k, leaves, spark) for k in range(25)}


def test_sharding_edges(make):
    clash = ["_row", "_part", "_nth", "_start", "_k0", "_k1", "part", "nth", "start", "k0", "region", "rack", "leaf"]
    docs = make(None, (None, "a"), (None, "b"), (7, "x"), (7, "x")).selectExpr("*", "1 AS shard", "2 AS slot", *[f"9 AS {c}" for c in clash])
    table = S.shard_rows(docs, "doc_id", S.topology(16), S.topology(17), rows=2)
    rows = table.collect()
    assert set(table.columns) == {*docs.columns, "grown_shard"} and all(r[c] == 9 for r in rows for c in clash)
    assert len(rows) == 5 and len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5
    assert S.shard_rows(docs.limit(0), "doc_id", S.topology(16)).count() == 0
    with pytest.raises(ValueError):
        S.topology(3)


def test_a_hot_key_is_numbered_in_parts(spark):
    docs = spark.range(5000).selectExpr("IF(id % 3 = 0, 7, id) AS doc_id")
    rows = S.shard_rows(docs, "doc_id", S.topology(16), rows=100).collect()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
