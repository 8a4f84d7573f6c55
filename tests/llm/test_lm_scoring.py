import math
import zlib
from collections import Counter

import numpy as np
import pytest

from loomcorpus.llm import lm_scoring as M


def tokens(t):
    return (t or "").encode().lower().split() + [b" end"]


def base(docs):
    train = Counter(w for i, t in docs if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return {i: (len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in docs}


@pytest.mark.parametrize("size", [1_000_000, 300])
def test_counts_and_base_equal_brute_force(small, monkeypatch, size):
    """With one block a partition, and with many."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", size)
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    want = base(docs)
    rows = M.score_documents(small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, known, total, score = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n, known, total)
        assert r["base_score"] == pytest.approx(score, rel=1e-9)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)


def test_model_beats_the_base_on_held_out_texts(small):
    held = M.score_documents(small).filter("held_out").collect()
    assert sum(r["score"] for r in held) > 1.05 * sum(r["base_score"] for r in held)


def counted(docs):
    """Counts of words, pairs and triples of some texts, and how often contexts were seen."""
    c = [Counter(), Counter(), Counter()]
    for t in docs:
        w = ["<<", "<", *tokens(t)]
        c[0]["<"] += 1
        for i in range(2, len(w)):
            c[0][w[i]] += 1
            c[1][tuple(w[i - 1 : i + 1])] += 1
            c[2][tuple(w[i - 2 : i + 1])] += 1
    return c


def octave(c):
    return min(c.bit_length(), M.OCTAVES - 1)


def terms(c, w, i, n, v, order):
    """(class, the four estimates) of token i of a text."""
    longer = 0 if order == 2 else c[0]["<"] if w[i - 1] == "<" else c[1][tuple(w[i - 2 : i])]
    shorter = c[0][w[i - 1]]
    kind = octave(longer) * M.OCTAVES + octave(shorter)
    p3 = c[2][tuple(w[i - 2 : i + 1])] / longer if longer else 0.0
    p2 = c[1][tuple(w[i - 1 : i + 1])] / shorter if shorter else 0.0
    return kind, (p3, p2, c[0][w[i]] / n, 1 / (v + 1))


@pytest.mark.parametrize("size,order", [(1_000_000, 2), (5000, 2), (5000, 3)])
def test_score_equals_the_mixture_by_brute_force(small, monkeypatch, size, order):
    """Counts, contexts, classes and the weights' EM again in dictionaries and plain loops."""
    monkeypatch.setattr(M, "BLOCK_TOKENS", size)
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    rest = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in docs}
    train = counted([t for i, t in docs if rest[i] != 1])
    kept = counted([t for i, t in docs if rest[i] not in (1, 2)])
    n = sum(x for w, x in train[0].items() if w != "<")
    v = len(train[0]) - 1
    n_kept = n - sum(len(tokens(t)) for i, t in docs if rest[i] == 2)
    learned = []
    for i, t in docs:
        if rest[i] == 2:
            w = ["<<", "<", *tokens(t)]
            learned += [terms(kept, w, k, n_kept, v, order) for k in range(2, len(w))]
    every = np.array([0.3, 0.3, 0.3, 0.1])
    found = {kind: every for kind in [*(k for k, _ in learned), None]}  # None: a class without tokens
    for _ in range(M._ITERATIONS):
        total, sums = np.zeros(4), {kind: np.zeros(4) for kind in found}
        for kind, p in learned:
            total += every * p / np.dot(every, p)
            sums[kind] += found[kind] * p / np.dot(found[kind], p)
        every = (total + 1e-9) / (total + 1e-9).sum()
        old, found = found, {kind: (x + M._PRIOR * every + 1e-9) / (x + M._PRIOR * every + 1e-9).sum() for kind, x in sums.items()}
        if max(np.abs(found[k] - old[k]).max() for k in found) < M._STILL:
            break
    weights = {}
    for r in M.score_documents(small, order).collect():
        w = ["<<", "<", *tokens(dict(docs)[r["doc_id"]])]
        total = 0.0
        for k in range(2, len(w)):
            kind, p = terms(train, w, k, n, v, order)
            if kind not in weights:
                x = found.get(kind, found[None]).copy()
                x[0] *= kind // M.OCTAVES > 0
                x[1] *= kind % M.OCTAVES > 0
                weights[kind] = x / x.sum()
            total += math.log10(float(np.dot(weights[kind], p)))
        assert r["score"] == pytest.approx(total, rel=1e-6)


def test_the_mixture_sums_to_one_over_the_vocabulary():
    """After any context, over all known words and one unknown one."""
    rng = np.random.default_rng(3)
    lengths = np.full(50, 9)
    tokens = rng.integers(0, 6, 450).astype(np.int32)
    tokens[8::9] = 6  # the end
    g = M.Grams(tokens, lengths, 7, rng.integers(1, 1 << 62, 8).astype(np.uint64), 4)
    c1 = np.bincount(tokens, minlength=8)
    c1[7] = 50
    c2, c3 = np.bincount(g.pair, minlength=len(g.pairs)), np.bincount(g.triple, minlength=len(g.triples))
    weights = np.tile([0.3, 0.3, 0.3, 0.1], (M.OCTAVES**2, 1))
    two = {(int(a), int(b)): int(c2[p]) for a, b, p in zip(g.before, tokens, g.pair)}
    three = {(int(a), int(b)): int(c3[p]) for a, b, p in zip(g.context, tokens, g.triple)}
    for at in (3, 100, 200):
        u, context = int(g.before[at]), int(g.context[at])
        kind = M.classes(np.array([c2[context]]), np.array([c1[u]]))[0]
        w = weights[kind]
        total = sum(w[0] * three.get((context, x), 0) / c2[context] + w[1] * two.get((u, x), 0) / c1[u] + w[2] * c1[x] / 450 + w[3] / 8 for x in range(7))
        assert total + w[3] / 8 == pytest.approx(1)


def test_em_finds_weights():
    """Tokens that only the trigram explains pull its weight up; a class without tokens has all's."""
    kind = np.repeat([5 * M.OCTAVES + 6, 7], [1000, 100])
    p = np.tile([0.0, 0.0, 1e-6, 1e-3], (1100, 1))
    p[:900, 0] = 1.0
    weights, every = np.tile([0.3, 0.3, 0.3, 0.1], (M.OCTAVES**2, 1)), np.array([0.3, 0.3, 0.3, 0.1])
    for _ in range(20):
        weights, every = M.after_round(M.shares(kind, p, weights, every), every)
    assert weights[5 * M.OCTAVES + 6][0] > 0.85 and weights[7][0] < 0.6 and np.allclose(weights[9], every)
    assert np.allclose(weights.sum(1), 1)


def test_ids_of_any_kind(spark):
    for kind in ("int", "string", "long"):
        docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string").selectExpr(f"CAST(doc_id AS {kind}) AS doc_id", "text")
        out = M.score_documents(docs)
        assert out.schema["doc_id"].dataType == docs.schema["doc_id"].dataType and out.count() == 2


def test_planes_round_trip():
    for kind in (np.uint32, np.int64, np.uint64, np.int32):
        a = np.arange(1000, dtype=kind) ** 2
        assert np.array_equal(M.unplanes(M.planes(a), kind), a)
    assert len(M.unplanes(M.planes(np.zeros(0, np.int64)), np.int64)) == 0


def test_nulls_empties_repeats_and_clashes(make):
    docs = make(None, "", (None, "a b"), (5, "A b"), (5, "A b"), (9, "x " * 3000)).selectExpr("*", "1 AS score", "2 AS block")
    rows = M.score_documents(docs).collect()
    assert len(rows) == 6
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["n_tokens"] == 1 and by[1]["n_tokens"] == 1 and by[9]["n_tokens"] == 3001 and not by[None]["held_out"]
    assert M.score_documents(docs.limit(0)).count() == 0
