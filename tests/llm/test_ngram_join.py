import numpy as np
import pytest

from loomcorpus.llm import ngram_join as J


def brute(docs, n, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n,percent,cell", [(3, 90, 500_000), (5, 80, 500_000), (5, 80, 1500)])
def test_equals_brute_force(small, monkeypatch, n, percent, cell):
    """In one cell a block, and with blocks dealt over cells."""
    monkeypatch.setattr(J, "CELL", cell)
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(small, n, percent).collect()}
    assert got == brute(docs, n, percent)


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_linked_sets_share_enough_of_their_prefixes(percent):
    """The blocking loses no link, at many sizes, with common shingles and without."""
    rng = np.random.default_rng(percent)
    tried = 0
    for size in [*range(1, 40), 63, 64, 65, 100, 250, 1000]:
        for _ in range(12):
            a = rng.integers(0, 1 << 63, size).astype(np.uint64)
            k = size - int(np.ceil(percent * size / 100))
            b = a[rng.permutation(size)[: size - rng.integers(0, k + 1)]]
            extra = max(0, (100 * len(b)) // percent - size)
            b = np.concatenate([b, rng.integers(0, 1 << 63, rng.integers(0, extra + 1)).astype(np.uint64)])
            x, y = np.unique(a), np.unique(b)
            both = len(np.intersect1d(x, y))
            if 100 * both >= percent * (len(x) + len(y) - both):
                tried += 1
                for common in (None, np.unique(rng.choice(x, len(x) // 3))):
                    shared = len(np.intersect1d(J.prefix(x, percent, common), J.prefix(y, percent, common)))
                    assert shared >= max(J.needed(len(x), percent), J.needed(len(y), percent)), (size, len(y))
    assert tried > 100


def test_chain_is_one_component_and_a_hot_group_too(make):
    words = [f"w{i}" for i in range(200)]
    chain = [" ".join(words[k : k + 150]) for k in range(0, 40, 4)]
    hot = [" ".join([*words[50:], f"x{k}", "end"]) for k in range(60)]
    docs = [(k, t) for k, t in enumerate([*chain, *hot, *[hot[0]] * 30])]
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(make(*docs), 3, 90).collect()}
    assert got == {i: c for i, (_, c) in brute(docs, 3, 90).items()}


def test_nulls_empties_short_and_clashes(make):
    docs = make(None, "", "  \n ", "One", "one", "one two", (None, "one two"), (9, "a b c"), (9, "a b c"))
    docs = docs.selectExpr("*", "1 AS component_id", "2 AS n", "3 AS kind", "4 AS a", "5 AS b")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs, 3, 90).collect()), key=str)
    assert got == sorted([(0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 3), (5, 1, 5), (None, 1, 5), (9, 1, 9), (9, 1, 9)], key=str)
    assert J.jaccard_components(docs.limit(0)).count() == 0
    assert J.keep_one(docs.limit(0)).count() == 0


def test_keep_one_keeps_one_of_each_group(make):
    text = " ".join(f"w{i}" for i in range(100))
    docs = make(text, text, text + " more", "other words stand here today")
    assert sorted(r["doc_id"] for r in J.keep_one(docs).collect()) == [0, 3]
