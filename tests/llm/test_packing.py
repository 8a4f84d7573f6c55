import random
import zlib

import numpy as np
import pytest

from loomcorpus.llm import packing as P
from loomcorpus.llm.tokens import Encoder

tokenizers = pytest.importorskip("tokenizers")


def test_encoder_equals_the_library():
    path = P.tokenizer_path()
    plain = tokenizers.Tokenizer.from_file(path)
    random.seed(3)
    alphabet = list("ab é'.,!?\n\n  \t12²#|<>_- 　中")
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 16))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a <|endoftext|> b", "Don't. It's\nfine, isn't it?", "word.'s", "x  y", " x", "x ", "\n", ""]
    got = Encoder(path).encode(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_is_a_packing_of_the_documents(spark, small):
    rows = P.pack(small, P.tokenizer_path()).collect()
    plain = tokenizers.Tokenizer.from_file(P.tokenizer_path())
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d in small.collect():
        ids = np.array([*plain.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(by_doc[d["doc_id"]], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == 1024)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024


def exact(lengths, capacity):
    """The fewest bins, by trying every bin for every piece."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                bins[i] += lengths[k]
                place(k + 1, bins)
                bins[i] -= lengths[k]
        place(k + 1, [*bins, lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def packed(bins):
    used = {}
    for filling, times in bins:
        for n in filling:
            used[n] = used.get(n, 0) + times
    return used


def test_the_fewest_bins():
    rng = random.Random(5)
    proved = improved = 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        lengths = [rng.randint(2, capacity) for _ in range(rng.randint(1, 11))]
        counts = {n: lengths.count(n) for n in lengths}
        found = P.search(counts, capacity)
        assert packed(found.bins) == packed(P.best_fit(counts, capacity)) == counts
        assert all(sum(filling) <= capacity and times > 0 for filling, times in found.bins)
        best = exact(lengths, capacity)
        assert found.bound <= best == found.made and found.gap == 0
        proved += found.proved
    assert proved == 150


def test_branching_beats_best_fit_and_reports_its_gap():
    rng = random.Random(9)
    better = 0
    for _ in range(400):
        lengths = [rng.randint(15, 60) for _ in range(12)]
        counts = {n: lengths.count(n) for n in lengths}
        plain, found = sum(t for _, t in P.best_fit(counts, 100)), P.search(counts, 100)
        better += found.made < plain
        stopped = P.search(counts, 100, nodes=0)
        assert stopped.made == plain and stopped.gap in (0, plain - stopped.bound)
    assert better > 0


def test_dominated_fillings():
    counts = {8: 1, 5: 1, 3: 2, 2: 1}
    lengths = sorted(counts)
    assert P.dominated((5, 3), 0, counts, lengths)  # 8 in place of both
    assert P.dominated((3,), 2, counts, lengths)  # 5 in place of 3, or 2 beside it
    assert not P.dominated((8,), 1, counts, lengths)
    assert list(P.fillings(counts, lengths, 8))[0] == (0, (8,))


@pytest.mark.parametrize("counts", [{1: 5000}, {1: 1000}, {1: 700, 2: 5000, 500: 3, 1024: 2}, {1024: 10**9, 1: 10**9}])
def test_many_small_pieces(counts):
    found = P.search(counts, 1024)
    assert packed(found.bins) == counts and found.made == found.bound


def test_large_counts_reach_the_bound():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 4000) for n in range(1, 1025)}
    made = sum(t for _, t in P.pack_counts(counts, 1024))
    assert made <= P.lower_bound(counts, 1024) * 1.003


def test_nulls_empties_long_repeats_and_clashes(make):
    docs = make(None, "", (None, "a"), (5, "a b"), (5, "a b"), (6, "word " * 5000)).selectExpr("*", "1 AS piece", "2 AS length", "3 AS sequence_id")
    rows = P.pack(docs, P.tokenizer_path()).collect()
    assert len([r for r in rows if r["doc_id"] != 6]) == 5
    assert [r["length"] for r in rows if r["doc_id"] == 0] == [1]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert P.pack(docs.limit(0), P.tokenizer_path()).count() == 0
    assert P.pack_counts({}, 8) == []
    with pytest.raises(ValueError):
        P.pack_counts({9: 1}, 8)


def test_a_table_of_null_texts(spark):
    docs = spark.range(1200).selectExpr("id AS doc_id", "CAST(NULL AS STRING) AS text", "1 AS _row", "2 AS _rank", "3 AS part")
    rows = P.pack(docs, P.tokenizer_path()).collect()
    assert len(rows) == 1200 and len({r["sequence_id"] for r in rows}) == 2 and {r["length"] for r in rows} == {1}


def test_all_fillings_prove_what_few_can_not(spark):
    counts = {n: 1 for n in (91, 83, 71, 62, 55, 47, 38, 33, 29, 24, 21, 18, 14, 11, 9, 6, 5, 3)}
    few, every = (P.search(counts, 100, nodes=10**6, limit=k) for k in (1, None))
    assert every.proved and every.made <= few.made
    total = lambda found: sum(t * sum(b) for b, t in found.bins)
    assert total(few) == total(every) == sum(counts)
