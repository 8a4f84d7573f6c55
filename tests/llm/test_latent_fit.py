import numpy as np

from loomcorpus.llm import decontamination as D
from loomcorpus.llm.words import word_hashes


def test_every_document_is_in_the_fitted_matrix(spark, monkeypatch):
    """2,500 documents of three passages, two of which have telling terms."""
    text = lambda i: f"alpha w{i % 50} " + "x " * 70 + f"beta w{i % 50} w{i % 50} " + "x " * 60
    docs = spark.createDataFrame([(i, text(i)) for i in range(2500)], "doc_id long, text string")
    items = D.items_of(spark.createDataFrame([(1, "alpha beta w1 w2 w3 w4"), (2, "w5 w6 w7 alpha")], "item_id long, text string").collect())
    seen, own = [], D.fit

    def fit(passages, *more):
        seen.append(passages.agg({"n": "sum"}).first()[0])
        return own(passages, *more)

    monkeypatch.setattr(D, "fit", fit)
    groups = D._groups(docs, items)
    assert seen == [5000] and np.isfinite(groups[0].targets).all()


def test_rows_of_passages():
    flat = np.concatenate([word_hashes("a " * 64 + "b a b"), word_hashes("c c b")])
    terms = D.Lookup(np.unique(word_hashes("a b")))
    n, start, term, tf = D.passage_rows(flat, np.array([0, 67, 70]), terms)
    a, b = (int(np.searchsorted(terms.terms, word_hashes(w)[0])) for w in "ab")
    rows = sorted(zip(np.frombuffer(term, np.int32).tolist(), np.frombuffer(tf, np.int32).tolist()))
    assert n == 3 and np.frombuffer(start, np.int64).tolist() == [0, 1, 3]
    assert rows == sorted([(a, 64), (a, 1), (b, 2), (b, 1)])
