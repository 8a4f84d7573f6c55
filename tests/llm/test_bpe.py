"""Byte-level BPE against the public library."""

import hashlib
import random

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from loomcorpus.llm import bpe

PATH, PATTERN = bpe.multilingual()


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH, PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def test_random_texts(vocabulary, library):
    rng = random.Random(1)
    pieces = ["a", "ab", "the", " ", "\n", "  ", "\t", "é", "漢", "1", "'s", "!!", "ß", "　", "😀", "\x1c", "\x00", "<|endoftext|>", "é"]
    for _ in range(2000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))
        assert ids(vocabulary.encode(text)) == library.encode_ordinary(text)
        assert vocabulary.decode(vocabulary.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 100_001, "abcab" * 30_000, "漢字" * 30_000, " " * 50_000 + "x", "é" * 40_000])
def test_long_parts(vocabulary, library, text):
    assert ids(vocabulary.encode(text)) == library.encode_ordinary(text)


def test_a_long_text_goes_by_blocks(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG", 100)
    monkeypatch.setattr(bpe, "BLOCK", 7)
    text = "Die Häuser  stehen\n\n hier, it's 1999!" * 40
    assert ids(vocabulary.encode(text)) == library.encode_ordinary(text)


def test_the_cache_stays_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 20)
    own = bpe.Vocabulary(PATH, PATTERN)
    for i in range(200):
        text = f"ragzu{i % 30} same {i}zuk"
        assert ids(own.encode(text)) == library.encode_ordinary(text)
        assert len(own.parts) <= 10 and len(own.parts.older) <= 10


@pytest.mark.parametrize("ranks", [1, 2, 3, 257, 300])
def test_lowest_rank_then_leftmost(ranks):
    """A vocabulary of random merges, by the plain rule."""
    rng = random.Random(ranks)
    known = {bytes([b]): b for b in range(256)}
    while len(known) < 256 + ranks:
        known.setdefault(rng.choice(list(known)) + rng.choice([b"a", b"b", b"ab", b"ba"]), len(known))
    shuffled = list(known)[256:]
    rng.shuffle(shuffled)
    known.update({t: 256 + i for i, t in enumerate(shuffled)})
    queue = bpe.RankQueue(len(known))
    for _ in range(300):
        piece = bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 40)))
        parts = [piece[i : i + 1] for i in range(len(piece))] if piece not in known else [piece]
        while True:
            pairs = [(known[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in known]
            if not pairs:
                break
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.merged(piece, known, queue) == [known[p] for p in parts]
        assert not any(queue.words) and not any(queue.buckets)


def test_unknown_ids_are_an_error(vocabulary):
    with pytest.raises(KeyError):
        vocabulary.decode(np.array([60_000], "<u4").tobytes())


def test_what_is_stale_at_the_end_is_not_popped(vocabulary, library, monkeypatch):
    """A part ends with its last pair, and a gap among the ids is an error too."""
    pops, own = [], bpe.heappop
    monkeypatch.setattr(bpe, "heappop", lambda bucket: pops.append(1) or own(bucket))
    for word in ("anblewhsttible", "hentharesh", "thndatintionston", "oftionntenti"):
        queue = bpe.RankQueue(len(vocabulary.ranks))
        found = bpe.merged(word.encode(), vocabulary.ranks, queue)
        assert found == library.encode_ordinary(word) and not any(queue.words) and not any(queue.buckets)
    assert len(pops) < 72  # as many pairs as were put there
    few = bpe.Vocabulary(PATH, PATTERN)
    few.tokens = few.tokens.slice(0, 300).take(bpe.pa.array([0, None, 2], bpe.pa.int64()))
    with pytest.raises(KeyError):
        few.decode(np.array([0, 1], "<u4").tobytes())


def test_columns_with_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "one one", "x"), (3, "one one", "y"), (None, "ü" * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = df.withColumn("_i", bpe.encoded(F.col("text"), PATH, PATTERN)).withColumn("_d", bpe.decoded(F.col("_i"), PATH, PATTERN)).collect()
    assert sorted(repr((r.doc_id, bytes(r._d).decode(), r.ids)) for r in got) == sorted(repr((a, b or "", c)) for a, b, c in rows)
    empty = df.limit(0).withColumn("_i", bpe.encoded(F.col("text"), PATH, PATTERN))
    assert empty.collect() == []
    assert df.limit(1).select(bpe.decoded(F.lit(None).cast("binary"), PATH, PATTERN).alias("d")).first().d is None


def test_query(spark, library):
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = bpe.op11_bitmap_bpe(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_one_worker_encodes_and_decodes(spark, library):
    """The query holds one vocabulary a task, not one for each way."""
    plan = bpe.op11_bitmap_bpe(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    texts = [None, "", "one one", "ü" * 30_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in df.select("doc_id", bpe.encoded_and_decoded(F.col("text"), PATH, PATTERN).alias("b")).collect():
        text = texts[r.doc_id] or ""
        assert ids(r.b.ids) == library.encode_ordinary(text) and bytes(r.b.bytes) == text.encode()
