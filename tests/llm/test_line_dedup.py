from collections import Counter

from loomcorpus.llm import line_dedup as L


def brute(docs):
    """Chunks by bytes in a dictionary, first occurrence by id and place."""
    first = {}
    for i, t in sorted((x for x in docs if x[1]), key=lambda x: x[0]):
        lines = t.encode().split(b"\n")
        for s, e in L.chunks(lines):
            if L.removable(lines, s, e):
                first.setdefault(b"\n".join(lines[s:e]), (i, s))
    out = {}
    for i, t in docs:
        if not t:
            out[i] = t
            continue
        lines = t.encode().split(b"\n")
        keep = []
        for s, e in L.chunks(lines):
            body = b"\n".join(lines[s:e])
            if not L.removable(lines, s, e) or first[body] == (i, s):
                keep += lines[s:e]
        out[i] = b"\n".join(keep).decode()
    return out


def test_equals_brute_force(small):
    docs = [(r["doc_id"], r["text"]) for r in small.collect()]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(small).collect()}
    assert got == brute(docs)
    assert any(got[i] != t for i, t in docs)


def test_boundaries_fall_into_step_after_an_insertion():
    lines = [f"line number {i}".encode() for i in range(60)]
    a = [b"\n".join(lines[s:e]) for s, e in L.chunks(lines)]
    shifted = [b"something new", *lines]
    b = [b"\n".join(shifted[s:e]) for s, e in L.chunks(shifted)]
    assert a[-12:] == b[-12:]  # of 19: some chunks after the insertion, all are the same again


def test_chunks_cover_a_text():
    lines = [b"x"] * 500 + [b"word " * 60] + [b""]
    ends = [0]
    for s, e in L.chunks(lines):
        assert s == ends[-1] and e > s and e - s <= L.MOST
        ends.append(e)
    assert ends[-1] == len(lines)


def test_long_line_goes_and_short_lines_stay(make):
    long = " ".join(f"w{i}" for i in range(60))
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(make("a\n" + long, "b\n" + long + "\nc", "a", "a")).collect()}
    assert got == {0: "a\n" + long, 1: "b\nc", 2: "a", 3: "a"}


def test_nulls_empties_clashes_and_repeats(make, spark):
    docs = make(None, "", (None, "p\nq\nr\ns"), (7, "p\nq\nr\ns"), (8, "p\nq\nr\ns"), (8, "p\nq\nr\ns"))
    docs = docs.selectExpr("*", "1 AS n_lines", "2 AS place", "3 AS hash", "4 AS chunk", "5 AS places")
    rows = L.dedup_lines(docs).collect()
    assert len(rows) == 6
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert got[(0, None)] == 1 and got[(1, "")] == 1 and got[(7, "p\nq\nr\ns")] == 1
    assert got[(None, "")] == 1 and got[(8, "")] == 2
    assert L.dedup_lines(docs.limit(0)).count() == 0


def test_rows_of_one_id_are_told_apart(make):
    """Neither unique texts nor all copies are lost where ids are repeated or null."""
    docs = make((1, "a b\nc d"), (5, "a b\nc d"), (5, "unique one\nunique two"), (None, "only\nhere"), (None, "a b\nc d"), (9, "e f\ng h"), (9, "e f\ng h"))
    docs = docs.selectExpr("*", "1 AS _row", "2 AS row", "3 AS _id", "4 AS _places", "5 AS pairs", "6 AS key")
    for whole in (False, True):
        rows = L.dedup_lines(docs, whole=whole)
        assert [c for c in rows.columns if c not in docs.columns] == ["n_lines", "n_removed_lines"]
        assert {(r["_row"], r["row"], r["_id"], r["_places"], r["pairs"], r["key"]) for r in rows.collect()} == {(1, 2, 3, 4, 5, 6)}
        got = Counter((r["doc_id"], r["text"]) for r in rows.collect())
        assert got == Counter([(1, "a b\nc d"), (5, ""), (5, "unique one\nunique two"), (None, "only\nhere"), (None, ""), (9, "e f\ng h"), (9, "")])


def test_very_long_texts(make):
    long = "\n".join(f"line {i} of many" for i in range(60_000))
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(make(long, "new\n" + long, "w " * 500_000), whole=True).collect()}
    assert got[0] == long and len(got[1]) < 1000 and len(got[2]) == 1_000_000


def brute_passages(docs):
    """Chunks as above; then runs of lines whose pairs occurred before, found in a dictionary."""
    chunked = {}
    first, seen = {}, set()
    for i, t in sorted(docs):
        lines = t.encode().split(b"\n")
        for s, e in L.chunks(lines):
            if L.removable(lines, s, e) and first.setdefault(b"\n".join(lines[s:e]), (i, s)) != (i, s):
                chunked.setdefault(i, set()).update(range(s, e))
    out = {}
    for i, t in sorted(docs):
        lines = t.encode().split(b"\n")
        worded = [k for k, x in enumerate(lines) if x.split()]
        old = []
        for a, b in zip(worded, worded[1:]):
            old.append((lines[a], lines[b]) in seen)
            seen.add((lines[a], lines[b]))
        gone = set(chunked.get(i, ()))
        k = 0
        while k < len(old):
            end = k
            while end < len(old) and old[end]:
                end += 1
            if end > k:
                run = range(worded[k], worded[end] + 1)
                if set(run) & chunked.get(i, set()) or sum(len(lines[x].split()) for x in run) > 50:
                    gone |= set(run)
            k = end + 1
        out[i] = b"\n".join(x for k, x in enumerate(lines) if k not in gone).decode()
    return out


def test_whole_passages_go(make):
    """Shared runs of 4 lines and 52 words in fresh surroundings, of which chunks alone leave most."""
    docs = []
    for k in range(60):
        run = [" ".join(f"r{k}w{i}x{j}" for j in range(13)) for i in range(4)]
        for copy in range(2):
            fresh = [f"{side} {k} {copy} {i}" for side in ("before", "after") for i in range(3)]
            docs.append((copy * 100 + k, "\n".join(fresh[:3] + run[:2] + [""] * copy + run[2:] + fresh[3:])))
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(make(*docs), whole=True).collect()}
    for i, t in docs:
        assert got[i] == (t if i < 100 else "\n".join(x for x in t.split("\n") if x.startswith(("before", "after"))))
    chunked = L.dedup_lines(make(*docs)).filter("doc_id >= 100").collect()
    assert sum("r%dw0x0" % (r["doc_id"] - 100) in r["text"] for r in chunked) > 20


def test_passages_equal_brute_force_and_keep_a_first_of_every_line(small):
    docs = [(r["doc_id"], r["text"]) for r in small.collect() if r["text"]]
    got = {r["doc_id"]: r["text"] for r in L.dedup_lines(small.filter("text <> ''"), whole=True).collect()}
    assert got == brute_passages(docs)
    lines = lambda texts: {x for t in texts for x in t.split("\n") if x.encode().split()}
    assert lines(got.values()) == lines(t for _, t in docs)


def test_a_shared_digest_removes_nothing(make, monkeypatch):
    """Every chunk and pair has the digest of every other one of its length; only equal bytes go."""
    import loomcorpus.llm.line_dedup as module

    monkeypatch.setattr(module, "digest", lambda body: len(body).to_bytes(16, "little"))
    docs = [(i, "\n".join(f"{side} text {i:03d} {k} " + "word " * 6 for k in range(12))) for i, side in enumerate(["left", "rite"] * 8)]
    docs.append((99, docs[3][1]))
    got = {r["doc_id"]: r["text"] for r in module.dedup_lines(make(*docs), whole=True).collect()}
    assert got == {**dict(docs), 99: ""}

