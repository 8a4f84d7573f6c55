"""Secret and license scans."""

import hashlib
import re
from re import _constants as C
from re import _parser

from loomcorpus.llm import license_scan as L
from loomcorpus.llm import secret_scan as S
from loomcorpus.llm.license_rules import _GRANT, rules

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base(text):
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found, key=lambda x: (x[1], S.KINDS.index(x[0])))


def test_base_spans_equal_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = S.op7_owned_secrets(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x[0] == k for x in want) for k in S.BASE)
        assert set(joined.split(",")) <= set(r["spans"].split(",")) | {""}


def test_finder_edges():
    key = "AKIA" + "A1B2C3D4E5F6G7H8"
    text = f'é TOKEN : "secret=token: abcdefgh" {key} {"0f" * 14} ſecret=abcdefgh Api_Key=x.y/z+w='
    assert [x[:3] for x in S.find(text) if x[0] in S.BASE] == [(k, a, b) for k, a, b in sorted(base(text), key=lambda x: S.KINDS.index(x[0]))]
    assert S.find(None) == [] and S.find("") == []


def test_ownership_parts_examples_from_live_values(spark):
    own, copied = "q7Rt92LmXz04KpVb81Nc", "Zx81Lq07Tn55Rw32Bk90"
    rows = [(i, f"see {copied} here", f"r{i}", f"o{i}") for i in range(5)]
    rows += [(9, f"use {own} and token={copied}", "r9", "o9"), (10, None, None, None), (11, "", "r", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string").selectExpr("*", "1 AS spans", "2 AS hash")
    scanned = S.scan(docs, "repo", "owner")
    assert scanned.count() == 8
    got = S.owned_spans(scanned).collect()
    assert sorted((r["doc_id"], r["kind"], r["live"]) for r in got) == [(9, "assign", False), (9, "mixed", True)]
    owners = {r["hash"]: r["n_owners"] for r in S.ownership(scanned).collect()}
    assert owners[hashlib.sha256(copied.encode()).hexdigest()] == 6 and owners[hashlib.sha256(own.encode()).hexdigest()] == 1


def brute_license(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for phrase, label in L.BASE for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    for r in L.op10_license_signatures(spark, d).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["score"] > 0) == (r["labels"] != "")


def labels(text):
    return sorted({rule.label for _, _, rule in L.detect(L.words_of(text.encode()))})


def test_priority_and_containment():
    assert labels("Licensed under the Apache License, Version 2.0.") == ["apache-2.0"]
    assert labels("SPDX-License-Identifier: GPL-3.0-or-later") == ["gpl-3.0"]
    assert labels("This work is licensed under the GNU General Public License, version 3.") == ["gpl-3.0"]
    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc-4.0"]
    assert labels("see http://opensource.org/licenses/MIT and the MIT License") == ["mit"]
    assert labels("nothing of the kind, admit it") == []


def test_hundreds_of_rules_with_keywords_that_their_matches_hold():
    every = rules()
    assert len(every) >= 300 and [r.priority for r in every] == sorted((r.priority for r in every), reverse=True)


def alternatives(tree):
    """Texts of every alternative of a parsed regex; what may repeat often is one word."""
    out = [""]
    for op, a in tree:
        new = {
            C.LITERAL: lambda: [chr(a)],
            C.IN: lambda: [chr(x) for _, x in a],
            C.BRANCH: lambda: [s for t in a[1] for s in alternatives(t)],
            C.SUBPATTERN: lambda: alternatives(a[3]),
            C.MAX_REPEAT: lambda: ["", *alternatives(a[2])],
            C.MIN_REPEAT: lambda: ["someone"],
            C.ASSERT_NOT: lambda: [""],
        }[op]()
        out = [o + n for o in out for n in new]
    return out


def test_the_keyword_gate_loses_no_alternative_of_any_rule():
    every, n = rules(), 0
    for rule in every:
        grant = _GRANT in rule.pattern.pattern
        name = rule.pattern.pattern.replace(_GRANT, "")
        for text in alternatives(_parser.parse(name)):
            text = "licensed under " * grant + text.strip()
            assert any(r is rule for _, _, r in L._kept(text, [rule])), (rule.label, text)
            got = L.detect(L.words_of(text.encode()))
            assert set(got) == set(L._kept(text, every)), (rule.label, text)
            n += 1
    assert n > 2000


def test_names_without_the_usual_keyword():
    assert labels("licensed under the GPLv3") == ["gpl"]
    assert labels("Creative Commons Attribution-ShareAlike 4.0") == ["cc-by-sa-4.0"]
    assert labels("the FreeBSD license") == ["bsd-2-clause"] and labels("0BSD") == ["bsd-zero"]
    assert labels("GNU Library General Public License version 2") == ["lgpl-2.0"]
    assert labels("General Public License version 3") == ["gpl-3.0"] and labels("CreativeML OpenRAIL-M") == ["openrail"]
    assert labels("the\u00a0MIT License") == ["mit"]  # a space beyond ASCII


def test_license_edges(make):
    docs = make(None, "", (None, "MIT license"), (3, "mit License"), (3, "mit License")).selectExpr("*", "1 AS labels", "2 AS n_words")
    rows = L.scan_licenses(docs).collect()
    assert sorted(r["n_base"] for r in rows) == [0, 0, 1, 1, 1] and len(rows) == 5
    assert L.scan_licenses(docs.limit(0)).count() == 0


def test_long_secrets_and_many_repositories(spark):
    long = "".join(f"{i:x}G" for i in range(120))
    login = "https://user:" + "p4" * 60 + "@host"
    found = {k: v for k, _, _, v in S.find(f"see {long} and {login}")}
    assert found["mixed"] == long and found["url_login"].endswith("p4") and len(found["url_login"]) == 125
    rows = [(i, "see q7Rt92LmXz04KpVb81Nc", f"r{i}", "one owner") for i in range(S.MAX_REPOSITORIES + 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repo string, owner string")
    assert S.owned_spans(S.scan(docs, "repo", "owner")).count() == 0  # copied, though by one owner
    few = S.owned_spans(S.scan(docs.limit(2), "repo", "owner")).collect()
    assert len(few) == 2 and all(r["live"] for r in few)
    assert S.owned_spans(S.scan(docs.limit(0), "repo", "owner")).count() == 0
    twice = S.scan(docs.limit(1).unionByName(docs.limit(1)), "repo", "owner")
    assert twice.count() == 2 and twice.select("_row").distinct().count() == 2


def test_spans_of_a_text_don_t_meet_as_plain_comparison_finds(spark):
    import random

    rng = random.Random(8)
    parts = ["token=", "a1b2c3d4e5f6a7b8c9d0e1f2", "AKIA" + "A1" * 9, "ghp_" + "x1" * 20, "https://u:pass1234@h ", " ", "q7Rt92LmXz04KpVb81Nc", "eyJabcdefgh.abcdefghi.abcdefghij", "\n"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(30))
        found = S.find(text)
        extra = [x for x in found if x[0] not in S.BASE]
        assert sorted(x[:3] for x in found if x[0] in S.BASE) == sorted(base(text))
        for i, (_, s, e, _) in enumerate(extra):
            others = [x for x in found if x[0] in S.BASE] + extra[:i]
            assert all(e <= a or s >= b for _, a, b, _ in others)
    run = "f" * 30 + " "
    assert len(S.find(run * 30_000)) == 30_000  # a text of very many spans takes seconds, not hours


def test_containment_equals_comparing_every_pair():
    import random

    class Match:
        def __init__(self, s, e):
            self.s, self.e = s, e

        def start(self):
            return self.s

        def end(self):
            return self.e

    class Pattern:
        def __init__(self, spans):
            self.spans = spans

        def finditer(self, text):
            return [Match(*x) for x in self.spans]

    class Fake:
        def __init__(self, n, priority, spans):
            self.label, self.priority, self.pattern = f"l{n}", priority, Pattern(spans)

    rng = random.Random(3)
    for _ in range(300):
        fakes = []
        for n in range(5):
            starts = [rng.randint(0, 30) for _ in range(6)]
            fakes.append(Fake(n, rng.randint(0, 2), [(s, s + rng.randint(1, 12)) for s in starts]))
        every = sorted(((s, e, f) for f in fakes for s, e in f.pattern.spans), key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].label))
        want = []
        for s, e, f in every:
            if not any(a <= s and e <= b for a, b, _ in want):
                want.append((s, e, f))
        assert L._kept("", fakes) == want


def test_license_scan_of_very_long_and_repetitive_texts(spark):
    text = "MIT License and Apache License 2.0. " * 20_000
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "none " * 200_000), (4, "none")], "doc_id int, text string").selectExpr("*", "1 AS labels", "2 AS n_words")
    rows = sorted((r["doc_id"], r["n_words"], r["n_base"], r["labels"]) for r in L.scan_licenses(docs).collect())
    assert rows[0][2] == 40_000 and "mit" in rows[0][3] and "apache" in rows[0][3]
    assert [x[:3] for x in rows[1:]] == [(2, 0, 0), (3, 0, 0), (4, 1, 0), (4, 200_000, 0)]
    assert L.scan_licenses(docs.limit(0)).count() == 0
