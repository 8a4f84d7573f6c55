"""Fill-in-middle against cuts by hand, and the SQL."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomcorpus.llm import fim


def by_hand(key, text, seed=7, rate=100, spm=50, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    p, s, m = marks
    if h[3] % 100 < spm:
        return n, "spm", len(prefix), len(middle), s + suffix + p + prefix + m + middle
    return n, "psm", len(prefix), len(middle), p + prefix + s + suffix + m + middle


ODD = [
    None, "", "\n", "\n\n\n", "one", "one\n", "one\ntwo", "a <P> b\nc", "<", "x<S", "S>\nP>\nM>", "$1 \\ $2\n{}", "漢字\n😀😀\nü\n", "\r\n\r\n", "a b\x85c\nd",
    "same\n" * 3, "same\n" * 3, "word " * 200_000, "\n" * 100_000, "line of words\n" * 100_000, "(" * 50 + "\n)?*+\n",
]


def test_odd_texts(spark):
    rows = [(i, t, "kept", i) for i, t in enumerate(ODD)] + [(None, "no\nkey\nhere", "kept", 7), (3, ODD[12], "kept", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, _h int")
    made = fim.fill_in_middle(df, "doc_id", "text", 7).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = made.collect()
    assert set(made.columns) == {"doc_id", "text", "_h", "n", "form", "prefix_chars", "middle_chars", "output", "back"}
    assert len(got) == len(rows) and {r._h for r in got} == {r[3] for r in rows}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == by_hand(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert fim.fill_in_middle(df.limit(0), "doc_id", "text", 7).collect() == []


def test_rates_units_and_marks(spark):
    marks = ("[$pre]", "[\\suf]", "{mid}")
    texts = [(i, f"w{i} x y z\nlast line {i}") for i in range(300)]
    df = spark.createDataFrame(texts, "k long, t string")
    made = fim.fill_in_middle(df, "k", "t", 3, marks=fim.Marks(*marks), rate=60, spm=20)
    got = made.withColumn("back", fim.restored(F.col("output"), F.col("form"), fim.Marks(*marks))).collect()
    assert {r.k: (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got} == {k: by_hand(k, t, 3, 60, 20, marks) for k, t in texts}
    assert all(r.back == r.t for r in got) and {r.form for r in got} == {"plain", "psm", "spm"}
    words = fim.fill_in_middle(df, "k", "t", 3, unit=r"[^ ]*+ |[^ ]++").collect()
    assert all(r.n == r.t.count(" ") + 1 for r in words)


@pytest.mark.parametrize("marks", [("", "b", "c"), ("ab", "ba", "x"), ("aba", "x", "y"), ("<P>", "<P>!", "z"), ("a", "a", "b")])
def test_marks_that_can_not_be_told_apart(marks):
    with pytest.raises(ValueError):
        fim.Marks(*marks)


def test_no_python_in_the_plan(spark, capsys):
    fim.op12_counted_fim(spark, "/root/testdata/sf0.001").explain()
    assert "Python" not in capsys.readouterr().out


def test_query_equals_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    found = con.execute(fim.OP12_SQL)
    names = [x[0] for x in found.description]
    got = sorted(tuple(r[c] for c in names) for r in fim.op12_counted_fim(spark, d).collect())
    assert got == sorted(found.fetchall())
