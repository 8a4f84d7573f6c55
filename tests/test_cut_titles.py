"""Titles that are cut within a character reference, by the queries and their SQL."""

import duckdb
import pytest

from loomcorpus import plans

TITLES = ["Of the&amp;&amp", "Of the&amp;am", "A &lt", "A &lt;b&gt", "said &quot", "it&#x27", "&amp;lt", "&amp;lt;", "plain", "the&am"]


@pytest.mark.parametrize("name", ["a27_repaired_rows", "s14_html_extract", "s16_navigation", "j7_title_duplicates", "c11_link_graph", "j15_link_joins"])
def test_sql_reads_cut_references(spark, tmp_path, name):
    pages = [(i, f"https://a.example.org/{10000 + i}", f'<html><head><title>{t}</title></head><body><a href="/x">x</a></body></html>') for i, t in enumerate(TITLES)]
    documents = [(i, f"{t}\nmore") for i, t in enumerate(["Of the&& and", "A <b> c", "said amp", "it's", "< a", "plain"])]
    con = duckdb.connect()
    for table, rows, schema in (("pages", pages, "page_id long, url string, html string"), ("documents", documents, "doc_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    df = plans.QUERIES[name](spark, f"file://{tmp_path}")
    found = con.execute(plans.ORACLES[name])
    at = [[x[0] for x in found.description].index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r[i] for i in at) for r in found.fetchall()))) == sorted(map(repr, map(tuple, df.collect())))
