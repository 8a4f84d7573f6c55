"""The places that scores are shown to."""

import duckdb
from pyspark.sql import functions as F

from loomcorpus.plans import retrieve


def test_places_are_rounded_as_sql_does(spark):
    scores = [(i * 137 + 13) / 1e4 + 0.0000000050 + i * 1e-8 for i in range(20_000)]
    scores = [round(x, 10) for x in scores]
    con = duckdb.connect()
    want = [x for (x,) in con.execute("SELECT round(x, 8) FROM (SELECT unnest($1::DOUBLE[]) AS x, generate_subscripts($1::DOUBLE[], 1) AS i) ORDER BY i", [scores]).fetchall()]
    df = spark.createDataFrame(list(enumerate(scores)), "i int, x double")
    assert [r.y for r in df.orderBy("i").select(retrieve.places(F.col("x"), 8).alias("y")).collect()] == want
