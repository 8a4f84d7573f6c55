"""A run's measures where all cases have gold, or none has."""

import pytest
from pyspark.sql import functions as F

from loomcorpus.operators import answers as a

RESULTS = "query_id long, position long, chunk_id long, score double, document string, url string, tier string, title string, excerpt string, used long"


@pytest.mark.parametrize("gold, cited, none", [([(1, 7), (2, 8)], 50.0, None), ([(1, 7)], 100.0, 100.0), ([], None, 50.0)])
def test_percentages_over_no_case_are_null(spark, gold, cited, none):
    results = spark.createDataFrame([(1, 1, 7, 1.0, "d", "https://x", "A", "t", "e", 1)], RESULTS)
    cases = spark.createDataFrame([(1, "A"), (2, None)], "query_id long, expected_tier string")
    each = a.case_measures(results, cases, spark.createDataFrame(gold, "query_id long, chunk_id long"), lambda c: c.startswith("https"), ("zz",), ("##",))
    row = a.run_measures(each, "x").first()
    assert (row.cases, row.cited_percent, row.cited_safely_percent, row.right_tier_percent, row.no_answer_percent) == (2, cited, cited, cited, none)
    assert (row.mrr is None) == (cited is None)
    passed = a.quality_gate(a.run_measures(each, "x")).first()
    assert passed.citations_met == (cited == 100.0) and not a.quality_gate(a.run_measures(each.filter(F.lit(False)), "x")).collect()
