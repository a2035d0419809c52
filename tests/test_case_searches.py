import os

import pytest

import __spark_entry__ as entry

SMALLEST = "/root/testdata/sf0.001"


def test_searches_run_for_the_whole_question_set(spark):
    if not os.path.isdir(SMALLEST):
        pytest.skip("no test tables here")
    found = entry.queries()["bm25_topk_of_cases"](spark, SMALLEST)
    assert found.select("query_id").distinct().count() > 300
