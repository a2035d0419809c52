"""Every operator takes nulls in any column, repeated rows, and columns it does not know."""

import re

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", [n for n in entry.queries() if re.match(r"p\d+_", n)])
def test_nulls_in_any_column(spark, damaged, name):
    assert entry.queries()[name](spark, damaged).count() >= 0
