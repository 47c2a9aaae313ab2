"""Names are also scored where their first letters differ."""

import pytest

from casewell.plans import registry


@pytest.mark.parametrize("name", ["f6_f7_jaro_winkler_of_rows", "f8_name_similarity_of_rows"])
def test_other_first_letters(spark, sf, name):
    assert registry.QUERIES[name](spark, sf).filter("left(a, 1) <> left(b, 1)").count() > 0
