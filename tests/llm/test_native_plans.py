import re

import pytest

from orrery.llm import queries


@pytest.mark.parametrize("name", ["op2_quality_rules", "op5_chat_rotation", "op6_mixing", "op10_line_dedup"])
def test_native_operators_stay_in_the_engine(spark, sf, name):
    text = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", text)
