"""Every registered query of the engine against its SQL on the smallest tables."""

import pytest
from tests_common import canonical

from orrery.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf).toPandas()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_points():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "bayes_decide" in e.queries()


def test_merges_compare_whole_texts(spark, tmp_path):
    head = "the same forty characters stand at the front of these: "
    rows = [(1, head + "a"), (2, head + "b"), (4, head.upper() + "A"), (5, head + "b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("merge_canonical", "split_effect"):
        got = {r["identity_id"]: r["canonical_id"] for r in catalogue.queries()[name](spark, str(tmp_path)).collect()}
        assert got == {1: 1, 2: 2, 4: 1, 5: 2}
