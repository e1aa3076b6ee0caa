"""What the plans of registered queries must and must not hold."""

import re

import pytest

from orrery.plans import catalogue

LAZY = sorted(set(catalogue.queries()) - {"stream_workspace", "stream_eviction", "stream_resolve"})


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_products(spark, sf, name):
    text = plan(catalogue.queries()[name](spark, sf))
    assert "CartesianProduct" not in text
    if name not in ("pair_posterior_exact", "loopy_posterior", "rdf_decisions"):
        assert not re.search("Python|Pandas|Arrow", text.replace("ArrowEval", ""))


def test_scans_read_what_they_need(spark, sf):
    text = plan(catalogue.queries()["geo_haversine"](spark, sf))
    assert "c_name" not in text and "c_acctbal" not in text
    text = plan(catalogue.queries()["current_decision"](spark, sf))
    assert "o_orderdate" not in text


def test_filters_reach_the_scan(spark, sf):
    text = plan(catalogue.queries()["outbox_pending"](spark, sf))
    assert "PushedFilters: [In(o_orderpriority" in text or "In(o_orderpriority" in text
    assert "EqualTo(o_orderstatus,F)" in text


def test_softmax_and_decision_share_one_shuffle(spark, sf):
    """Posterior and decision group by the same key: one exchange of the entries, none between the two."""
    text = plan(catalogue.queries()["bayes_decide"](spark, sf))
    assert len(re.findall(r"Exchange hashpartitioning\(inference_id", text)) == 1


def test_export_shuffles_no_pairs(spark, sf):
    """Events and users are dealt out, once each; what is made of their pairs stays where it is made."""
    text = plan(catalogue.queries()["rdf_decisions"](spark, sf))
    assert "Window" not in text and "Exchange hashpartitioning(inference_id" not in text
    rows = text.splitlines()
    top = next(i for i, x in enumerate(rows) if "Join" in x)
    assert not any("Exchange" in x or "Aggregate" in x or "Sort" in x for x in rows[:top])


def test_export_shuffles_events_as_they_are_read(spark, sf):
    """An event's hash, clocks and version are longer than what they are made of: they are made behind the exchange."""
    rows = plan(catalogue.queries()["rdf_decisions"](spark, sf)).splitlines()
    dealt = next(i for i, x in enumerate(rows) if "REPARTITION_BY_NUM" in x)
    assert any("sha2" in x for x in rows[:dealt])
    assert not any(re.search("sha2|unix_micros|FLOOR", x) for x in rows[dealt:])


def test_export_has_the_parts_of_the_join(spark, sf):
    """With fewer parts than the session's, adaptive execution was seen to deal the events out twice."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        rows = plan(catalogue.queries()["rdf_decisions"](spark, sf)).splitlines()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [", 50)" in x for x in rows if "REPARTITION_BY_NUM" in x] == [True]
