"""Operators that are registered in a cut form are registered whole, too."""

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry


@pytest.mark.parametrize("cut", ["dedup_entities", "link_task_relevance", "quality_rules_mixed", "extract_with_fallback"])
def test_whole_form(spark, sf_dir, cut):
    name = f"{cut}_all"
    line = compare(spark, connect(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("ok"), line


def test_whole_forms_hold_what_the_cut_ones_leave_out(spark, sf_dir):
    run = lambda name: entry.queries()[name](spark, sf_dir)
    assert run("dedup_entities_all").groupBy("page_id").count().where("count > 6").count() > 0
    assert run("link_task_relevance_all").groupBy("page_id").count().where("count > 3").count() > 0
    assert run("quality_rules_mixed_all").select("rule").distinct().count() == 18
    assert run("extract_with_fallback_all").where("strategy = 'rules' and entities > 0").count() > 0
