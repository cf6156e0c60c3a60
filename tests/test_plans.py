"""Plan checks: no cross products, no Python on the row-level paths, columns pruned at the scan."""

import pytest

import __spark_entry__ as entry

JVM_ONLY = (
    "usable_pages strip_html page_head body_text structured_text sanitize_html elements drop_noise main_content html_to_markdown markdown_clean "
    "normalize_url page_links url_dedup link_priority should_follow quality_rules quality_verdict page_metrics rule_extract cosine_query "
    "rate_limit_all source_health job_state"
).split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM_ONLY)
def test_stays_in_the_jvm(spark, sf_dir, name):
    text = plan(entry.queries()[name](spark, sf_dir))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text and "ArrowEval" not in text


def test_scan_reads_only_what_is_used(spark, sf_dir):
    text = plan(entry.queries()["url_domain"](spark, sf_dir))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text


def test_pages_are_exchanged_once_for_elements(spark, sf_dir):
    text = plan(entry.queries()["elements"](spark, sf_dir))
    assert text.count("Exchange hashpartitioning") == 1


def test_structure_costs_one_more_exchange(spark, sf_dir):
    import re

    for name in ("structural_select", "structural_paths"):
        text = plan(entry.queries()[name](spark, sf_dir))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert len(re.findall(r"Exchange hashpartitioning\(page_id", text)) == text.count("Exchange hashpartitioning") == 3  # pages, elements, texts
