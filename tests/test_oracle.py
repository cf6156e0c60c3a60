"""Registered queries against their SQL twins.  ALL_QUERIES=1 runs every one; the default is a cross-section."""

import os

import pytest
from check_oracle import compare, connect

import __spark_entry__ as entry
from webquarry.plans import catalog

SECTION = (
    "usable_pages json_records markdown_pages html_tokens elements drop_noise sanitize_html html_to_markdown clean_text normalize_url page_links "
    "filter_links url_dedup crawl_frontier meta_tags microdata page_forms rule_extract dedup_entities pattern_entities jsonld_entities "
    "structural_select structural_paths own_rules extract_with_fallback parse_llm_rows tfidf cosine_query top_segments quality_verdict rule_based_verdict hybrid_verdict blocked_page_flag "
    "cascade_cost request_intent classify_errors retry_delay jobs_page job_state fresh_or_recompute session_reuse rate_limit_all "
    "rate_limit_admitted source_health ttl_lookup rate_limit_stream progress_stream"
).split()
NAMES = list(entry.queries()) if os.environ.get("ALL_QUERIES") else SECTION


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, duck, sf_dir, name):
    line = compare(spark, duck, sf_dir, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert not line.startswith("FAIL"), line


def test_every_query_is_checked():
    """Queries of the optional modules are checked by their own tests where SQL cannot express them."""
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
