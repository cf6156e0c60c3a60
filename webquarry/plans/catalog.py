"""All registered queries, area by area."""

from __future__ import annotations

from webquarry.plans import (
    entity_queries, job_queries, link_queries, page_queries, quality_queries, relevance_queries, stream_queries,
)

AREAS = (page_queries, link_queries, entity_queries, quality_queries, relevance_queries, job_queries, stream_queries)

QUERIES = {name: fn for area in AREAS for name, fn in area.QUERIES.items()}
ORACLE = {name: sql for area in AREAS for name, sql in area.ORACLE.items()}
