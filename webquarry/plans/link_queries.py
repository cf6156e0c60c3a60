"""Registered queries over URLs, links and the crawl (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webquarry.functions import urls as U
from webquarry.operators import links as L
from webquarry.oracles import sql as O
from webquarry.plans.derived import cte, derive, read

TASK = "Find the latest article details about thanedble, aulich and example"


def q_normalize_url(spark, sf):
    rows = derive(spark, sf, "url_cases")
    return U.with_normalized(rows, F.col("url"), "norm", F.col("base")).select("event_id", "norm")


def q_normalize_page_url(spark, sf):
    return U.with_normalized(read(spark, sf, "pages"), F.col("url"), "norm").select("page_id", "norm")


def q_resolve_url(spark, sf):
    return derive(spark, sf, "url_cases").select("event_id", U.resolve_url(F.col("url"), F.col("base")).alias("absolute"))


def q_url_domain(spark, sf):
    return read(spark, sf, "pages").select("page_id", U.url_domain(F.col("url")).alias("domain"))


def q_url_checks(spark, sf):
    url, base = F.col("url"), F.col("base")
    return derive(spark, sf, "url_cases").select(
        "event_id", U.is_valid_url(url).cast("int").alias("valid"), U.is_parsable(url).cast("int").alias("absolute"),
        U.is_same_domain(url, base).cast("int").alias("same_domain"), U.is_external(url, base).cast("int").alias("external"),
    )


def q_should_follow(spark, sf):
    rows = U.with_normalized(derive(spark, sf, "url_cases"), F.col("url"), "norm", F.col("base"))
    open_config = U.CrawlConfig(follow_external=True, allowed_domains=("example.com", "example.net"), blocked_patterns=())
    strict = U.CrawlConfig(allowed_domains=("example.net",))
    return rows.select(
        "event_id", U.should_follow(F.col("norm"), F.col("base")).cast("int").alias("default_follow"),
        U.should_follow(F.col("norm"), F.col("base"), open_config).cast("int").alias("open_follow"),
        U.should_follow(F.col("norm"), F.col("base"), strict).cast("int").alias("strict_follow"),
    )


def q_page_links(spark, sf):
    return L.page_links(read(spark, sf, "pages"))


def q_link_priority(spark, sf):
    rows = L.anchors(derive(spark, sf, "frame_pages"))
    label = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("anchor"))
    return rows.select("page_id", "pos", "href", "anchor", U.link_priority(F.col("anchor"), label, F.col("href")).cast("long").alias("priority"))


def q_link_task_relevance(spark, sf):
    ranked = L.prioritize_links(L.page_links(read(spark, sf, "pages")), F.lit(TASK), top=3)
    return ranked.select("page_id", "pos", "url", "priority", "rank")


def q_link_task_relevance_all(spark, sf):
    return L.prioritize_links(L.page_links(read(spark, sf, "pages")), F.lit(TASK)).select("page_id", "pos", "url", "priority")


def q_filter_links(spark, sf):
    found = L.page_links(read(spark, sf, "pages"))
    visited = found.filter(F.length("url") % 2 == 0).select("url").distinct()
    return L.filter_links(found, visited).select("page_id", "pos", "url")


def q_frame_links(spark, sf):
    return L.frame_links(derive(spark, sf, "frame_pages")).select("page_id", "url", "pos")


def q_ajax_endpoints(spark, sf):
    return L.ajax_endpoints(derive(spark, sf, "frame_pages"))


def q_endpoint_candidates(spark, sf):
    return L.endpoint_candidates(derive(spark, sf, "frame_pages"))


def q_detail_links(spark, sf):
    return L.detail_links(derive(spark, sf, "frame_pages"), overall=None)


def q_page_triggers(spark, sf):
    rows = L.page_triggers(derive(spark, sf, "frame_pages"))
    return rows.select("page_id", "kind", "tag", "text", F.col("likely").cast("int").alias("likely"))


def q_url_dedup(spark, sf):
    return L.url_dedup(read(spark, sf, "pages"))


def q_url_dedup_stats(spark, sf):
    cases = derive(spark, sf, "url_cases").withColumnRenamed("event_id", "page_id")
    return L.dedup_stats(L.url_dedup(cases, F.col("base")))


def shop_edges(spark, sf):
    """Region to nation to supplier to part to order, with links back: a graph of four levels."""
    item, supp = read(spark, sf, "lineitem"), read(spark, sf, "supplier")
    nation = read(spark, sf, "nation")

    def edge(df, src, dst, priority):
        return df.select(F.expr(src).alias("src"), F.expr(dst).alias("dst"), F.expr(priority).cast("long").alias("priority"))

    return (
        edge(nation, "concat('/r/', n_regionkey)", "concat('/n/', n_nationkey)", "n_nationkey % 3")
        .unionByName(edge(supp, "concat('/n/', s_nationkey)", "concat('/s/', s_suppkey)", "0"))
        .unionByName(edge(supp, "concat('/s/', s_suppkey)", "concat('/n/', s_nationkey)", "5"))
        .unionByName(edge(item, "concat('/s/', l_suppkey)", "concat('/p/', l_partkey)", "l_linenumber"))
        .unionByName(edge(item, "concat('/p/', l_partkey)", "concat('/o/', l_orderkey)", "l_linenumber % 4"))
        .unionByName(edge(item, "concat('/o/', l_orderkey)", "concat('/s/', l_suppkey)", "9"))
    )


def q_crawl_frontier(spark, sf):
    seeds = read(spark, sf, "region").select(F.concat(F.lit("/r/"), "r_regionkey").alias("url"))
    return L.crawl_frontier(seeds, shop_edges(spark, sf))


def q_crawl_budget(spark, sf):
    """A budget that ends the walk within its third round."""
    seeds = read(spark, sf, "region").select(F.concat(F.lit("/r/"), "r_regionkey").alias("url"))
    return L.crawl_frontier(seeds, shop_edges(spark, sf), max_pages=60 + read(spark, sf, "supplier").count())


def q_page_crawl(spark, sf):
    pages = read(spark, sf, "pages")
    seeds = U.with_normalized(pages.select("url"), F.col("url"), "n").select(F.col("n").alias("url"))
    return L.crawl_frontier(seeds, L.page_edges(pages))


def q_crawl_stats(spark, sf):
    rows = read(spark, sf, "events").selectExpr(
        "case event_type when 'error' then 'failed' when 'click' then 'skipped' else 'visited' end as status",
        "user_id % 4 as depth", "value", "user_id % 7 as links", "user_id % 3 as dups",
    )
    out = L.crawl_stats(rows, F.col("status"), F.col("value"), F.col("links"), F.col("dups"))
    return out.withColumns({"avg_page_ms": F.round("avg_page_ms", 6), "success_rate": F.round("success_rate", 6)})


def q_tracker_urls(spark, sf):
    rows = derive(spark, sf, "outbound_urls")
    return rows.groupBy(U.url_domain(F.col("url")).alias("domain")).agg(
        F.count("*").alias("urls"), F.count_if(U.is_tracker(F.col("url"))).alias("trackers")
    )


QUERIES = {
    "normalize_url": q_normalize_url, "normalize_page_url": q_normalize_page_url, "resolve_url": q_resolve_url,
    "url_domain": q_url_domain, "url_checks": q_url_checks, "should_follow": q_should_follow,
    "page_links": q_page_links, "link_priority": q_link_priority, "link_task_relevance": q_link_task_relevance, "link_task_relevance_all": q_link_task_relevance_all,
    "filter_links": q_filter_links, "frame_links": q_frame_links, "ajax_endpoints": q_ajax_endpoints,
    "endpoint_candidates": q_endpoint_candidates, "detail_links": q_detail_links, "page_triggers": q_page_triggers,
    "url_dedup": q_url_dedup, "url_dedup_stats": q_url_dedup_stats, "crawl_frontier": q_crawl_frontier, "crawl_budget": q_crawl_budget,
    "page_crawl": q_page_crawl, "crawl_stats": q_crawl_stats, "tracker_urls": q_tracker_urls,
}

# ---- SQL twins: the cases are built from known parts, so their answers are written out ------

PAGE = "'https://www.example.com/dir/page' || (user_id % 5) || '.html"
NORM = f"""case event_id % 12 when 0 then 'http://www.example.com/a/c?a=' || user_id || '&z=1'
when 1 then 'https://www.example.com/p/' || user_id when 2 then 'https://www.example.com/dir/img/x.png'
when 3 then 'https://cdn.example.net/lib.js' when 4 then {PAGE}?q=' || event_type when 5 then {PAGE}?s=1'
when 6 then 'mailto:u' || user_id || '@example.com' when 7 then 'https://sub.example.com/api/v1'
when 8 then 'https://www.example.com/rss/feed/' || event_type when 9 then 'https://www.example.com/dir/doc.pdf'
when 10 then 'https://example.com/path?a=2&b=' || user_id || '&b=1' else 'https://www.example.com/up/' || event_type end"""
RESOLVED = f"""case event_id % 12 when 0 then 'http://www.example.com/a/c/?z=1&a=' || user_id || '#frag'
when 1 then 'https://www.example.com/p/' || user_id || '/' when 5 then {PAGE}?s=1#top'
when 10 then 'https://Example.com/path/?b=' || user_id || '&a=2&b=1' else {NORM} end"""
PAGE_NORM = "regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '')"
ENC = "replace(replace(url_encode(substring(href, 2)), '%2C', ','), '%2F', '/')"
LINKS = f"""a as (select page_id, url parent_url, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) h,
    regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) t from pages),
b as (select page_id, parent_url, unnest(h) href, unnest(t) anchor, generate_subscripts(h, 1) - 1 pos from a),
pl as (select page_id, pos, parent_url, regexp_extract(parent_url, '^(https?://[^/]*)', 1) || '/' || {ENC} url, anchor, 1 as depth,
  (case when length(anchor) > 5 and length(anchor) < 100 then 1 else 0 end
   + case when regexp_matches(lower(anchor), 'read|more|view|details|article|post|page') then 2 else 0 end
   - case when regexp_matches(lower(anchor), 'login|signup|register|logout|cart|checkout') then 2 else 0 end
   + case when regexp_matches(href, '[0-9]') then 1 else 0 end)::bigint priority from b)"""
SITE = "'http://site' || c_nationkey || '.example.com'"
TASK_WORDS = [w for w in TASK.lower().split() if len(w) > 3]


def _relevance(url: str) -> str:
    toks = f"list_filter(regexp_split_to_array(lower({url}), '[/\\-_.]'), lambda t: length(t) > 2)"
    return " + ".join(
        f"(case when len(list_filter({toks}, lambda t: contains(t, {O.q(w)}) or contains({O.q(w)}, t))) > 0 then 2 else 0 end"
        f" + case when contains(lower({url}), {O.q(w)}) then 1 else 0 end)"
        for w in TASK_WORDS
    )


ANCHOR_ROWS = """
  select c_custkey page_id, 0 pos, '#' href, '' || (2000 + c_nationkey) anchor from customer union all
  select c_custkey, 1, '', 'View all' from customer union all
  select c_custkey, 2, '#', '' || (c_custkey % 50) from customer union all
  select c_custkey, 3, '/detail/' || (c_custkey % 40), 'Open' from customer union all
  select c_custkey, 4, 'more/' || c_nationkey || '.html', 'Learn more' from customer union all
  select c_custkey, 5, '/back', 'View back' from customer union all
  select c_custkey, 6, '#x', 'details' from customer union all
  select c_custkey, 7, '/plain', 'plain' from customer union all
  select c_custkey, 8, '?p=1', 'see >>' from customer union all
  select c_custkey, 9, '/t', 'Tab ' || c_nationkey from customer"""
LIST_PAGE = f"{SITE} || '/list/' || (c_custkey % 10)"
CAND = f"""
  select c_custkey page_id, 0 s, {LIST_PAGE} || '?ajax=true&year=' || (2000 + c_nationkey) url from customer union all
  select c_custkey, 1, {LIST_PAGE} || '?year=' || (2000 + c_nationkey) from customer union all
  select c_custkey, 2, {SITE} || '/api/list/' || (c_custkey % 10) || '?year=' || (2000 + c_nationkey) from customer union all
  select c_custkey, 3, {LIST_PAGE} || '?ajax=true&year=' || (1990 + c_nationkey) from customer union all
  select c_custkey, 4, {LIST_PAGE} || '?year=' || (1990 + c_nationkey) from customer union all
  select c_custkey, 5, {SITE} || '/api/list/' || (c_custkey % 10) || '?year=' || (1990 + c_nationkey) from customer union all
  select c_custkey, 6, {LIST_PAGE} || '?id=' || (c_custkey % 50) from customer union all
  select c_custkey, 7, {LIST_PAGE} || '?page=' || (c_custkey % 50) from customer union all
  select c_custkey, 8, {LIST_PAGE} || '?id=7' from customer where c_custkey % 50 <> 7 union all
  select c_custkey, 9, {LIST_PAGE} || '?page=7' from customer where c_custkey % 50 <> 7"""
DETAIL = f"""
  select c_custkey page_id, 3 pos, {SITE} || '/detail/' || (c_custkey % 40) url from customer union all
  select c_custkey, 4, {SITE} || '/list/more/' || c_nationkey || '.html' from customer union all
  select c_custkey, 8, {LIST_PAGE} || '?p=1' from customer"""
EDGES = """e as (
  select '/r/' || n_regionkey src, '/n/' || n_nationkey dst, (n_nationkey % 3)::bigint p from nation union all
  select '/n/' || s_nationkey, '/s/' || s_suppkey, 0 from supplier union all
  select '/s/' || s_suppkey, '/n/' || s_nationkey, 5 from supplier union all
  select '/s/' || l_suppkey, '/p/' || l_partkey, l_linenumber from lineitem union all
  select '/p/' || l_partkey, '/o/' || l_orderkey, l_linenumber % 4 from lineitem union all
  select '/o/' || l_orderkey, '/s/' || l_suppkey, 9 from lineitem),
l0 as (select '/r/' || r_regionkey u from region),
l1 as (select dst u, src, p from e where src in (select u from l0) and dst not in (select u from l0) qualify row_number() over (partition by dst order by p desc, src) = 1),
k1 as (select u from l0 union select u from l1),
l2 as (select dst u, src, p from e where src in (select u from l1) and dst not in (select u from k1) qualify row_number() over (partition by dst order by p desc, src) = 1),
k2 as (select u from k1 union select u from l2),
l3 as (select dst u, src, p from e where src in (select u from l2) and dst not in (select u from k2) qualify row_number() over (partition by dst order by p desc, src) = 1),
k3 as (select u from k2 union select u from l3),
l4 as (select dst u, src, p from e where src in (select u from l3) and dst not in (select u from k3) qualify row_number() over (partition by dst order by p desc, src) = 1),
k4 as (select u from k3 union select u from l4),
l5 as (select dst u, src, p from e where src in (select u from l4) and dst not in (select u from k4) qualify row_number() over (partition by dst order by p desc, src) = 1)"""

ORACLE = {
    "normalize_url": f"select event_id, {NORM} as norm from events",
    "normalize_page_url": f"select page_id, {PAGE_NORM} as norm from pages",
    "resolve_url": f"select event_id, {RESOLVED} as absolute from events",
    "url_domain": "select page_id, regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]*)', 1), '^www\\.', '') as domain from pages",
    "url_checks": "select event_id, 1 as valid, case when event_id % 12 in (0, 6, 7, 10) then 1 else 0 end as absolute, "
    "case when event_id % 12 in (0, 10) then 1 else 0 end as same_domain, case when event_id % 12 in (0, 10) then 0 else 1 end as external from events",
    "should_follow": "select event_id, case when event_id % 12 in (0, 1, 4, 5, 10, 11) then 1 else 0 end as default_follow, "
    "case when event_id % 12 in (0, 1, 4, 5, 10, 11) then 1 else 0 end as open_follow, 0 as strict_follow from events",
    "page_links": f"with {LINKS} select page_id, pos, parent_url, url, anchor, depth, priority, 'pending' as status from pl",
    "link_priority": f"""with r as ({ANCHOR_ROWS}) select page_id, pos, href, anchor,
(case when length(anchor) > 5 then 1 else 0 end + case when regexp_matches(lower(anchor), 'read|more|view|details|article|post|page') then 2 else 0 end
 + case when regexp_matches(href, '[0-9]') then 1 else 0 end)::bigint as priority from r""",
    "link_task_relevance": f"""with {LINKS}, s as (select page_id, pos, url, priority + {_relevance('url')} as priority from pl)
select page_id, pos, url, priority, row_number() over (partition by page_id order by priority desc, pos) as rank from s
qualify row_number() over (partition by page_id order by priority desc, pos) <= 3""",
    "link_task_relevance_all": f"with {LINKS} select page_id, pos, url, priority + {_relevance('url')} as priority from pl",
    "filter_links": f"with {LINKS} select page_id, pos, url from pl where length(url) % 2 = 1",
    "frame_links": f"select c_custkey as page_id, {SITE} || '/frames/' || c_nationkey || '?y=2&z=1' as url, 0 as pos from customer "
    f"union all select c_custkey, {SITE} || '/list/side.html', 1 from customer",
    "ajax_endpoints": f"select c_custkey as page_id, {SITE} || '/rest/' || c_custkey as url from customer union all "
    f"select c_custkey, {SITE} || '/list/data.json' from customer union all select c_custkey, {SITE} || '/x/' || c_mktsegment from customer union all "
    "select c_custkey, 'https://api.example.net/v1?q=' || c_nationkey from customer union all "
    "select c_custkey, 'https://cdn.example.org/d/' || c_nationkey from customer",
    "endpoint_candidates": f"with c as ({CAND}) select page_id, url, row_number() over (partition by page_id order by s) as rank from c",
    "detail_links": f"with d as ({DETAIL}) select url, page_id, pos from d qualify row_number() over (partition by url order by page_id, pos) = 1",
    "page_triggers": """select c_custkey as page_id, 'link' as kind, 'a' as tag, '' || (2000 + c_nationkey) as text, 1 as likely from customer
union all select c_custkey, 'link', 'a', 'View all', 1 from customer union all select c_custkey, 'link', 'a', '' || (c_custkey % 50), 1 from customer
union all select c_custkey, 'control', 'div', 'Year', 1 from customer union all select c_custkey, 'control', 'span', '7', 1 from customer
union all select c_custkey, 'control', 'button', 'Go & load', 1 from customer union all select c_custkey, 'control', 'div', 'Press', 1 from customer
union all select c_custkey, 'tab', 'a', 'Tab ' || c_nationkey, 1 from customer union all select c_custkey, 'tab', 'li', 'Second', 1 from customer""",
    "url_dedup": f"select {PAGE_NORM} as norm_url, min(page_id) as page_id, arg_min(url, page_id) as url, count(*) as copies from pages group by 1",
    "url_dedup_stats": f"select count(distinct n) as total, count(*) - count(distinct n) as duplicates from (select {NORM} n from events)",
    "crawl_budget": f"""with {EDGES} select * from (select u as url, 0 as depth, null as parent_url, 0 as priority from l0
union all select u, 1, src, p from l1 union all select u, 2, src, p from l2 union all select u, 3, src, p from l3
union all select u, 4, src, p from l4 union all select u, 5, src, p from l5)
order by depth, priority desc, url limit 60 + (select count(*) from supplier)""",
    "crawl_frontier": f"""with {EDGES} select u as url, 0 as depth, null as parent_url, 0 as priority from l0
union all select u, 1, src, p from l1 union all select u, 2, src, p from l2 union all select u, 3, src, p from l3
union all select u, 4, src, p from l4 union all select u, 5, src, p from l5""",
    "page_crawl": f"""with {LINKS}, seeds as (select distinct {PAGE_NORM} url from pages),
x as (select url, {PAGE_NORM.replace('url', 'parent_url')} src, priority from pl where url not in (select url from seeds)
  qualify row_number() over (partition by url order by priority desc, src) = 1)
select url, 0 as depth, null as parent_url, 0 as priority from seeds union all select url, 1, src, priority from x""",
    "crawl_stats": """select count(*) filter (where event_type not in ('error', 'click')) as visited, count(*) filter (where event_type = 'click') as skipped,
count(*) filter (where event_type = 'error') as failed, sum(user_id % 7)::bigint as links, sum(user_id % 3)::bigint as duplicates,
max(user_id % 4) filter (where event_type not in ('error', 'click')) as max_depth,
round(avg(value) filter (where event_type not in ('error', 'click')), 6) as avg_page_ms,
round(count(*) filter (where event_type not in ('error', 'click')) / (count(*) filter (where event_type <> 'click')), 6) as success_rate from events""",
    "tracker_urls": f"""with {cte('outbound_urls')} select regexp_extract(url, '^https://(?:www\\.)?([^/]*)', 1) as domain, count(*) as urls,
count(*) filter (where event_id % 9 in (0, 1, 3, 4, 6, 7)) as trackers from outbound_urls group by 1""",
}
