"""Links, frames, endpoints and the crawl over the link graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.functions import patterns as P
from webquarry.functions import text as T
from webquarry.functions import urls as U
from webquarry.functions.markup import attr
from webquarry.operators.jobs import first_rows
from webquarry.operators import dom
from webquarry.session import cut_lineage

# Calls and settings in scripts that name an endpoint.
ENDPOINT_PATTERNS = (
    r"""fetch\(['"]([^'"]+)['"]""", r"""\.get\(['"]([^'"]+)['"]""", r"""\.post\(['"]([^'"]+)['"]""",
    r"""ajax\(['"]([^'"]+)['"]""", r"""url:\s*['"]([^'"]+)['"]""", r"""endpoint:\s*['"]([^'"]+)['"]""",
)


def anchors(pages: DataFrame) -> DataFrame:
    """page_id, url, pos, href, anchor, title, css_class: every <a> with an href attribute, in page order.

    A page is cut at its anchor tags inside the row; an anchor ends at its end tag or
    at the next anchor, as in HTML.
    """
    parts = F.split(dom.visible_source(F.col("html")), F.lit(r"(?i)<a[\s]"))
    rows = pages.select("page_id", "url", F.posexplode(F.slice(parts, F.lit(2), F.size(parts))).alias("pos", "part"))
    inside = rf"\A({P.INSIDE_TAG})>"
    rows = rows.withColumn("tok", F.concat(F.lit("<a "), F.regexp_extract("part", inside, 1), F.lit(">")))
    rows = rows.withColumn("href", attr(F.col("tok"), "href")).filter("href is not null or tok rlike '(?is)[\\\\s]href\\\\s*=\\\\s*(\"\"|\\'\\')'")
    inner = T.sub(T.sub(F.col("part"), inside), r"(?is)</a\b.*\z")
    text = T.js_trim(T.decode_entities(T.sub(inner, P.TAG)))
    return rows.select(
        "page_id", "url", F.col("pos").cast("long").alias("pos"), F.coalesce("href", F.lit("")).alias("href"),
        text.alias("anchor"), F.coalesce(attr(F.col("tok"), "title"), F.lit("")).alias("title"),
        F.coalesce(attr(F.col("tok"), "class"), F.lit("")).alias("css_class"),
    )


def page_links(
    pages: DataFrame,
    config: U.CrawlConfig = U.CrawlConfig(),
    visited: DataFrame | None = None,
    depth: Column | None = None,
) -> DataFrame:
    """Followable links: page_id, pos, parent_url, url, anchor, depth, priority, status.

    `visited` holds a column `url` of normalised addresses.  Links are not
    deduplicated within a page.
    """
    at = F.lit(0) if depth is None else depth
    rows = anchors(pages).filter(F.col("href") != "").withColumn("depth", at.cast("long"))
    rows = U.with_normalized(rows.withColumnRenamed("url", "parent_url"), F.col("href"), "dst", F.col("parent_url"))
    rows = rows.filter(U.should_follow(F.col("dst"), F.col("parent_url"), config) & (F.col("depth") < config.max_depth))
    label = F.when(F.col("title") != "", F.col("title")).otherwise(F.col("anchor"))
    out = rows.select(
        "page_id", "pos", "parent_url", F.col("dst").alias("url"), "anchor", (F.col("depth") + 1).alias("depth"),
        U.link_priority(F.col("anchor"), label, F.col("href")).cast("long").alias("priority"),
        F.lit("pending").alias("status"),
    )
    return out if visited is None else out.join(visited.select("url"), "url", "left_anti")


def filter_links(
    links: DataFrame, visited: DataFrame, config: U.CrawlConfig = U.CrawlConfig(), base: Column | None = None
) -> DataFrame:
    """Links not visited yet, not too deep, and followable from `base` (default: their parent)."""
    base = F.col("parent_url") if base is None else base
    kept = links.filter((F.col("depth") <= config.max_depth) & U.should_follow(F.col("url"), base, config))
    return kept.join(visited.select("url"), "url", "left_anti")


def prioritize_links(links: DataFrame, task: Column, top: int | None = None) -> DataFrame:
    """Priority raised by task relevance; `top` keeps the best of each page (ties by position)."""
    scored = links.withColumn("words", U.task_words(task))
    scored = scored.withColumn("priority", F.col("priority") + U.task_relevance(F.col("url"), F.col("words"))).drop("words")
    if top is None:
        return scored
    w = W.partitionBy("page_id").orderBy(F.desc("priority"), "pos")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= top)


def frame_links(pages: DataFrame) -> DataFrame:
    """page_id, pos, url: distinct frame addresses of a page, first occurrence kept."""
    toks = T.find_all(dom.visible_source(F.col("html")), r"(?is)<i?frame\b[^>]*>")
    rows = pages.select("page_id", F.col("url").alias("parent_url"), F.posexplode(toks).alias("pos", "tok"))
    rows = rows.withColumn("src", attr(F.col("tok"), "src")).filter("src is not null")
    rows = U.with_normalized(rows, F.col("src"), "url", F.col("parent_url"))
    valid = rows.filter(U.is_valid_url(F.col("url")))
    return valid.groupBy("page_id", "url").agg(
        F.min("pos").cast("long").alias("pos"), F.min("parent_url").alias("parent_url")
    )


def ajax_endpoints(pages: DataFrame) -> DataFrame:
    """page_id, url: addresses named in scripts, and web addresses quoted in data and onclick attributes."""
    scripts = F.array_join(T.find_all(F.col("html"), r"(?is)<script\b[^>]*>(.*?)</script\s*>", 1), "\n")
    called = F.filter(
        F.concat(*[T.find_all(scripts, p, 1) for p in ENDPOINT_PATTERNS]),
        lambda e: ~F.startswith(e, F.lit("javascript:")) & ~F.startswith(e, F.lit("#")),
    )
    toks = T.find_all(dom.visible_source(F.col("html")), rf"(?is)<[a-z]{P.INSIDE_TAG}>")
    values = F.transform(toks, lambda t: F.coalesce(
        attr(t, "data-year"), attr(t, "data-id"), attr(t, "data-page"), attr(t, "onclick"), F.lit("")
    ))
    quoted = F.filter(
        F.transform(values, lambda v: F.regexp_extract(v, r"""['"](https?://[^'"]+)['"]""", 1)), lambda u: u != ""
    )
    rows = pages.select("page_id", F.col("url").alias("base"), F.explode(F.array_distinct(F.concat(called, quoted))).alias("e"))
    return U.with_normalized(rows, F.col("e"), "url", F.col("base")).select("page_id", "url").distinct()


def _trigger_values(pages: DataFrame) -> DataFrame:
    """page_id, url, value, pos: texts of empty links, then data-year, data-id, data-page values."""
    empty = anchors(pages).filter(F.col("href").isin("#", "") & (F.col("anchor") != ""))
    texts = empty.select("page_id", "url", F.col("anchor").alias("value"), F.col("pos").alias("pos"), F.lit(0).alias("src"))
    toks = T.find_all(dom.visible_source(F.col("html")), r"""(?is)<[a-z][^>]*\sdata-(?:year|id|page)[^>]*>""")
    data = pages.select("page_id", "url", F.posexplode(toks).alias("pos", "tok")).select(
        "page_id", "url",
        F.coalesce(*[F.nullif(attr(F.col("tok"), n), F.lit("")) for n in ("data-year", "data-id", "data-page")]).alias("value"),
        F.col("pos").cast("long").alias("pos"), F.lit(1).alias("src"),
    ).filter("value is not null")
    return texts.unionByName(data)


def endpoint_candidates(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """page_id, url, rank: year triggers give three guesses, short numbers two; the first `limit` per page, if given."""
    rows = _trigger_values(pages).groupBy("page_id", "url", "value").agg(F.min(F.struct("src", "pos")).alias("seen"))
    path = F.when(U.url_path(F.col("url")) == "", F.lit("/")).otherwise(U.url_path(F.col("url")))
    origin = F.regexp_extract("url", r"^([a-zA-Z]+://[^/?#]*)", 1)
    value = F.col("value")
    years = F.array(
        F.concat(origin, path, F.lit("?ajax=true&year="), value), F.concat(origin, path, F.lit("?year="), value),
        F.concat(origin, F.lit("/api"), path, F.lit("?year="), value),
    )
    ids = F.array(F.concat(origin, path, F.lit("?id="), value), F.concat(origin, path, F.lit("?page="), value))
    guesses = F.when(T.matches(value, r"^\d{4}$"), years).when(T.matches(value, r"^\d{1,3}$"), ids)
    rows = rows.withColumn("is_id", (~T.matches(value, r"^\d{4}$")).cast("int"))
    rows = rows.select("page_id", "is_id", "seen", F.posexplode(guesses).alias("i", "guess"))
    best = rows.groupBy("page_id", "guess").agg(F.min(F.struct("is_id", "seen", "i")).alias("k"))
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("page_id").orderBy("k")).cast("long"))
    kept = ranked if limit is None else ranked.filter(F.col("rank") <= limit)
    return kept.select("page_id", F.col("guess").alias("url"), "rank")


def detail_links(pages: DataFrame, per_page: int | None = None, overall: int | None = None) -> DataFrame:
    """url, page_id, pos: links that promise detail, distinct; the first `per_page` of each page and the first `overall`, if given."""
    rows = anchors(pages)
    words = F.lower(F.col("anchor"))
    # Words and classes of detail links.
    promising = T.matches(words, "learn|more|detail|view|→|>>") | F.contains("css_class", F.lit("btn"))
    href = F.col("href")
    rows = rows.filter(
        promising & (href != "") & ~F.contains(href, F.lit("#")) & ~F.startswith(href, F.lit("javascript:"))
    )
    rows = U.with_resolved(rows, href, "dst", F.col("url"))
    rows = rows.filter(~F.contains("dst", F.lit("back")) & (F.col("dst") != F.col("url")))
    first = rows.groupBy("page_id", "dst").agg(F.min("pos").alias("pos"))
    ranked = first.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("pos")))
    kept = ranked if per_page is None else ranked.filter(F.col("n") <= per_page)
    once = kept.groupBy("dst").agg(F.min(F.struct("page_id", "pos")).alias("k"))
    out = once.select(F.col("dst").alias("url"), "k.page_id", "k.pos")
    return out if overall is None else out.orderBy("page_id", "pos", "url").limit(overall)


def page_triggers(pages: DataFrame) -> DataFrame:
    """page_id, kind, pos, tag, text, likely: interactive elements that may load data."""
    els = dom.with_selectors(dom.elements(pages), {
        "link": 'a[href="#"], a[href=""]',
        "control": 'button, [role="button"], [onclick], [data-year], [data-id]',
        "tab": '[role="tab"], .tab, .nav-link, .nav-item a',
    })
    blank_href = T.matches(F.col("tok"), r"""(?is)\shref\s*=\s*(?:""|'')""")
    kinds = F.array_compact(F.array(
        F.when(F.col("link") | ((F.col("tag") == "a") & blank_href), F.lit("link")),
        F.when(F.col("control"), F.lit("control")), F.when(F.col("tab"), F.lit("tab")),
    ))
    data = F.coalesce(F.nullif(attr(F.col("tok"), "data-year"), F.lit("")), attr(F.col("tok"), "data-id"), F.lit(""))
    rows = els.select("page_id", "pos", "tag", "raw0", "raw1", data.alias("data"), F.explode(kinds).alias("kind"))
    rows = dom.with_page_text(rows, pages).withColumn("text", T.js_trim(F.col("text")))
    short = (F.col("text") != "") & (F.length("text") < 50)
    rows = rows.filter(short | ((F.col("kind") == "control") & (F.col("data") != "")))
    likely = (F.col("kind") != "link") | T.matches(F.col("text"), r"^\d+$") | F.contains(F.lower("text"), F.lit("view"))
    label = F.when((F.col("kind") == "control") & (F.col("text") == ""), F.col("data")).otherwise(F.col("text"))
    return rows.select("page_id", "kind", F.col("pos").cast("long").alias("pos"), "tag", label.alias("text"), likely.alias("likely"))


# ---- duplicates ---------------------------------------------------------------------------

def url_dedup(pages: DataFrame, base: Column | None = None) -> DataFrame:
    """norm_url, page_id, url, copies: the first page of every normalised URL.

    An aggregate, not a window: a URL seen by a third of all rows is reduced before
    the shuffle.
    """
    rows = U.with_normalized(pages.drop("html"), F.col("url"), "norm_url", base)
    return rows.groupBy("norm_url").agg(
        F.min(F.struct("page_id", "url")).alias("first"), F.count("*").alias("copies")
    ).select("norm_url", "first.page_id", "first.url", "copies")


def dedup_stats(deduped: DataFrame) -> DataFrame:
    return deduped.agg(F.count("*").alias("total"), (F.sum("copies") - F.count("*")).alias("duplicates"))


# ---- crawl --------------------------------------------------------------------------------

def crawl_frontier(
    seeds: DataFrame, edges: DataFrame, max_depth: int | None = None, max_pages: int | None = None
) -> DataFrame:
    """url, depth, parent_url, priority: breadth-first over edges(src, dst, priority, frame).

    One round per depth, until no new URL is found or `max_depth`, if given, is reached.  Each round joins the frontier with the edges on the source,
    keeps one parent per new URL by aggregate and drops known URLs by anti join; its
    result is written to the shared checkpoint folder, so a lost executor repeats one
    round only.  `max_pages` counts pages in breadth-first order (depth, then priority,
    then URL): the walk ends in the round that reaches it, and only that round's pages are ordered.
    """
    links = cut_lineage(
        edges.select("src", "dst", F.coalesce("priority", F.lit(0)).cast("long").alias("priority"))
    )
    level = cut_lineage(
        seeds.select(F.col("url")).distinct().select(
            "url", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent_url"),
            F.lit(0).cast("long").alias("priority"),
        )
    )
    order = [F.desc("priority"), F.asc("url")]
    left = max_pages
    if left is not None:
        if (n := level.count()) >= left:
            return first_rows(level, order, left)
        left -= n
    known = level
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        found = (
            links.join(level.select(F.col("url").alias("src")), "src")
            .groupBy("dst")
            .agg(F.min(F.struct((-F.col("priority")).alias("np"), F.col("src"))).alias("best"))
            .select(
                F.col("dst").alias("url"), F.lit(depth).cast("long").alias("depth"),
                F.col("best.src").alias("parent_url"), (-F.col("best.np")).alias("priority"),
            )
        )
        level = cut_lineage(found.join(known.select("url"), "url", "left_anti"))
        if level.isEmpty():
            break
        if left is not None:
            if (n := level.count()) >= left:
                return known.unionByName(first_rows(level, order, left))
            left -= n
        known = known.unionByName(level)
    return known


def page_edges(pages: DataFrame, config: U.CrawlConfig = U.CrawlConfig()) -> DataFrame:
    """src, dst, priority, frame: links and frames of pages as normalised edges."""
    links = page_links(pages, config).select(
        "parent_url", F.col("url").alias("dst"), "priority", F.lit(False).alias("frame")
    )
    frames = frame_links(pages).select(
        "parent_url", F.col("url").alias("dst"), F.lit(0).cast("long").alias("priority"), F.lit(True).alias("frame")
    )
    edges = U.with_normalized(links.unionByName(frames), F.col("parent_url"), "src")
    return edges.select("src", "dst", "priority", "frame")


def crawl_stats(frontier: DataFrame, status: Column, page_ms: Column, links: Column, duplicates: Column) -> DataFrame:
    """One row: visited, skipped, failed, links, duplicates, max_depth, avg_page_ms, success_rate."""
    visited, failed = F.count_if(status == "visited"), F.count_if(status == "failed")
    return frontier.agg(
        visited.alias("visited"),
        F.count_if(status == "skipped").alias("skipped"),
        failed.alias("failed"),
        F.coalesce(F.sum(links), F.lit(0)).cast("long").alias("links"),
        F.coalesce(F.sum(duplicates), F.lit(0)).cast("long").alias("duplicates"),
        F.coalesce(F.max(F.when(status == "visited", F.col("depth"))), F.lit(0)).cast("long").alias("max_depth"),
        F.coalesce(F.avg(F.when(status == "visited", page_ms)), F.lit(0.0)).alias("avg_page_ms"),
        F.when(visited + failed > 0, visited / (visited + failed)).otherwise(F.lit(0.0)).alias("success_rate"),
    )
