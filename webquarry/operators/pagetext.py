"""HTML to text: heads, noise removal, main content, markdown, structured text.

Operators that need no nesting work on the page row itself and move no data.  The
others go through the token table, one exchange on page_id for the whole chain.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.functions import patterns as P
from webquarry.functions import text as T
from webquarry.functions.markup import attr
from webquarry.operators import dom
from webquarry.operators.skew import laid_out, parts_of

# What counts as noise on a page.
NOISE_SELECTORS = (
    "script", "style", "noscript",
    'iframe[src*="ads"]', 'iframe[src*="advertising"]', 'iframe[src*="doubleclick"]', 'iframe[src*="googlesyndication"]',
    '[class*="ad"]', '[class*="advertisement"]', '[class*="advert"]',
    '[id*="ad"]', '[id*="advertisement"]', '[id*="advert"]',
    "[data-ad]", "[data-ad-client]", "[data-ad-slot]",
    ".ad-banner", ".ad-container", ".ad-wrapper", ".advertisement", ".adsbygoogle", ".google-ad",
    ".social-share", ".share-buttons", ".social-media",
    ".twitter-widget", ".facebook-widget", ".instagram-embed", ".disqus-comments", ".comment-section",
    "nav", "footer", "header",
    'aside[class*="sidebar"]', ".sidebar", ".related-posts", ".related-articles",
    ".newsletter", ".subscribe", ".cookie-banner", ".cookie-consent",
    '[role="banner"]', '[role="navigation"]', '[role="complementary"]', '[role="contentinfo"]',
)
# Where main content is looked for, best first.
MAIN_SELECTORS = (
    "main", "article", '[role="main"]', ".content", "#content", ".post", ".article", ".entry-content",
    ".post-content", ".article-content", ".main-content", ".page-content", "section", ".body-content",
)
MIN_MAIN_CHARS = 200

# Tags, attributes and URL schemes that survive sanitising.
ALLOWED_TAGS = (
    "address article aside footer header h1 h2 h3 h4 h5 h6 hgroup main nav section blockquote dd div dl dt "
    "figcaption figure hr li ol p pre ul a abbr b bdi bdo br cite code data dfn em i kbd mark q rb rp rt rtc ruby "
    "s samp small span strong sub sup time u var wbr caption col colgroup table tbody td tfoot th thead tr img"
).split()
ALLOWED_ATTRIBUTES = {"a": ["href", "title", "target", "rel"], "img": ["src", "alt", "title", "width", "height"]}
GLOBAL_ATTRIBUTES = ["class", "id"]
DROPPED_WITH_TEXT = r"(?is)<(?:textarea|option|noscript)\b[^>]*>.*?</(?:textarea|option|noscript)\s*>"


def page_title(html: Column) -> Column:
    return T.js_trim(T.decode_entities(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)))


def page_description(html: Column) -> Column:
    metas = T.find_all(html, r"(?is)<meta\b[^>]*>")

    def first(name: str, value: str) -> Column:
        hits = F.filter(metas, lambda m: F.coalesce(attr(m, name) == value, F.lit(False)))
        return F.nullif(F.coalesce(attr(F.get(hits, 0), "content"), F.lit("")), F.lit(""))

    return F.coalesce(first("name", "description"), first("property", "og:description"), F.lit(""))


def page_head(pages: DataFrame) -> DataFrame:
    return pages.select(
        "page_id", page_title(F.col("html")).alias("title"), page_description(F.col("html")).alias("description")
    )


def body_source(html: Column) -> Column:
    """Visible source from <body> on; without a body tag, everything after the head."""
    return T.sub(dom.visible_source(html), r"(?is)\A.*?<body\b[^>]*>|\A.*?</head\s*>")


def body_text(html: Column) -> Column:
    """Text of the body, white space collapsed.  No token table needed: tags simply vanish."""
    return T.collapse(T.decode_entities(T.sub(body_source(html), P.TAG)))


def _open_tag(names: str) -> str:
    return rf"(?i)<(?:{names})(?:[\s/]{P.INSIDE_TAG})?>"


def structured_text(html: Column) -> Column:
    """Body text with blank lines before blocks, '- ' before list items, line breaks kept."""
    out = T.sub(body_source(html), r"(?is)<noscript\b.*?</noscript\s*>")
    out = T.sub(out, rf">{P.WS}+<", "><")
    out = T.sub(out, _open_tag("h[1-6]|p|div|section|article"), "\n\n")
    out = T.sub(out, _open_tag("li"), "\n- ")
    out = T.sub(out, _open_tag("br|hr"), "\n")
    return T.js_trim(T.decode_entities(T.sub(out, P.TAG)))


# ---- noise --------------------------------------------------------------------------------

def word_boundary_selectors(selectors=NOISE_SELECTORS) -> tuple[str, ...]:
    """The stricter set: substring tests on 'ad' replaced by whole class and id names."""
    loose = {'[class*="ad"]': ".ad", '[id*="ad"]': "#ad"}
    return tuple(loose.get(s, s) for s in selectors)


def mark_noise(pages: DataFrame, selectors=NOISE_SELECTORS, partitioned: bool = False) -> DataFrame:
    """All tokens with `noise` (token lies in a noise element) and `removed` (tag that starts one).

    A token is covered when the furthest end of the noise elements opened so far
    reaches it: one running maximum, no interval join.
    """
    tokens = dom.spans(dom.with_totals(dom.html_tokens(pages, partitioned)))
    tokens = dom.with_selectors(tokens, {"hit": ", ".join(selectors)})
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    tokens = tokens.withColumn("noise_end", F.when(F.col("hit"), F.col("last")))
    return tokens.withColumns({
        "noise": F.coalesce(F.max("noise_end").over(w) >= F.col("pos"), F.lit(False)),
        "removed": F.when(F.col("noise_end").isNotNull(), F.col("tag")),
    })


def _joined(parts: Column, field: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(parts)), lambda s: s[field]), "")


def drop_noise(pages: DataFrame, selectors=NOISE_SELECTORS, partitioned: bool = False) -> DataFrame:
    """page_id, html without noise elements, removed_tags (sorted, distinct)."""
    marked = mark_noise(pages, selectors, partitioned)
    kept = F.when(~F.col("noise") & (F.col("tag") != "#end"), F.struct("pos", "tok"))
    return marked.groupBy("page_id").agg(
        _joined(kept, "tok").alias("html"),
        F.array_sort(F.collect_set("removed")).alias("removed_tags"),
    )


def main_content(pages: DataFrame, denoise: bool = True) -> DataFrame:
    """page_id, main_selector, main_text, main_html, main_len.

    First selector whose first element holds at least 200 characters, else the body
    under the same rule, else nulls.
    """
    clean = drop_noise(pages).select("page_id", "html") if denoise else laid_out(pages.select("page_id", "html"), "page_id", parts_of(pages, "html"))
    ranked = [*MAIN_SELECTORS, "body"]
    els = dom.with_selectors(dom.elements(clean, partitioned=True), {f"c{i}": sel for i, sel in enumerate(ranked)})
    # The element that answers each selector, all in one aggregate.
    where = F.struct("pos", "raw0", "raw1", "src0", "src1")
    firsts = els.groupBy("page_id").agg(*[
        F.min(F.when(F.col(f"c{i}"), where)).alias(f"c{i}") for i in range(len(ranked))
    ])
    source = clean.withColumns({"visible": dom.visible_source(F.col("html")), "raw": dom.page_text(F.col("html"))})
    both = source.join(firsts, "page_id", "left")

    def cut(col: str, c: Column, kind: str) -> Column:
        start, size = c[f"{kind}0"] + 1, c[f"{kind}1"] - c[f"{kind}0"]
        return F.col(col).substr(start.cast("int"), size.cast("int"))

    cands = F.array_compact(F.array(*[
        F.when(F.col(f"c{i}").isNotNull(), F.struct(F.lit(sel).alias("selector"), F.col(f"c{i}").alias("c")))
        for i, sel in enumerate(ranked)
    ]))
    measured = F.transform(
        cands,
        lambda x: F.struct(
            x["selector"].alias("selector"),
            T.collapse(T.decode_entities(cut("raw", x["c"], "raw"))).alias("text"),
            x["c"].alias("c"),
        ),
    )
    best = F.get(F.filter(measured, lambda x: F.length(x["text"]) >= MIN_MAIN_CHARS), 0)
    return both.withColumn("best", best).select(
        "page_id",
        F.col("best.selector").alias("main_selector"),
        F.col("best.text").alias("main_text"),
        cut("visible", F.col("best.c"), "src").alias("main_html"),
        F.length("best.text").cast("long").alias("main_len"),
    )


# ---- sanitising ---------------------------------------------------------------------------

def sanitize_html(html: Column) -> Column:
    """Allow-listed tags, attributes and URL schemes; text of refused tags stays.  Works inside the row."""
    source = T.sub(dom.visible_source(html), DROPPED_WITH_TEXT)

    def safe_url(value: Column, tag: Column) -> Column:
        scheme = F.lower(F.regexp_extract(T.sub(value, r"[\x00-\x20]"), r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1))
        ok = F.when(tag == "img", scheme.isin("", "http", "https", "data")).otherwise(
            scheme.isin("", "http", "https", "mailto", "tel")
        )
        return ok

    def clean_attrs(tok: Column, tag: Column) -> Column:
        pairs = T.find_all(tok, r"""(?s)[\s"']([a-zA-Z_:@][\w:.\-]*\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+))""", 1)

        def kept(p: Column) -> Column:
            name = F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1))
            allowed = name.isin(GLOBAL_ATTRIBUTES) | F.startswith(name, F.lit("data-"))
            for owner, names in ALLOWED_ATTRIBUTES.items():
                allowed = allowed | ((tag == owner) & name.isin(names))
            value = T.sub(T.sub(p, r"^[^=]*=\s*"), r"""\A["']|["']\z""")
            return allowed & (~name.isin("href", "src", "cite") | safe_url(value, tag))

        def written(p: Column) -> Column:
            name = F.lower(F.regexp_extract(p, r"^([^\s=]+)", 1))
            value = T.sub(T.sub(p, r"^[^=]*=\s*"), r"""\A["']|["']\z""")
            return F.concat(F.lit(" "), name, F.lit('="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))

        return F.array_join(F.transform(F.filter(pairs, kept), written), "")

    def piece(tok: Column) -> Column:
        tag = F.lower(F.regexp_extract(tok, P.TAG_NAME, 1))
        is_tag = T.matches(tok, r"(?s)^<[a-zA-Z/!?].*>\z")
        close = F.when(tag.isin("br", "hr", "img", "col", "wbr"), F.lit(" />")).otherwise(F.lit(">"))
        return (
            F.when(~is_tag, F.when(tok == "<", F.lit("&lt;")).otherwise(tok))
            .when(~tag.isin(ALLOWED_TAGS), F.lit(""))
            .when(F.startswith(tok, F.lit("</")), F.concat(F.lit("</"), tag, F.lit(">")))
            .otherwise(F.concat(F.lit("<"), tag, clean_attrs(tok, tag), close))
        )

    return F.array_join(F.transform(T.find_all(source, P.TOKEN), piece), "")


# ---- markdown -----------------------------------------------------------------------------

_BLOCKS = "p div section article header footer main nav aside table form ul ol dl figure body".split()


# Marks of where a block quote begins and ends while fragments are joined; no characters of any text.
QUOTE_OPEN, QUOTE_CLOSE = "\ufdd0", "\ufdd1"


def _quoted(md: Column) -> Column:
    """Every line between quote marks gets "> " for each quote around it."""

    def step(acc: Column, piece: Column) -> Column:
        mark = F.substring(piece, 1, 1)
        depth = acc["depth"] + F.when(mark == QUOTE_OPEN, 1).when(mark == QUOTE_CLOSE, -1).otherwise(0)
        body = F.when(mark.isin(QUOTE_OPEN, QUOTE_CLOSE), F.substring(piece, 2, F.length(piece))).otherwise(piece)
        text = T.sub(T.sub(body, r"\A\s*\n|\A\s+\z|\n\s*\z"), r"\n{3,}", "\n\n")
        prefix = F.repeat(F.lit("> "), depth)
        gap = F.when(acc["depth"] > 0, F.concat(F.lit("\n"), F.rtrim(F.repeat(F.lit("> "), F.least(depth, acc["depth"]))), F.lit("\n"))).otherwise(F.lit(""))
        lines = F.array_join(F.transform(F.split(text, F.lit("\n")), lambda line: F.rtrim(F.concat(prefix, line))), "\n")
        more = F.when(depth <= 0, body).when(text == "", F.lit("")).otherwise(F.concat(gap, lines))
        return F.struct(depth.cast("int").alias("depth"), F.concat(acc["out"], more).alias("out"))

    start = F.struct(F.lit(0).cast("int").alias("depth"), F.lit("").alias("out"))
    return F.aggregate(F.split(md, F.lit(f"(?=[{QUOTE_OPEN}{QUOTE_CLOSE}])")), start, step, lambda acc: acc["out"])


def html_to_markdown(pages: DataFrame, partitioned: bool = False) -> DataFrame:
    """page_id, markdown.

    Each token becomes a fragment, each element end another one placed where the
    element stops (also when its end tag is missing); fragments are joined in order.
    """
    tokens = dom.spans(dom.with_totals(dom.html_tokens(pages, partitioned)))
    tag, kind, tok = F.col("tag"), F.col("kind"), F.col("tok")
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_list = tag.isin("ul", "ol") & (kind == "open")
    before = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)

    def depth(*names: str) -> Column:
        step = F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
        return F.sum(F.when(tag.isin(*names), step).otherwise(0)).over(w)

    tokens = tokens.withColumns({
        "list_depth": depth("ul", "ol"),
        "in_pre": F.coalesce(F.max(F.when((tag == "pre") & (kind == "open"), F.col("last"))).over(before) >= F.col("pos"), F.lit(False)),
        "prev_tok": F.lag("tok").over(W.partitionBy("page_id").orderBy("pos")),
        "next_tok": F.lead("tok").over(W.partitionBy("page_id").orderBy("pos")),
    })
    # First cell at or after a token, read from the back: tells header rows from body rows.
    ahead = W.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    tokens = tokens.withColumn(
        "first_cell", F.last(F.when(tag.isin("td", "th") & (kind == "open"), tag), ignorenulls=True).over(ahead)
    )
    per_depth = W.partitionBy("page_id", "list_depth").orderBy("pos")
    tokens = tokens.withColumns({
        "list_pos": F.last(F.when(is_list, F.col("pos")), ignorenulls=True).over(per_depth),
        "list_tag": F.last(F.when(is_list, tag), ignorenulls=True).over(per_depth),
    })
    item = (tag == "li") & (kind == "open")
    tokens = tokens.withColumn(
        "ordinal",
        F.sum(item.cast("int")).over(W.partitionBy("page_id", "list_depth", "list_pos").orderBy("pos")),
    )
    blank = (F.col("ink1") - F.col("ink0")) == 0
    href = attr(tok, "href")
    titled = F.when(F.coalesce(attr(tok, "title"), F.lit("")) != "", F.concat(F.lit(' "'), attr(tok, "title"), F.lit('"'))).otherwise(F.lit(""))
    src = F.coalesce(attr(tok, "src"), F.lit(""))
    lang = F.regexp_extract(F.col("next_tok"), r"""(?i)^<code\b[^>]*class\s*=\s*["'][^"']*language-(\w+)""", 1)
    code_block = (tag == "pre") & T.matches(F.coalesce(F.col("next_tok"), F.lit("")), r"(?i)^<code\b")
    bold, italic = tag.isin("b", "strong"), tag.isin("i", "em")
    struck, code = tag.isin("del", "s", "strike"), (tag == "code") & ~F.col("in_pre")
    cells = F.col("cells1") - F.col("cells0")
    heading = T.matches(tag, r"^h[1-6]$")
    is_open = kind.isin("open", "void")
    opening = (
        F.when(~is_open, F.lit(""))
        .when(heading, F.concat(F.lit("\n\n"), F.repeat(F.lit("#"), F.substring(tag, 2, 1).try_cast("int")), F.lit(" ")))
        .when(item, F.concat(
            F.lit("\n"), F.repeat(F.lit("    "), F.greatest(F.col("list_depth").cast("int") - 1, F.lit(0))),
            F.when(F.col("list_tag") == "ol", F.concat(F.col("ordinal").cast("string"), F.lit(".  "))).otherwise(F.lit("-   ")),
        ))
        .when(tag.isin("ul", "ol") & (F.col("list_depth") > 1), F.lit(""))
        .when(tag == "tr", F.lit("\n|"))
        .when(tag.isin("td", "th"), F.lit(" "))
        .when(code_block, F.concat(F.lit("\n\n```"), lang, F.lit("\n")))
        .when(tag == "pre", F.lit("\n\n"))
        .when(tag == "blockquote", F.lit("\n\n" + QUOTE_OPEN))
        .when((bold | italic | struck) & blank, F.lit(""))
        .when(bold, F.lit("**"))
        .when(italic, F.lit("*"))
        .when(struck, F.lit("~"))
        .when(code, F.lit("`"))
        .when((tag == "a") & href.isNotNull() & (~blank | (F.col("els1") > F.col("els0"))), F.lit("["))
        .when(tag == "br", F.lit("  \n"))
        .when(tag == "hr", F.lit("\n\n---\n\n"))
        .when((tag == "img") & (src != ""), F.concat(
            F.lit("!["), F.coalesce(attr(tok, "alt"), F.lit("")), F.lit("]("), src, titled, F.lit(")")))
        .when(tag.isin(_BLOCKS), F.lit("\n\n"))
        .otherwise(F.lit(""))
    )
    ending = (
        F.when(kind != "open", F.lit(""))
        .when(heading, F.lit("\n\n"))
        .when(tag.isin("ul", "ol") & (F.col("list_depth") > 1), F.lit(""))
        .when(tag == "tr", F.when(
            F.col("has_th"), F.concat(F.lit("\n|"), F.repeat(F.lit(" --- |"), cells.cast("int")))).otherwise(F.lit("")))
        .when(tag.isin("td", "th"), F.lit(" |"))
        .when(code_block, F.lit("\n```\n\n"))
        .when(tag == "blockquote", F.lit(QUOTE_CLOSE + "\n\n"))
        .when(tag == "pre", F.lit("\n\n"))
        .when((bold | italic | struck) & blank, F.lit(""))
        .when(bold, F.lit("**"))
        .when(italic, F.lit("*"))
        .when(struck, F.lit("~"))
        .when(code, F.lit("`"))
        .when((tag == "a") & href.isNotNull() & (~blank | (F.col("els1") > F.col("els0"))), F.concat(F.lit("]("), href, titled, F.lit(")")))
        .when(tag.isin(_BLOCKS), F.lit("\n\n"))
        .otherwise(F.lit(""))
    )
    tokens = tokens.withColumn("has_th", F.coalesce(F.col("first_cell") == "th", F.lit(False)))
    flat = T.sub(F.col("text"), P.WS_RUN, " ")
    escaped = T.sub(flat, r"([\\*_`\[\]])", r"\\$1")
    escaped = T.sub(T.sub(escaped, r"^(-|>|~~~|=+|\+ |#{1,6} )", r"\\$1"), r"^(\d+)\. ", r"$1\\. ")
    blank_break = T.matches(F.col("text"), rf"\A{P.WS}*\n{P.WS}*\z")
    body = (
        F.when(kind != "text", opening)
        .when(F.col("in_pre"), F.col("text"))
        .when(blank_break, F.lit(""))
        .otherwise(escaped)
    )
    pieces = F.array(
        F.struct(F.col("pos").alias("at"), F.lit(1).alias("phase"), F.lit(0).alias("inner"), body.alias("frag")),
        F.struct(F.coalesce(F.col("stop"), F.col("pos")).alias("at"), F.lit(0).alias("phase"), (-F.col("pos")).alias("inner"), ending.alias("frag")),
    )
    rows = tokens.select("page_id", F.explode(F.filter(pieces, lambda p: p["frag"] != "")).alias("p"))
    joined = rows.groupBy("page_id").agg(_joined(F.col("p"), "frag").alias("markdown"))
    md = F.col("markdown")
    md = F.when(F.contains(md, F.lit(QUOTE_OPEN)), _quoted(md)).otherwise(md)
    return joined.withColumn("markdown", T.markdown_clean(md))


# ---- the whole page pipeline --------------------------------------------------------------

def page_pipeline(
    pages: DataFrame,
    *,
    clean_html: bool = True,
    markdown: bool = True,
    text: bool = True,
    max_length: int | None = None,
) -> DataFrame:
    """page_id, clean_html, markdown, text, text_len, stages, status.

    Stage 1 removes noise and sanitises, stage 2 writes markdown from the clean page,
    stage 3 structured text from the original page, then cleaned.  A stage that gives
    nothing for a non-empty page falls back to stripped tags and is named in `status`.
    """
    base = pages.select("page_id", "html")
    if clean_html:
        staged = drop_noise(base).select("page_id", sanitize_html(F.col("html")).alias("clean_html"))
    else:
        staged = laid_out(base, "page_id", parts_of(base, "html")).select("page_id", F.col("html").alias("clean_html"))
    out = staged
    if markdown:
        md = html_to_markdown(staged.withColumnRenamed("clean_html", "html"), partitioned=True)
        out = out.join(md, "page_id", "left")
    else:
        out = out.withColumn("markdown", F.lit(None).cast("string"))
    if text:
        texts = laid_out(base, "page_id", parts_of(base, "html")).select(
            "page_id",
            T.clean_text(structured_text(F.col("html")), max_length=max_length).alias("text"),
            T.strip_tags_only(F.col("html")).alias("plain"),
        )
        out = out.join(texts, "page_id")
    else:
        out = out.withColumns({"text": F.lit(None).cast("string"), "plain": F.lit("")})
    missing = F.array_compact(F.array(
        F.when(F.lit(clean_html) & (F.col("clean_html") == ""), "html"),
        F.when(F.lit(markdown) & (F.coalesce(F.col("markdown"), F.lit("")) == ""), "markdown"),
        F.when(F.lit(text) & (F.coalesce(F.col("text"), F.lit("")) == ""), "text"),
    ))
    filled = out.withColumns({
        "status": F.when(F.size(missing) == 0, F.lit("ok")).otherwise(F.concat(F.lit("fallback:"), F.array_join(missing, ","))),
        "text": F.when(F.lit(text), F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("plain"))),
        "markdown": F.when(F.lit(markdown), F.coalesce(F.nullif(F.col("markdown"), F.lit("")), F.col("plain"))),
    })
    return filled.select(
        "page_id", "clean_html", "markdown", "text",
        F.length("text").cast("long").alias("text_len"),
        F.lit(int(clean_html) + int(markdown) + int(text)).cast("long").alias("stages"),
        "status",
    )


def checked_pipeline(
    pages: DataFrame, checks: Mapping[str, Mapping[str, Column]], *, stop_on_error: bool = False, max_length: int | None = None
) -> DataFrame:
    """page_id, clean_html, markdown, text, executed array<string>, errors array<struct<stage, cause>>.

    The stages of `page_pipeline`, each with its causes of failure: `checks` gives for "html", "markdown" and "text" conditions on
    `html`, the input of that stage; the first that holds is the cause, and a null page fails everywhere with "no page".  A failed stage
    never sees the page.  Without a clean page, markdown is written from the page as it came; a failed markdown
    stage leaves an empty text, a failed text stage stripped tags.  With `stop_on_error` the failed
    stage and all later ones give null and later ones are not tried.  `page_id` is unique.
    """
    def cause(stage: str) -> Column:
        found = [F.when(F.col("html").isNull(), F.lit("no page"))] + [F.when(holds, F.lit(name)) for name, holds in checks.get(stage, {}).items()]
        return F.coalesce(*found)

    base = laid_out(pages.select("page_id", "html"), "page_id", parts_of(pages, "html")).withColumn("html_error", cause("html"))
    clean = drop_noise(base.filter("html_error IS NULL").select("page_id", "html"), partitioned=True)
    clean = clean.select("page_id", sanitize_html(F.col("html")).alias("clean_html"))
    staged = base.join(clean, "page_id", "left").withColumn("clean_html", F.when(F.col("html_error").isNull(), F.coalesce("clean_html", F.lit(""))))
    stop = F.lit(stop_on_error)
    first = stop & F.col("html_error").isNotNull()
    tried = staged.select("page_id", "html_error", "clean_html", F.col("html").alias("page"), F.coalesce(F.nullif("clean_html", F.lit("")), "html").alias("html"))
    tried = tried.withColumn("markdown_error", F.when(~first, cause("markdown")))
    md = html_to_markdown(tried.filter(~first & F.col("markdown_error").isNull()).select("page_id", "html"), partitioned=True)
    second = first | (stop & F.col("markdown_error").isNotNull())
    out = tried.join(md, "page_id", "left").drop("html").withColumnRenamed("page", "html").withColumn("text_error", F.when(~second, cause("text")))
    written = lambda name, tried, value, instead: F.when(tried & F.col(f"{name}_error").isNull(), value).when(~stop, instead)
    third = second | (stop & F.col("text_error").isNotNull())
    error = lambda name: F.when(F.col(f"{name}_error").isNotNull(), F.struct(F.lit(name).alias("stage"), F.col(f"{name}_error").alias("cause")))
    ran = lambda name, tried: F.when(tried & F.col(f"{name}_error").isNull(), F.lit(name))
    return out.select(
        "page_id", "clean_html",
        written("markdown", ~second, F.coalesce("markdown", F.lit("")), F.lit("")).alias("markdown"),
        written("text", ~third, T.clean_text(structured_text(F.col("html")), max_length=max_length), F.coalesce(T.strip_tags_only(F.col("html")), F.lit(""))).alias("text"),
        F.array_compact(F.array(ran("html", F.lit(True)), ran("markdown", ~first), ran("text", ~second))).alias("executed"),
        F.array_compact(F.array(error("html"), error("markdown"), error("text"))).alias("errors"),
    )


def quarantined(result: DataFrame) -> DataFrame:
    """page_id, stage, cause: one row for every failed stage of `checked_pipeline`."""
    return result.select("page_id", F.inline("errors"))


def pipeline_report(result: DataFrame) -> DataFrame:
    """One row of run statistics over pipeline output."""
    return result.agg(
        F.count("*").alias("pages"),
        F.sum("stages").alias("stages_run"),
        F.count_if(F.col("status") == "ok").alias("pages_ok"),
        F.count_if(F.col("status") != "ok").alias("pages_with_fallback"),
        F.sum("text_len").alias("text_chars"),
        F.sum(F.length("markdown")).alias("markdown_chars"),
    )
