"""Inputs derived from the given tables for operators whose input the tables do not hold as such.

Each is one SELECT that Spark and the checking engine both run, so the input grows
with the tables.  Texts avoid engine-specific escapes: line feeds are chr(10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NL = "chr(10)"
ROWS_PER_TASK = 5000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# name -> (source table, SELECT)
DERIVED: dict[str, tuple[str, str]] = {}


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt to tasks by their number: a file of short rows is one task, however much text is derived from each."""
    return rows.repartition(-(-rows.count() // ROWS_PER_TASK) or 1)


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = DERIVED[name]
    literal = sql.replace("{", "{{").replace("}", "}}")  # braces of JSON texts are not parameters
    return spark.sql(literal.replace(f"from {table}", f"from {{{table}}}"), **{table: spread(read(spark, sf_dir, table))})


def cte(*names: str) -> str:
    """`name AS (...)` list for the checking engine."""
    return ", ".join(f"{n} as ({DERIVED[n][1]})" for n in names)


DERIVED["markdown_docs"] = (
    "documents",
    "select doc_id, case when doc_id % 11 = 3 then 'Error: ' || source when doc_id % 13 = 5 then 'short' "
    "else '# Title ' || cast(doc_id as string) || ' **' || lang || '**' || chr(10) || chr(10) || "
    "'## Part' || chr(10) || chr(10) || 'See [the _source_](http://x.example/' || source || ') and `code` now.' || "
    "chr(10) || chr(10) || text || chr(10) || chr(10) || '- one' || chr(10) || '1. two' || chr(10) || '> quote' || "
    "chr(10) || '---' || chr(10) || '![pic](p.png) ~~gone~~ ```x``` end' end as markdown from documents",
)
DERIVED["payloads"] = (
    "events",
    "select event_id, case event_id % 7 when 0 then '[' || props || ',' || props || ']' "
    "when 1 then '{\"data\":[' || props || ']}' when 2 then '{\"results\":[' || props || ',' || props || ',' || props || ']}' "
    "when 3 then '{\"items\":[' || props || '],\"data\":7}' when 4 then props "
    "when 5 then '{\"k\": ' else '{\"data\":{\"k\":1},\"k\":' || cast(user_id as string) || '}' end as body from events",
)
DERIVED["deal_payloads"] = (
    "part",
    "select p_partkey, '{\"page\":{\"widgets\":[{\"productInfo\":{\"title\":\"' || p_name || '\",\"price\":\"' || p_brand || "
    "'\",\"rating\":' || cast(p_size as string) || '}},{\"other\":{\"dealBox\":{\"name\":\"' || p_type || "
    "'\",\"savings\":\"5%\",\"inner\":{\"Item\":{\"rating\":4}}}}}],\"items\":[{\"title\":\"skip\"}],\"product\":\"flat\"},\"deep\":' || "
    "repeat('{\"in\":[', 14) || '{\"lastDeal\":{\"title\":\"deep ' || cast(p_partkey as string) || '\"}}' || repeat(']}', 14) || '}' "
    "as body from part",
)
# Pages as they are in the wild: a missing quote before a long rest, tags left open, very many attributes.
DERIVED["broken_pages"] = (
    "customer",
    "select c_custkey as page_id, 'http://b' || cast(c_nationkey as string) || '.example.com/' as url, "
    "case c_custkey % 4 when 0 then '<body><a href=\"x>one ' || c_mktsegment || '</a>' || repeat('<p class=\"k\">' || c_name || '</p>', 40) || '</body>' "
    "when 1 then '<body><ul><li>a<li>b ' || c_name || '<p>open <b>bold</ul>tail</body>' "
    "when 2 then '<body><div ' || repeat('data-a=\"v>\" ', 300) || '>' || c_name || '</div></body>' "
    "else '<body>1 < 2 <em title=''a>b''>' || c_name || '</em> & <br/>end' end as html from customer",
)
DERIVED["entity_texts"] = (
    "customer",
    "select c_custkey as page_id, '<body>caf&eacute; ' || cast(c_custkey as string) || ' &uuml;&sect;&frac12; &amp &#233;&#x41;&#150; "
    "&nope; ?a=1&copy=2 &notin; &#0;&#99999999; &lt;b&gt;</body>' as html from customer",
)
DERIVED["frame_pages"] = (
    "customer",
    "select c_custkey as page_id, 'http://site' || cast(c_nationkey as string) || '.example.com/list/' || "
    "cast(c_custkey % 10 as string) || '?b=2&a=1' as url, "
    "'<html><head><script>var u = {url: \"/rest/' || cast(c_custkey as string) || '\", endpoint: \"data.json\"}; fetch(\"/x/' || c_mktsegment || "
    "'\"); $.get(\"#top\"); $.post(\"javascript:void\"); axios.get(\"https://api.example.net/v1?q=' || cast(c_nationkey as string) || '\")</script></head><body>"
    "<iframe src=\"/frames/' || cast(c_nationkey as string) || '/?z=1&y=2#f\"></iframe><frame src=\"side.html\"><iframe src=\"/frames/' || "
    "cast(c_nationkey as string) || '/?y=2&z=1\"></iframe>"
    "<a href=\"#\">' || cast(2000 + c_nationkey as string) || '</a><a href=\"\">View all</a><a href=\"#\">' || "
    "cast(c_custkey % 50 as string) || '</a><a class=\"btn big\" href=\"/detail/' || cast(c_custkey % 40 as string) || '\">Open</a>"
    "<a href=\"more/' || cast(c_nationkey as string) || '.html\">Learn more</a><a href=\"/back\">View back</a><a href=\"#x\">details</a>"
    "<a href=\"/plain\">plain</a><a href=\"?p=1\">see &gt;&gt;</a>"
    "<div data-year=\"' || cast(1990 + c_nationkey as string) || '\">Year</div><span data-id=\"7\"></span>"
    "<button onclick=\"go(''https://cdn.example.org/d/' || cast(c_nationkey as string) || ''')\">Go &amp; load</button>"
    "<div role=\"button\">Press</div><ul class=\"nav\"><li class=\"nav-item\"><a href=\"/t\">Tab ' || cast(c_nationkey as string) || "
    "'</a></li><li class=\"tab\">Second</li></ul></body></html>' as html from customer",
)
DERIVED["url_cases"] = (
    "events",
    "select event_id, case event_id % 12 when 0 then 'HTTP://WWW.Example.COM:80/a/b/../c/?z=1&a=' || cast(user_id as string) || '#frag' "
    "when 1 then '/p/' || cast(user_id as string) || '/' when 2 then 'img/x.png' when 3 then '//cdn.example.net/lib.js' "
    "when 4 then '?q=' || event_type when 5 then '#top' when 6 then 'mailto:u' || cast(user_id as string) || '@example.com' "
    "when 7 then 'https://sub.example.com/api/v1' when 8 then '/rss/feed/' || event_type when 9 then 'doc.pdf' "
    "when 10 then 'https://Example.com/path/?b=' || cast(user_id as string) || '&a=2&b=1' else '../up/' || event_type end as url, "
    "'https://www.example.com/dir/page' || cast(user_id % 5 as string) || '.html?s=1' as base from events",
)
DERIVED["outbound_urls"] = (
    "events",
    "select event_id, user_id, case event_id % 9 when 0 then 'https://www.google-analytics.com/collect?v=1' "
    "when 1 then 'https://ads.example.com/b/' || cast(user_id as string) when 2 then 'https://shop.example.com/i/' || cast(user_id as string) "
    "when 3 then 'https://twitter.com/i/jot' when 4 then 'https://tracking.example.net/p' when 5 then 'https://example.org/' || event_type "
    "when 6 then 'https://www.googletagmanager.com/gtm.js' when 7 then 'https://ad.doubleclick.net/x' else 'https://blog.example.org/analytics' end as url from events",
)
DERIVED["widget_pages"] = (
    "customer",
    "select c_custkey as page_id, 'http://shop.example.com/w/' || cast(c_custkey as string) as url, "
    "'<html><head><title>' || c_name || '</title><script>fetch(\"/x\")</script></head><body><button>Go</button>' || "
    "repeat('<input type=\"button\" value=\"b\">', cast(c_nationkey % 9 as int)) || "
    "'<table><tbody></tbody></table><table><tr><td>a</td></tr><tr></tr></table><ul></ul><div class=\"data-x\"></div>' || "
    "case c_custkey % 4 when 0 then '<ol id=\"y\"></ol><p>And so on...</p>' when 1 then '<p>Please wait</p>' "
    "when 2 then '<p>Lorem ipsum dolor</p>' else '<div role=\"main\">Text of ' || c_name || '</div>' end || '</body></html>' as html from customer",
)
DERIVED["blocked_pages"] = (
    "events",
    "select event_id, '<html><body>' || case event_id % 9 when 0 then 'Cloudflare says: Ray ID ' || cast(user_id as string) "
    "when 1 then 'Solve the reCAPTCHA, access denied' when 2 then '403 Forbidden' when 3 then 'Unusual Traffic from you' "
    "when 4 then 'Incapsula incident id' when 5 then 'Enter the characters you see below' when 6 then 'hCaptcha' "
    "when 7 then 'cloudflare hosted ' || event_type else event_type end || '</body></html>' as html from events",
)
DERIVED["rich_pages"] = (
    "part",
    "select p_partkey as page_id, 'https://shop.example.com/p/' || cast(p_partkey as string) as url, "
    "'<html><head><title>' || p_name || '</title><meta name=\"description\" content=\"About ' || p_brand || '\">"
    "<meta property=\"og:title\" content=\"' || p_name || '\"><meta property=\"og:site_name\" content=\"Shop ' || cast(p_size as string) || '\">"
    "<meta name=\"twitter:card\" content=\"summary\"><meta name=\"twitter:card\" content=\"large\"><meta itemprop=\"sku\" content=\"' || p_type || '\">"
    "<script type=\"application/ld+json\">{\"@type\":\"Product\",\"name\":\"' || p_name || '\",\"offers\":{\"price\":\"12.5\",\"priceCurrency\":\"EUR\"}}</script>"
    "<script type=\"application/ld+json\">[{\"@type\":\"Organization\",\"name\":\"' || p_brand || '\",\"url\":\"http://b.example\"},"
    "{\"@type\":\"Recipe\",\"cook\":\"' || p_type || '\"},{\"name\":\"untyped\"}]</script>"
    "<script type=\"application/ld+json\">{broken</script><script type=\"application/json\">{\"k\":' || cast(p_size as string) || '}</script>"
    "</head><body><div itemscope itemtype=\"http://schema.org/Product\"><span itemprop=\"name\">' || p_name || '</span>"
    "<a itemprop=\"url\" href=\"/p/1\">x</a><span itemprop=\"tag\">a</span><span itemprop=\"tag\">b</span>"
    "<div itemprop=\"brand\" itemscope itemtype=\"http://schema.org/Organization\"><span itemprop=\"name\">' || p_brand || '</span></div></div>"
    "<form action=\"/buy\" method=\"post\"><input name=\"q\" value=\"' || cast(p_size as string) || '\" required><input type=\"hidden\" name=\"csrf_token\" "
    "value=\"tok' || cast(p_partkey as string) || '\"><select name=\"s\"><option value=\"a\">A</option><option value=\"b\" selected>B</option></select>"
    "<textarea name=\"t\">Note</textarea></form>"
    "<div data-asin=\"A' || cast(p_partkey as string) || '\"><h2><a href=\"/dp/1\"><span>' || p_name || '</span></a></h2><span class=\"a-price\">"
    "<span class=\"a-offscreen\">$' || cast(p_size as string) || '</span></span></div><div data-asin=\"B2\"><span>none</span></div>"
    "<div class=\"contact-box\"><a href=\"mailto:Sales' || cast(p_size as string) || '@Example.com\">mail</a><a href=\"tel:555 123 4567\">call</a></div>"
    "<h1 class=\"company-title\">Acme ' || cast(p_size as string) || '</h1><time datetime=\"2024-03-05\">x</time>"
    "<p>Write to info@x' || cast(p_partkey as string) || '.example.com or 555-123-9999 , see https://docs.example.com/x now</p></body></html>' as html from part",
)
DERIVED["model_replies"] = (
    "events",
    "select event_id, case event_id % 5 when 0 then '```json' || chr(10) || '{\"summary\":\"S' || cast(user_id as string) || '\",\"entities\":[{\"type\":\" Company \","
    "\"data\":{\"name\":\"' || event_type || '\"},\"confidence\":1.7,\"source\":\"body\"}]}' || chr(10) || '```' "
    "when 1 then 'Sure: {\"summary\":\"A\",\"explanation\":\"B\",\"entities\":[{\"type\":\"gadget\",\"data\":{\"n\":' || cast(user_id as string) || '},\"confidence\":\"0.25x\"},"
    "{\"type\":\"person\",\"confidence\":\"high\"}]} done' when 2 then 'no json here ' || event_type when 3 then '{\"explanation\":\"E\",\"entities\":[]}' "
    "else '{\"summary\": broken' end as reply from events",
)
DERIVED["fetch_errors"] = (
    "events",
    "select event_id, ts, user_id, value, cast(event_id % 5 as int) as attempt, case event_id % 12 when 0 then 'request timeout' when 1 then 'connect ECONNRESET' "
    "when 2 then 'Too many' when 3 then 'you are banned' when 4 then 'no entry' when 5 then 'gone' when 6 then 'oops' when 7 then 'solve recaptcha' "
    "when 8 then 'access denied' when 9 then 'bad JSON at ' || event_type when 10 then 'strange' else 'HTTP 404' end as message, "
    "case event_id % 12 when 2 then 429 when 3 then 403 when 4 then 401 when 5 then 404 when 6 then 503 end as status from events",
)
DERIVED["asks"] = (
    "events",
    "select event_id, case event_id % 6 when 0 then 'Refresh https://a.example/' || cast(user_id as string) || ' what is the price?' "
    "when 1 then 'explore https://b.example/x and https://c.example' when 2 then 'just a question about ' || event_type when 3 then 'new scrape please' "
    "when 4 then 'reinforced  https://d.example/' || event_type else 'Follow  links there' end as text from events",
)
