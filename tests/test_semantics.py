"""Small inputs with known answers: text, markdown, rules, quality, registries."""

import pytest
from pyspark.sql import functions as F

from webquarry.functions import text as T
from webquarry.functions import transforms as X
from webquarry.functions import urls as U
from webquarry.operators import entities as E
from webquarry.operators import pagetext as PT
from webquarry.operators import quality as Q
from webquarry.operators import relevance as R
from webquarry.operators import selection as G
from webquarry.operators import structured as S

PAGE = (
    '<!doctype html><html><head><title>Harbour tides</title><meta name="description" content="When the ferry leaves"></head>'
    '<body><h1>Ferry times</h1><p>The first boat leaves at six.</p><main>Tickets on board.</main><script>var boats = 3</script></body></html>'
)


def one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "v string").select(*columns).first()
    return row[0] if len(row) == 1 else tuple(row)


def pages(spark, *htmls):
    return spark.createDataFrame([(i, f"https://example.com/p{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


@pytest.mark.parametrize("raw, clean", [
    ("a\r\nb\rc", "a\nb\nc"), ("  a  ", "a"), ("é", "é"), ("a​b\x07c", "abc"), ("a\n\n\n\nb", "a\n\nb"), ("   ", ""), ("x  \t y", "x y"),
    ("a \n  b", "a\nb"),
])
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, T.clean_text(F.col("v"))) == clean


def test_markdown_to_text_keeps_the_image_quirk(spark):
    assert one(spark, "# H\n\n**b** [t](u) ![a](u)", T.markdown_to_text(F.col("v"))) == "H\n\nb t !a"


@pytest.mark.parametrize("html, part", [
    ("<h1>A</h1><h2>B</h2>", "# A\n## B"), ("<p>x <strong>b</strong> <em>i</em></p>", "x **b** *i*"), ('<a href="u">t</a>', "[t](u)"),
    ('<img src="s" alt="a">', "![a](s)"), ("<ol><li>x</li><li>y</li></ol>", "1.  x\n2.  y"), ("<blockquote>q</blockquote>", "> q"), ("<p>a</p><blockquote><p>q1</p><p>q2</p></blockquote><pre><code>x\n</code></pre>", "a\n\n> q1\n>\n> q2\n```\nx\n```"),
    ("<blockquote>o<blockquote>i</blockquote></blockquote><p>z</p>", "> o\n>\n> > i\n\nz"),
    ('<pre><code class="language-js">a = 1\n</code></pre>', "```js\na = 1\n"),
    ("<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b |\n| --- | --- |\n| 1 | 2 |"),
])
def test_markdown(spark, html, part):
    assert part in PT.html_to_markdown(pages(spark, html)).first().markdown


def test_page_pipeline_stages(spark):
    row = PT.page_pipeline(pages(spark, PAGE)).first()
    assert "# Ferry times" in row.markdown and "The first boat leaves at six." in row.text and "boats" not in row.clean_html
    off = PT.page_pipeline(pages(spark, PAGE), markdown=False).first()
    assert off.markdown is None and off.stages == 2


def test_malformed_page(spark):
    assert "left open" in PT.page_pipeline(pages(spark, "<body><div><p>left open<p>and the next</body>")).first().text


def test_broken_pages_do_not_overflow(spark):
    rest = "".join(f'<p class="k{i}">w{i}</p>' for i in range(40_000))
    missing = f'<body><a href="x>one</a>{rest}</body>'
    many = "<body><div " + " ".join(f'a{i}="v>"' for i in range(2000)) + ">inside</div></body>"
    large = "<body>" + "<p title='a'>five megabytes</p>" * 170_000 + "</body>"
    bare = f"<body><a {'x' * 2000}=1 href=/y>link</a></body>"
    rows = {r.page_id: r.text for r in pages(spark, missing, many, large, bare).select("page_id", PT.body_text(F.col("html")).alias("text")).collect()}
    assert len(missing) > 1_000_000 and "w39999" in rows[0] and rows[1] == "inside" and len(rows[2]) > 2_000_000 and rows[3] == "link"
    from webquarry.operators import links as L

    assert {r.page_id for r in L.anchors(pages(spark, missing, bare)).collect()} >= {1}
    assert L.ajax_endpoints(pages(spark, missing, many)).count() == 0


def test_character_references(spark):
    got = one(spark, "&eacute;&uuml;&frac12; &amp &#233; &#x41; &#150; &nope; ?a=1&copy=2 &notin; &#0;", T.decode_entities(F.col("v")))
    assert got == "éü½ & é A – &nope; ?a=1&copy=2 ∉ �"


def test_json_items_at_any_depth(spark):
    from webquarry.sources.payloads import json_find_items

    bodies = [(d, '{"a":[' * d + '{"myDeal":{"title":"t%d"}}' % d + "]}" * d) for d in (0, 3, 4, 12, 20)]
    rows = json_find_items(spark.createDataFrame(bodies, "k int, body string"), "k", "body").collect()
    assert {(r.k, r.title) for r in rows} == {(d, f"t{d}") for d in (0, 3, 4, 12, 20)}


@pytest.mark.parametrize("selector, want", [
    ('[title="a b"]', ["x"]), ('[data-x="a,b"]', ["y"]), ("p:not(.k)", ["x", "y"]), ("p:not([title])", ["y", "z"]), (".k, [title]", ["x", "z"]), ("div p.k", ["z"]),
    (":not(div).k", ["z"]),
])
def test_selector_forms(spark, selector, want):
    from webquarry.operators import dom

    html = '<p title="a b">x</p><p data-x="a,b">y</p><div><p class="k j">z</p></div>'
    rows = dom.select_elements(pages(spark, html), {"s": (selector, None)}).orderBy("pos").collect()
    assert [r.value for r in rows] == want


STRUCTURE = """<html><body><div id="a"><p>1<p class="k">2</p><ul><li>x<li class="k">y</li><li>z</ul><p>3</p></div><div><b>m<p>4</b>n</p><em></em></div></body></html>"""


SELECTORS = [
    ("div > p", ["1", "2", "3"]), ("b > p", ["4n"]), ("ul + p", ["3"]), ("p + p", ["2"]), (".k ~ p", ["3"]), ("li:first-child", ["x"]), ("li:nth-child(2n)", ["y"]), ("li:nth-child(odd)", ["x", "z"]),
    ("li:not(:nth-child(n+2))", ["x"]), ("p:nth-last-of-type(1)", ["3", "4n"]), ("div:last-child > b", ["m4"]), ("div:first-of-type li:last-child", ["z"]), ("ul:only-of-type > .k", ["y"]),
    ("body > div > ul > li", ["x", "y", "z"]), ("html:root > body p.k", ["2"]), ("li:nth-child(-n+2), b", ["x", "y", "m4"]), ("div ul .k + li", ["z"]), ("p.k ~ ul li:only-child", []), ("b:not(:empty)", ["m4"]),
]


def test_structural_selectors(spark):
    from webquarry.operators import dom

    rows = dom.select_elements(pages(spark, STRUCTURE), {selector: (selector, None) for selector, _ in SELECTORS}).orderBy("pos").collect()
    assert {s: [r.value for r in rows if r.name == s] for s, _ in SELECTORS} == dict(SELECTORS)


XPATHS = [
    ("//div/p[2]", ["2"]), ("//ul/li[last()]", ["z"]), ("//li[position()<=2]", ["x", "y"]), ("//li[@class='k']/preceding-sibling::li", ["x"]), ("//p[@class='k'][1]", ["2"]),
    ("/html/body/div[1]/p[last()-1]", ["2"]), ("//em/../b", ["m4"]), ("//li/parent::ul/following-sibling::p", ["3"]), ("//b/ancestor::div/em | //ul/*[1]", ["x"]), ("//p[not(@class) and not(@id)][2]", ["3"]),
    ("//div[@id='b' or @id=\"a\"]/descendant::li[@class != 'x']", ["y"]), ("//div[@id]/@id", ["a"]), ("/div", []), ("//ul/node()[2]", ["y"]),
]


def test_structural_paths(spark):
    rows = E.paths_select(pages(spark, STRUCTURE), {p: p for p, _ in XPATHS if "/@" not in p}).orderBy("pos").collect()
    assert {p: [r.value for r in rows if r.name == p] for p, _ in XPATHS if "/@" not in p} == {p: want for p, want in XPATHS if "/@" not in p}
    assert [r.value for r in E.xpath_select(pages(spark, STRUCTURE), "//div[@id]/@id").collect()] == ["a"]


def test_rules_with_structure(spark):
    sets = E.RuleSets((E.RuleSet("own", 1, (E.Rule("a", "article", selector="div > p:nth-of-type(2)"), E.Rule("b", "custom", xpath="//li[2]", multiple=True))),))
    got = {(r.type, *r.data.values()) for r in E.rule_extract(pages(spark, STRUCTURE), sets).collect()}
    assert got == {("article", "2"), ("custom", "y")}


def test_forms_that_are_not_covered_raise(spark):
    from webquarry.functions.markup import css

    for selector in ("> li", "h1 +", "a > + b", "li:nth-child(x)", "!!!", "a:hover", "", "a,,b", ":not(a b)", "a:first-childish"):
        with pytest.raises(ValueError):
            css(selector)
    for path in ("html", "//ul/", "//div[text()='x']", "//li[.='x']", "//a[@b or]", "//a/following-sibling::b[1]", "//a[b]", "//a//..", "//a/@b | //c", "//a/@b/c"):
        with pytest.raises(ValueError):
            E.xpath_select(pages(spark, PAGE), path)
    html = '<a href="u" rel="n">k</a><a href="v">l</a>'
    assert [r.value for r in E.xpath_select(pages(spark, html), '//a[@href and @rel="n"]').collect()] == ["k"]
    assert [r.value for r in E.xpath_select(pages(spark, html), "//a[not(@rel)]/text()").collect()] == ["l"]


@pytest.mark.parametrize("url, want", [
    ("HTTPS://WWW.Example.com:443/a/?b=2&a=1#f", "https://www.example.com/a?a=1&b=2"), ("https://e.com", "https://e.com/"), ("not a url", "not a url"),
    ("https://e.com/?x=2&x=1", "https://e.com/?x=2&x=1"),
])
def test_normalize_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert U.with_normalized(df, F.col("u"), "n").first().n == want


def test_allow_list_does_not_override_the_external_check(spark):
    cfg = U.CrawlConfig(allowed_domains=("other.com",))
    df = spark.createDataFrame([("https://other.com/a", "https://e.com/")], "u string, b string")
    assert df.select(U.should_follow(F.col("u"), F.col("b"), cfg)).first()[0] is False


def test_transforms(spark):
    v = F.col("v")
    assert one(spark, "$1,234.50", X.apply_transform(v, "parseNumber")) == "1234.5"
    assert one(spark, "x", X.apply_transform(v, "parseNumber")) is None
    assert one(spark, "/rel", X.apply_transform(v, "parseUrl")) is None
    assert one(spark, "v", X.apply_transform(v, "twice", {"twice": lambda c: F.concat(c, c)})) == "vv"


def test_rules_filter_and_custom_set(spark):
    sets = E.RuleSets()
    sets.add(E.RuleSet("mine", 20, (E.Rule("h", "article", selector="h1", confidence=0.5), E.Rule("bad", "article", selector="!!!invalid!!!"),
                                    E.Rule("x", "custom", xpath='//div[contains(@class,"main")]', transform="shout"))))
    sets.register_transform("shout", F.upper)
    html = '<p>Write to Harbour@ferry.example or ring 555-010-4477</p><h1>T</h1><div class="main">m</div>'
    got = {(r.type, tuple(sorted(r.data.items())), r.confidence) for r in E.rule_extract(pages(spark, html), sets).collect()}
    assert ("contact", (("email", "harbour@ferry.example"), ("type", "email")), 0.9) in got
    assert ("article", (("title", "T"),), 0.5) in got and ("custom", (("value", "M"),), 0.8) in got
    only = E.rule_extract(pages(spark, html), sets, ["contact"])
    assert {r.type for r in only.collect()} == {"contact"}


def test_fallback_order(spark):
    known = E.Extractors()
    with pytest.raises(ValueError):
        known.register(E.Strategy("", E.head_entities))
    known.register(E.Strategy("none", lambda p: E.head_entities(p).filter("false"), needs_entities=True))
    known.register(E.Strategy("head", E.head_entities))
    found, status = E.extract_with_fallback(pages(spark, PAGE, " "), known, ["none", "head"])
    assert {r.strategy for r in found.collect()} == {"head"}
    assert [(r.page_id, r.strategy, r.success) for r in status.orderBy("page_id").collect()] == [(0, "head", True), (1, None, False)]
    assert known.stats() == {"total": 2, "available": 2}


def test_embedded_json_and_microdata(spark):
    html = '<script type="application/ld+json">[{"@type":"Person","name":"A"},{"@type":"X"}]</script><div itemscope itemtype="T/Product"><b itemprop="name">N</b></div>'
    assert [r.item_pos for r in S.json_ld(pages(spark, html)).orderBy("item_pos").collect()] == [0, 1]
    assert E.microdata_entities(pages(spark, html)).first().data == {"name": "N"}


def test_quality_rules_pass_and_fail(spark):
    good = f"<html><head><title>Blue lamps</title></head><body><nav>n</nav><main>{'blue lamps shine ' * 30}<a href='/x'>a</a><a href='/y'>b</a><a href='/z'>c</a><a href='/w'>d</a><a href='/v'>e</a></main><footer>f</footer></body></html>"
    bad = '<div onclick="load()"></div><table><tr></tr></table><ul></ul>Loading lorem ipsum...'
    rows = Q.quality_rules(Q.quality_inputs(pages(spark, good, bad), "find blue lamps")).collect()
    failed = {i: {r.rule for r in rows if r.page_id == i and not r.passed} for i in (0, 1)}
    assert failed[0] == set()
    assert {"ajax-indicators", "empty-data-containers", "loading-placeholders", "placeholder-detection", "incomplete-table-detection",
            "truncated-content-detection", "minimum-word-count", "main-content-presence"} <= failed[1]
    verdicts = {r.page_id: r for r in Q.verdicts(Q.quality_inputs(pages(spark, good, bad), "find blue lamps")).collect()}
    assert verdicts[0].sufficient and not verdicts[1].sufficient and verdicts[0].reason.startswith("Content quality good")


def test_keyword_rule_counts_as_completeness_and_book_edits(spark):
    assert Q.category_of("keyword-matching") == "completeness" and Q.category_of("title-relevance") == "relevance"
    book = Q.RuleBook()
    assert book.enable("noise-ratio", False) and not book.enable("nope") and book.remove("link-density")
    book.add(Q.QualityRule("always-bad", "heuristic", 1.0, lambda: F.lit(False), lambda: F.lit(0.0), category="quality"))
    row = Q.verdicts(Q.quality_inputs(pages(spark, PAGE)), book).first()
    assert "always-bad" in row.failed and "noise-ratio" not in row.failed


def test_policy_and_errors(spark):
    book = G.Policies()
    book.register("only", (G.Tier("jina", min_quality=0.9),))
    rows = spark.createDataFrame([(1, "jina", True, True, True, 0.8, 5.0, 1), (2, "jina", True, True, True, 0.95, 5.0, 1)],
                                 "item_id long, tier string, success boolean, valid boolean, sufficient boolean, quality double, duration_ms double, ts long")
    assert {r.item_id: r.status for r in G.cascade_select(rows, book.get("only")).collect()} == {1: "failed", 2: "selected"}
    df = spark.createDataFrame([("blocked by captcha", 403)], "m string, s int")
    assert df.select(G.error_class(F.col("m"), F.col("s"))).first()[0] == "BLOCKED"


def test_corpus_idf_is_unsmoothed(spark):
    docs = spark.createDataFrame([(1, "apple apple pear"), (2, "apple plum")], "doc_id long, text string")
    w = {(r.doc_id, r.term): r.weight for r in R.tfidf(docs).collect()}
    assert w[(1, "apple")] == 0.0 and abs(w[(1, "pear")] - 0.6931471805599453 / 3) < 1e-12
    tf = R.term_frequencies(docs)
    sims = {r.doc_id: r.similarity for r in R.cosine_query(R.tfidf(docs), R.inverse_frequencies(tf, docs), "pear pie").collect()}
    assert abs(sims[1] - 1.0) < 1e-12 and sims[2] == 0.0
