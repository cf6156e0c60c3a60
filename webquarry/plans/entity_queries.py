"""Registered queries over structured data and entities (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webquarry.functions import patterns as P
from webquarry.functions import text as T
from webquarry.functions import transforms as X
from webquarry.operators import dom, pagetext
from webquarry.operators import entities as E
from webquarry.operators import structured as S
from webquarry.oracles import sql as O
from webquarry.plans.derived import cte, derive, read
from webquarry.plans.page_queries import s_body_source


def rich(spark, sf):
    return derive(spark, sf, "rich_pages")


def flat(entities, key="page_id"):
    """Data maps as sorted 'key=value' text, so both engines can be compared."""
    pairs = F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return entities.select(key, "type", F.array_join(pairs, ";").alias("data"), F.round("confidence", 6).alias("confidence"), "source")


def q_meta_tags(spark, sf):
    return S.meta_tags(rich(spark, sf))


def q_open_graph(spark, sf):
    return S.open_graph(S.meta_tags(rich(spark, sf)))


def q_twitter_card(spark, sf):
    return S.twitter_card(S.meta_tags(rich(spark, sf)))


def q_json_ld(spark, sf):
    rows = S.json_ld(rich(spark, sf))
    return rows.select("page_id", F.col("item_pos").cast("long").alias("item_pos"), F.expr("try_variant_get(item, '$.name', 'string')").alias("name"))


def q_embedded_json(spark, sf):
    rows = S.embedded_json(rich(spark, sf))
    return rows.groupBy("page_id").agg(F.count("*").alias("scripts"), F.max(F.expr("try_variant_get(value, '$.k', 'bigint')")).alias("k"))


def q_microdata(spark, sf):
    return S.microdata(rich(spark, sf)).select("page_id", "item_type", "prop", F.array_join("values", "|").alias("value"))


def q_page_forms(spark, sf):
    def names(c):
        return F.array_join(F.transform(c, lambda f: F.concat(f["name"], F.lit("="), f["value"], F.lit("/"), f["type"])), ",")

    forms = S.page_forms(rich(spark, sf))
    return forms.select("page_id", "action", "method", names(F.col("fields")).alias("fields"), names(F.col("hidden_fields")).alias("hidden"),
                        "csrf_field", "csrf_token")


def q_csrf_token(spark, sf):
    return S.csrf_token(rich(spark, sf))


def q_listing_cards(spark, sf):
    return S.listing_cards(rich(spark, sf)).drop("pos")


def q_cards_text(spark, sf):
    return S.cards_text(S.listing_cards(rich(spark, sf)))


def q_select_elements(spark, sf):
    rows = dom.select_elements(read(spark, sf, "pages"), {"heading": ("h1", None), "ad": (".ad", None), "menu": ("nav a", "href"), "text": ("article p", None)})
    return rows.select("page_id", "name", F.col("pos").cast("long").alias("pos"), "value")


def q_xpath_select(spark, sf):
    rows = E.xpath_select(read(spark, sf, "pages"), "//nav//a/@href")
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), "value")


#: Selectors and paths over parents, children and siblings.
FORMS = {
    "child": "ul > li > a", "next": "h1 + p, ul + p", "later": "nav ~ article p:first-of-type", "odd": "li:nth-child(2n+1)", "ends": "p:last-child, li:nth-last-of-type(-n+2)",
    "only": "b:only-of-type, em:only-child", "nested": "body > :not(nav) > p:not(:first-of-type)", "deep": "body article p b",
}
PATHS = {
    "second": "//nav/ul/li[2]/a", "last": "//p[last()]", "few": "//li[position() <= 2]", "up": "//h1/..", "top": "/html/head/title", "after": "//a[not(@class) and contains(@href, 'a')]/parent::li/following-sibling::li",
    "around": "//li/ancestor::nav | //b/ancestor::article", "before": "//p[@class='k' or @id]/preceding-sibling::p[@class]",
}


def good_and_broken(spark, sf):
    """The pages and, under negative ids, pages whose elements cross and stay open."""
    return read(spark, sf, "pages").select("page_id", "html").unionByName(derive(spark, sf, "broken_pages").select((-1 - F.col("page_id")).alias("page_id"), "html"))


def q_structural_select(spark, sf):
    rows = dom.select_elements(good_and_broken(spark, sf), {name: (selector, None) for name, selector in FORMS.items()})
    return rows.select("page_id", "name", F.col("pos").cast("long").alias("pos"), "value")


def q_structural_paths(spark, sf):
    rows = E.paths_select(good_and_broken(spark, sf), PATHS)
    return rows.select("page_id", "name", F.col("pos").cast("long").alias("pos"), "value")


def q_regex_select(spark, sf):
    rows = read(spark, sf, "documents").select("doc_id", F.posexplode(E.regex_select(F.col("text"), r"\b[a-z]{2}tion\b")).alias("pos", "value"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


def q_own_rules(spark, sf):
    """A registered rule set with a registered transform."""
    sets = E.RuleSets(())
    sets.add(E.RuleSet("own", 3, (E.Rule("heading", "article", selector="h1", attribute=None, transform="shout", confidence=0.6),)))
    sets.register_transform("shout", lambda c: F.concat(F.upper(F.trim(c)), F.lit("!")))
    out = E.rule_extract(read(spark, sf, "pages"), sets)
    return out.select("page_id", "type", F.element_at("data", "title").alias("title"), F.round("confidence", 6).alias("confidence"))


def q_transforms(spark, sf):
    rows = read(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit(" USD "), F.col("value").cast("string"), F.lit(" per unit ")).alias("price"),
        F.concat(F.lit("To: U"), F.col("user_id").cast("string"), F.lit(".X@Mail.Example.com!")).alias("mail"),
        F.concat(F.lit("call 555 123 "), F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"), F.lit(" now")).alias("phone"),
        F.concat(F.lit("Sub"), F.col("user_id").cast("string"), F.lit(".Example.com/x")).alias("site"),
        F.concat(F.lit("<b>"), F.col("event_type"), F.lit("</b> <i>x</i>")).alias("tagged"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )
    apply = X.apply_transform
    return rows.select(
        "event_id", F.round(apply(F.col("price"), "parseNumber").cast("double"), 6).alias("number"), apply(F.col("mail"), "parseEmail").alias("email"),
        apply(F.col("phone"), "parsePhone").alias("phone"), apply(F.col("site"), "extractDomain").alias("domain"),
        apply(F.col("tagged"), "removeHtml").alias("plain"), apply(F.col("day"), "parseDate").alias("date"),
        apply(F.col("site"), "parseUrl").alias("url"), apply(F.col("tagged"), "uppercase").alias("upper"), apply(F.col("day"), "noSuch").alias("same"),
    )


def q_parse_dates(spark, sf):
    """Dates in the forms that scripts read."""
    forms = ("EEE, dd MMM yyyy HH:mm:ss 'GMT'", "EEE, d MMM yyyy HH:mm:ss '+0230'", "MMMM d, yyyy h:mm a", "M/d/yyyy HH:mm:ss", "dd-MMM-yyyy", "yyyy-MM-dd'T'HH:mm:ss'-05:00'",
             "d MMMM yyyy HH:mm 'EST'", "'day' d 'of' MMM yyyy")
    text = F.array(*[F.date_format("ts", f) for f in forms])
    rows = read(spark, sf, "events").select("event_id", F.element_at(text, (F.col("event_id") % len(forms) + 1).cast("int")).alias("text"))
    return rows.select("event_id", X.apply_transform(F.col("text"), "parseDate").alias("date"))


def q_rule_extract(spark, sf):
    return flat(E.rule_extract(rich(spark, sf)))


def q_rule_extract_pages(spark, sf):
    return flat(E.rule_extract(read(spark, sf, "pages"), entity_types=["article", "contact"]))


def q_shape_entity(spark, sf):
    kinds = F.array(*[F.lit(k) for k in E.ENTITY_TYPES])
    rows = read(spark, sf, "events").select("event_id", F.element_at(kinds, (F.col("event_id") % 7 + 1).cast("int")).alias("type"),
                                            F.col("user_id").cast("string").alias("value"))
    rows = rows.withColumn("data", E.entity_data(F.col("type"), F.col("value")))
    return rows.select("event_id", "type", F.array_join(F.transform(F.array_sort(F.map_entries("data")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("data"))


def event_entities(spark, sf):
    """Events as entity rows: pages are users, values repeat."""
    return read(spark, sf, "events").select(
        F.col("user_id").alias("page_id"),
        F.when(F.col("event_type") == "click", "company").when(F.col("event_type") == "view", "person").when(F.col("event_type") == "error", "bogus").otherwise("custom").alias("type"),
        F.create_map(F.lit("value"), F.when(F.col("event_id") % 10 != 3, (F.floor("value") % 5).cast("string"))).alias("data"),
        F.when(F.col("event_id") % 4 != 0, (F.col("event_id") % 100) / 100).alias("confidence"), F.lit("event").alias("source"),
        F.struct(F.lit(0).cast("long").alias("rank"), F.col("event_id").alias("pos")).alias("ord"),
    )


def q_dedup_entities(spark, sf):
    out = E.dedup_entities(event_entities(spark, sf), cap=6)
    return out.select("page_id", "type", F.element_at("data", "value").alias("value"), F.col("ord.pos").alias("event_id"))


def q_dedup_entities_all(spark, sf):
    out = E.dedup_entities(event_entities(spark, sf))
    return out.select("page_id", "type", F.element_at("data", "value").alias("value"), F.col("ord.pos").alias("event_id"))


def q_validate_entities(spark, sf):
    out = E.validate_entities(event_entities(spark, sf))
    return out.groupBy("type").agg(F.count("*").alias("entities"))


def q_page_confidence(spark, sf):
    pages = read(spark, sf, "pages")
    means = E.page_confidence(pages, event_entities(spark, sf))
    return means.withColumn("confidence", F.round("confidence", 6))


def doc_entities(spark, sf):
    return E.pattern_entities(read(spark, sf, "documents"), "doc_id", F.col("text"), F.lit(0.7))


def q_pattern_entities(spark, sf):
    return flat(doc_entities(spark, sf), "doc_id")


def q_jsonld_entities(spark, sf):
    return flat(E.jsonld_entities(rich(spark, sf)))


def q_microdata_entities(spark, sf):
    return flat(E.microdata_entities(rich(spark, sf)))


def q_head_entities(spark, sf):
    return flat(E.head_entities(rich(spark, sf)).unionByName(E.head_entities(read(spark, sf, "pages").withColumn("page_id", -F.col("page_id") - 1))))


def fallback(spark, sf, rules=False):
    """Status with `rules`: all strategies in their own order, so that every page without JSON-LD reaches the rules."""
    known = E.default_extractors()
    if not rules:
        known.remove("rules")
    known.register(E.Strategy("model", E.head_entities, available=False))
    rows = rich(spark, sf).unionByName(read(spark, sf, "pages").select((F.col("page_id") + 100000000).alias("page_id"), "url", "html"))
    html = F.when(F.col("page_id") % 5 != 0, F.col("html")).otherwise(F.lit(" "))
    return E.extract_with_fallback(rows.select(F.col("page_id"), "url", html.alias("html")), known, ["model", "json-ld"] if rules else ["model", "json-ld", "head"])


def q_extract_with_fallback(spark, sf):
    return fallback(spark, sf)[1].withColumn("success", F.col("success").cast("int"))


def q_extract_with_fallback_all(spark, sf):
    return fallback(spark, sf, rules=True)[1].withColumn("success", F.col("success").cast("int"))


def q_extraction_report(spark, sf):
    rows = doc_entities(spark, sf).withColumnRenamed("doc_id", "page_id")
    return E.extraction_report(rows).withColumn("confidence", F.round("confidence", 6))


def q_prompt_rows(spark, sf):
    docs = read(spark, sf, "documents").withColumn("url", F.concat(F.lit("https://x.example/"), F.when(F.col("doc_id") % 3 == 0, "store/").otherwise("a/"), F.col("doc_id").cast("string")))
    task = F.when(F.col("doc_id") % 2 == 0, F.lit("Describe the offer")).otherwise(F.lit("List prices"))
    out = E.prompt_rows(docs, F.col("text"), task, F.col("url"))
    return out.select("doc_id", "prompt_content", F.col("wants_explanation").cast("int").alias("wants_explanation"), F.col("is_commerce").cast("int").alias("is_commerce"))


def q_parse_replies(spark, sf):
    out = E.parse_replies(derive(spark, sf, "model_replies"), "event_id", F.col("reply"))
    one = F.transform("entities", lambda e: F.concat_ws("/", e["type"], F.coalesce(F.try_element_at(F.map_values(e["data"]), F.lit(1)), F.lit("-")), F.format_number(e["confidence"], 2), e["source"]))
    return out.select("event_id", "summary", F.array_join(one, ",").alias("entities"))


QUERIES = {
    "meta_tags": q_meta_tags, "open_graph": q_open_graph, "twitter_card": q_twitter_card, "json_ld": q_json_ld, "embedded_json": q_embedded_json,
    "microdata": q_microdata, "page_forms": q_page_forms, "csrf_token": q_csrf_token, "listing_cards": q_listing_cards, "cards_text": q_cards_text,
    "select_elements": q_select_elements, "xpath_select": q_xpath_select, "structural_select": q_structural_select, "structural_paths": q_structural_paths, "regex_select": q_regex_select, "transforms": q_transforms, "parse_dates": q_parse_dates, "own_rules": q_own_rules,
    "rule_extract": q_rule_extract, "rule_extract_pages": q_rule_extract_pages, "shape_entity": q_shape_entity, "dedup_entities": q_dedup_entities, "dedup_entities_all": q_dedup_entities_all,
    "validate_entities": q_validate_entities, "page_confidence": q_page_confidence, "pattern_entities": q_pattern_entities,
    "jsonld_entities": q_jsonld_entities, "microdata_entities": q_microdata_entities, "head_entities": q_head_entities,
    "extract_with_fallback": q_extract_with_fallback, "extract_with_fallback_all": q_extract_with_fallback_all, "extraction_report": q_extraction_report, "prompt_rows": q_prompt_rows, "parse_llm_rows": q_parse_replies,
}

# ---- SQL twins: rich pages are built from known parts, so their answers are written out -----

ORG, PROD = "http://schema.org/Organization", "http://schema.org/Product"
BRAND_ITEM = f"""'{{"@type":"{ORG}","name":"' || p_brand || '"}}'"""
META = """select p_partkey page_id, 'description' as name, 'About ' || p_brand as content from part union all
select p_partkey, 'og:title', p_name from part union all select p_partkey, 'og:site_name', 'Shop ' || p_size from part union all
select p_partkey, 'twitter:card', 'large' from part union all select p_partkey, 'sku', p_type from part"""


def lit_rows(rows):
    """type, data, confidence, source per part."""
    return " union all ".join(
        f"select p_partkey as page_id, '{t}' as type, {d} as data, {c}::double as confidence, '{s}' as source from part" for t, d, c, s in rows
    )


RULE_ROWS = [
    ("contact", "'email=sales' || p_size || '@example.com;type=email'", 0.95, "rule:email.email-href"),
    ("contact", "'email=info@x' || p_partkey || '.example.com;type=email'", 0.9, "rule:email.email-text"),
    ("contact", "'phone=555-123-4567;type=phone'", 0.95, "rule:phone.phone-href"),
    ("contact", "'phone=555-123-9999;type=phone'", 0.9, "rule:phone.phone-text"),
    ("custom", "'value=mailto:Sales' || p_size || '@Example.com'", 0.95, "rule:url.url-href"),
    ("custom", "'value=tel:555 123 4567'", 0.95, "rule:url.url-href"),
    ("custom", "'value=https://docs.example.com/x'", 0.85, "rule:url.url-text"),
    ("company", "'name=Acme ' || p_size", 0.9, "rule:company.company-name-h1"),
    ("company", "'name=' || p_brand", 0.85, "rule:company.company-name-title"),
    ("company", "'name=Shop ' || p_size", 0.8, "rule:company.company-name-meta"),
    ("product", "'name=' || p_name", 0.9, "rule:product.product-name"),
    ("pricing", "'price=' || p_size", 0.85, "rule:product.product-price"),
    ("article", "'title=Acme ' || p_size", 0.9, "rule:article.article-title"),
    ("article", "'title=2024-03-05T00:00:00.000Z'", 0.8, "rule:article.article-date"),
    ("article", "'title=About ' || p_brand", 0.7, "rule:article.article-description"),
]
JSONLD_ROWS = [
    ("product", "'currency=EUR;name=' || p_name || ';price=12.5'", 0.95, "json-ld"),
    ("company", "'name=' || p_brand || ';url=http://b.example'", 0.95, "json-ld"),
    ("custom", "'@type=Recipe;cook=' || p_type", 0.95, "json-ld"),
]
MICRO_ROWS = [
    ("product", "'name=' || p_name || ', ' || p_brand", 0.85, "microdata"),
    ("company", "'name=' || p_brand", 0.85, "microdata"),
]


COMPANY = rf"\b[A-Z][a-z]+(?:[{E._S}]+[A-Z][a-z]+)*(?:[{E._S}]+(?:Inc|LLC|Ltd|Corp|Corporation|Company|Co))?\.?\b"


def plain(name, pattern):
    """The pattern without possessive repeats and lookaround."""
    return COMPANY if name == "company" else pattern.replace("++", "+")


def pat_cte(col="text", key="doc_id", table="documents", conf="0.7"):
    parts = []
    for name, pattern in E.PATTERNS:
        pattern = plain(name, pattern)
        kind = {"email": "contact", "phone": "contact", "url": "custom", "price": "pricing", "company": "company", "date": "custom"}[name]
        data = {"price": f"'price=' || v || ';value=' || regexp_replace(v, '[^0-9.]', '', 'g')", "company": "'name=' || v"}.get(
            name, f"case when '{name}' < 'type' then '{name}=' || v || ';type={name}' else 'type={name};{name}=' || v end")
        c = f"{conf} * 0.9" if name == "company" else conf
        parts.append(f"select {key}, '{kind}' as type, {data} as data, round(({c})::double, 6) as confidence, 'pattern_match' as source "
                     f"from (select distinct {key}, unnest(regexp_extract_all({col}, {O.q(pattern)})) v{', conf' if 'conf' in conf else ''} from {table})")
    return " union all ".join(parts)


BODY = O.decode(O.rep(s_body_source(), O.TAG))
TITLE = O.trim(O.decode("regexp_extract(html, " + O.q("(?is)<title[^>]*>(.*?)</title>") + ", 1)"))
TEXT_OF = O.trim(O.decode("string_agg(case when t.kind = 'text' then t.tok else '' end, '' order by t.pos)"))
SEL = f"""{O.tokens_cte()}, {O.elements_cte()},
pick as (select e.page_id, e.pos, e.stop, case when e.tag = 'h1' then 'heading' when e.tag = 'div' and {O.attr('e.tok', 'class')} = 'ad' then 'ad'
    when e.tag = 'p' then 'text' end as name from el e where (e.tag = 'h1') or (e.tag = 'div' and {O.attr('e.tok', 'class')} = 'ad')
    or (e.tag = 'p' and exists (select 1 from el a where a.page_id = e.page_id and a.tag = 'article' and a.pos < e.pos and e.pos < a.stop))),
cut as (select k.page_id, k.name, k.pos, {TEXT_OF} as v from pick k left join tok t on t.page_id = k.page_id and t.pos > k.pos and t.pos < k.stop group by 1, 2, 3),
menu as (select e.page_id, e.pos, {O.decode(O.attr('e.tok', 'href'))} as v from el e where e.tag = 'a'
    and exists (select 1 from el a where a.page_id = e.page_id and a.tag = 'nav' and a.pos < e.pos and e.pos < a.stop))"""
HEADING = f"""{SEL}, firsts as (select page_id, v from cut where name = 'heading' and v <> '' qualify row_number() over (partition by page_id order by pos) = 1)"""
# Parents by containment: of all earlier elements that reach over one, the latest.
TREE = f"""{cte("broken_pages")}, both_pages as (select page_id, html from pages union all select -1 - page_id, html from broken_pages),
{O.tokens_cte("both_pages")}, {O.elements_cte()},
n as (select page_id, pos, tag, tok, stop, case when kind = 'void' then pos when closed then stop else stop - 1 end last from el),
up as (select c.page_id, c.pos, max(a.pos) parent from n c left join n a on a.page_id = c.page_id and a.pos < c.pos and a.last >= c.pos group by 1, 2),
tree as materialized (select n.*, parent, row_number() over s k, count(*) over (partition by page_id, parent) z, row_number() over t tk, count(*) over (partition by page_id, parent, tag) tz,
  lag(tag) over s before from n join up using (page_id, pos) window s as (partition by page_id, parent order by pos), t as (partition by page_id, parent, tag order by pos)),
kin as materialized (select e.*, p.tag ptag, p.pos ppos, p.parent gparent, g.tag gtag from tree e left join tree p on p.page_id = e.page_id and p.pos = e.parent left join tree g on g.page_id = e.page_id and g.pos = p.parent)"""
KIN_TEXT = f"""cut as (select k.page_id, k.name, k.pos, {TEXT_OF} as v from pick k left join tok t on t.page_id = k.page_id and t.pos > k.pos and t.pos < k.stop group by 1, 2, 3)
select page_id, name, pos::bigint as pos, v as value from cut where v <> ''"""
INSIDE = "exists (select 1 from tree a where a.page_id = e.page_id and a.pos < e.pos and a.last >= e.pos and {})"
AROUND = "exists (select 1 from tree d where d.page_id = e.page_id and d.pos > e.pos and d.pos <= e.last and {})"
BESIDE = "exists (select 1 from {0} s where s.page_id = e.page_id and s.parent is not distinct from e.parent and {1})"
REPLY = "case event_id % 5"
ENTITY_EVENTS = """ee as (select event_id, user_id page_id, case event_type when 'click' then 'company' when 'view' then 'person' when 'error' then 'bogus' else 'custom' end as type,
 case when event_id % 10 <> 3 then (floor(value)::bigint % 5)::varchar end v, case when event_id % 4 <> 0 then (event_id % 100) / 100 end conf from events)"""
PAGE_RULES = f"""{HEADING}, b as (select page_id, {BODY} txt from pages),
c as (select page_id, lower(unnest(list_distinct(regexp_extract_all(txt, {O.q(plain("email", E.EMAIL))})))) v from b),
p as (select page_id, regexp_replace(unnest(list_distinct(regexp_extract_all(txt, {O.q(E.PHONE)}))), '\\s+', '-', 'g') v from b),
found as (select page_id, v from firsts union all select distinct page_id, 'email=' || v from c union all select distinct page_id, 'phone=' || v from p)"""
ORACLE = {
    "meta_tags": META,
    "open_graph": f"select * from ({META}) where name like 'og:%'",
    "twitter_card": f"select * from ({META}) where name like 'twitter:%'",
    "json_ld": "select p_partkey as page_id, 0 as item_pos, p_name as name from part union all select p_partkey, 0, p_brand from part "
    "union all select p_partkey, 1, null from part union all select p_partkey, 2, 'untyped' from part",
    "embedded_json": "select p_partkey as page_id, 3::bigint as scripts, p_size::bigint as k from part",
    "microdata": f"""select p_partkey as page_id, '{PROD}' as item_type, 'name' as prop, p_name || '|' || p_brand as value from part
union all select p_partkey, '{PROD}', 'url', '/p/1' from part union all select p_partkey, '{PROD}', 'tag', 'a|b' from part
union all select p_partkey, '{PROD}', 'brand', {BRAND_ITEM} from part union all select p_partkey, '{ORG}', 'name', p_brand from part""",
    "page_forms": "select p_partkey as page_id, '/buy' as action, 'POST' as method, 'q=' || p_size || '/text,s=b/text,t=Note/text' as fields, "
    "'csrf_token=tok' || p_partkey || '/hidden' as hidden, 'csrf_token' as csrf_field, 'tok' || p_partkey as csrf_token from part",
    "csrf_token": "select p_partkey as page_id, 'csrf_token' as field, 'tok' || p_partkey as token from part",
    "listing_cards": "select p_partkey as page_id, 'A' || p_partkey as asin, p_name as title, '$' || p_size as price, null as original_price, null as discount, "
    "null as rating, null as image, '/dp/1' as link from part",
    "cards_text": "select p_partkey as page_id, chr(10) || chr(10) || '--- EXTRACTED DEALS ---' || chr(10) || chr(10) || 'DEAL #1' || chr(10) || '  ASIN: A' || p_partkey || chr(10) || "
    "'  Title: ' || p_name || chr(10) || '  Price: $' || p_size || chr(10) || '  URL: /dp/1' || chr(10) || chr(10) as text from part",
    "select_elements": f"with {SEL} select page_id, name, pos::bigint as pos, v as value from cut where v <> '' union all "
    "select page_id, 'menu', pos, v from menu where v is not null",
    "xpath_select": f"with {SEL} select page_id, pos::bigint as pos, v as value from menu where v is not null",
    "structural_select": f"""with {TREE}, pick as (
select page_id, pos, stop, 'child' as name from kin where tag = 'a' and ptag = 'li' and gtag = 'ul'
union all select page_id, pos, stop, 'next' from kin where tag = 'p' and before in ('h1', 'ul')
union all select page_id, pos, stop, 'later' from kin e where tag = 'p' and tk = 1 and {INSIDE.format("a.tag = 'article' and exists (select 1 from tree s where s.page_id = a.page_id and s.parent is not distinct from a.parent and s.pos < a.pos and s.tag = 'nav')")}
union all select page_id, pos, stop, 'odd' from kin where tag = 'li' and k % 2 = 1
union all select page_id, pos, stop, 'ends' from kin where tag = 'p' and k = z or tag = 'li' and tz - tk < 2
union all select page_id, pos, stop, 'only' from kin where tag = 'b' and tz = 1 or tag = 'em' and z = 1
union all select page_id, pos, stop, 'nested' from kin where tag = 'p' and tk > 1 and ptag <> 'nav' and gtag = 'body'
union all select page_id, pos, stop, 'deep' from kin e where tag = 'b' and {INSIDE.format("a.tag = 'p' and exists (select 1 from tree b where b.page_id = a.page_id and b.pos < a.pos and b.last >= a.pos and b.tag = 'article' and exists (select 1 from tree c where c.page_id = b.page_id and c.pos < b.pos and c.last >= b.pos and c.tag = 'body'))")}),
{KIN_TEXT}""",
    "structural_paths": f"""with {TREE}, pick as (
select e.page_id, e.pos, e.stop, 'second' as name from kin e join kin l on l.page_id = e.page_id and l.pos = e.parent where e.tag = 'a' and l.tag = 'li' and l.tk = 2 and l.ptag = 'ul' and l.gtag = 'nav'
union all select page_id, pos, stop, 'last' from kin where tag = 'p' and tk = tz
union all select page_id, pos, stop, 'few' from kin where tag = 'li' and tk <= 2
union all select distinct e.page_id, e.pos, e.stop, 'up' from kin e join kin h on h.page_id = e.page_id and h.parent = e.pos where h.tag = 'h1'
union all select page_id, pos, stop, 'top' from kin where tag = 'title' and ptag = 'head' and gtag = 'html' and (page_id, gparent) in (select page_id, pos from kin where parent is null)
union all select page_id, pos, stop, 'after' from kin e where tag = 'li' and {BESIDE.format("kin", f"s.tag = 'li' and s.pos < e.pos and exists (select 1 from kin x where x.page_id = s.page_id and x.parent = s.pos and x.tag = 'a' and {O.attr('x.tok', 'class')} is null and contains({O.attr('x.tok', 'href')}, 'a'))")}
union all select page_id, pos, stop, 'around' from kin e where tag = 'nav' and {AROUND.format("d.tag = 'li'")} or tag = 'article' and {AROUND.format("d.tag = 'b'")}
union all select page_id, pos, stop, 'before' from kin e where tag = 'p' and {O.attr('e.tok', 'class')} is not null and {BESIDE.format("kin", f"s.tag = 'p' and s.pos > e.pos and ({O.attr('s.tok', 'class')} = 'k' or {O.attr('s.tok', 'id')} is not null)")}),
{KIN_TEXT}""",
    "regex_select": r"""with m as (select doc_id, list_distinct(regexp_extract_all(text, '(?i)\b[a-z]{2}tion\b')) d, regexp_extract_all(text, '(?i)\b[a-z]{2}tion\b') a from documents),
u as (select doc_id, unnest(d) v, a from m), p as (select doc_id, v, list_position(a, v) k from u)
select doc_id, row_number() over (partition by doc_id order by k) - 1 as pos, v as value from p""",
    "transforms": """select event_id, round(value, 6) as number, 'u' || user_id || '.x@mail.example.com' as email, '555-123-' || lpad((user_id % 10000)::varchar, 4, '0') as phone,
'sub' || user_id || '.example.com' as domain, event_type || ' x' as plain, strftime(ts, '%Y-%m-%d') || 'T00:00:00.000Z' as date, null as url,
upper('<b>' || event_type || '</b> <i>x</i>') as upper, strftime(ts, '%Y-%m-%d') as same from events""",
    "parse_dates": """select event_id, strftime(case event_id % 8 when 0 then date_trunc('second', ts) when 1 then date_trunc('second', ts) - interval 150 minute when 2 then date_trunc('minute', ts)
when 3 then date_trunc('second', ts) when 4 then date_trunc('day', ts) when 5 then date_trunc('second', ts) + interval 5 hour when 6 then date_trunc('minute', ts) + interval 5 hour end::timestamp,
'%Y-%m-%dT%H:%M:%S.000Z') as date from events""",
    "own_rules": f"with {HEADING} select page_id, 'article' as type, upper(replace(trim(v), 'ß', 'SS')) || '!' as title, 0.6::double as confidence from firsts",
    "rule_extract": lit_rows(RULE_ROWS),
    "rule_extract_pages": f"""with {HEADING}, b as (select page_id, {BODY} txt from pages),
c as (select page_id, lower(unnest(list_distinct(regexp_extract_all(txt, {O.q(plain("email", E.EMAIL))})))) v from b),
p as (select page_id, regexp_replace(unnest(list_distinct(regexp_extract_all(txt, {O.q(E.PHONE)}))), '\\s+', '-', 'g') v from b)
select page_id, 'article' as type, 'title=' || v as data, 0.9::double as confidence, 'rule:article.article-title' as source from firsts
union all select distinct page_id, 'contact', 'email=' || v || ';type=email', 0.9, 'rule:email.email-text' from c
union all select distinct page_id, 'contact', 'phone=' || v || ';type=phone', 0.9, 'rule:phone.phone-text' from p""",
    "shape_entity": """select event_id, ['company','person','product','article','contact','pricing','custom'][event_id % 7 + 1] as type,
case event_id % 7 when 3 then 'title=' || user_id when 4 then 'phone=' || user_id || ';type=phone' when 5 then 'value=' || user_id when 6 then 'value=' || user_id else 'name=' || user_id end as data from events""",
    "dedup_entities": f"with {ENTITY_EVENTS}, d as (select page_id, type, v, min(event_id) e from ee group by all) "
    "select page_id, type, v as value, e as event_id from d qualify row_number() over (partition by page_id order by e) <= 6",
    "dedup_entities_all": f"with {ENTITY_EVENTS} select page_id, type, v as value, min(event_id) as event_id from ee group by all",
    "validate_entities": f"with {ENTITY_EVENTS} select type, count(*) as entities from ee where type <> 'bogus' and v is not null group by 1",
    "page_confidence": f"with {ENTITY_EVENTS} select p.page_id, count(ee.event_id) as entities, coalesce(round(avg(case when ee.event_id is not null then coalesce(conf, 0.5) end), 6), 0) as confidence "
    "from pages p left join ee on p.page_id = ee.page_id group by 1",
    "pattern_entities": pat_cte(),
    "jsonld_entities": lit_rows(JSONLD_ROWS),
    "microdata_entities": lit_rows(MICRO_ROWS),
    "head_entities": lit_rows([("article", "'title=' || p_name", 0.9, "head"), ("article", "'description=About ' || p_brand", 0.8, "head")])
    + f" union all select -page_id - 1, 'article', 'title=' || {TITLE}, 0.9, 'head' from pages where {TITLE} <> ''",
    "extract_with_fallback": f"""select p_partkey as page_id, case when p_partkey % 5 = 0 then null else 'json-ld' end as strategy, (p_partkey % 5 <> 0)::int as success,
case when p_partkey % 5 = 0 then 0 else 3 end::bigint as entities, case when p_partkey % 5 = 0 then 'All extraction strategies failed' end as error from part
union all select page_id + 100000000, case when page_id % 5 = 0 then null else 'head' end, (page_id % 5 <> 0)::int,
case when page_id % 5 = 0 or {TITLE} = '' then 0 else 1 end, case when page_id % 5 = 0 then 'All extraction strategies failed' end from pages""",
    "extract_with_fallback_all": f"""with {PAGE_RULES}, n as (select page_id, count(*) n from found group by 1)
select p_partkey as page_id, case when p_partkey % 5 = 0 then null else 'json-ld' end as strategy, (p_partkey % 5 <> 0)::int as success,
case when p_partkey % 5 = 0 then 0 else 3 end::bigint as entities, case when p_partkey % 5 = 0 then 'All extraction strategies failed' end as error from part
union all select page_id + 100000000, case when page_id % 5 = 0 then null else 'rules' end, (page_id % 5 <> 0)::int,
case when page_id % 5 = 0 then 0 else coalesce(n, 0) end, case when page_id % 5 = 0 then 'All extraction strategies failed' end from pages left join n using (page_id)""",
    "extraction_report": f"with e as ({pat_cte()}) select type, source, count(*) as entities, count(distinct doc_id) as pages, round(avg(confidence), 6) as confidence from e group by rollup (type, source)",
    "prompt_rows": "select doc_id, text as prompt_content, "
    "(doc_id % 2 = 0)::int as wants_explanation, (doc_id % 3 = 0)::int as is_commerce from documents",
    "parse_llm_rows": f"""select event_id, {REPLY} when 0 then 'S' || user_id when 1 then 'A' || chr(10) || chr(10) || 'B' when 2 then 'no json here ' || event_type when 3 then 'E' else '{{"summary": broken' end as summary,
{REPLY} when 0 then 'company/' || event_type || '/1.00/body' when 1 then 'custom/' || user_id || '/0.25/,person/-/0.50/' else '' end as entities from events""",
}
