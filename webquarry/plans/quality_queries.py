"""Registered queries over page quality (with their SQL twins)."""

from __future__ import annotations

from pyspark.sql import functions as F

from webquarry.functions import patterns as P
from webquarry.operators import pagetext
from webquarry.operators import quality as Q
from webquarry.oracles import sql as O
from webquarry.plans.derived import cte, derive, read
from webquarry.plans.page_queries import s_body_source

TASK = "Find the latest article about thanedble, aulich and example sichen"


def inputs(spark, sf):
    return Q.quality_inputs(read(spark, sf, "pages"), TASK)


def q_page_metrics(spark, sf):
    return Q.page_metrics(inputs(spark, sf))


def q_quality_rules(spark, sf):
    rules = Q.quality_rules(inputs(spark, sf))
    return rules.withColumns({"score": F.round("score", 6), "passed": F.col("passed").cast("int")})


def q_quality_rules_mixed(spark, sf):
    rules = Q.quality_rules(Q.quality_inputs(derive(spark, sf, "widget_pages")))
    kept = rules.filter(F.col("rule").isin("empty-data-containers", "interactive-elements", "incomplete-table-detection",
                                           "ajax-indicators", "loading-placeholders", "placeholder-detection", "main-content-presence",
                                           "truncated-content-detection"))
    return kept.select("page_id", "rule", F.col("passed").cast("int").alias("passed"), F.round("score", 6).alias("score"))


def q_quality_rules_mixed_all(spark, sf):
    rules = Q.quality_rules(Q.quality_inputs(derive(spark, sf, "widget_pages")))
    return rules.select("page_id", "rule", F.col("passed").cast("int").alias("passed"), F.round("score", 6).alias("score"))


def q_quality_own_rule(spark, sf):
    book = Q.RuleBook()
    for rule in list(book.active()):
        book.remove(rule.name)
    low = F.col("words") < 40
    book.add(Q.QualityRule("own-length", "heuristic", 0.5, lambda: ~low, lambda: F.when(low, 0.25).otherwise(1.0), category="quality"))
    rules = Q.quality_rules(inputs(spark, sf), book)
    return rules.select("page_id", "rule", "kind", "category", "weight", F.col("passed").cast("int").alias("passed"), "score")


def _shown(df):
    scores = {c: F.round(c, 6) for c in ("overall", "completeness", "relevance", "structure", "quality") if c in df.columns}
    flags = {c: F.col(c).cast("int") for c in ("sufficient", "needs_interaction", "used_second") if c in df.columns}
    lists = {c: F.array_join(c, ",") for c in ("failed", "actions") if c in df.columns}
    return df.withColumns({**scores, **flags, **lists})


def q_quality_score(spark, sf):
    out = _shown(Q.verdicts(inputs(spark, sf)))
    return out.select("page_id", "completeness", "relevance", "structure", "quality", "overall")


def q_quality_verdict(spark, sf):
    out = _shown(Q.verdicts(inputs(spark, sf)))
    return out.select("page_id", "overall", "sufficient", "needs_interaction", "failed", "actions")


def q_rule_based_verdict(spark, sf):
    out = _shown(Q.verdicts(inputs(spark, sf), kinds=("heuristic", "pattern")))
    return out.select("page_id", "overall", "sufficient", "failed")


def q_hybrid_verdict(spark, sf):
    second = read(spark, sf, "labels").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") * 0.9).alias("second_score"),
        (F.col("quality") == 1).alias("second_sufficient"), (F.col("toxic") == 1).alias("second_interaction"),
    )
    return _shown(Q.hybrid_verdicts(Q.verdicts(inputs(spark, sf)), second))


def q_dynamic_page_flag(spark, sf):
    html = F.col("html")
    rows = read(spark, sf, "pages").select("page_id", "html").unionByName(derive(spark, sf, "widget_pages").select(
        (-F.col("page_id") - 1).alias("page_id"), "html"))
    return rows.select("page_id", Q.is_dynamic(html, pagetext.body_text(html)).cast("int").alias("dynamic"))


def q_min_content(spark, sf):
    docs = read(spark, sf, "documents")
    html = F.concat(F.lit("<p>"), F.col("text"), F.lit("</p>"))
    return docs.select(
        "doc_id", Q.has_min_content(html, F.col("text")).cast("int").alias("usable"),
        Q.has_min_content(html, F.col("text"), service=True).cast("int").alias("accepted"),
    )


def q_content_hash_dedup(spark, sf):
    return Q.hash_dedup(read(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"), F.col("text").alias("html"), F.col("lang").alias("url")))


def q_blocked_page_flag(spark, sf):
    rows = derive(spark, sf, "blocked_pages")
    return rows.groupBy(Q.block_class(F.col("html")).alias("block")).agg(F.count("*").alias("pages"))


QUERIES = {
    "page_metrics": q_page_metrics, "quality_rules": q_quality_rules, "quality_rules_mixed": q_quality_rules_mixed, "quality_rules_mixed_all": q_quality_rules_mixed_all,
    "quality_own_rule": q_quality_own_rule,
    "quality_score": q_quality_score, "quality_verdict": q_quality_verdict, "rule_based_verdict": q_rule_based_verdict,
    "hybrid_verdict": q_hybrid_verdict, "dynamic_page_flag": q_dynamic_page_flag, "min_content": q_min_content,
    "content_hash_dedup": q_content_hash_dedup, "blocked_page_flag": q_blocked_page_flag,
}

# ---- SQL twins ----------------------------------------------------------------------------

AJAX = r"data-load|onclick[^\n]*load|ajax[^\n]*true|fetch\(|xmlhttprequest|\.load\("
LOADING = r"loading|please wait|click to view|select to load|choose[^\n]*to view|load more"
PLACEHOLDER = r"(?i)lorem ipsum|placeholder|sample text|coming soon|under construction|no data|no content"
TRUNCATION = r"(?i)\.\.\.\z|more\.\.\.|read more|show more|continue reading"
WORDS = [w for w in TASK.lower().split() if len(w) > 3]


def hits(col: str) -> str:
    return "(" + " + ".join(f"contains(lower({col}), {O.q(w)})::int" for w in WORDS) + ")"


TITLE = O.trim(O.decode("regexp_extract(html, " + O.q("(?is)<title[^>]*>(.*?)</title>") + ", 1)"))
SCRIPTS, STYLES = r"(?is)<script\b[^>]*>(.*?)</script\s*>", r"(?is)<style\b[^>]*>(.*?)</style\s*>"
INPUTS = f"""{O.tokens_cte()}, {O.elements_cte()},
ec as (select e.page_id, e.pos, e.tag, e.kind, {O.attr('e.tok', 'class')} cls,
   sum(case when t.kind = 'text' then length({O.decode('t.tok')}) else 0 end) chars,
   sum(case when t.kind = 'text' then length(regexp_replace({O.decode('t.tok')}, {O.q(P.PLAIN_WS)}, '', 'g')) else 0 end) ink,
   sum(case when t.kind in ('open','void') then 1 else 0 end) inner_els
   from el e left join tok t on t.page_id = e.page_id and t.pos > e.pos and t.pos < e.stop group by all),
ef as (select page_id, count(*) tags, count(*) filter (where coalesce(ink, 0) = 0 and coalesce(inner_els, 0) = 0) hollow,
   max((tag='html')::int) hh, max((tag='head')::int) hd, max((tag='body')::int) hb,
   count(distinct tag) filter (where tag in ('article','main','section','header','footer','nav','aside')) sem,
   max((tag in ('main','article'))::int) main_any, coalesce(sum(chars) filter (where tag in ('main','article')), 0) main_chars,
   coalesce(sum(chars) filter (where tag in ('nav','header')), 0) nav_chars,
   coalesce(sum(chars * ((tag in ('nav','header','footer'))::int + (cls like '%ad%')::int + coalesce((cls like '%sidebar%')::int, 0) + coalesce((cls like '%widget%')::int, 0))) , 0)
     + coalesce(sum(chars) filter (where cls is null and tag in ('nav','header','footer')), 0) noise_chars,
   count(*) filter (where tag = 'a') links, count(*) filter (where tag in ('ul','ol')) lists from ec group by page_id),
rn as (select page_id, length(html) html_len, {O.collapse(O.decode(O.rep(s_body_source(), O.TAG)))} txt, {TITLE} title,
   len(regexp_extract_all(html, {O.q(SCRIPTS)})) scripts, len(regexp_extract_all(html, {O.q(STYLES)})) styles,
   coalesce(length(array_to_string(regexp_extract_all(html, {O.q(SCRIPTS)}, 1) || regexp_extract_all(html, {O.q(STYLES)}, 1), '')), 0) script_chars,
   regexp_matches(lower(html), {O.q(AJAX)}) ajax from pages),
i as (select page_id, html_len::double html_len, length(txt)::double text_len, {O.words('txt')}::double words, scripts, lists,
   (tags + scripts + styles + 3 - hh - hd - hb)::double tags, (hollow + 1 - hd)::double hollow, sem::double sem, main_any,
   case when main_chars > 0 then main_chars else length(txt) end::double main_chars, nav_chars::double nav_chars,
   (noise_chars + script_chars)::double noise_chars, links::double links, ajax or regexp_matches(lower(txt), {O.q(AJAX)}) ajax,
   regexp_matches(lower(txt), {O.q(LOADING)}) loading, regexp_matches(txt, {O.q(PLACEHOLDER)}) placeholder,
   regexp_matches(txt, {O.q(TRUNCATION)}) truncated, title, {hits('txt')}::double / {len(WORDS)} m, {hits('title')}::double / {len(WORDS)} mt
   from rn join ef using (page_id))"""
NAV, NOISE = "(nav_chars / (nav_chars + main_chars))", "(noise_chars / (noise_chars + main_chars))"
DENS, LINKED = "(text_len / html_len)", "(case when words > 0 then links / words else 0 end)"
# name, kind, category, weight, passed, score
RULES = [
    ("minimum-content-length", "heuristic", "completeness", 0.3, "html_len >= 100 or text_len >= 100", "least(1.0, (html_len + text_len) / 200)"),
    ("minimum-word-count", "heuristic", "completeness", 0.2, "words >= 20", "least(1.0, words / 20)"),
    ("empty-content-ratio", "heuristic", "completeness", 0.15, "hollow / tags < 0.5", "1 - hollow / tags"),
    ("semantic-html-presence", "heuristic", "structure", 0.2, "sem / 7 > 0.3", "sem / 7"),
    ("main-content-presence", "heuristic", "structure", 0.25, "main_any = 1", "case when main_any = 1 then 1.0 else 0.5 end"),
    ("navigation-content-ratio", "heuristic", "quality", 0.15, f"{NAV} < 0.4", f"1 - {NAV}"),
    ("ajax-indicators", "pattern", "quality", 0.3, "not ajax", "case when ajax then 0.3 else 1.0 end"),
    ("empty-data-containers", "pattern", "completeness", 0.25, "true", "1.0"),
    ("loading-placeholders", "pattern", "quality", 0.2, "not loading", "case when loading then 0.4 else 1.0 end"),
    ("interactive-elements", "pattern", "quality", 0.15, "true", "1.0"),
    ("noise-ratio", "heuristic", "quality", 0.2, f"{NOISE} < 0.5", f"1 - {NOISE}"),
    ("text-density", "heuristic", "quality", 0.15, f"{DENS} > 0.1", f"least(1.0, {DENS} * 10)"),
    ("link-density", "heuristic", "quality", 0.1, f"{LINKED} > 0.05 and {LINKED} < 0.3",
     f"case when {LINKED} < 0.05 then {LINKED} * 20 when {LINKED} > 0.2 then 0.5 else 1.0 end"),
    ("keyword-matching", "heuristic", "completeness", 0.3, "m > 0.3", "m"),
    ("title-relevance", "heuristic", "relevance", 0.2, "title = '' or mt > 0.2", "case when title = '' then 0.5 else mt end"),
    ("placeholder-detection", "pattern", "quality", 0.25, "not placeholder", "case when placeholder then 0.2 else 1.0 end"),
    ("incomplete-table-detection", "pattern", "quality", 0.2, "true", "1.0"),
    ("truncated-content-detection", "pattern", "quality", 0.15, "not truncated", "case when truncated then 0.7 else 1.0 end"),
]
LONG = " union all ".join(
    f"select {i} ord, page_id, '{n}' as rule, '{k}' as kind, '{c}' as category, {w}::double as weight, ({p})::int as passed, ({s})::double as sc from i"
    for i, (n, k, c, w, p, s) in enumerate(RULES)
)


def _scores(kinds="('heuristic')"):
    cats = ", ".join(
        f"sum(sc * weight) filter (where category = '{c}' and kind = 'heuristic') / sum(weight) filter (where category = '{c}' and kind = 'heuristic') {c}"
        for c in Q.CATEGORY_WEIGHTS
    )
    return f"""with {INPUTS}, lng as ({LONG}), sc as (select page_id, {cats},
  coalesce(string_agg(rule, ',' order by ord) filter (where passed = 0 and kind in {kinds}), '') failed from lng group by page_id),
ov as (select *, completeness * 0.3 + relevance * 0.25 + structure * 0.2 + quality * 0.15 overall from sc)"""


ACTIONS = """case when overall >= 0.5 then null else coalesce(nullif(concat_ws(',',
 case when regexp_matches(failed, 'dynamic|ajax') then 'Use browser to render dynamic content' end,
 case when regexp_matches(failed, 'length|word') then 'Check if content loaded completely' end,
 case when regexp_matches(failed, 'empty|placeholder') then 'Verify page content is not placeholder' end), ''), 'Review content quality') end"""
ORACLE = {
    "page_metrics": f"with {INPUTS} select page_id, html_len::bigint as content_length, tags::bigint as html_tags, words::bigint as text_words, "
    "links::bigint as link_count, 0::bigint as image_count, 0::bigint as form_count, scripts as script_count, 0::bigint as table_count, lists as list_count from i",
    "quality_rules": f"with {INPUTS}, lng as ({LONG}) select page_id, rule, kind, category, weight, passed, round(sc, 6) as score from lng",
    "quality_own_rule": f"""with t as (select page_id, {O.words(O.collapse(O.decode(O.rep(s_body_source(), O.TAG))))} w from pages)
select page_id, 'own-length' as rule, 'heuristic' as kind, 'quality' as category, 0.5::double as weight, (w >= 40)::int as passed, case when w < 40 then 0.25 else 1.0 end::double as score from t""",
    "quality_rules_mixed": f"""with {cte('widget_pages')}, k as (select c_custkey page_id, c_custkey % 4 c, c_nationkey % 9 b from customer)
select page_id, 'empty-data-containers' as rule, 0 as passed, case when c = 0 then 0.6 else 0.7 end::double as score from k
union all select page_id, 'interactive-elements', (b + 1 <= 5)::int, case when b + 1 > 5 then 0.6 else 1.0 end from k
union all select page_id, 'incomplete-table-detection', 0, 0.5 from k
union all select page_id, 'ajax-indicators', 0, 0.3 from k
union all select page_id, 'loading-placeholders', (c <> 1)::int, case when c = 1 then 0.4 else 1.0 end from k
union all select page_id, 'placeholder-detection', (c <> 2)::int, case when c = 2 then 0.2 else 1.0 end from k
union all select page_id, 'main-content-presence', (c = 3)::int, case when c = 3 then 1.0 else 0.5 end from k
union all select page_id, 'truncated-content-detection', (c <> 0)::int, case when c = 0 then 0.7 else 1.0 end from k""",
    "quality_score": _scores() + " select page_id, round(completeness, 6) as completeness, round(relevance, 6) as relevance, "
    "round(structure, 6) as structure, round(quality, 6) as quality, round(overall, 6) as overall from ov",
    "quality_verdict": _scores() + f" select page_id, round(overall, 6) as overall, (overall >= 0.5)::int as sufficient, "
    f"(overall < 0.4)::int as needs_interaction, failed, {ACTIONS} as actions from ov",
    "rule_based_verdict": _scores("('heuristic', 'pattern')") + " select page_id, round(overall, 6) as overall, (overall >= 0.5)::int as sufficient, failed from ov",
    "hybrid_verdict": _scores() + """, u as (select page_id, overall o, overall < 0.7 and doc_id is not null use, overall * 0.4 + labels.quality * 0.9 * 0.6 bl, labels.quality lq, toxic
  from ov left join labels on doc_id = page_id)
select page_id, round(case when use then bl else o end, 6) as overall, case when use then lq = 1 and bl >= 0.5 else o >= 0.5 end::int as sufficient,
 case when use then o < 0.4 or toxic = 1 else o < 0.4 end::int as needs_interaction, use::int as used_second from u""",
    "dynamic_page_flag": f"""select page_id, (regexp_matches(html, {O.q(Q.DYNAMIC_MARKS)}) or regexp_matches({O.collapse(O.decode(O.rep(s_body_source(), O.TAG)))}, {O.q(Q.DYNAMIC_PHRASES)}))::int as dynamic from pages
union all select -c_custkey - 1, 1 from customer""",
    "min_content": "select doc_id, (length(case when text = '' then '<p></p>' else text end) > 100)::int as usable, "
    "(length(text) >= 200 or length(text) + 7 >= 500)::int as accepted from documents",
    "content_hash_dedup": "select sha256(text || '::' || lang) as content_hash, min(doc_id) as page_id, count(*) as copies from documents group by 1",
    "blocked_page_flag": """select case event_id % 9 when 0 then 'BLOCKED:cloudflare' when 1 then 'CAPTCHA' when 2 then 'BLOCKED:denied' when 3 then 'BLOCKED:bot'
 when 4 then 'BLOCKED:incapsula' when 5 then 'BLOCKED:robot check' when 6 then 'CAPTCHA' end as block, count(*) as pages from events group by 1""",
}
#: The eight rules as written out above; the others over the numbers of the widget pages, without a task.  A main role counts as main text.
ORACLE["quality_rules_mixed_all"] = f"""with eight as ({ORACLE['quality_rules_mixed']}), {cte('widget_pages')}, pages as (select * from widget_pages), {INPUTS},
j as (select i.* replace (case when c_custkey % 4 = 3 then length('Text of ' || c_name) else main_chars end as main_chars) from i join customer on c_custkey = page_id)
select * from eight union all """ + " union all ".join(
    f"select page_id, '{n}', ({p})::int, round(({s})::double, 6) from j"
    for n, _, _, _, p, s in [(n, *r) if n not in ("keyword-matching", "title-relevance") else (n, *r[:3], "true", "0.5") for n, *r in RULES]
    if f"'{n}'" not in ORACLE["quality_rules_mixed"]
)
