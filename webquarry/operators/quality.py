"""Page metrics, quality rules, scores and verdicts.

What a rule needs from the page row (lengths, words, phrases) is reduced to a few
numbers before anything moves; what needs nesting comes from one aggregate over the
element table.  Only those two narrow tables meet, on page_id.  Scores and verdicts
are plain column arithmetic on the joined row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import text as T
from webquarry.operators import dom, pagetext

MIN_LENGTH, MIN_WORDS, MIN_SCORE, INTERACTION_SCORE, TRUSTED_SCORE = 100, 20, 0.5, 0.4, 0.7
SEMANTIC_TAGS = "article main section header footer nav aside".split()
CATEGORY_WEIGHTS = {"completeness": 0.3, "relevance": 0.25, "structure": 0.2, "quality": 0.15}

# Phrases and markup (lower case) that point to content still to be loaded, missing or cut.
AJAX_MARKS = ("data-load", "fetch(", "xmlhttprequest", ".load(")
AJAX_SPANS = (("onclick", "load"), ("ajax", "true"))
LOADING_PHRASES = ("loading", "please wait", "click to view", "select to load", "load more")
LOADING_SPANS = (("choose", "to view"),)
PLACEHOLDER_PHRASES = ("lorem ipsum", "placeholder", "sample text", "coming soon", "under construction", "no data", "no content")
TRUNCATION_PHRASES = ("more...", "read more", "show more", "continue reading")
DYNAMIC_HTML = (
    r"(?is)<table[^>]*>\s*(<thead[^>]*>.*?</thead>)?\s*<tbody[^>]*>\s*</tbody>|<ul[^>]*>\s*</ul>|"
    r"""<div[^>]*class="[^"]*data[^"]*"[^>]*>\s*</div>"""
)
DYNAMIC_MARKS = r"(?i)data-load|onclick[^\n]*load|ajax[^\n]*true"
DYNAMIC_PHRASES = r"(?i)select[^\n]*to view|click[^\n]*to load|choose[^\n]*year|loading\.\.\."
ROBOT_PHRASES = (
    "sorry, we just need to make sure you're not a robot", "enter the characters you see below",
    "type the characters you see in this image", "api-services-support@amazon.com",
    "to discuss automated access to amazon data", "automated access to amazon",
)

# Selectors of the ratios.
MAIN = 'main, article, [role="main"]'
RATIO_NOISE = ("nav", "header", "footer", '[class*="ad"]', '[class*="sidebar"]', '[class*="widget"]')
FEATURES = {
    "main_any": 'main, article, [role="main"], .main-content, #main-content',
    "main": MAIN,
    "interactive": 'button, [onclick], [data-toggle], [data-target], select, input[type="button"]',
    "data_box": '[class*="data"], [id*="data"]',
    "list_box": '[class*="list"], [id*="list"]',
    **{f"noise_{i}": s for i, s in enumerate(RATIO_NOISE)},
}


def mentions(low: Column, phrases: Sequence[str], spans: Sequence[tuple[str, str]] = ()) -> Column:
    """Does lower-case text hold a phrase, or the two ends of a span on one line?  Plain searches come before any pattern."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(low, F.lit(phrase))
    for start, end in spans:
        found = found | (F.contains(low, F.lit(start)) & T.matches(low, rf"{start}[^\n]*{end}"))
    return found


# ---- inputs -------------------------------------------------------------------------------

def _element_features(pages: DataFrame) -> DataFrame:
    """One narrow row per page from the element table; aggregates where the elements already are."""
    els = dom.with_selectors(dom.elements(pages), FEATURES)
    tag = F.col("tag")
    chars = dom.content_length()
    hollow = (F.col("kind") == "void") | (F.col("stop") == F.col("pos") + 1)
    bad_table = (tag == "table") & (F.col("trs1") > F.col("trs0")) & (F.col("cells1") - F.col("cells0") < F.col("trs1") - F.col("trs0"))
    noise = F.lit(0)
    for i in range(len(RATIO_NOISE)):
        noise = noise + F.when(F.col(f"noise_{i}"), chars).otherwise(0)

    def count(cond: Column) -> Column:
        return F.count_if(cond)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, chars)), F.lit(0)).cast("long")

    holds = {t: F.coalesce(F.max((tag == t).cast("int")), F.lit(0)) for t in ("html", "head", "body")}
    return els.groupBy("page_id").agg(
        F.count("*").alias("tags"),
        count(((F.col("ink1") - F.col("ink0")) == 0) & (F.col("els1") == F.col("els0"))).alias("hollow_tags"),
        *[holds[t].alias(f"has_{t}") for t in holds],
        *[F.coalesce(F.max((tag == t).cast("int")), F.lit(0)).alias(f"sem_{t}") for t in SEMANTIC_TAGS],
        F.max(F.col("main_any").cast("int")).alias("main_any"),
        total(F.col("main")).alias("main_chars"),
        total(tag.isin("nav", "header")).alias("nav_chars"),
        F.sum(noise).cast("long").alias("noise_chars"),
        count(F.col("interactive")).alias("interactive"),
        (
            count((tag == "tbody") & hollow) + count(tag.isin("ul", "ol") & hollow)
            + count(F.col("data_box") & hollow) + count(F.col("list_box") & hollow)
        ).alias("empty_boxes"),
        count(tag == "a").alias("links"), count(tag == "img").alias("images"), count(tag == "form").alias("forms"),
        count(tag == "table").alias("tables"), count(tag.isin("ul", "ol")).alias("lists"),
        count(bad_table).alias("bad_tables"),
    )


def _task_hits(low: Column, words: Sequence[str]) -> Column:
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w)).cast("int")
    return out


def quality_inputs(pages: DataFrame, task: str | None = None, text: Column | None = None, title: Column | None = None) -> DataFrame:
    """page_id and every number the rules use.  `text` and `title` default to what the HTML holds."""
    html = F.col("html")
    words = [w for w in (task or "").lower().split() if len(w) > 3]
    rows = pages.select(
        "page_id", "html",
        (pagetext.body_text(html) if text is None else text).alias("text"),
        (pagetext.page_title(html) if title is None else title).alias("title"),
    )
    hidden = T.find_all(html, r"(?is)<(?:script|style)\b[^>]*>.*?</(?:script|style)\s*>")
    rows = rows.select(
        "page_id", F.length("html").alias("html_len"), "text", "title", F.lower("html").alias("low_html"), F.lower("text").alias("low"),
        F.transform(hidden, lambda s: F.struct(
            (F.lower(F.substring(s, 1, 7)) == "<script").alias("is_script"), T.sub(s, r"(?is)\A<[^>]*>|</[a-z]+\s*>\z").alias("body"))).alias("hidden"),
    )
    low = F.col("low")
    numbers = rows.select(
        "page_id", F.col("html_len").cast("long").alias("html_len"),
        F.length("text").cast("long").alias("text_len"),
        T.word_count(F.col("text")).alias("words"),
        F.size(F.filter("hidden", lambda s: s["is_script"])).cast("long").alias("scripts"),
        F.size(F.filter("hidden", lambda s: ~s["is_script"])).cast("long").alias("styles"),
        F.size(F.filter("hidden", lambda s: T.js_trim(s["body"]) == "")).cast("long").alias("blank_scripts"),
        F.aggregate("hidden", F.lit(0).cast("long"), lambda acc, s: acc + F.length(s["body"])).alias("script_chars"),
        (mentions(F.col("low_html"), AJAX_MARKS, AJAX_SPANS) | mentions(low, AJAX_MARKS, AJAX_SPANS)).alias("ajax"),
        mentions(low, LOADING_PHRASES, LOADING_SPANS).alias("loading"),
        mentions(low, PLACEHOLDER_PHRASES).alias("placeholder"),
        (F.endswith("low", F.lit("...")) | mentions(low, TRUNCATION_PHRASES)).alias("truncated"),
        (F.coalesce(F.col("title"), F.lit("")) != "").alias("titled"),
        _task_hits(low, words).alias("task_hits"),
        _task_hits(F.lower(F.coalesce("title", F.lit(""))), words).alias("title_hits"),
        F.lit(len(words)).alias("task_words"),
        F.lit(bool((task or "").strip())).alias("has_task"),
    )
    joined = numbers.join(_element_features(pages), "page_id", "left").na.fill(0)
    # The parser adds missing html, head and body elements; hidden scripts and styles are elements too.
    added = 3 - F.col("has_html") - F.col("has_head") - F.col("has_body")
    return joined.withColumns({
        "tags": (F.col("tags") + F.col("scripts") + F.col("styles") + added).cast("long"),
        "hollow_tags": F.col("hollow_tags") + F.col("blank_scripts") + (1 - F.col("has_head")),
        "noise_chars": F.col("noise_chars") + F.col("script_chars"),
        "semantic": sum((F.col(f"sem_{t}") for t in SEMANTIC_TAGS), F.lit(0)),
    })


def page_metrics(inputs: DataFrame) -> DataFrame:
    return inputs.select(
        "page_id", F.col("html_len").alias("content_length"), F.col("tags").alias("html_tags"), F.col("words").alias("text_words"),
        F.col("links").alias("link_count"), F.col("images").alias("image_count"), F.col("forms").alias("form_count"),
        F.col("scripts").alias("script_count"), F.col("tables").alias("table_count"), F.col("lists").alias("list_count"),
    )


# ---- rules --------------------------------------------------------------------------------

@dataclass(frozen=True)
class QualityRule:
    """`passed` and `score` are Columns over the inputs; heuristic rules are scored, pattern rules only listed."""

    name: str
    kind: str
    weight: float
    passed: Callable[[], Column]
    score: Callable[[], Column]
    category: str | None = None
    enabled: bool = True

    def group(self) -> str:
        return self.category or category_of(self.name)


def category_of(name: str) -> str:
    """Category by parts of the rule name; 'word' also hits 'keyword', so that rule counts as completeness."""
    for parts, category in (
        (("length", "word", "empty"), "completeness"), (("keyword", "relevance", "title"), "relevance"),
        (("structure", "semantic", "main"), "structure"),
    ):
        if any(p in name for p in parts):
            return category
    return "quality"


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _main_chars() -> Column:
    return F.when(F.col("main_chars") > 0, _c("main_chars")).otherwise(_c("text_len"))


def _share(part: str) -> Column:
    """Share of `part` in part + main text; null when both are empty."""
    whole = _c(part) + _main_chars()
    return F.when(whole > 0, _c(part) / whole)


def _matched(hits: str) -> Column:
    return F.when(F.col("task_words") > 0, _c(hits) / _c("task_words")).otherwise(F.lit(0.5))


def _flag(name: str, low: float) -> Column:
    return F.when(F.col(name), F.lit(low)).otherwise(F.lit(1.0))


def default_rules() -> list[QualityRule]:
    hollow = lambda: _ratio(_c("hollow_tags"), _c("tags"))
    density = lambda: _ratio(_c("text_len"), _c("html_len"))
    linked = lambda: _ratio(_c("links"), _c("words"))
    semantic = lambda: _c("semantic") / len(SEMANTIC_TAGS)
    no_title = ~F.col("has_task") | ~F.col("titled")
    return [
        QualityRule("minimum-content-length", "heuristic", 0.3,
                    lambda: (F.col("html_len") >= MIN_LENGTH) | (F.col("text_len") >= MIN_LENGTH),
                    lambda: F.least(F.lit(1.0), (_c("html_len") + _c("text_len")) / (2 * MIN_LENGTH))),
        QualityRule("minimum-word-count", "heuristic", 0.2, lambda: F.col("words") >= MIN_WORDS,
                    lambda: F.least(F.lit(1.0), _c("words") / MIN_WORDS)),
        QualityRule("empty-content-ratio", "heuristic", 0.15, lambda: hollow() < 0.5, lambda: 1 - hollow()),
        QualityRule("semantic-html-presence", "heuristic", 0.2, lambda: semantic() > 0.3, semantic),
        QualityRule("main-content-presence", "heuristic", 0.25, lambda: F.col("main_any") > 0,
                    lambda: F.when(F.col("main_any") > 0, F.lit(1.0)).otherwise(F.lit(0.5))),
        QualityRule("navigation-content-ratio", "heuristic", 0.15, lambda: F.coalesce(_share("nav_chars") < 0.4, F.lit(False)),
                    lambda: F.coalesce(1 - _share("nav_chars"), F.lit(0.0))),
        QualityRule("ajax-indicators", "pattern", 0.3, lambda: ~F.col("ajax"), lambda: _flag("ajax", 0.3)),
        QualityRule("empty-data-containers", "pattern", 0.25, lambda: F.col("empty_boxes") == 0,
                    lambda: F.greatest(F.lit(0.0), 1 - _c("empty_boxes") / 10)),
        QualityRule("loading-placeholders", "pattern", 0.2, lambda: ~F.col("loading"), lambda: _flag("loading", 0.4)),
        QualityRule("interactive-elements", "pattern", 0.15, lambda: F.col("interactive") <= 5,
                    lambda: F.when(F.col("interactive") > 5, F.lit(0.6)).otherwise(F.lit(1.0))),
        QualityRule("noise-ratio", "heuristic", 0.2, lambda: F.coalesce(_share("noise_chars") < 0.5, F.lit(False)),
                    lambda: F.coalesce(1 - _share("noise_chars"), F.lit(0.0))),
        QualityRule("text-density", "heuristic", 0.15, lambda: density() > 0.1, lambda: F.least(F.lit(1.0), density() * 10)),
        QualityRule("link-density", "heuristic", 0.1, lambda: (linked() > 0.05) & (linked() < 0.3),
                    lambda: F.when(linked() < 0.05, linked() * 20).when(linked() > 0.2, F.lit(0.5)).otherwise(F.lit(1.0))),
        QualityRule("keyword-matching", "heuristic", 0.3, lambda: ~F.col("has_task") | (_matched("task_hits") > 0.3),
                    lambda: F.when(F.col("has_task"), _matched("task_hits")).otherwise(F.lit(0.5))),
        QualityRule("title-relevance", "heuristic", 0.2, lambda: no_title | (_matched("title_hits") > 0.2),
                    lambda: F.when(no_title, F.lit(0.5)).otherwise(_matched("title_hits"))),
        QualityRule("placeholder-detection", "pattern", 0.25, lambda: ~F.col("placeholder"), lambda: _flag("placeholder", 0.2)),
        QualityRule("incomplete-table-detection", "pattern", 0.2, lambda: F.col("bad_tables") == 0,
                    lambda: F.when(F.col("bad_tables") == 0, F.lit(1.0)).otherwise(
                        F.greatest(F.lit(0.0), 1 - _ratio(_c("bad_tables"), _c("tables"))))),
        QualityRule("truncated-content-detection", "pattern", 0.15, lambda: ~F.col("truncated"), lambda: _flag("truncated", 0.7)),
    ]


class RuleBook:
    """The rules in force: add, remove, switch on and off.  Added rules are evaluated like the others."""

    def __init__(self, rules: Sequence[QualityRule] | None = None):
        self._rules = {r.name: r for r in (default_rules() if rules is None else rules)}

    def add(self, rule: QualityRule) -> None:
        self._rules[rule.name] = rule

    def remove(self, name: str) -> bool:
        return self._rules.pop(name, None) is not None

    def enable(self, name: str, on: bool = True) -> bool:
        if name not in self._rules:
            return False
        self._rules[name] = replace(self._rules[name], enabled=on)
        return True

    def active(self, kinds: Sequence[str] = ("heuristic", "pattern")) -> list[QualityRule]:
        return [r for r in self._rules.values() if r.enabled and r.kind in kinds]


def quality_rules(inputs: DataFrame, book: RuleBook | None = None) -> DataFrame:
    """page_id, rule, kind, category, weight, passed, score: one row per page and rule."""
    rules = (book or RuleBook()).active()
    results = F.array(*[
        F.struct(
            F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.group()).alias("category"),
            F.lit(r.weight).alias("weight"), r.passed().alias("passed"), r.score().cast("double").alias("score"),
        )
        for r in rules
    ])
    return inputs.select("page_id", F.explode(results).alias("r")).select("page_id", "r.*")


def _with_results(inputs: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    out = {f"p_{i}": r.passed() for i, r in enumerate(rules)}
    out |= {f"s_{i}": r.score().cast("double") for i, r in enumerate(rules)}
    return inputs.withColumns(out)


def verdicts(inputs: DataFrame, book: RuleBook | None = None, kinds: Sequence[str] = ("heuristic",)) -> DataFrame:
    """page_id, four scores, overall, sufficient, needs_interaction, failed, reason, actions.

    With kinds=('heuristic', 'pattern') all rules are checked and can fail, but only
    heuristic ones reach the score.
    """
    rules = (book or RuleBook()).active(kinds)
    scored = _with_results(inputs, rules)

    def category(name: str) -> Column:
        own = [(i, r) for i, r in enumerate(rules) if r.group() == name and r.kind == "heuristic"]
        if not own:
            return F.lit(0.5)
        return sum((F.col(f"s_{i}") * r.weight for i, r in own), F.lit(0.0)) / sum(r.weight for _, r in own)

    scored = scored.withColumns({c: category(c) for c in CATEGORY_WEIGHTS})
    overall = sum((F.col(c) * w for c, w in CATEGORY_WEIGHTS.items()), F.lit(0.0))
    failed = F.array_compact(F.array(*[F.when(~F.col(f"p_{i}"), F.lit(r.name)) for i, r in enumerate(rules)]))
    scored = scored.withColumns({"overall": overall, "failed": failed})
    shown = F.format_number("overall", 2)
    reason = F.when(F.size("failed") == 0, F.concat(F.lit("Content quality good (score: "), shown, F.lit(")"))).otherwise(
        F.concat(F.lit("Content quality: "), shown, F.lit(". Failed rules: "), F.array_join(F.slice("failed", 1, 3), ", "))
    )

    def fails(*parts: str) -> Column:
        return F.exists("failed", lambda n: T.matches(n, "|".join(parts)))

    actions = F.array_compact(F.array(
        F.when(fails("dynamic", "ajax"), F.lit("Use browser to render dynamic content")),
        F.when(fails("length", "word"), F.lit("Check if content loaded completely")),
        F.when(fails("empty", "placeholder"), F.lit("Verify page content is not placeholder")),
    ))
    actions = F.when(F.size(actions) == 0, F.array(F.lit("Review content quality"))).otherwise(actions)
    sufficient = F.col("overall") >= MIN_SCORE
    return scored.select(
        "page_id", *CATEGORY_WEIGHTS, "overall", sufficient.alias("sufficient"),
        (F.col("overall") < INTERACTION_SCORE).alias("needs_interaction"), "failed", reason.alias("reason"),
        F.when(~sufficient, actions).alias("actions"),
    )


def hybrid_verdicts(heuristic: DataFrame, second: DataFrame) -> DataFrame:
    """page_id, overall, sufficient, needs_interaction, used_second.

    `second` holds page_id, second_score, second_sufficient, second_interaction: another
    scorer's results, asked only where the heuristic is below 0.7.
    """
    both = heuristic.join(second, "page_id", "left")
    blend = F.col("overall") * 0.4 + F.col("second_score") * 0.6
    use = (F.col("overall") < TRUSTED_SCORE) & F.col("second_score").isNotNull()
    return both.select(
        "page_id", F.when(use, blend).otherwise(F.col("overall")).alias("overall"),
        F.when(use, F.col("second_sufficient") & (blend >= MIN_SCORE)).otherwise(F.col("sufficient")).alias("sufficient"),
        F.when(use, F.col("needs_interaction") | F.col("second_interaction")).otherwise(F.col("needs_interaction")).alias("needs_interaction"),
        use.alias("used_second"),
    )


# ---- row tests ----------------------------------------------------------------------------

def is_dynamic(html: Column, text: Column) -> Column:
    return T.matches(html, DYNAMIC_HTML) | T.matches(html, DYNAMIC_MARKS) | T.matches(text, DYNAMIC_PHRASES)


def has_min_content(html: Column, text: Column, service: bool = False) -> Column:
    """For choosing a result: more than 100 characters; for accepting a job: text >= 200 or html >= 500."""
    if service:
        return (F.coalesce(F.length(text), F.lit(0)) >= 200) | (F.coalesce(F.length(html), F.lit(0)) >= 500)
    shown = F.coalesce(F.nullif(text, F.lit("")), html, F.lit(""))
    return F.length(shown) > 100


def block_class(html: Column) -> Column:
    """BLOCKED or CAPTCHA with the kind of block, null for a normal page."""
    low = F.lower(html)

    def any_of(*parts: str) -> Column:
        return T.matches(low, "|".join(p.replace(".", r"\.") for p in parts))

    return (
        F.when(any_of("cloudflare") & any_of("challenge", "ray id"), F.lit("BLOCKED:cloudflare"))
        .when(any_of("captcha"), F.lit("CAPTCHA"))
        .when(any_of("access denied", "permission denied", "forbidden"), F.lit("BLOCKED:denied"))
        .when(any_of("bot detected", "automated access", "unusual traffic"), F.lit("BLOCKED:bot"))
        .when(any_of("incapsula", "incident id", "request unsuccessful", "imperva"), F.lit("BLOCKED:incapsula"))
        .when(any_of(*ROBOT_PHRASES), F.lit("BLOCKED:robot check"))
    )


def content_hash(html: Column, task: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws(":", html, F.coalesce(task, F.lit("")), url), 256)


def hash_dedup(pages: DataFrame, task: Column | None = None) -> DataFrame:
    """content_hash, page_id, copies: the first page of every identity.  An aggregate, so copies shrink before the shuffle."""
    key = content_hash(F.col("html"), F.lit("") if task is None else task, F.col("url"))
    return pages.select(key.alias("content_hash"), "page_id").groupBy("content_hash").agg(
        F.min("page_id").alias("page_id"), F.count("*").alias("copies")
    )
