"""Typed entities: rules, patterns, structured data, model replies, fallback between strategies.

An entity row is page_id, type, data MAP<STRING,STRING>, confidence, source, plus `ord`,
the place of the entity on its page, which decides what counts as first.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.functions import patterns as P
from webquarry.functions import text as T
from webquarry.functions.markup import css, path
from webquarry.functions.transforms import apply_transform
from webquarry.operators import dom, pagetext, structured

# Entity types and the patterns that find entities in text.
ENTITY_TYPES = "company person product article contact pricing custom".split()
_S = P.PLAIN_WS[1:-1]  # white space inside a character class
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"  # word boundary as scripts see it: ASCII words only
EMAIL = r"[\w.-]++@[\w.-]+\.\w+"
PHONE = rf"(?:\+?\d{{1,3}}[-.{_S}]?)?\(?\d{{3}}\)?[-.{_S}]?\d{{3}}[-.{_S}]?\d{{4}}"
WEB_URL = rf"[hH][tT][tT][pP][sS]?://[^{_S}]+"
RULE_URL = rf"""[hH][tT][tT][pP][sS]?://[^{_S}<>"{{}}|\\^`\[\]]+"""
PRICE = (
    rf"(?i)[$₱€£¥₹][{_S}]*[\d,]+\.?\d*|[\d,]+\.?\d*[{_S}]*[$₱€£¥₹]|"
    rf"[\d,]+\.?\d*[{_S}]*(?:USD|PHP|EUR|GBP|JPY|INR|peso|dollar|euro|pound|yen)"
)
DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
COMPANY = (
    rf"[A-Z](?<!\w[A-Z])[a-z]+(?:[{_S}]+[A-Z][a-z]+)*"
    rf"(?:[{_S}]+(?:Inc|LLC|Ltd|Corp|Corporation|Company|Co))?(?:\.(?=\w)|(?!\w))"
)
# A character without which a pattern cannot match; tested first, as most texts hold none.
NEEDS = {EMAIL: "@", WEB_URL: "://", RULE_URL: "://"}
NO_DATA = "cast(map() as map<string,string>)"


@dataclass(frozen=True)
class Rule:
    """One extraction rule; selector goes before path, path before regex."""

    name: str
    entity_type: str
    selector: str | None = None
    xpath: str | None = None
    regex: str | None = None
    attribute: str | None = None
    transform: str | None = None
    confidence: float | None = None
    multiple: bool = False
    required: bool = False


@dataclass(frozen=True)
class RuleSet:
    name: str
    priority: int
    rules: tuple[Rule, ...]
    enabled: bool = True


def _css(name, kind, selector, attribute, transform, confidence, multiple=False):
    return Rule(name, kind, selector=selector, attribute=attribute, transform=transform, confidence=confidence, multiple=multiple)


# The built-in rule sets.
DEFAULT_RULE_SETS = (
    RuleSet("email", 10, (
        _css("email-href", "contact", 'a[href^="mailto:"]', "href", "parseEmail", 0.95, True),
        Rule("email-text", "contact", regex=EMAIL, transform="parseEmail", confidence=0.9, multiple=True),
        _css("email-data-attr", "contact", "[data-email], [data-mail]", "data-email", "parseEmail", 0.85, True),
    )),
    RuleSet("phone", 10, (
        _css("phone-href", "contact", 'a[href^="tel:"]', "href", "parsePhone", 0.95, True),
        Rule("phone-text", "contact", regex=PHONE, transform="parsePhone", confidence=0.9, multiple=True),
        _css("phone-data-attr", "contact", "[data-phone], [data-tel], [data-telephone]", "data-phone", "parsePhone", 0.85, True),
    )),
    RuleSet("url", 10, (
        _css("url-href", "custom", "a[href]", "href", "parseUrl", 0.95, True),
        _css("url-src", "custom", "img[src], iframe[src], video[src]", "src", "parseUrl", 0.9, True),
        Rule("url-text", "custom", regex=RULE_URL, transform="parseUrl", confidence=0.85, multiple=True),
    )),
    RuleSet("company", 5, (
        _css("company-name-h1", "company", 'h1.company-name, h1[class*="company"]', None, "trim", 0.9),
        _css("company-name-title", "company", '[itemtype*="Organization"] [itemprop="name"], .org-name', None, "trim", 0.85),
        _css("company-name-meta", "company", 'meta[property="og:site_name"], meta[name="application-name"]', "content", "trim", 0.8),
        _css("company-address", "company", '[itemtype*="PostalAddress"], .address, [class*="address"]', None, "trim", 0.75, True),
    )),
    RuleSet("product", 5, (
        _css("product-name", "product", 'h1.product-title, [itemtype*="Product"] [itemprop="name"], .product-name', None, "trim", 0.9),
        _css("product-price", "pricing", '[itemtype*="Product"] [itemprop="price"], .price, [class*="price"]', None, "parseNumber", 0.85),
        _css("product-price-shopee", "pricing",
             '[class*="price"], [data-testid*="price"], .product-price, [class*="Price"], [class*="amount"]', None, "parseNumber", 0.8),
        _css("product-price-currency", "pricing", '[itemtype*="Product"] [itemprop="priceCurrency"]', "content", "trim", 0.8),
        _css("product-description", "product", '[itemtype*="Product"] [itemprop="description"], .product-description', None, "removeHtml", 0.75),
    )),
    RuleSet("article", 5, (
        _css("article-title", "article", 'h1, [itemtype*="Article"] [itemprop="headline"], article h1, .article-title', None, "trim", 0.9),
        _css("article-author", "person", '[itemtype*="Article"] [itemprop="author"], .author, [rel="author"]', None, "trim", 0.85, True),
        _css("article-date", "article",
             '[itemtype*="Article"] [itemprop="datePublished"], time[datetime], .date, [class*="date"]', "datetime", "parseDate", 0.8),
        _css("article-date-content", "article", "time[datetime]", "datetime", "parseDate", 0.75),
        _css("article-description", "article", 'meta[property="og:description"], meta[name="description"]', "content", "trim", 0.7),
    )),
    RuleSet("contact", 8, (
        _css("contact-email", "contact", '.contact-email, [class*="contact"] a[href^="mailto:"]', "href", "parseEmail", 0.9, True),
        _css("contact-phone", "contact", '.contact-phone, [class*="contact"] a[href^="tel:"]', "href", "parsePhone", 0.9, True),
        _css("contact-form", "contact", 'form.contact-form, form[action*="contact"]', None, "trim", 0.7),
    )),
)


class RuleSets:
    """The rule sets in force: add, remove, get, list.  Plans are built from them on the driver."""

    def __init__(self, sets: Sequence[RuleSet] = DEFAULT_RULE_SETS, transforms: dict[str, Callable[[Column], Column]] | None = None):
        self._sets = {s.name: s for s in sets}
        self.transforms = dict(transforms or {})

    def add(self, rule_set: RuleSet) -> None:
        self._sets[rule_set.name] = rule_set

    def remove(self, name: str) -> bool:
        return self._sets.pop(name, None) is not None

    def get(self, name: str) -> RuleSet | None:
        return self._sets.get(name)

    def all(self) -> list[RuleSet]:
        return list(self._sets.values())

    def register_transform(self, name: str, fn: Callable[[Column], Column]) -> None:
        self.transforms[name] = fn

    def ranked(self, entity_types: Sequence[str] | None = None) -> list[tuple[str, Rule]]:
        """(source name, rule) by descending set priority, pruned to the wanted entity types."""
        active = sorted((s for s in self._sets.values() if s.enabled), key=lambda s: -s.priority)
        return [
            (f"{s.name}.{r.name}", r) for s in active for r in s.rules
            if not entity_types or r.entity_type in entity_types
        ]


# ---- values by selector, path, pattern ----------------------------------------------------

def xpath_select(pages: DataFrame, path: str, attribute: str | None = None, els: DataFrame | None = None) -> DataFrame:
    """page_id, pos, value of one path; see `paths_select`."""
    return paths_select(pages, {"x": path}, attribute, els).drop("name")


def paths_select(pages: DataFrame, paths: Mapping[str, str], attribute: str | None = None, els: DataFrame | None = None) -> DataFrame:
    """page_id, name, pos, value for named XPaths, in the forms of `markup.path`; a path ends in /@attr, /text() or an element.

    Paths are steps as selectors are, so they run on the same element table, all in one pass.  ValueError for forms not covered.
    """
    compiled = {name: path(text) for name, text in paths.items()}
    return dom.select_elements(pages, {name: (steps, attribute or own) for name, (steps, own) in compiled.items()}, els)


def distinct_matches(text: Column, pattern: str) -> Column:
    """Distinct matches in order; texts that cannot match are passed over by a cheaper test."""
    found = F.array_distinct(T.find_all(text, pattern))
    possible = F.contains(text, F.lit(NEEDS[pattern])) if pattern in NEEDS else (
        T.matches(text, r"\d") if pattern in (PHONE, DATE) else None)
    return found if possible is None else F.when(possible, found).otherwise(F.array().cast("array<string>"))


def regex_select(text: Column, pattern: str) -> Column:
    """Distinct matches in order, case ignored; word boundaries are ASCII ones, as in scripts."""
    if pattern in NEEDS or pattern == PHONE:  # built-in patterns have no letters whose case matters
        return distinct_matches(text, pattern)
    pattern = pattern.replace(r"\b", _EDGE)
    return F.array_distinct(T.find_all(text, pattern if pattern.startswith("(?i)") else f"(?i){pattern}"))


# ---- rules --------------------------------------------------------------------------------

def entity_data(kind: Column, value: Column, transform: Column | None = None) -> Column:
    """Value -> data map by entity type."""
    is_price_number = F.lit(False) if transform is None else transform == "parseNumber"
    return (
        F.when(kind == "contact", F.when(F.contains(value, F.lit("@")), F.create_map(F.lit("email"), value, F.lit("type"), F.lit("email")))
               .when(T.matches(value, r"[\d\-()]"), F.create_map(F.lit("phone"), value, F.lit("type"), F.lit("phone")))
               .otherwise(F.create_map(F.lit("value"), value)))
        .when(kind.isin("company", "product", "person"), F.create_map(F.lit("name"), value))
        .when((kind == "pricing") & is_price_number, F.create_map(F.lit("price"), value))
        .when(kind == "article", F.create_map(F.lit("title"), value))
        .otherwise(F.create_map(F.lit("value"), value))
    )


def rule_extract(pages: DataFrame, sets: RuleSets | None = None, entity_types: Sequence[str] | None = None) -> DataFrame:
    """Entities of all rules, duplicates of a page removed.

    All selector rules share one pass over the element table, all pattern rules one
    projection of the page row.  Rules for unwanted types never enter the plan.
    """
    sets = sets or RuleSets()
    rules = sets.ranked(entity_types)
    by_selector = {}
    for i, (name, r) in enumerate(rules):
        if r.selector or r.xpath:
            try:
                selector, own = (css(r.selector), None) if r.selector else path(r.xpath)
            except ValueError as broken:
                warnings.warn(f"rule {name} is left out: {broken}", stacklevel=2)  # one broken rule does not stop the others
                continue
            by_selector[str(i)] = (selector, r.attribute or own)
    by_regex = {i: r.regex for i, (_, r) in enumerate(rules) if not (r.selector or r.xpath) and r.regex}
    found = []
    if by_selector:
        hits = dom.select_elements(pages, by_selector)
        found.append(hits.select("page_id", F.col("name").cast("int").alias("rule"), F.col("pos").cast("long").alias("pos"), "value"))
    if by_regex:
        html = F.col("html")
        # As in the element table, text is taken as it stands: tags vanish, white space stays.
        body = T.decode_entities(T.sub(pagetext.body_source(html), P.TAG))
        rows = pages.select("page_id", F.when(T.js_trim(body) == "", html).otherwise(body).alias("body"))
        matches = F.array(*[
            F.struct(F.lit(i).alias("rule"), regex_select(F.col("body"), p).alias("values")) for i, p in by_regex.items()
        ])
        rows = rows.select("page_id", F.explode(matches).alias("m"))
        found.append(rows.select("page_id", F.col("m.rule").alias("rule"), F.posexplode("m.values").alias("pos", "value")).withColumn("pos", F.col("pos").cast("long")))
    if not found:
        raise ValueError("no rule is active")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)

    def per_rule(field: Callable[[int, Rule], object], kind: str) -> Column:
        return F.element_at(F.array(*[F.lit(field(i, r)) for i, (_, r) in enumerate(rules)]).cast(f"array<{kind}>"), F.col("rule") + 1)

    transforms = {name: [i for i, (_, r) in enumerate(rules) if r.transform == name] for name in {r.transform for _, r in rules if r.transform}}
    value = F.col("value")
    changed = None
    for name, ids in sorted(transforms.items()):
        done = apply_transform(value, name, sets.transforms)
        changed = F.when(F.col("rule").isin(ids), done) if changed is None else changed.when(F.col("rule").isin(ids), done)
    rows = rows.withColumn("value", value if changed is None else changed.otherwise(value))
    rows = rows.filter(F.coalesce("value", F.lit("")) != "")
    single = [i for i, (_, r) in enumerate(rules) if not r.multiple]
    first = F.row_number().over(W.partitionBy("page_id", "rule").orderBy("pos"))
    rows = rows.withColumn("n", first).filter((F.col("n") == 1) | ~F.col("rule").isin(single))
    typed = rows.select(
        "page_id", per_rule(lambda i, r: r.entity_type, "string").alias("type"), F.col("value"),
        per_rule(lambda i, r: r.transform or "", "string").alias("transform"),
        per_rule(lambda i, r: 0.8 if r.confidence is None else r.confidence, "double").alias("confidence"),
        F.concat(F.lit("rule:"), per_rule(lambda i, r: rules[i][0], "string")).alias("source"),
        F.struct(F.col("rule").cast("long").alias("rank"), F.col("pos").alias("pos")).alias("ord"),
    )
    shaped = typed.withColumn("data", entity_data(F.col("type"), F.col("value"), F.col("transform"))).drop("value", "transform")
    return dedup_entities(shaped)


# ---- common steps -------------------------------------------------------------------------

def _with_key(entities: DataFrame) -> DataFrame:
    return entities.withColumn("key", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("data")))))


def dedup_entities(entities: DataFrame, cap: int | None = None) -> DataFrame:
    """First entity per page, type and data; `cap` keeps that many per page, in order."""
    keyed = _with_key(entities)
    first = keyed.groupBy("page_id", "type", "key").agg(F.min_by(F.struct("data", "confidence", "source", "ord"), "ord").alias("e"))
    out = first.select("page_id", "type", "e.data", "e.confidence", "e.source", "e.ord")
    if cap is None:
        return out
    n = F.row_number().over(W.partitionBy("page_id").orderBy("ord"))
    return out.withColumn("n", n).filter(F.col("n") <= cap).drop("n")


def validate_entities(entities: DataFrame) -> DataFrame:
    """Known type and non-empty data; null values are dropped from the data first."""
    kept = F.map_filter("data", lambda k, v: v.isNotNull())
    return entities.withColumn("data", kept).filter(F.col("type").isin(ENTITY_TYPES) & (F.size("data") > 0))


def page_confidence(pages: DataFrame, entities: DataFrame) -> DataFrame:
    """page_id, entities, confidence: mean confidence, a missing one counting 0.5; 0 without entities."""
    means = entities.groupBy("page_id").agg(F.count("*").alias("entities"), F.avg(F.coalesce("confidence", F.lit(0.5))).alias("confidence"))
    return pages.select("page_id").join(means, "page_id", "left").na.fill({"entities": 0, "confidence": 0.0})


def extraction_report(entities: DataFrame) -> DataFrame:
    """type, source, entities, pages, confidence, with subtotals (null = all)."""
    return entities.rollup("type", "source").agg(
        F.count("*").alias("entities"), F.countDistinct("page_id").alias("pages"), F.avg("confidence").alias("confidence")
    )


# ---- patterns in text ---------------------------------------------------------------------

PATTERNS = (("email", EMAIL), ("phone", PHONE), ("url", WEB_URL), ("price", PRICE), ("company", COMPANY), ("date", DATE))


def pattern_entities(
    docs: DataFrame, key: str, text: Column, confidence: Column, entity_types: Sequence[str] | None = None, order: Column | None = None
) -> DataFrame:
    """key, type, data, confidence, source, ord: six patterns, distinct values per text.  One projection, no shuffle."""
    kinds = {"email": "contact", "phone": "contact", "url": "custom", "price": "pricing", "company": "company", "date": "custom"}
    wanted = [(i, n, p) for i, (n, p) in enumerate(PATTERNS) if not entity_types or kinds[n] in entity_types]
    groups = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(n).alias("name"), F.lit(kinds[n]).alias("type"), distinct_matches(F.col("__text"), p).alias("vs"))
        for i, n, p in wanted
    ])
    at = F.lit(0) if order is None else order
    rows = docs.select(key, text.alias("__text"), confidence.cast("double").alias("__conf"), at.cast("long").alias("__at"))
    rows = rows.select(key, "__conf", "__at", F.explode(groups).alias("g"))
    rows = rows.select(key, "__conf", "__at", "g.rank", "g.name", "g.type", F.posexplode("g.vs").alias("pos", "v"))
    name, v = F.col("name"), F.col("v")
    data = (
        F.when(name == "price", F.create_map(F.lit("price"), v, F.lit("value"), T.sub(v, r"[^0-9.]")))
        .when(name == "company", F.create_map(F.lit("name"), v))
        .otherwise(F.create_map(name, v, F.lit("type"), name))
    )
    return rows.select(
        key, "type", data.alias("data"),
        F.when(name == "company", F.col("__conf") * 0.9).otherwise(F.col("__conf")).alias("confidence"),
        F.lit("pattern_match").alias("source"),
        F.struct(F.col("__at").alias("rank"), (F.col("rank").cast("long") * 1000000000 + F.col("pos")).alias("pos")).alias("ord"),
    )


# ---- structured data ----------------------------------------------------------------------

def _ord(rank: Column, pos: Column) -> Column:
    return F.struct(rank.cast("long").alias("rank"), pos.cast("long").alias("pos"))


def _data(pairs: dict[str, Column]) -> Column:
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def jsonld_entities(pages: DataFrame) -> DataFrame:
    """schema.org items of JSON-LD scripts as entities; unknown types keep all their fields."""
    items = structured.json_ld(pages)

    def field(path: str) -> Column:
        v = F.try_variant_get("item", path, "variant")
        return F.coalesce(F.try_variant_get("item", path, "string"), F.to_json(v))

    kind = F.lower(F.try_variant_get("item", "$.@type", "string"))
    rows = items.withColumn("kind", F.coalesce(kind, F.lower(F.try_variant_get("item", "$['@type']", "string")))).filter("kind is not null")
    k = F.col("kind")
    company, product = T.matches(k, "organization|corporation"), F.contains(k, F.lit("product"))
    article, person = T.matches(k, "article|blogposting"), F.contains(k, F.lit("person"))
    kind = F.when(company, "company").when(product, "product").when(article, "article").when(person, "person").otherwise("custom")
    rest = F.transform_values(
        F.try_variant_get("item", "$", "map<string,variant>"), lambda key, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    )
    data = (
        F.when(company, _data({n: field(f"$.{n}") for n in ("name", "url", "logo", "address", "contactPoint")}))
        .when(product, _data({"name": field("$.name"), "description": field("$.description"), "price": field("$.offers.price"),
                              "currency": field("$.offers.priceCurrency"), "image": field("$.image")}))
        .when(article, _data({"title": F.coalesce(F.nullif(field("$.headline"), F.lit("")), field("$.name")), "description": field("$.description"),
                              "author": field("$.author.name"), "datePublished": field("$.datePublished"), "dateModified": field("$.dateModified")}))
        .when(person, _data({"name": field("$.name"), "email": field("$.email"), "jobTitle": field("$.jobTitle"), "worksFor": field("$.worksFor.name")}))
        .otherwise(rest)
    )
    return rows.select(
        "page_id", kind.alias("type"), data.alias("data"), F.lit(0.95).alias("confidence"), F.lit("json-ld").alias("source"),
        _ord(F.col("pos"), F.col("item_pos")).alias("ord"),
    )


def microdata_entities(pages: DataFrame) -> DataFrame:
    """The same mapping over microdata items that have a type; repeated values are joined with ', '."""
    props = structured.microdata(pages)
    value = F.array_join("values", ", ")
    items = props.groupBy("page_id", "item").agg(
        F.first("item_type", ignorenulls=True).alias("item_type"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("prop"), value.alias("v"))))).alias("m"),
    ).filter("item_type is not null")
    k, m = F.lower("item_type"), F.col("m")

    def get(name: str) -> Column:
        return F.try_element_at(m, F.lit(name))

    company, product = F.contains(k, F.lit("organization")), F.contains(k, F.lit("product"))
    article, person = F.contains(k, F.lit("article")), F.contains(k, F.lit("person"))
    kind = F.when(company, "company").when(product, "product").when(article, "article").when(person, "person").otherwise("custom")
    data = (
        F.when(company, _data({n: get(n) for n in ("name", "url", "logo")}))
        .when(product, _data({"name": get("name"), "description": get("description"), "price": get("price"), "currency": get("priceCurrency")}))
        .when(article, _data({"title": F.coalesce(F.nullif(get("headline"), F.lit("")), get("name")), "author": get("author"), "datePublished": get("datePublished")}))
        .when(person, _data({n: get(n) for n in ("name", "email", "jobTitle")}))
        .otherwise(F.map_concat(F.create_map(F.lit("@type"), F.col("item_type")), m))
    )
    return items.select(
        "page_id", kind.alias("type"), data.alias("data"), F.lit(0.85).alias("confidence"), F.lit("microdata").alias("source"),
        _ord(F.lit(0), F.col("item")).alias("ord"),
    )


def head_entities(pages: DataFrame) -> DataFrame:
    """Title (0.9) and description (0.8) as article entities."""
    title, described = pagetext.page_title(F.col("html")), pagetext.page_description(F.col("html"))
    found = F.array(
        F.struct(F.lit(0).alias("i"), F.lit("title").alias("k"), title.alias("v"), F.lit(0.9).alias("c")),
        F.struct(F.lit(1).alias("i"), F.lit("description").alias("k"), described.alias("v"), F.lit(0.8).alias("c")),
    )
    rows = pages.select("page_id", F.explode(F.filter(found, lambda e: e["v"] != "")).alias("e"))
    return rows.select(
        "page_id", F.lit("article").alias("type"), F.create_map("e.k", "e.v").alias("data"), F.col("e.c").alias("confidence"),
        F.lit("head").alias("source"), _ord(F.lit(0), F.col("e.i")).alias("ord"),
    )


# ---- strategies ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Strategy:
    """A named extractor.  It succeeds on a page where `ready` holds; with `needs_entities` it must also find something."""

    name: str
    extract: Callable[[DataFrame], DataFrame]
    ready: Callable[[], Column] = lambda: T.js_trim(F.coalesce("html", F.lit(""))) != ""
    needs_entities: bool = False
    available: bool = True


class Extractors:
    """Strategies by name; users add their own functions DataFrame -> entities DataFrame."""

    def __init__(self):
        self._known: dict[str, Strategy] = {}

    def register(self, strategy: Strategy) -> None:
        if not strategy.name:
            raise ValueError("a strategy needs a name")
        self._known[strategy.name] = strategy

    def remove(self, name: str) -> bool:
        return self._known.pop(name, None) is not None

    def ordered(self, preferred: Sequence[str]) -> list[Strategy]:
        """Preferred ones first, then the remaining ones; unavailable ones are left out."""
        names = [n for n in preferred if n in self._known] + [n for n in self._known if n not in preferred]
        return [self._known[n] for n in names if self._known[n].available]

    def stats(self) -> dict[str, int]:
        return {"total": len(self._known), "available": sum(s.available for s in self._known.values())}


def default_extractors() -> Extractors:
    out = Extractors()
    out.register(Strategy("json-ld", jsonld_entities, needs_entities=True))
    out.register(Strategy("rules", rule_extract))
    out.register(Strategy("head", head_entities))
    return out


def extract_with_fallback(pages: DataFrame, extractors: Extractors, preferred: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(entities with `strategy`, page status): the first strategy that succeeds on each page.

    A page on which an earlier strategy is sure to succeed never reaches the later
    ones.  Where success depends on findings, the results compete by rank.
    """
    chain = extractors.ordered(preferred)
    rest, found, sure = pages, [], []
    for rank, s in enumerate(chain):
        fit = rest.filter(F.coalesce(s.ready(), F.lit(False)))
        found.append(s.extract(fit).withColumns({"strategy_rank": F.lit(rank), "strategy": F.lit(s.name)}))
        if not s.needs_entities:
            sure.append((rank, s))
            rest = rest.filter(~F.coalesce(s.ready(), F.lit(False)))
    entities = found[0]
    for more in found[1:]:
        entities = entities.unionByName(more)
    best = F.min("strategy_rank").over(W.partitionBy("page_id"))
    chosen = entities.withColumn("best", best).filter(F.col("strategy_rank") == F.col("best"))
    used = chosen.groupBy("page_id").agg(F.min("strategy_rank").alias("found_rank"), F.count("*").alias("entities"))
    known = F.coalesce(*[F.when(F.coalesce(s.ready(), F.lit(False)), F.lit(rank)) for rank, s in sure], F.lit(None).cast("int"))
    names = F.array(*[F.lit(s.name) for s in chain])
    status = pages.select("page_id", known.alias("sure_rank")).join(used, "page_id", "left")
    rank = F.least("found_rank", "sure_rank")
    status = status.select(
        "page_id", F.get(names, rank).alias("strategy"), rank.isNotNull().alias("success"),
        F.coalesce("entities", F.lit(0)).cast("long").alias("entities"),
        F.when(rank.isNull(), F.lit("All extraction strategies failed")).alias("error"),
    )
    return chosen.drop("best", "strategy_rank"), status


# ---- prompts and replies ------------------------------------------------------------------

def prompt_rows(pages: DataFrame, text: Column, task: Column, url: Column, entity_types: Sequence[str] = (), max_chars: int | None = None) -> DataFrame:
    """Adds prompt_content, wants_explanation, is_commerce, focus and prompt for an offline model; `max_chars`, if given, cuts the text."""
    low = F.lower(F.coalesce(task, F.lit("")))
    rows = pages.withColumns({
        "prompt_content": text if max_chars is None else F.when(F.length(text) > max_chars, F.concat(F.substring(text, 1, max_chars), F.lit("...[truncated]"))).otherwise(text),
        # Words that ask for an explanation, and URL parts of shops.
        "wants_explanation": T.matches(low, "explain|explanation|details|detail|describe|what"),
        "is_commerce": T.matches(url, "shopee|amazon|ebay|commerce|product|store|buy|cart"),
        "focus": F.lit(f"Focus on extracting these types: {', '.join(entity_types)}" if entity_types else "Extract any relevant structured data"),
    })
    lines = [
        F.concat(F.lit("Task: "), F.coalesce(F.nullif(task, F.lit("")), F.lit("Extract relevant information from this web page"))),
        F.concat(F.lit("URL: "), url), F.col("focus"),
        F.when(F.col("wants_explanation"), F.lit("Explain in detail, with context.")).otherwise(F.lit("Be accurate and concise.")),
        F.when(F.col("is_commerce"), F.lit("Also extract prices as pricing entities: price, currency, original price, discount.")),
        F.lit("Answer with JSON only: summary, entities[type, data, confidence, source]."),
        F.lit("Content:"), F.col("prompt_content"),
    ]
    return rows.withColumn("prompt", F.concat_ws("\n", *lines))


def parse_replies(replies: DataFrame, key: str, reply: Column, failed_chars: int | None = None) -> DataFrame:
    """key, summary, entities ARRAY<STRUCT<type, data, confidence, source>> from model replies.

    A reply that is no JSON becomes the summary, its first `failed_chars` characters if given.
    """
    clean = T.sub(T.sub(T.js_trim(reply), r"```json\s*"), r"```\s*\z")
    body = F.nullif(F.regexp_extract(clean, r"(?s)\{.*\}", 0), F.lit(""))
    rows = replies.select(key, reply.alias("__reply"), F.try_parse_json(body).alias("v"))

    def text(v: Column | str, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def confidence(e: Column) -> Column:
        raw = F.try_variant_get(e, "$.confidence", "variant")
        kind = F.schema_of_variant(raw)
        numeric = T.matches(kind, "^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|TINYINT|SMALLINT)")
        leading = F.regexp_extract(F.try_variant_get(e, "$.confidence", "string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+))", 1)
        value = F.when(numeric, F.try_variant_get(e, "$.confidence", "double")).when(
            kind == "STRING", F.nullif(leading, F.lit("")).try_cast("double"))
        bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))  # these two skip nulls
        return F.when(value.isNull(), F.lit(0.5)).otherwise(bounded)

    def entity(e: Column) -> Column:
        kind = F.trim(F.lower(text(e, "$.type")))
        data = F.transform_values(
            F.try_variant_get(e, "$.data", "map<string,variant>"), lambda k, v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))
        return F.struct(
            F.when(kind.isin(ENTITY_TYPES), kind).otherwise(F.lit("custom")).alias("type"),
            F.coalesce(data, F.expr(NO_DATA)).alias("data"),
            confidence(e).alias("confidence"), F.coalesce(text(e, "$.source"), F.lit("")).alias("source"),
        )

    summary, more = F.coalesce(text("v", "$.summary"), F.lit("")), F.coalesce(text("v", "$.explanation"), F.lit(""))
    joined = F.when(more == "", summary).when(summary == "", more).otherwise(F.concat(summary, F.lit("\n\n"), more))
    listed = F.coalesce(F.try_variant_get("v", "$.entities", "array<variant>"), F.array().cast("array<variant>"))
    return rows.select(
        key, F.when(F.col("v").isNull(), F.col("__reply") if failed_chars is None else F.substring("__reply", 1, failed_chars)).otherwise(joined).alias("summary"),
        F.transform(listed, entity).alias("entities"),
    )
