"""Structured data of pages: meta tags, JSON-LD, microdata, forms, repeated cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from webquarry.functions import text as T
from webquarry.functions.markup import attr, has_attr
from webquarry.operators import dom
from webquarry.session import cut_lineage

# Names of anti-forgery form fields and meta tags.
CSRF_FIELDS = (
    "csrf_token", "csrftoken", "csrf", "_csrf", "_token", "authenticity_token", "__RequestVerificationToken",
    "csrfmiddlewaretoken", "_xsrf", "XSRF-TOKEN", "X-CSRF-TOKEN", "nonce", "_wpnonce", "form_token",
)
CSRF_METAS = ("csrf-token", "csrf_token", "csrftoken", "_csrf", "X-CSRF-TOKEN")

# Where the fields of a listing card are found.
CARD = "[data-asin]"
CARD_FIELDS = {
    "title": 'h2 a span, .a-text-normal, [data-testid="deal-title"]',
    "price": '.a-price .a-offscreen, [data-testid="deal-price"]',
    "original_price": ".a-text-price .a-offscreen",
    "discount": '.savingsPercentage, [data-testid="discount-badge"]',
    "rating": ".a-icon-alt",
    "image": '.s-image, [data-testid="deal-image"] img',
    "link": 'a[href*="/dp/"], a[href*="/deal/"]',
}


def meta_tags(pages: DataFrame) -> DataFrame:
    """page_id, name, content: the last meta tag of every name (name, else property, else itemprop)."""
    toks = T.find_all(dom.visible_source(F.col("html")), r"(?is)<meta\b[^>]*>")
    entries = F.filter(
        F.transform(toks, lambda t: F.struct(
            F.coalesce(*[F.nullif(attr(t, n), F.lit("")) for n in ("name", "property", "itemprop")]).alias("name"),
            F.nullif(attr(t, "content"), F.lit("")).alias("content"),
        )),
        lambda e: e["name"].isNotNull() & e["content"].isNotNull(),
    )
    rows = pages.select("page_id", entries.alias("es"))
    last = F.filter(F.col("es"), lambda e, i: ~F.exists(
        F.slice("es", i + 2, F.size("es")), lambda later: later["name"] == e["name"]
    ))
    return rows.select("page_id", F.explode(last).alias("e")).select("page_id", "e.*")


def open_graph(metas: DataFrame) -> DataFrame:
    return metas.filter(F.startswith("name", F.lit("og:")))


def twitter_card(metas: DataFrame) -> DataFrame:
    return metas.filter(F.startswith("name", F.lit("twitter:")))


def _script_bodies(html: Column, kind: str) -> Column:
    return T.find_all(html, rf"""(?is)<script\b[^>]*type\s*=\s*["']application/(?:{kind})["'][^>]*>(.*?)</script\s*>""", 1)


def embedded_json(pages: DataFrame) -> DataFrame:
    """page_id, pos, value (VARIANT): every parsable JSON or JSON-LD script."""
    rows = pages.select("page_id", F.posexplode(_script_bodies(F.col("html"), r"ld\+json|json")).alias("pos", "body"))
    return rows.select("page_id", "pos", F.try_parse_json("body").alias("value")).filter("value is not null")


def json_ld(pages: DataFrame) -> DataFrame:
    """page_id, pos, item_pos, item (VARIANT): JSON-LD scripts, top-level arrays flattened."""
    rows = pages.select("page_id", F.posexplode(_script_bodies(F.col("html"), r"ld\+json")).alias("pos", "body"))
    rows = rows.select("page_id", "pos", F.try_parse_json("body").alias("v")).filter("v is not null")
    is_list = F.startswith(F.schema_of_variant("v"), F.lit("ARRAY"))
    items = F.when(is_list, F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    return rows.select("page_id", "pos", F.posexplode(items).alias("item_pos", "item"))


def owners(els: DataFrame, scope: Column, item: Column) -> DataFrame:
    """Item rows once per enclosing scope element, with `owner` = position of that scope.

    Scopes are numbered by nesting depth with one running sum; an item at depth d asks
    once for each depth 1..d and takes the last scope opened at that depth.  Work
    follows the output, never scopes times items.
    """
    rows = els.withColumns({"is_scope": scope, "is_item": item}).filter("is_scope or is_item")
    start = F.struct(F.col("pos").alias("at"), F.lit(1).alias("phase"), F.col("is_scope").cast("int").alias("delta"))
    end = F.struct(F.col("stop").alias("at"), F.lit(0).alias("phase"), F.lit(-1).alias("delta"))
    events = rows.select("*", F.explode(F.when(F.col("is_scope"), F.array(start, end)).otherwise(F.array(start))).alias("ev"))
    w = W.partitionBy("page_id").orderBy("ev.at", "ev.phase").rowsBetween(W.unboundedPreceding, W.currentRow)
    depth = F.sum("ev.delta").over(w)
    events = events.withColumn("depth", depth).filter("ev.phase = 1")
    around = F.col("depth") - F.col("is_scope").cast("int")
    asks = F.when(F.col("is_item") & (around > 0), F.sequence(F.lit(1).cast("long"), around)).otherwise(F.array().cast("array<bigint>"))
    asks = F.concat(
        F.transform(asks, lambda k: F.struct(k.alias("k"), F.lit(True).alias("ask"))),
        F.when(F.col("is_scope"), F.array(F.struct(F.col("depth").alias("k"), F.lit(False).alias("ask")))).otherwise(
            F.array().cast("array<struct<k:bigint,ask:boolean>>")
        ),
    )
    rows = events.select("*", F.explode(asks).alias("q"))
    by_depth = W.partitionBy("page_id", "q.k").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("owner", F.last(F.when(~F.col("q.ask"), F.col("pos")), ignorenulls=True).over(by_depth))
    return rows.filter("q.ask").drop("q", "ev", "depth", "is_scope", "is_item")


def microdata(pages: DataFrame) -> DataFrame:
    """page_id, item, item_type, prop, values: one row per property of every [itemscope].

    Repeated properties become longer arrays; a nested item is given as JSON of its
    own type and properties.
    """
    els = dom.elements(pages)
    tok = F.col("tok")
    els = els.withColumns({
        "scope": has_attr(tok, "itemscope"), "prop": F.nullif(attr(tok, "itemprop"), F.lit("")),
        "item_type": F.nullif(attr(tok, "itemtype"), F.lit("")),
    })
    given = F.coalesce(*[F.nullif(attr(tok, n), F.lit("")) for n in ("datetime", "href", "src")])
    # Both tables are read several times below; written once, the elements of a page are found once.
    els = els.filter(F.col("scope") | F.col("prop").isNotNull())
    els = cut_lineage(els.select("page_id", "pos", "stop", "raw0", "raw1", "scope", "prop", "item_type", given.alias("given")))
    props = owners(els, F.col("scope"), F.col("prop").isNotNull())
    props = dom.with_page_text(props, pages)
    value = F.coalesce("given", T.js_trim(F.col("text")))
    props = cut_lineage(props.select("page_id", "owner", "pos", "prop", "scope", "item_type", value.alias("value")))
    # Plain properties of each item, later ones winning, as a map: the body of nested items.
    plain = F.array_sort(F.collect_list(F.when(~F.col("scope"), F.struct("pos", "prop", "value"))))
    bodies = props.groupBy("page_id", F.col("owner").alias("pos")).agg(plain.alias("ps")).select(
        "page_id", "pos",
        F.map_from_entries(F.transform(
            F.filter("ps", lambda p, i: ~F.exists(F.slice("ps", i + 2, F.size("ps")), lambda n: n["prop"] == p["prop"])),
            lambda p: F.struct(p["prop"], p["value"]),
        )).alias("body"),
    )
    nested = props.filter("scope").join(bodies, ["page_id", "pos"], "left")
    typed = F.when(F.col("item_type").isNull(), F.create_map().cast("map<string,string>")).otherwise(
        F.create_map(F.lit("@type"), F.col("item_type"))
    )
    nested = nested.select(
        "page_id", "owner", "pos", "prop",
        F.to_json(F.map_concat(typed, F.coalesce("body", F.create_map().cast("map<string,string>")))).alias("value"),
    )
    flat = props.filter("not scope").select("page_id", "owner", "pos", "prop", "value")
    values = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda v: v["value"])
    grouped = flat.unionByName(nested).groupBy("page_id", "owner", "prop").agg(values.alias("values"))
    types = els.filter("scope").select("page_id", F.col("pos").alias("owner"), "item_type")
    return grouped.join(types, ["page_id", "owner"]).select(
        "page_id", F.col("owner").cast("long").alias("item"), "item_type", "prop", "values"
    )


def page_forms(pages: DataFrame) -> DataFrame:
    """First form of every page that has one: action, method, fields, hidden_fields, csrf_field, csrf_token."""
    els = dom.elements(pages)
    tag, tok = F.col("tag"), F.col("tok")
    whole = W.partitionBy("page_id")
    ahead = W.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, W.currentRow)
    option = F.struct("pos", F.coalesce(attr(tok, "value"), F.lit("")).alias("value"))
    els = els.withColumns({
        "form": F.min(F.when(tag == "form", F.struct("pos", "stop", "tok"))).over(whole),
        "picked": F.last(F.when((tag == "option") & has_attr(tok, "selected"), option), ignorenulls=True).over(ahead),
    })
    inside = els.filter((F.col("pos") >= F.col("form.pos")) & (F.col("pos") < F.col("form.stop")))
    inside = inside.filter(tag.isin("form", "input", "select", "textarea"))
    rows = dom.with_page_text(inside, pages)
    value = (
        F.when(tag == "select", F.when(F.col("picked.pos") < F.col("stop"), F.col("picked.value")))
        .when(tag == "textarea", F.col("text"))
        .otherwise(attr(tok, "value"))
    )
    field = F.struct(
        "pos", attr(tok, "name").alias("name"), F.coalesce(value, F.lit("")).alias("value"),
        F.coalesce(attr(tok, "type"), F.lit("text")).alias("type"), has_attr(tok, "required").alias("required"),
    )
    named = (tag != "form") & (F.coalesce(attr(tok, "name"), F.lit("")) != "")
    hidden = named & (F.coalesce(attr(tok, "type"), F.lit("")) == "hidden")
    csrf_names = "|".join(n.lower().replace("-", "[-]") for n in CSRF_FIELDS)
    is_csrf = hidden & T.matches(F.lower(F.coalesce(attr(tok, "name"), F.lit(""))), csrf_names)
    grouped = rows.groupBy("page_id").agg(
        F.max(F.when(tag == "form", tok)).alias("form"),
        F.array_sort(F.collect_list(F.when(named & ~hidden, field))).alias("fields"),
        F.array_sort(F.collect_list(F.when(hidden, field))).alias("hidden_fields"),
        F.max(F.when(is_csrf, field)).alias("csrf"),
    )
    return grouped.select(
        "page_id", F.coalesce(attr(F.col("form"), "action"), F.lit("")).alias("action"),
        F.upper(F.coalesce(F.nullif(attr(F.col("form"), "method"), F.lit("")), F.lit("GET"))).alias("method"),
        "fields", "hidden_fields", F.col("csrf.name").alias("csrf_field"), F.col("csrf.value").alias("csrf_token"),
    )


def csrf_token(pages: DataFrame) -> DataFrame:
    """page_id, field, token: meta tags before inputs, each in the order of the name lists."""

    def named(pattern: str, value: str) -> Column:
        return F.transform(T.find_all(F.col("html"), pattern), lambda t: F.struct(
            F.coalesce(attr(t, "name"), F.lit("")).alias("name"), F.coalesce(attr(t, value), F.lit("")).alias("token")))

    rows = pages.select(
        "page_id", named(r"(?is)<meta\b[^>]*>", "content").alias("metas"), named(r"(?is)<input\b[^>]*>", "value").alias("inputs")
    )

    def meta(name: str) -> Column:
        return F.get(F.filter("metas", lambda e: e["name"] == name), 0)

    def field(name: str) -> Column:
        return F.get(F.filter("inputs", lambda e: F.contains(F.lower(e["name"]), F.lit(name.lower()))), 0)

    firsts = [meta(n) for n in CSRF_METAS] + [field(n) for n in CSRF_FIELDS]
    found = F.filter(F.array(*firsts), lambda e: F.coalesce(e["token"], F.lit("")) != "")
    # A generator, as a filter on the choice itself would be pushed down and read the page again for every name.
    best = rows.select("page_id", F.inline_outer(F.slice(found, 1, 1)))
    return best.filter("token is not null").select("page_id", F.col("name").alias("field"), "token")


def listing_cards(pages: DataFrame, card: str = CARD, fields: dict[str, str] = CARD_FIELDS) -> DataFrame:
    """page_id, pos, asin and one column per field: repeated cards that have a title or a price."""
    els = dom.with_selectors(dom.elements(pages), {"is_card": card, **{f"f_{n}": s for n, s in fields.items()}})
    is_card = F.col("is_card") & (F.coalesce(attr(F.col("tok"), "data-asin"), F.lit("")) != "")
    any_field = F.lit(False)
    for n in fields:
        any_field = any_field | F.col(f"f_{n}")
    # Read twice below; written once, the elements of a page are found once.
    els = els.filter(is_card | any_field).select("page_id", "pos", "stop", "raw0", "raw1", "tok", "is_card", *[f"f_{n}" for n in fields])
    els = cut_lineage(els)
    parts = dom.with_page_text(owners(els, is_card, any_field), pages)
    tok = F.col("tok")

    def value(name: str) -> Column:
        if name == "image":
            return F.nullif(attr(tok, "src"), F.lit(""))
        if name == "link":
            return F.nullif(attr(tok, "href"), F.lit(""))
        return T.js_trim(F.col("text"))

    found = parts.groupBy("page_id", F.col("owner").alias("pos")).agg(*[
        F.min(F.when(F.col(f"f_{n}"), F.struct("pos", value(n).alias("v")))).alias(n) for n in fields
    ])
    cards = els.filter(is_card).select("page_id", "pos", attr(tok, "data-asin").alias("asin"))
    out = cards.join(found, ["page_id", "pos"]).select("page_id", "pos", "asin", *[F.col(f"{n}.v").alias(n) for n in fields])
    return out.filter((F.coalesce("title", F.lit("")) != "") | (F.coalesce("price", F.lit("")) != ""))


def cards_text(cards: DataFrame) -> DataFrame:
    """page_id, text: the cards of a page as readable lines."""
    labels = {"asin": "ASIN", "title": "Title", "price": "Price", "original_price": "Original Price",
              "discount": "Discount", "rating": "Rating", "link": "URL"}
    numbered = cards.withColumn("n", F.row_number().over(W.partitionBy("page_id").orderBy("pos")))
    lines = [F.concat(F.lit("DEAL #"), F.col("n").cast("string"), F.lit("\n"))] + [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"  {label}: "), F.col(c), F.lit("\n"))).otherwise(F.lit(""))
        for c, label in labels.items()
    ] + [F.lit("\n")]
    entry = F.struct("n", F.concat(*lines).alias("t"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["t"]), "")
    return numbered.groupBy("page_id").agg(F.concat(F.lit("\n\n--- EXTRACTED DEALS ---\n\n"), listed).alias("text"))
