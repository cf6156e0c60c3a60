"""Pages as token and element tables.

The raw page rows are exchanged once on `page_id`, before tokenising; every later
window, join and regrouping on `page_id` then runs inside the partition.  Contents
of elements are ranges of prefix sums, so "text of an element", "number of
descendants" and "inside an ad" cost no join at all.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql.types import ArrayType, LongType

from webquarry.functions import patterns as P
from webquarry.functions.markup import AROUND, CHILD, EARLIER, INSIDE, LATER, NEXT, PARENT, Position, Step, attr, css
from webquarry.functions.text import decode_entities, find_all, js_trim, matches, sub
from webquarry.operators.skew import laid_out, parts_of

# Tags without content, and tags that end an open paragraph-like element.
VOID_TAGS = "area base br col embed frame hr img input link meta param source track wbr".split()
BLOCK_TAGS = "p div ul ol h1 h2 h3 h4 h5 h6 section article table footer header nav blockquote pre form hr".split()
INLINE_TAGS = "b i a em strong span u".split()
SIBLING_TAGS = "li td th tr option dt dd".split()
CONTAINER_TAGS = "ul ol table tbody thead tr select dl #end".split()
END = "</#end>"

# Running totals kept per token; the value before the token is stored.
TOTALS = ("src", "raw", "chars", "ink", "els", "cells", "trs")


def visible_source(html: Column) -> Column:
    """Page source without scripts, styles and comments."""
    return sub(html, P.HIDDEN)


def page_text(html: Column) -> Column:
    """All text of a page as written (entities not decoded): the string element ranges cut from."""
    return sub(visible_source(html), P.TAG)


def with_tokens(pages: DataFrame, partitioned: bool = False) -> DataFrame:
    """One row per token.  `partitioned=True` when `pages` is already laid out by page_id."""
    src = pages.select("page_id", "html")
    if not partitioned:
        src = laid_out(src, "page_id", parts_of(pages, "html"))
    parts = find_all(visible_source(F.col("html")), P.TOKEN)
    return src.select("page_id", F.posexplode(F.array_append(parts, F.lit(END))).alias("pos", "tok"))


def html_tokens(pages: DataFrame, partitioned: bool = False) -> DataFrame:
    """page_id, pos, tok, kind (text, open, close, void, other), tag, text."""
    tok = F.col("tok")
    named = with_tokens(pages, partitioned).withColumn(
        "tag", F.when(tok == END, "#end").otherwise(F.lower(F.regexp_extract(tok, P.TAG_NAME, 1)))
    )
    kind = (
        F.when(tok == END, "close")
        .when(~matches(tok, r"(?s)^<[a-zA-Z/!?].*>\z"), "text")
        .when(F.col("tag") == "", "other")
        .when(F.startswith(tok, F.lit("</")), "close")
        .when(F.col("tag").isin(VOID_TAGS), "void")
        .otherwise("open")
    )
    named = named.withColumn("kind", kind)
    return named.withColumn("text", F.when(F.col("kind") == "text", decode_entities(tok)))


def with_totals(tokens: DataFrame) -> DataFrame:
    """Prefix sums before each token: raw and decoded text length, inked chars, elements, cells."""
    w = W.partitionBy("page_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_el = F.col("kind").isin("open", "void")
    own = {
        "src": F.length("tok"),
        "raw": F.when(F.col("kind") == "text", F.length("tok")).otherwise(0),
        "chars": F.coalesce(F.length("text"), F.lit(0)),
        "ink": F.coalesce(F.length(sub(F.col("text"), P.WS)), F.lit(0)),
        "els": is_el.cast("int"),
        "cells": (is_el & F.col("tag").isin("td", "th")).cast("int"),
        "trs": (is_el & (F.col("tag") == "tr")).cast("int"),
    }
    sized = tokens.withColumns({f"{k}_own": v.cast("long") for k, v in own.items()})
    summed = sized.withColumns({k: F.sum(f"{k}_own").over(w) - F.col(f"{k}_own") for k in TOTALS})
    return summed.drop(*[f"{k}_own" for k in TOTALS])


def spans(tokens: DataFrame) -> DataFrame:
    """Tokens that carry totals, with the extent of the element each open tag starts.

    stop = first token behind the content; closed = has its own end tag; raw0/raw1
    and the other totals bound the content.  Unclosed elements end where HTML ends
    them: at the next sibling for list and table parts, at the page end for html and
    body, at the next block boundary otherwise.
    """
    tags = tokens
    here = F.struct(F.col("pos").alias("stop"), *[F.col(t).alias(f"{t}1") for t in TOTALS])
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    by_tag = W.partitionBy("page_id", "tag").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    levelled = tags.withColumns({
        "level": F.sum(step).over(by_tag) + F.when(F.col("kind") == "close", 1).otherwise(0),
        "twin": F.lead(F.when(F.col("kind") == "open", here)).over(W.partitionBy("page_id", "tag").orderBy("pos")),  # in the same sort
    })
    same_level = W.partitionBy("page_id", "tag", "level").orderBy("pos")
    paired = levelled.withColumn("mate", F.lead(F.when(F.col("kind") == "close", here)).over(same_level))
    boundary = (F.col("kind").isin("open", "void") & F.col("tag").isin(BLOCK_TAGS)) | (
        (F.col("kind") == "close") & ~F.col("tag").isin(INLINE_TAGS)
    )
    container = (F.col("kind") == "close") & F.col("tag").isin(CONTAINER_TAGS)
    ahead = W.partitionBy("page_id").orderBy(F.desc("pos")).rowsBetween(W.unboundedPreceding, -1)
    bounded = paired.withColumns({
        "next_block": F.last(F.when(boundary, here), ignorenulls=True).over(ahead),
        "next_container": F.last(F.when(container, here), ignorenulls=True).over(ahead),
        "page_end": F.first(here).over(ahead),
    })
    sibling_stop = F.when(
        F.col("twin").isNotNull() & (F.col("twin.stop") < F.col("next_container.stop")), F.col("twin")
    ).otherwise(F.col("next_container"))
    stop = (
        F.when(F.col("kind") == "void", here)
        .when(F.col("mate").isNotNull(), F.col("mate"))
        .when(F.col("tag").isin("html", "body"), F.col("page_end"))
        .when(F.col("tag").isin(SIBLING_TAGS), sibling_stop)
        .otherwise(F.col("next_block"))
    )
    is_el = F.col("kind").isin("open", "void")
    kept = [c for c in ("text",) if c in tokens.columns]
    return (
        bounded.select(
            "page_id", "pos", "tag", "kind", "tok", *kept,
            (F.col("mate").isNotNull() & (F.col("kind") == "open")).alias("closed"),
            *[F.col(t).alias(f"{t}0") for t in TOTALS],
            F.when(is_el, stop).alias("s"),
        )
        .select("*", "s.*")
        .drop("s")
        .withColumns({
            "src0": F.col("src0") + F.length("tok"),
            "src1": F.greatest(F.col("src1"), F.col("src0") + F.length("tok")),
            "els0": F.col("els0") + is_el.cast("int"),
            "els1": F.greatest(F.col("els1"), F.col("els0") + is_el.cast("int")),
            "cells0": F.col("cells0") + F.col("tag").isin("td", "th").cast("int"),
            "last": F.when(F.col("kind") == "void", F.col("pos"))
            .when(F.col("closed"), F.col("stop"))
            .otherwise(F.col("stop") - 1),
        })
    )


def elements(pages: DataFrame, partitioned: bool = False) -> DataFrame:
    """Element rows only; text never travels past the first window."""
    tokens = with_totals(html_tokens(pages, partitioned))
    tags = tokens.filter(F.col("kind").isin("open", "close", "void")).drop("text")
    return spans(tags).filter(F.col("kind") != "close")


def content_length() -> Column:
    """Decoded text length of an element row."""
    return F.col("chars1") - F.col("chars0")


def content_text(full_text: Column) -> Column:
    """Decoded text of an element row, cut from the page text."""
    cut = full_text.substr((F.col("raw0") + 1).cast("int"), (F.col("raw1") - F.col("raw0")).cast("int"))
    return decode_entities(cut)


def with_page_text(els: DataFrame, pages: DataFrame, partitioned: bool = False) -> DataFrame:
    """Adds `text`.  A N:1 join on the page key; pages are exchanged the same way as for the tokens."""
    texts = pages.select("page_id", "html")
    if not partitioned:
        texts = laid_out(texts, "page_id", parts_of(pages, "html"))
    texts = texts.select("page_id", page_text(F.col("html")).alias("page_text"))
    return els.join(texts, "page_id").withColumn("text", content_text(F.col("page_text"))).drop("page_text")


@F.arrow_udf(ArrayType(LongType()))
def _enclosing(pos: pa.Array, last: pa.Array) -> pa.Array:
    """For the elements of a page in order: the place of the innermost earlier one that reaches over them, null for none."""
    starts, ends, cuts = np.asarray(pos.flatten()).tolist(), np.asarray(last.flatten()).tolist(), pos.value_lengths().to_pylist()
    out: list[int | None] = []
    at = 0
    for n in cuts:
        open_: list[int] = []
        for i in range(at, at + n):
            while open_ and ends[open_[-1]] < starts[i]:
                open_.pop()
            out.append(starts[open_[-1]] if open_ else None)
            open_.append(i)
        at += n
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *cuts]), pa.int32()), pa.array(out, pa.int64()))


def with_parents(els: DataFrame, parts: int | None = None) -> DataFrame:
    """Adds `parent`, the place of the innermost element around each, null at the top.

    Extents of broken pages may cross, so the parent is the latest element that is still open.  A page's elements become one
    row for that, where they already are; behind the Python step Spark no longer knows their layout, so they are exchanged
    once more on page_id, for all windows that follow, in as many `parts` as the pages.
    """
    rest = [c for c in els.columns if c not in ("page_id", "pos")]
    pages = els.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[F.col(f"`{c}`") for c in rest]))).alias("e"))
    up = _enclosing(F.transform("e", lambda x: x["pos"].cast("long")), F.transform("e", lambda x: x["last"].cast("long")))
    rows = pages.withColumn("p", up).select("page_id", F.inline(F.arrays_zip("e", "p")))
    return laid_out(rows.select("page_id", "e.*", F.col("p").alias("parent")), "page_id", parts)


def siblings() -> WindowSpec:
    return W.partitionBy("page_id", "parent")


def with_places(els: DataFrame, kinds: set[str]) -> DataFrame:
    """Adds the place among all siblings (child_nth, child_last from the end) or among those of the same name (type_nth, type_last)."""
    by = {"child": siblings(), "type": W.partitionBy("page_id", "parent", "tag")}
    return els.withColumns({
        f"{k}_{way}": F.row_number().over(by[k].orderBy("pos" if way == "nth" else F.desc("pos"))) for k in sorted(kinds) for way in ("nth", "last")
    })


def _related(els: DataFrame, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """Adds a column per (link, flag column, name): does the element stand in that relation to a flagged one?"""
    page = W.partitionBy("page_id").orderBy("pos")
    above, below = page.rowsBetween(W.unboundedPreceding, -1), page.rowsBetween(1, W.unboundedFollowing)
    sides = siblings().orderBy("pos")
    by_link = {
        INSIDE: lambda f: F.max(F.when(f, F.col("last"))).over(above) >= F.col("pos"),
        AROUND: lambda f: F.min(F.when(f, F.col("pos"))).over(below) <= F.col("last"),
        NEXT: lambda f: F.lag(f).over(sides),
        LATER: lambda f: F.max(f).over(sides.rowsBetween(W.unboundedPreceding, -1)),
        EARLIER: lambda f: F.max(f).over(sides.rowsBetween(1, W.unboundedFollowing)),
    }
    plain = {name: F.coalesce(by_link[link](F.col(flag)), F.lit(False)) for link, flag, name in wanted if link in by_link}
    out = els.withColumns(plain) if plain else els
    # Parents and children meet in the group of the parent's place, where the parent stands as 0 and every child as 1.
    for side, link in ((1, CHILD), (0, PARENT)):
        asked = [(flag, name) for l, flag, name in wanted if l == link]
        if asked:
            both = out.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("family", F.when(F.col("side") == 0, F.col("pos")).otherwise(F.col("parent")))
            family = W.partitionBy("page_id", "family")
            both = both.withColumns({name: F.coalesce(F.max(F.when(F.col("side") == 1 - side, F.col(flag))).over(family), F.lit(False)) for flag, name in asked})
            out = both.filter(F.col("side") == side).drop("side", "family")
    return out


def with_selectors(els: DataFrame, selectors: Mapping[str, str | tuple[Step, ...]], parts: int | None = None) -> DataFrame:
    """Adds one boolean column per selector (text, or steps of a path).

    Each attribute is read from the tag once, however many selectors ask for it.  Steps are decided from the left to the
    right, those with as many steps before them together: an element lies inside an earlier one that passes when the furthest end of
    those passing so far is behind it; relations between parents, children and siblings are windows over the page's rows.  Only
    selectors that ask for such relations pay for the parents.
    """
    compiled = {name: css(s) if isinstance(s, str) else s for name, s in selectors.items()}
    tops = [top for alternatives in compiled.values() for top in alternatives]
    steps = list(dict.fromkeys(s for top in tops for s in top.chain()))
    names = sorted(set().union(*(s.names() for s in steps)))
    is_el = F.col("kind").isin("open", "void")
    out = els.withColumns({f"@{n}": F.when(is_el, attr(F.col("tok"), n, decode=False)) for n in names})
    places: dict[tuple[Step, int], tuple[Column, Column]] = {}
    extra = []
    if any(s.structural() for s in steps):
        out = with_parents(out, parts)
        kinds = {t.of for s in steps for t in s.tests if isinstance(t, Position) and t.of != "match"}
        out = with_places(out, kinds)
        extra = ["parent", *[f"{k}_{way}" for k in kinds for way in ("nth", "last")]]
        for s in steps:
            for i, t in enumerate(s.tests):
                if isinstance(t, Position) and t.of == "match":  # counted among the siblings that the tests before it leave
                    n, z = f"place_{len(places)}", f"places_{len(places)}"
                    left = F.coalesce(is_el & s.local(places, i), F.lit(False)).cast("int")
                    out = out.withColumn("left", left).withColumns({
                        n: F.sum("left").over(siblings().orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)), z: F.sum("left").over(siblings()),
                    }).drop("left")
                    places[s, i] = F.col(n), F.col(z) - F.col(n) + 1
                    extra += [n, z]
    inner = list(dict.fromkeys(s.within for s in steps if s.within))
    links = {(s.within, s.link): f"^{i}" for i, s in enumerate(dict.fromkeys(s for s in steps if s.within))}

    def test(s: Step) -> Column:
        return is_el & s.local(places) & (F.col(links[s.within, s.link]) if s.within else F.lit(True))

    for depth in range(1, max((len(s.chain()) for s in inner), default=0) + 1):
        here = [s for s in inner if len(s.chain()) == depth]
        flags = {s: f"?{inner.index(s)}" for s in here}
        out = out.withColumns({flag: F.coalesce(test(s), F.lit(False)) for s, flag in flags.items()})
        out = _related(out, [(link, flags[s], name) for (s, link), name in links.items() if s in flags]).drop(*flags.values())

    def hit(alternatives: tuple[Step, ...]) -> Column:
        found = F.lit(False)
        for top in alternatives:
            found = found | F.coalesce(test(top), F.lit(False))
        return found

    out = out.withColumns({name: hit(alternatives) for name, alternatives in compiled.items()})
    return out.drop(*[f"@{n}" for n in names], *links.values(), *extra)


def select_elements(
    pages: DataFrame, selectors: Mapping[str, tuple[str | tuple[Step, ...], str | None]], els: DataFrame | None = None
) -> DataFrame:
    """name -> (selector or steps, attribute or None) evaluated together over one element table.

    Returns page_id, name, pos, value: the attribute, or the trimmed text; empty
    values are dropped.
    """
    if els is None:  # what selectors do not read is not computed, and not carried where pages become one row
        els = elements(pages).select("page_id", "pos", "tag", "kind", "tok", "last", "raw0", "raw1", "els0", "els1")
    hits = with_selectors(els, {f"hit_{i}": sel for i, (sel, _) in enumerate(selectors.values())}, parts_of(pages, "html"))
    wanted = F.array_compact(F.array(*[
        F.when(
            F.col(f"hit_{i}"),
            F.struct(
                F.lit(name).alias("name"),
                (attr(F.col("tok"), attribute) if attribute else F.lit(None).cast("string")).alias("attr_value"),
                F.lit(attribute is None).alias("wants_text"),
            ),
        )
        for i, (name, (_, attribute)) in enumerate(selectors.items())
    ]))
    rows = hits.select("page_id", "pos", "raw0", "raw1", F.explode(wanted).alias("h"))
    rows = rows.select("page_id", "pos", "raw0", "raw1", "h.*")
    if any(attribute is None for _, attribute in selectors.values()):
        rows = with_page_text(rows, pages)
        value = F.when(F.col("wants_text"), js_trim(F.col("text"))).otherwise(F.col("attr_value"))
    else:
        value = F.col("attr_value")
    out = rows.select("page_id", "name", "pos", value.alias("value"))
    return out.filter(F.coalesce(F.col("value"), F.lit("")) != "")
