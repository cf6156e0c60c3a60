"""URL building blocks.

Single-value helpers are Columns; resolving and normalising adds columns step by
step on a DataFrame so every intermediate part is computed once per row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import patterns as P
from webquarry.functions.text import collapse, find_all, matches, sub

URL = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
BAD_HOST = r"[\s<>%\[\]\\^|]"

# File endings and path parts that never hold page content.
BLOCKED_EXTENSIONS = ".pdf .zip .jpg .jpeg .png .gif .svg .css .js .xml".split()
BLOCKED_PATHS = "/api/ /ajax/ /json/ /xml/ /rss/ /feed/".split()
DEFAULT_BLOCKED_PATTERNS = (
    "/api/", "/ajax/", "/json/", "/xml/", "/rss/", "/feed/", r"\.pdf$", r"\.zip$", r"\.(jpg|jpeg|png|gif|svg)$",
)
# Addresses of ads and trackers.
TRACKER_PATTERNS = (
    r"google-analytics\.com", r"googletagmanager\.com", r"facebook\.net", r"twitter\.com/i/",
    r"doubleclick\.net", r"ads\.", r"analytics\.", r"tracking\.",
)
# Words that raise or lower the priority of a link.
CONTENT_WORDS = "read more view details article post page".split()
ACCOUNT_WORDS = "login signup register logout cart checkout".split()


@dataclass(frozen=True)
class CrawlConfig:
    """Limits and filters of a crawl."""

    max_depth: int = 3
    max_pages: int | None = None
    follow_external: bool = False
    allowed_domains: tuple[str, ...] = ()
    blocked_patterns: tuple[str, ...] = field(default=DEFAULT_BLOCKED_PATTERNS)


def url_domain(url: Column) -> Column:
    """Lower-case host without `www.`; '' when there is none."""
    return F.coalesce(
        F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]*)", 1), F.lit("")
    )


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, URL, 3)


def is_absolute(url: Column) -> Column:
    return matches(url, r"^https?://")


def is_parsable(url: Column) -> Column:
    """Stands alone as a URL: a scheme, and for web schemes a proper host and port."""
    authority = F.regexp_extract(url, URL, 2)
    web = matches(url, r"(?i)^(https?|ftp|wss?):")
    host_ok = (authority != "") & ~matches(authority, BAD_HOST) & matches(authority, r"^(?:[^@]*@)?[^:@]+(?::[0-9]{0,5})?$")
    return F.coalesce(matches(url, URL) & (~web | host_ok), F.lit(False))


def is_valid_url(url: Column) -> Column:
    """Parses alone, or as a relative reference, which only a broken absolute URL fails to do."""
    return F.coalesce(is_parsable(url) | ~matches(url, r"(?i)^([a-z][a-z0-9+.\-]*:|//[^/?#]*[\s<>%\[\]\\^|]|//(?:[/?#]|$))"), F.lit(False))


def is_same_domain(a: Column, b: Column) -> Column:
    return url_domain(a) == url_domain(b)


def is_external(a: Column, b: Column) -> Column:
    return ~is_same_domain(a, b)


def _without_dots(path: Column) -> Column:
    """`/a/./b/../c` -> `/a/c`, only where dot segments occur."""
    segments = F.split(path, F.lit("/"))
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.array_append(acc, s)),
    )
    ends_open = matches(path, r"/\.{1,2}$")
    joined = F.concat(F.array_join(folded, "/"), F.when(ends_open, F.lit("/")).otherwise(F.lit("")))
    rooted = F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))
    return F.when(matches(path, r"/\.{1,2}(/|$)"), rooted).otherwise(path)


def _percent_encode(path: Column) -> Column:
    """Characters outside printable ASCII, and the few printable ones not allowed in paths."""
    runs = F.transform(
        find_all(path, r"[\x21-\x7E]+|[^\x21-\x7E]+"),
        lambda r: F.when(matches(r, r"^[\x21-\x7E]"), r).otherwise(F.replace(F.url_encode(r), F.lit("+"), F.lit("%20"))),
    )
    out = F.when(matches(path, r"[^\x21-\x7E]"), F.array_join(runs, "")).otherwise(path)
    for char, code in [('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"), ("{", "%7B"), ("}", "%7D")]:
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def _sorted_query(query: Column) -> Column:
    """Form-encoded parameters ordered by name; equal names keep their order."""

    def form(value: Column) -> Column:
        return F.url_encode(F.coalesce(F.try_url_decode(value), value))

    params = F.filter(F.split(query, F.lit("&")), lambda p: p != "")
    keyed = F.transform(
        params,
        lambda p, i: F.struct(
            F.lower(F.regexp_extract(p, r"^([^=]*)", 1)).alias("name"),
            (F.regexp_extract(p, r"^([^=]*)", 1) != F.lower(F.regexp_extract(p, r"^([^=]*)", 1))).alias("upper"),
            i.alias("i"),
            F.concat(form(F.regexp_extract(p, r"^([^=]*)", 1)), F.lit("="), form(sub(p, r"^[^=]*=?"))).alias("pair"),
        ),
    )
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["pair"]), "&")


def _joined(url: Column, base: Column) -> Column:
    """A reference put onto its base, dot segments still in place."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*(/[^?#]*/|/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(matches(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), url)
        .when(F.startswith(url, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*:)", 1), url))
        .when(F.startswith(url, F.lit("/")), F.concat(origin, url))
        .when(F.startswith(url, F.lit("?")), F.concat(sub(base, r"[?#].*$"), url))
        .when(F.startswith(url, F.lit("#")), F.concat(sub(base, r"#.*$"), url))
        .when(url == "", sub(base, r"#.*$"))
        .otherwise(F.concat(origin, folder, url))
    )


def resolve_url(url: Column, base: Column) -> Column:
    """Absolute web addresses stay; anything else is put onto the base."""
    trimmed = F.trim(url)
    return F.when(is_absolute(url), url).otherwise(_percent_encode(_tidy(_joined(trimmed, base))))


def with_resolved(df: DataFrame, url: Column, out: str, base: Column) -> DataFrame:
    """Adds `out`: `resolve_url` computed step by step."""
    kept = [c for c in df.columns if c != out]
    df = df.withColumn("__abs", _joined(F.trim(url), base))
    df = df.withColumn("__abs", _tidy(F.col("__abs")))
    value = F.when(is_absolute(url), url).otherwise(_percent_encode(F.col("__abs")))
    return df.select(*kept, F.explode(F.array(value)).alias(out))


def _tidy(url: Column) -> Column:
    """Dot segments of an absolute web URL folded, an empty path made '/'."""
    head = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1))
    head = sub(sub(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    tail = F.regexp_extract(url, r"([?#].*)$", 1)
    path = url_path(url)
    path = F.when(path == "", F.lit("/")).otherwise(_without_dots(path))
    return F.when(head == "", url).otherwise(F.concat(head, path, tail))


def with_normalized(df: DataFrame, url: Column, out: str, base: Column | None = None) -> DataFrame:
    """Adds `out`: fragment dropped, query sorted, one trailing '/' dropped, host lower-cased,
    default port dropped, path percent-encoded.  What does not parse is kept as it is.
    """
    t = "__u_"
    absolute = url if base is None else F.when(is_absolute(url), url).otherwise(_joined(F.trim(url), base))
    df = df.withColumn(f"{t}abs", absolute)
    u = F.col(f"{t}abs")
    df = df.withColumns({
        f"{t}ok": is_parsable(u),
        f"{t}scheme": F.lower(F.regexp_extract(u, URL, 1)),
        f"{t}auth": F.regexp_extract(u, URL, 2),
        f"{t}path": F.regexp_extract(u, URL, 3),
        f"{t}query": F.regexp_extract(u, URL, 4),
    })
    auth, path, query, scheme = (F.col(f"{t}{k}") for k in ("auth", "path", "query", "scheme"))
    host = F.lower(F.regexp_extract(auth, r"^(?:[^@]*@)?([^@]*)$", 1))
    df = df.withColumns({
        f"{t}host": F.when(scheme == "http", sub(host, r":80$"))
        .when(scheme == "https", sub(host, r":443$"))
        .otherwise(host),
        f"{t}user": F.regexp_extract(auth, r"^([^@]*@)", 1),
        f"{t}path": F.when(path == "", F.lit("/")).otherwise(_percent_encode(_without_dots(path))),
        f"{t}query": F.when(query == "", F.lit("")).otherwise(_sorted_query(query)),
    })
    path = F.when(F.length(path) > 1, sub(path, r"/$")).otherwise(path)
    web = F.concat(
        scheme, F.lit("://"), F.col(f"{t}user"), F.col(f"{t}host"), path,
        F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
    )
    norm = F.when(~F.col(f"{t}ok"), url).when(auth == "", sub(u, r"#.*$")).otherwise(web)
    # Exploding a one-element array keeps later filters on the result above this step;
    # pushed below it they would repeat the whole normalisation once per mention.
    kept = [c for c in df.columns if not c.startswith(t) and c != out]
    return df.select(*kept, F.explode(F.array(norm)).alias(out))


def should_follow(norm: Column, base: Column, config: CrawlConfig = CrawlConfig()) -> Column:
    """Filter on an already normalised URL.

    The external check comes before the allow list, so with follow_external=False an
    allow-listed foreign domain is still refused.
    """
    domain, same = url_domain(norm), is_same_domain(norm, base)
    path = F.lower(url_path(norm))
    keep = is_parsable(norm)
    if config.blocked_patterns:
        keep = keep & ~matches(norm, "|".join(f"(?:{p})" for p in config.blocked_patterns))
    if not config.follow_external:
        keep = keep & same
    if config.allowed_domains:
        allowed = F.lit(False)
        for d in config.allowed_domains:
            allowed = allowed | (domain == d) | F.endswith(domain, F.lit(f".{d}"))
        keep = keep & allowed
    else:
        keep = keep & same
    keep = keep & ~matches(path, "(?:" + "|".join(e.replace(".", r"\.") for e in BLOCKED_EXTENSIONS) + ")$")
    keep = keep & ~matches(path, "|".join(BLOCKED_PATHS))
    return F.coalesce(keep, F.lit(False))


def link_priority(text: Column, title: Column, href: Column) -> Column:
    words = F.lower(F.concat(text, F.lit(" "), title))
    return (
        ((F.length(text) > 5) & (F.length(text) < 100)).cast("int")
        + matches(words, "|".join(CONTENT_WORDS)).cast("int") * 2
        - matches(words, "|".join(ACCOUNT_WORDS)).cast("int") * 2
        + matches(href, r"[0-9]").cast("int")
    )


def task_words(task: Column) -> Column:
    """Lower-case words of more than three characters, in order, repeats kept."""
    return F.filter(F.split(F.lower(collapse(task)), F.lit(" ")), lambda w: F.length(w) > 3)


def task_relevance(url: Column, words: Column) -> Column:
    """+2 when a URL token contains a task word or is contained in it, +1 when the URL contains it."""
    low = F.lower(url)
    tokens = F.filter(F.split(low, F.lit(r"[/\-_.]")), lambda w: F.length(w) > 2)
    per_word = F.transform(
        words,
        lambda w: F.exists(tokens, lambda t: F.contains(t, w) | F.contains(w, t)).cast("int") * 2
        + F.contains(low, w).cast("int"),
    )
    return F.aggregate(per_word, F.lit(0), lambda acc, x: acc + x)


def is_tracker(url: Column) -> Column:
    return matches(url, "|".join(TRACKER_PATTERNS))
