"""Which fetch result to keep, which tiers to try, how attempts went, what failed and when to retry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.functions import text as T
from webquarry.operators.skew import micros


@dataclass(frozen=True)
class Tier:
    """One step of a policy and what its result must fulfil."""

    name: str
    min_quality: float = 0.0
    needs_valid: bool = False
    needs_sufficient: bool = False


# The built-in tier orders and their acceptance tests.
DEFAULT_POLICIES = {
    "speed": (Tier("http", needs_valid=True, needs_sufficient=True), Tier("smart"), Tier("browser")),
    "cost": (
        Tier("http", needs_valid=True, needs_sufficient=True), Tier("cheerio", needs_valid=True, needs_sufficient=True),
        Tier("jina", needs_sufficient=True), Tier("browser"),
    ),
    "quality": (Tier("smart", min_quality=0.7), Tier("jina", min_quality=0.6), Tier("http")),
}
BROWSER_FIRST, HTTP_FIRST = ("playwright", "jina", "http"), ("http", "jina", "playwright")
# URL parts that decide the tier order, first hit wins.
ROUTE_PATTERNS = (
    ("spa", BROWSER_FIRST), ("react", BROWSER_FIRST), ("vue", BROWSER_FIRST), ("angular", BROWSER_FIRST),
    ("blog", HTTP_FIRST), ("article", HTTP_FIRST), ("news", HTTP_FIRST),
    ("amazon.com", BROWSER_FIRST), ("amazon.", BROWSER_FIRST), ("shop", BROWSER_FIRST), ("store", BROWSER_FIRST),
    ("product", BROWSER_FIRST), ("deal", BROWSER_FIRST), ("goldbox", BROWSER_FIRST),
)


class Policies:
    """Named tier orders; users register their own."""

    def __init__(self):
        self._known = dict(DEFAULT_POLICIES)

    def register(self, name: str, tiers: tuple[Tier, ...]) -> None:
        self._known[name] = tuple(tiers)

    def get(self, name: str) -> tuple[Tier, ...]:
        return self._known[name]

    def names(self) -> list[str]:
        return list(self._known)


def cascade_select(attempts: DataFrame, tiers: tuple[Tier, ...]) -> DataFrame:
    """item_id, tier, rank, quality, duration_ms, tried, status: the first acceptable result in tier order.

    `attempts`: item_id, tier, success, valid, sufficient, quality, duration_ms, ts.
    One aggregate: the best attempt is a minimum, so an item with very many attempts
    is combined before the shuffle.  Items without an acceptable attempt stay, as failed.
    """
    rank, accepted = F.lit(None).cast("int"), F.lit(False)
    for i, t in enumerate(tiers):
        own = F.col("tier") == t.name
        rank = F.when(own, F.lit(i)).otherwise(rank)
        ok = F.col("success") & (F.col("quality") >= t.min_quality)
        ok = ok & F.col("valid") if t.needs_valid else ok
        ok = ok & F.col("sufficient") if t.needs_sufficient else ok
        accepted = F.when(own, ok).otherwise(accepted)
    rows = attempts.withColumns({"rank": rank, "ok": accepted})
    best = F.min(F.when(F.col("ok"), F.struct("rank", "ts", "tier", "quality", "duration_ms")))
    out = rows.groupBy("item_id").agg(best.alias("b"), F.count_if(F.col("rank").isNotNull()).alias("tried"))
    return out.select(
        "item_id", "b.tier", F.col("b.rank").cast("long").alias("rank"), "b.quality", "b.duration_ms", "tried",
        F.when(F.col("b").isNull(), F.lit("failed")).otherwise(F.lit("selected")).alias("status"),
    )


def route_by_pattern(url: Column, patterns=ROUTE_PATTERNS) -> Column:
    """Tier order of a URL as an array.  The short pattern list is part of the plan; no join."""
    low = F.lower(url)

    def order(names) -> Column:
        return F.array(*[F.lit(n) for n in names])

    out = F.when(F.contains(low, F.lit(patterns[0][0])), order(patterns[0][1]))
    for part, names in patterns[1:]:
        out = out.when(F.contains(low, F.lit(part)), order(names))
    spa = F.contains(low, F.lit("/#/")) | F.contains(low, F.lit("/#!/")) | (
        F.contains(low, F.lit("?")) & F.contains(low, F.lit("_escaped_fragment_"))
    )
    return out.when(spa, order(BROWSER_FIRST)).otherwise(order(HTTP_FIRST))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """strategy, tier, runs, success_rate, avg_ms, with subtotals (null = all)."""
    return attempts.rollup("strategy", "tier").agg(
        F.count("*").alias("runs"), F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("duration_ms").alias("avg_ms")
    )


def request_intent(text: Column) -> dict[str, Column]:
    """url, question, refresh, deep: what a free-text request asks for."""
    word = r"[a-zA-Z0-9_]"
    # Words that ask for a fresh fetch or a deep crawl.
    refresh_words = r"refresh|rescrape|force|new\s*scrape"
    deep_words = r"all\s*details|explore|deep\s*scrape|click|visit\s*all|follow\s*links|learn\s*more|ai\s*agent"
    refresh_at = rf"(?i)(?<!{word})(?:{refresh_words})(?!{word})"
    refresh = T.matches(text, refresh_at)
    found = F.regexp_extract(text, rf"(?is)\A(.*?){refresh_at[4:]}(.*)\z", 1)
    after = F.regexp_extract(text, rf"(?is)\A(.*?){refresh_at[4:]}(.*)\z", 2)
    rest = T.js_trim(F.when(refresh, F.concat(found, after)).otherwise(text))
    url = F.nullif(F.regexp_extract(rest, r"(?i)(https?://[^\s]+)", 1), F.lit(""))
    # Only the first occurrence of the address is taken out.
    at = F.instr(rest, url)
    cut = F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + F.length(url), F.length(rest)))
    return {
        "url": url, "question": T.js_trim(F.when(url.isNull(), rest).otherwise(cut)), "refresh": refresh,
        "deep": T.matches(rest, rf"(?i)(?<!{word})(?:{deep_words})(?!{word})"),
    }


# ---- errors and retries -------------------------------------------------------------------

# Error class -> (retryable, milliseconds to wait).
ERROR_CLASSES = {
    "TIMEOUT": (True, 5000), "NETWORK_ERROR": (True, 3000), "RATE_LIMITED": (True, 60000), "BLOCKED": (False, None),
    "AUTH_REQUIRED": (False, None), "NOT_FOUND": (False, None), "SERVER_ERROR": (True, 10000), "CAPTCHA": (False, None),
    "PARSE_ERROR": (False, None), "UNKNOWN": (True, 5000),
}


def error_class(message: Column, status: Column) -> Column:
    """Class of a failure from its message and HTTP status; the order of the tests matters."""
    def any_of(*parts: str) -> Column:
        return T.matches(message, "|".join(parts))

    code = F.coalesce(status, F.lit(0))
    return (
        F.when(any_of("timeout", "ETIMEDOUT", "ESOCKETTIMEDOUT"), "TIMEOUT")
        .when(any_of("ECONNREFUSED", "ECONNRESET", "ENOTFOUND", "EAI_AGAIN", "network"), "NETWORK_ERROR")
        .when(code == 429, "RATE_LIMITED")
        .when(code.isin(401, 403) & any_of("captcha", "blocked", "banned"), "BLOCKED")
        .when(code.isin(401, 403), "AUTH_REQUIRED")
        .when(code == 404, "NOT_FOUND")
        .when(code >= 500, "SERVER_ERROR")
        .when(any_of("captcha", "challenge"), "CAPTCHA")
        .when(any_of("blocked", "banned", "denied", "cloudflare", "incapsula", "incident id", "imperva"), "BLOCKED")
        .when(any_of("parse", "JSON", "syntax"), "PARSE_ERROR")
        .otherwise("UNKNOWN")
    )


def is_retryable(kind: Column) -> Column:
    return kind.isin([k for k, (again, _) in ERROR_CLASSES.items() if again])


def retry_after(kind: Column) -> Column:
    waits = [x for k, (_, ms) in ERROR_CLASSES.items() if ms for x in (F.lit(k), F.lit(ms))]
    return F.try_element_at(F.create_map(*waits), kind)


def retry_delay(kind: Column, attempt: Column, max_retries: int = 3, base_ms: int = 1000, jitter: Column | None = None) -> Column:
    """Milliseconds before the next try, null when there is none: the class's own wait, else doubled per attempt, 60 s at most."""
    backoff = F.lit(base_ms) * F.pow(F.lit(2.0), attempt) + (F.lit(0) if jitter is None else jitter)
    wait = F.coalesce(retry_after(kind).cast("double"), F.least(backoff, F.lit(60000.0)))
    return F.when((attempt < max_retries) & is_retryable(kind), wait)


def simple_delay(message: Column, attempt: Column, max_retries: int = 3, base_ms: int = 1000) -> Column:
    """The plain variant: doubled per attempt, none after a 403 or 404 or the last try."""
    return F.when(~T.matches(message, "404|403") & (attempt < max_retries - 1), F.lit(base_ms) * F.pow(F.lit(2.0), attempt))


def fetch_stats(fetches: DataFrame) -> DataFrame:
    """One row of run statistics from success, retries, duration_ms, ts."""
    ok = F.col("success")
    minutes = (micros(F.max("ts")) - micros(F.min("ts"))) / 60e6
    return fetches.agg(
        F.count_if(ok).alias("finished"), F.count_if(~ok).alias("failed"), F.sum("retries").cast("long").alias("retries"),
        F.min(F.when(ok, F.col("duration_ms"))).alias("min_ms"), F.max(F.when(ok, F.col("duration_ms"))).alias("max_ms"),
        F.avg(F.when(ok, F.col("duration_ms"))).alias("avg_finished_ms"), F.avg(F.when(~ok, F.col("duration_ms"))).alias("avg_failed_ms"),
        (F.count_if(ok) / minutes).alias("finished_per_minute"), (F.count_if(~ok) / minutes).alias("failed_per_minute"),
    )


def fetch_histograms(fetches: DataFrame) -> DataFrame:
    """kind, value, fetches: counts per status code and per number of retries, in one pass."""
    pair = F.array(
        F.struct(F.lit("status").alias("kind"), F.col("status").cast("long").alias("value")),
        F.struct(F.lit("retries").alias("kind"), F.col("retries").cast("long").alias("value")),
    )
    return fetches.select(F.explode(pair).alias("p")).groupBy("p.kind", "p.value").agg(F.count("*").alias("fetches"))
