"""Named value transforms for extraction rules.  A transform that fails gives null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions import text as T
from webquarry.functions import urls as U
from webquarry.functions.text import js_trim, sub

EMAIL = r"[\w.-]+@[\w.-]+\.\w+"
PHONE = r"(\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
DATE_FORMATS = (
    "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "M/d/yyyy", "yyyy/M/d", "MMM d, yyyy", "MMMM d, yyyy",
    "d MMM yyyy", "d MMMM yyyy",
)

_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
_MONTH = rf"(?<![a-z])({'|'.join(_MONTHS)})[a-z]*"
_TIME = r"(?<!\d)(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d+))?)?(?![\d:])"
_ZONES = {"est": -5, "edt": -4, "cst": -6, "cdt": -5, "mst": -7, "mdt": -6, "pst": -8, "pdt": -7}
_UTC = r"(?:utc?|gmt|z)"
_OFFSET = rf"(@\s*(?:[ap]m(?![a-z]))?\s*{_UTC}?|(?<![a-z]){_UTC})\s*([+-])(\d{{1,2}}(?!\d)|\d{{3,4}}(?!\d))(?::(\d{{2}}))?"


def first_match(value: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(value, pattern, 0), F.lit(""))


def parse_number(value: Column) -> Column:
    digits = sub(value, r"[^0-9.-]")
    return first_match(digits, r"^-?(?:\d+\.?\d*|\.\d+)").try_cast("double")


def number_text(value: Column) -> Column:
    """A number as scripts print it: no trailing '.0'."""
    whole = (value == F.floor(value)) & (F.abs(value) < 1e15)
    return F.when(whole, value.try_cast("bigint").cast("string")).otherwise(value.cast("string"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def script_date(value: Column) -> Column:
    """What scripts read from a date that is not ISO: up to three numbers, a month's name, a time, a zone in any order; UTC without a zone.

    A month's name makes the numbers day and year, else they are month, day, year, or year, month, day where the first is no day; what is
    missing counts 1, years below 100 are of 1950 to 2049.  Words before the first number and text in brackets say nothing, later ones make it null.
    """
    whole = lambda c: F.coalesce(F.nullif(c, F.lit("")).try_cast("int"), F.lit(0))
    names = "|".join(_ZONES)

    def parts(low: Column, marked: Column, bare: Column) -> Column:
        """The numbers of the date, the minutes of the zone, the fields of the time."""
        timed = F.contains(marked, F.lit("@"))
        rest = sub(bare, rf"{_MONTH}|(?<![a-z])(?:{names}|{_UTC})(?![a-z])", " ")
        rest = F.when(timed, sub(rest, r"(?<![a-z])[ap]m(?![a-z])", " ")).otherwise(rest)
        zone = F.regexp_extract(bare, rf"(?<![a-z])({names})(?![a-z])", 1)
        hours = F.coalesce(*[F.when(zone == name, h) for name, h in _ZONES.items()])
        sound = ~F.contains(low, F.lit("@")) & ~T.matches(marked, r"(?s)@.*@|:") & ~T.matches(rest, r"(?s)[\d@].*[a-z]")
        return F.struct(
            F.regexp_extract_all(rest, F.lit(r"(\d+)"), F.lit(1)).alias("numbers"),
            F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.regexp_extract(bare, rf"(?s).*{_MONTH}", 1)).cast("int").alias("named"),
            F.array(*[whole(F.regexp_extract(low, _TIME, k)) for k in (1, 2, 3)]).alias("time"),
            whole(F.substring(F.rpad(F.regexp_extract(low, _TIME, 4), 3, "0"), 1, 3)).alias("millis"),
            F.when(timed, F.regexp_extract(bare, r"(?<![a-z])([ap])m(?![a-z])", 1)).otherwise("").alias("half"),
            F.regexp_extract(marked, _OFFSET, 2).alias("sign"), F.regexp_extract(marked, _OFFSET, 3).alias("digits"),
            whole(F.regexp_extract(marked, _OFFSET, 4)).alias("minutes"), hours.alias("hours"), sound.alias("sound"),
        )

    def fields(p: Column) -> Column:
        a, b, c = (F.coalesce(F.get(p["numbers"], F.lit(k)), F.lit("1")).try_cast("int") for k in range(3))
        is_day, named = a.between(1, 31), p["named"] > 0
        year = F.when(~is_day, a).otherwise(F.when(named, b).otherwise(c))
        number = whole(p["digits"])
        ahead = F.when(F.length(p["digits"]) > 2, F.floor(number / 100) * 60 + number % 100).otherwise(number * 60 + p["minutes"])
        hour = p["time"][0]
        return F.struct(
            F.when(year < 50, year + 2000).when(year < 100, year + 1900).otherwise(year).alias("year"),
            F.when(named, p["named"]).otherwise(F.when(is_day, a).otherwise(b)).alias("month"),
            F.when(named, F.when(is_day, a).otherwise(b)).otherwise(F.when(is_day, b).otherwise(c)).alias("day"),
            F.when(p["half"] != "", hour % 12 + F.when(p["half"] == "p", 12).otherwise(0)).otherwise(hour).alias("hour"),
            p["time"][1].alias("minute"), p["time"][2].alias("second"), p["millis"].alias("millis"),
            F.coalesce(p["hours"] * 60, F.when(p["sign"] == "-", -ahead).otherwise(ahead)).alias("ahead"),
            (p["sound"] & F.size(p["numbers"]).between(1, 3) & ((p["half"] == "") | (hour <= 12))).alias("sound"),
        )

    def stamp(f: Column) -> Column:
        clock = (f["minute"] < 60) & (f["second"] < 60) & ((f["hour"] < 24) | ((f["hour"] == 24) & (f["minute"] == 0) & (f["second"] == 0)))
        sound = f["sound"] & clock & f["month"].between(1, 12) & f["day"].between(1, 31) & f["year"].between(0, 9999)
        start = F.unix_date(F.make_date(F.when(sound, f["year"]), F.when(sound, f["month"]), F.lit(1))).cast("long") + f["day"] - 1
        seconds = start * 86400 + f["hour"] * 3600 + f["minute"] * 60 + f["second"] - f["ahead"] * 60
        return F.when(sound, F.timestamp_millis((seconds * 1000 + f["millis"]).cast("long")))

    read = _let(sub(F.lower(value), r"\([^)]*\)", " "), lambda low: _let(
        sub(low, _TIME, " @ "), lambda marked: _let(sub(marked, _OFFSET, "$1 "), lambda bare: parts(low, marked, bare))))
    return _let(_let(read, fields), stamp)


def parse_date(value: Column) -> Column:
    text = js_trim(value)
    stamps = [text.try_cast("timestamp")] + [F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS] + [script_date(text)]
    return F.date_format(F.coalesce(*stamps), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_url(value: Column) -> Column:
    return F.when(U.is_absolute(value) | U.is_parsable(value), value)


def extract_domain(value: Column) -> Column:
    full = F.when(F.startswith(value, F.lit("http")), value).otherwise(F.concat(F.lit("https://"), value))
    return F.when(U.is_parsable(full), F.nullif(U.url_host(full), F.lit("")))


BUILT_IN: dict[str, Callable[[Column], Column]] = {
    "trim": js_trim,
    "lowercase": F.lower,
    "uppercase": F.upper,
    "parseNumber": lambda v: number_text(parse_number(v)),
    "parseDate": parse_date,
    "parseEmail": lambda v: F.lower(first_match(v, rf"(?i){EMAIL}")),
    "parsePhone": lambda v: sub(first_match(v, PHONE), r"\s+", "-"),
    "parseUrl": parse_url,
    "extractDomain": extract_domain,
    "removeHtml": lambda v: js_trim(sub(v, r"<[^>]*>")),
}


def apply_transform(value: Column, name: str | None, extra: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """A named transform; an unknown name leaves the value as it is."""
    if name is None:
        return value
    known = {**BUILT_IN, **(extra or {})}
    return known[name](value) if name in known else value
