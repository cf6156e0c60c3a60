"""Text building blocks: Column in, Column out."""

from __future__ import annotations

import json
import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webquarry.functions import patterns as P

# Character references decoded in page text.
ENTITIES = {
    "&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©",
    "&reg;": "®", "&trade;": "™", "&middot;": "·", "&bull;": "•",
    "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&lsquo;": "‘",
    "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&laquo;": "«",
    "&raquo;": "»", "&rarr;": "→", "&larr;": "←", "&euro;": "€",
    "&pound;": "£", "&yen;": "¥", "&cent;": "¢", "&deg;": "°",
    "&times;": "×", "&amp;": "&",
}


def sub(col: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(col, F.lit(pattern), F.lit(replacement))


def matches(col: Column, pattern: str) -> Column:
    """Does the pattern occur anywhere?"""
    return F.regexp_like(col, F.lit(pattern))


def find_all(col: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def js_trim(col: Column) -> Column:
    return F.btrim(col, F.lit(P.WS_CHARS))


def collapse(col: Column) -> Column:
    """Every run of white space becomes one blank, edges trimmed."""
    return F.trim(sub(col, P.WS_RUN, " "))


def word_count(col: Column) -> Column:
    """Runs of non-blank characters: one more than the blank runs between them."""
    inner = js_trim(col)
    return F.when(inner == "", F.lit(0)).otherwise(F.regexp_count(inner, F.lit(P.WS_RUN)) + 1).cast("long")


def _table(entries: dict[str, str]) -> Column:
    """A constant map, as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(entries)), "map<string,string>")


# All names of HTML; those without ';' at the end are the old ones that count without it too.
NAMED = {ref[:-1]: char for ref, char in html5.items() if ref.endswith(";")}
OLD_NAMES = sorted((ref for ref in html5 if not ref.endswith(";")), key=lambda r: (-len(r), r))
# References to 128..159 mean the characters of code page 1252.
WINDOWS = {str(i): bytes([i]).decode("cp1252") for i in range(128, 160) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def decode_entities(col: Column) -> Column:
    """Named and numeric character references to characters; text without '&' is passed through.

    The text is split at '&'; each piece that starts with a known reference has it replaced.  Old names
    without ';' count where no letter, digit or '=' follows, as in attribute values.  Numbers that are no character give U+FFFD.
    """
    common = F.create_map(*[F.lit(x) for ref, char in ENTITIES.items() for x in (ref[1:-1], char)])
    old = "|".join(OLD_NAMES)

    def piece(part: Column, i: Column) -> Column:
        closed = F.regexp_extract(part, r"^(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);", 1)
        name = F.when(closed != "", closed).otherwise(F.regexp_extract(part, rf"^({old})(?![a-zA-Z0-9=;])", 1))
        digits = F.regexp_extract(name, r"^#[xX]?0*([0-9a-fA-F]*)", 1)
        point = F.when(F.length(digits) > 7, F.lit(-1)).when(
            F.lower(F.substring(name, 2, 1)) == "x", F.conv(digits, 16, 10).try_cast("int")
        ).otherwise(digits.try_cast("int"))
        valid = point.between(1, 1114111) & ~point.between(55296, 57343)
        number = F.coalesce(
            F.try_element_at(_table(WINDOWS), point.cast("string")),
            F.when(valid, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd")),
        )
        char = F.when(F.startswith(name, F.lit("#")), number).when(
            name != "", F.coalesce(F.try_element_at(common, name), F.try_element_at(_table(NAMED), name))
        )
        rest = F.substring(part, F.length(name) + F.when(closed != "", 2).otherwise(1), F.length(part))
        return F.when(i == 0, part).otherwise(F.coalesce(F.concat(char, rest), F.concat(F.lit("&"), part)))

    decoded = F.array_join(F.transform(F.split(col, F.lit("&")), piece), "")
    return F.when(F.contains(col, F.lit("&")), decoded).otherwise(col)


# ---- tag stripping ------------------------------------------------------------------------

def strip_html(col: Column) -> Column:
    """Tags to blanks, the six classic entities decoded, other named ones blanked, white space collapsed."""
    out = sub(col, r"(?i)<script[^>]*>[\s\S]*?</script>")
    out = sub(out, r"(?i)<style[^>]*>[\s\S]*?</style>")
    out = sub(out, r"<[^>]+>", " ")
    # The entities decoded here, in this order.
    for ref, char in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]:
        out = F.replace(out, F.lit(ref), F.lit(char))
    return collapse(sub(out, r"(?i)&[a-z]+;", " "))


def strip_tags_only(col: Column) -> Column:
    """The short variant used when markdown conversion is not possible: no entity handling."""
    return collapse(sub(sub(col, P.SCRIPT_STYLE), r"<[^>]+>", " "))


# ---- plain-text cleaning ------------------------------------------------------------------

def unicode_normalize(col: Column, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD.  Plain ASCII, the bulk of most corpora, never leaves the JVM."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown normal form {form}")

    @F.udf("string", useArrow=True)
    def to_form(value):
        return None if value is None else unicodedata.normalize(form, value)

    ascii_only = F.length(col) == F.octet_length(col)
    return F.when(ascii_only, col).otherwise(to_form(F.when(~ascii_only, col)))


def remove_control_chars(col: Column) -> Column:
    # Control, zero-width and bidirectional marks that are dropped.
    return sub(
        col,
        r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F[\x{200B}-\x{FEFF}&&[\x{200B}-\x{200D}\x{FEFF}\x{202A}-\x{202E}\x{2066}-\x{2069}]]]",
    )


def normalize_line_breaks(col: Column) -> Column:
    return sub(col, r"\r\n?", "\n")


def clean_whitespace(col: Column, preserve_paragraphs: bool = True) -> Column:
    if not preserve_paragraphs:
        return collapse(col)
    out = sub(sub(col, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return js_trim(sub(sub(out, r"[ \t]+\n", "\n"), r"\n[ \t]+", "\n"))


def dedupe_whitespace(col: Column) -> Column:
    return sub(sub(col, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def trim_lines(col: Column) -> Column:
    lines = F.transform(F.split(col, F.lit("\n")), js_trim)
    return sub(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")


def clean_text(
    col: Column,
    *,
    form: str | None = "NFC",
    control_chars: bool = True,
    line_breaks: bool = True,
    whitespace: bool = True,
    preserve_paragraphs: bool = True,
    dedupe: bool = True,
    lines: bool = True,
    max_length: int | None = None,
) -> Column:
    """The whole cleaning chain; blank input gives ''."""
    out = col
    if form:
        out = unicode_normalize(out, form)
    if control_chars:
        out = remove_control_chars(out)
    if line_breaks:
        out = normalize_line_breaks(out)
    if whitespace:
        out = clean_whitespace(out, preserve_paragraphs)
    if dedupe:
        out = dedupe_whitespace(out)
    if lines:
        out = trim_lines(out)
    if max_length is not None:
        out = F.substring(out, 1, max_length)
    return F.when(F.coalesce(js_trim(col), F.lit("")) == "", F.lit("")).otherwise(out)


# ---- markdown -----------------------------------------------------------------------------

def markdown_clean(col: Column) -> Column:
    out = js_trim(sub(col, r"\n{3,}", "\n\n"))
    out = sub(out, rf"\n(#{{1,6}}){P.WS}+", "\n$1 ")
    out = sub(out, rf"{P.WS}+\n(#{{1,6}})", "\n$1")
    out = sub(out, rf"\n([-*+]|\d+\.){P.WS}", "\n$1 ")
    out = sub(out, rf"```{P.WS}*\n", "```\n")
    return sub(out, rf"\n{P.WS}*```", "\n```")


def markdown_to_text(col: Column) -> Column:
    """Markdown markers removed.  Links are handled before images, so `![a](u)` leaves `!a`."""
    ws = P.WS
    # Marker patterns in the order they are removed.
    steps = [
        (rf"(?m)^#{{1,6}}{ws}+", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"\*([^*]+)\*", "$1"),
        (r"__([^_]+)__", "$1"),
        (r"_([^_]+)_", "$1"),
        (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"!\[([^\]]*)\]\([^)]+\)", ""),
        (r"```[\s\S]*?```", ""),
        (r"`([^`]+)`", "$1"),
        (rf"(?m)^[-*+]{ws}+", ""),
        (rf"(?m)^\d+\.{ws}+", ""),
        (rf"(?m)^>{ws}+", ""),
        (r"(?m)^---+$", ""),
        (r"~~([^~]+)~~", "$1"),
    ]
    out = col
    for pattern, replacement in steps:
        out = sub(out, pattern, replacement)
    return js_trim(out)


def summary_fallback(col: Column, max_length: int = 200) -> Column:
    return F.concat(F.substring(col, 1, max_length), F.lit("..."))


# ---- splitting ----------------------------------------------------------------------------

def sentences(col: Column) -> Column:
    found = F.transform(find_all(col, r"[^.!?]+[.!?]*"), js_trim)
    return F.filter(found, lambda s: s != "")


def paragraphs(col: Column) -> Column:
    parts = F.transform(F.split(col, F.lit(rf"\n{P.WS}*\n")), js_trim)
    return F.filter(parts, lambda s: s != "")


def word_tokens(col: Column) -> Column:
    return find_all(F.lower(col), r"[a-z0-9_]+")
