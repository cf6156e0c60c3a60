"""Personal data: patterns propose, check digits confirm, words near by adjust the score."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import narrowed, small_batches, steps

#: In the order of results; the first four are found wherever their pattern and check hold.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "local_phone", "secret")
BASE = KINDS[:4]
#: Characters on either side that context words may stand in.
NEAR = 40
#: Score from which a proposed span of the further kinds counts.
BOUND = 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits unless it begins at the run's start, hence the look-behinds.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
#: Characters of an IBAN of each country, as registered.
_IBAN_SIZE = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in names.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{16}|[0-9a-f]{16,64}|[A-Za-z0-9+/]{32,64}={0,2})(?![A-Za-z0-9])")
_WORDS = {
    "ssn": re.compile(r"\b(?:ssn|social|security|insurance)\b", re.I),
    "local_phone": re.compile(r"\b(?:phone|tel|telephone|call|mobile|cell|fax)\b", re.I),
    "secret": re.compile(r"(?:password|passwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]", re.I),
}
_AGAINST = re.compile(r"\b(?:order|invoice|version|isbn|serial|part|sample|example)\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: from the start of the run before an @, or the end of the match before, if a host with a dot follows."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield m.span()


def _iban_end(text: str, start: int, limit: int) -> int | None:
    """Where the IBAN from `start` ends, before a character that is no letter or digit: at its country's length, else the longest that checks."""
    ends = [k + 1 for k in range(start, limit) if text[k] != " "]
    size = _IBAN_SIZE.get(text[start : start + 2])
    for n in [size] if size else range(len(ends), 14, -1):
        if n <= len(ends) and text[ends[n - 1] : ends[n - 1] + 1] not in _ALNUM and mod97(text[start : ends[n - 1]].replace(" ", "")):
            return ends[n - 1]
    return None


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """What follows the number after a blank is not part of it, and a run that fails is searched again behind its first four characters."""
    at = 0
    while m := _IBAN.search(text, at):
        end = _iban_end(text, *m.span())
        if end:
            yield m.start(), end
        at = end or m.start() + 4


def _score(kind: str, text: str, start: int, end: int, base: float) -> float:
    """`base` raised by words that go with the kind, lowered by words that speak against it."""
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    return base + 0.4 * bool(_WORDS[kind].search(around)) - 0.3 * bool(_AGAINST.search(around)) if kind in _WORDS else base - 0.3 * bool(_AGAINST.search(around))


def _further(text: str) -> Iterator[tuple[str, int, int, float]]:
    for start, end in ibans(text):
        yield "iban", start, end, 0.95
    for kind, pattern in (("ssn", _SSN), ("local_phone", _LOCAL_PHONE), ("secret", _SECRET)):
        for m in pattern.finditer(text):
            yield kind, *m.span(), _score(kind, text, *m.span(), 0.6 if m.group().startswith("AKIA") else 0.3)


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) of all spans in the order of KINDS, then start; places in code points, end exclusive.

    The first four kinds stay whatever their score; further kinds need a score of BOUND or more and do not overlap them.
    """
    out = [("email", *s, 0.95) for s in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *s, _score("ip", text, *s, 0.9)) for s in ips(text)]
        out += [("card", *s, _score("card", text, *s, 0.9)) for s in cards(text)]
        out += [("phone", *s, _score("phone", text, *s, 0.8)) for s in phones(text)] if "+" in text else []
        taken = sorted((a, b) for _, a, b, _ in out)
        starts, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
        more = [x for x in _further(text) if x[3] >= BOUND and reach[bisect_left(starts, x[2])] <= x[1]]
        out += sorted(more, key=lambda x: (KINDS.index(x[0]), x[1]))
    return out


_DIGIT = re.compile("[0-9]")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, score>>) of every row.

    Null and empty texts have no spans; repeated rows stay repeated; other columns are left out.  A row at a time: no shuffle,
    time in proportion to the text, as no pattern can begin twice in one run.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in steps(batches):
            found = [find(t or "") for t in rows.column("text").to_pylist()]
            flat = [{"kind": k, "start": a, "end": b, "score": s} for x in found for k, a, b, s in x]
            bounds = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, _SPAN))], names=["doc_id", "spans"])

    kept = narrowed(docs, key, text)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: long, end: long, score: double>>")


def masked_text(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first and longest counts."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b, _ in sorted(find(text), key=lambda x: (x[1], -x[2])):
        if a >= done:
            out.append(text[done:a] + f"<{kind}>")
        elif b <= done:
            continue
        done = max(done, b)
    return "".join(out) + text[done:] if out else text


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with all columns and rows, spans in the text masked; a null text stays null."""
    small_batches(docs.sparkSession)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias("text" if c == text else f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in steps(batches):
            at = rows.schema.get_field_index("text")
            clean = pa.array([masked_text(t) for t in rows.column("text").to_pylist()], rows.schema.field(at).type)
            yield rows.set_column(at, rows.schema.field(at), clean)

    return inner.mapInArrow(run, inner.schema).toDF(*names)


def digests(found: DataFrame) -> DataFrame:
    """Counts and joined spans of each row of `spans`."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    of = lambda kind: lambda x: x.kind == kind
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined("spans").alias("spans"))
