"""Stems of English terms by suffix rules, as column expressions over the distinct terms of a corpus.

Each step of Porter's method (Program 14, 1980) is three expressions: the longest suffix of the step by one pattern, the
stem before it, and the replacement by a map.  A `y` that stands for a consonant is written `Y` first, so that
vowels are one character class and the measure of a stem is a count of vowel-consonant pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.operators.skew import PART, salted_lookup

# The suffixes of each step and what takes their place.
PLURALS = {"sses": "ss", "ies": "i", "ss": "ss", "s": ""}
ENDINGS = {"eed": "ee", "ed": "", "ing": ""}
REPAIRS = {"at": "ate", "bl": "ble", "iz": "ize"}
DOUBLE_SUFFIXES = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al",
    "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
FULL_SUFFIXES = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST_SUFFIXES = dict.fromkeys(
    "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split(), ""
)
PAIR = "[aeiouy][^aeiouy]"
SHORT = "[^aeiouy][aeiouy][^aeiouywxY]$"


def _measure(stem: Column) -> Column:
    return F.regexp_count(stem, F.lit(PAIR))


def _voiced(stem: Column) -> Column:
    return F.regexp_like(stem, F.lit("[aeiouy]"))


def _short(stem: Column) -> Column:
    return F.regexp_like(stem, F.lit(SHORT))


def _doubled(word: Column, *but: str) -> Column:
    return F.regexp_like(word, F.lit(r"([^aeiouy])\1$")) & ~F.right(word, F.lit(1)).isin(*but)


def _cut(words: DataFrame, rules: dict[str, str]) -> DataFrame:
    """`suffix` is the longest of the step that `w` ends in (or empty), `stem` what stands before it."""
    found = words.withColumn("suffix", F.regexp_extract("w", f"(?:{'|'.join(rules)})$", 0))
    return found.withColumn("stem", F.expr("left(w, length(w) - length(suffix))"))


def _replaced(rules: dict[str, str]) -> Column:
    return F.concat("stem", F.create_map(*[F.lit(x) for rule in rules.items() for x in rule])[F.col("suffix")])


def _step(words: DataFrame, rules: dict[str, str], holds: Column) -> DataFrame:
    """`w` with its suffix replaced where the condition on the stem holds; a longer suffix whose condition fails stops shorter ones."""
    return _cut(words, rules).withColumn("w", F.when((F.col("suffix") != "") & holds, _replaced(rules)).otherwise(F.col("w")))


def stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """term, stem: the stem of every distinct term.

    Terms are in lower case; characters that are no letters count as consonants, and terms of up to two characters are
    their own stems.  A null term is left out.
    """
    return counted_stems(terms, term).select("term", "stem")


def counted_stems(terms: DataFrame, term: str = "term") -> DataFrame:
    """term, stem, term_rows: `stems` with the number of rows of each term."""
    words = terms.select(F.col(term).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("term_rows"))
    # One row a term, already laid out by it: the aggregate moves nothing, and keeps filters of later joins from being pushed into the
    # steps, where each would repeat the steps before it.
    return _by_steps(words).groupBy("term").agg(F.first("stem").alias("stem"), F.first("term_rows").alias("term_rows"))


def _by_steps(words: DataFrame) -> DataFrame:
    """`words` with the `stem` of their `term`, worked out for every row."""
    kept = words.columns
    w, stem, suffix = F.col("w"), F.col("stem"), F.col("suffix")
    words = words.withColumn("w", F.regexp_replace(F.regexp_replace("term", "(^|[aeiou])y", "$1Y"), "yy", "yY"))
    words = _step(words, PLURALS, F.lit(True))
    words = _cut(words, ENDINGS)
    words = words.withColumn("went", F.when(suffix == "eed", F.lit(False)).otherwise((suffix != "") & _voiced(stem)))
    words = words.withColumn("w", F.when(F.col("went"), stem).when((suffix == "eed") & (_measure(stem) > 0), F.concat(stem, F.lit("ee"))).otherwise(w))
    words = _cut(words, REPAIRS).withColumn(
        "w",
        F.when(~F.col("went"), w)
        .when(suffix != "", _replaced(REPAIRS))
        .when(_doubled(w, "l", "s", "z"), F.expr("left(w, length(w) - 1)"))
        .when((_measure(w) == 1) & _short(w), F.concat(w, F.lit("e")))
        .otherwise(w),
    )
    words = _step(words, {"y": "i", "Y": "i"}, _voiced(stem))
    words = _step(words, DOUBLE_SUFFIXES, _measure(stem) > 0)
    words = _step(words, FULL_SUFFIXES, _measure(stem) > 0)
    words = _step(words, LAST_SUFFIXES, (_measure(stem) > 1) & ((suffix != "ion") | F.right(stem, F.lit(1)).isin("s", "t")))
    words = _step(words, {"e": ""}, (_measure(stem) > 1) | ((_measure(stem) == 1) & ~_short(stem)))
    words = words.withColumn("w", F.when((_measure(w) > 1) & w.endswith("ll"), F.expr("left(w, length(w) - 1)")).otherwise(w))
    return words.select(*kept, F.when(F.length("term") > 2, F.lower("w")).otherwise(F.col("term")).alias("stem"))


def _stems_in_place(rows: DataFrame, term: str) -> DataFrame:
    """`dealt` rows with the stem of their term, worked out once for every term of a part; the rows stay in their part."""
    rest = [c for c in rows.columns if c not in (PART, term)]
    words = rows.where(F.col(term).isNotNull()).groupBy(F.col(term).alias("term"), PART)  # the term first: the other says nothing to a sort
    words = _by_steps(words.agg(F.collect_list(F.struct(*rest)).alias("__rows")))
    # The stem goes through the generator, as the optimizer otherwise follows it from later joins into the steps, where each repeats the steps before it.
    stemmed = F.transform("__rows", lambda r: F.struct(F.col("stem").alias("stem"), *[r[c].alias(c) for c in rest]))
    return words.select(PART, F.col("term").alias(term), F.inline(stemmed))


def with_stems(rows: DataFrame, by: str, term: str = "term", parts: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """`rows` with the stem of their term, worked out once for every distinct term; a term of a third of all rows is spread by `by`.

    `known`: `counted_stems` of these terms, where they are at hand; its counts only tell which terms are spread.
    `dealt` rows are not exchanged: each part works out the stems of its own distinct terms.
    """
    if PART in rows.columns:
        return _stems_in_place(rows, term)
    return salted_lookup(rows, counted_stems(rows, term) if known is None else known, term, by, count="term_rows", parts=parts)
