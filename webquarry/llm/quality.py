"""Quality by weak supervision: rules vote or abstain, expectation-maximisation learns how far to trust each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import U, mix, narrowed, row_sums, shingles, small_batches, span_hashes, steps, word_spans

REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ROUNDS = 60

_IS = {name: np.isin(np.arange(256), [ord(c) for c in chars]) for name, chars in {"symbol": "#*$%&|<>", "shout": "!", "stop": ".?!:;,"}.items()}
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80  # first byte of a code point

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_lower long, n_shouts long, n_stops long, n_wide long, n_distinct long"


def _groups(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that brings equal hashes of a row together, starts of the runs in it, and their sizes."""
    key = mix(hashes ^ mix(rows.astype(U) + U(1)))
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order][1:] != key[order][:-1]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, len(order)))


def measure_step(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a step."""
    n = len(at) - 1
    start, end, first = word_spans(data, at)
    n_words = np.diff(first)
    hashes = span_hashes(data, start, end)
    word_row = np.repeat(np.arange(n), n_words)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, start, 1)
    np.add.at(inside, end, -1)
    in_word = np.cumsum(inside[:-1]) > 0

    order, lead, size = _groups(hashes, word_row)
    n_distinct = np.bincount(word_row[order[lead]], minlength=n)

    windows, rows = shingles(hashes, first, REPEAT_WINDOW)
    full = n_words[rows] >= REPEAT_WINDOW
    windows, rows = windows[full], rows[full]
    per_row = np.maximum(n_words - REPEAT_WINDOW + 1, 0)
    place = np.arange(len(windows)) - np.repeat(np.cumsum(per_row) - per_row, per_row) + first[rows]
    order, lead, size = _groups(windows, rows)
    again = place[order[np.repeat(size > 1, size)]]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0

    breaks = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([at[:-1], breaks + 1]))
    line_start = line_start[line_start < len(data)] if len(data) else line_start[:0]
    line_end = np.minimum(np.append(line_start[1:], len(data)), len(data))
    ends_in_break = np.zeros(len(line_start), bool)
    ends_in_break[:] = data[line_end - 1] == 10 if len(line_start) else False
    line_end = line_end - ends_in_break
    has_word = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(at, line_start, "right") - 1
    order, lead, size = _groups(span_hashes(data, line_start, line_end), line_row)
    n_dup = np.bincount(line_row[order[lead]], weights=size - 1, minlength=n).astype(np.int64)

    return {
        "n_words": n_words, "word_chars": row_sums(_FIRST[data] & in_word, at), "n_symbols": row_sums(_IS["symbol"][data], at),
        "n_dup_lines": n_dup, "n_repeat_words": row_sums(repeated, first), "n_lines": np.bincount(line_row, minlength=n),
        "n_upper": row_sums(_UPPER[data], at), "n_lower": row_sums(_LOWER[data], at), "n_shouts": row_sums(_IS["shout"][data], at),
        "n_stops": row_sums(_IS["stop"][data], at), "n_wide": row_sums(data >= 0xC0, at), "n_distinct": n_distinct,
    }


def measures(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the counts that rules look at, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            found = measure_step(data, at)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(v.astype(np.int64)) for v in found.values()]], names=["doc_id", *found])

    kept = narrowed(docs, key, text)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, {MEASURES}")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes 1 (good), -1 (bad) or 0 (abstains) over the measures.

    Each kind of junk meets more than one rule, as their agreement is all that the fit goes by.
    """
    share = lambda x, y: F.col(x) / F.greatest(F.col(y), F.lit(1))
    letter_share = (F.col("n_upper") + F.col("n_lower") + F.col("n_wide")) / F.greatest(F.col("word_chars"), F.lit(1))
    letters = F.greatest(F.col("n_upper") + F.col("n_lower"), F.lit(1))
    enough = F.col("n_words") >= 30
    return {
        "length": _vote(F.col("n_words") < MIN_WORDS, F.col("n_words") >= 50),
        "word_length": _vote(~share("word_chars", "n_words").between(2.5, 14), share("word_chars", "n_words").between(3, 11)),
        "symbols": _vote(share("n_symbols", "n_words") > 0.15, share("n_symbols", "n_words") < 0.03),
        "symbol_load": _vote(share("n_symbols", "word_chars") > 0.03, share("n_symbols", "word_chars") < 0.01),
        "letters": _vote(letter_share < 0.88, letter_share > 0.92),
        "dup_lines": _vote(share("n_dup_lines", "n_lines") > 0.3, share("n_dup_lines", "n_lines") <= 0.1),
        "repeats": _vote(share("n_repeat_words", "n_words") > 0.25, share("n_repeat_words", "n_words") <= 0.1),
        "upper": _vote(F.col("n_upper") / letters > 0.5, F.col("n_upper") / letters < 0.2),
        "shouts": _vote(share("n_shouts", "n_words") > 0.2, share("n_shouts", "n_words") < 0.03),
        "stops": _vote(enough & (share("n_stops", "n_words") < 0.01), share("n_stops", "n_words").between(0.02, 0.4)),
        "variety": _vote(enough & (share("n_distinct", "n_words") < 0.1), share("n_distinct", "n_words") > 0.3),
    }


def fit(voted: DataFrame, names: list[str]) -> tuple[float, dict[str, dict[int, float]]]:
    """Log odds of good quality: what each vote adds, and the prior.

    Only the counts of vote patterns come to the driver, at most 3 to the power of the number of rules, over
    all documents.  Every rule has its own rates of right votes for good and for bad documents; abstaining says nothing.
    """
    rows = voted.groupBy(*names).count().collect()
    if not rows:
        return 0.0, {n: {-1: 0.0, 1: 0.0} for n in names}
    votes = np.array([[r[n] for n in names] for r in rows])
    count = np.array([r["count"] for r in rows], float)
    prior, bad_if_good, bad_if_bad = 0.8, np.full(len(names), 0.03), np.full(len(names), 0.4)
    for _ in range(ROUNDS):
        odds = _odds(votes, prior, bad_if_good, bad_if_bad)
        p = count / (1 + np.exp(-odds))
        q = count - p
        prior = float(np.clip((p.sum() + 1) / (count.sum() + 2), 0.05, 0.95))
        rate = lambda w: (w @ (votes == -1) + 0.1) / (w @ (votes != 0) + 1)
        bad_if_good, bad_if_bad = np.clip(rate(p), 1e-4, 0.4), np.clip(rate(q), 0.02, 0.999)
        bad_if_bad = np.maximum(bad_if_bad, bad_if_good)  # a rule is no worse than chance
    added = lambda j: {-1: float(np.log(bad_if_good[j] / bad_if_bad[j])), 1: float(np.log((1 - bad_if_good[j]) / (1 - bad_if_bad[j])))}
    return float(np.log(prior / (1 - prior))), {n: added(j) for j, n in enumerate(names)}


def _odds(votes: np.ndarray, prior: float, bad_if_good: np.ndarray, bad_if_bad: np.ndarray) -> np.ndarray:
    on_bad, on_good = np.log(bad_if_good / bad_if_bad), np.log((1 - bad_if_good) / (1 - bad_if_bad))
    return np.log(prior / (1 - prior)) + (votes == -1) @ on_bad + (votes == 1) @ on_good


def _model(counted: DataFrame) -> tuple[DataFrame, Column]:
    """`counted` with votes, and the log odds of good quality over them."""
    votes = rules()
    voted = counted.withColumns({f"vote_{n}": v.cast("int") for n, v in votes.items()})
    names = [f"vote_{n}" for n in votes]
    prior, weights = fit(voted, names)
    return voted, sum((F.when(F.col(n) == -1, weights[n][-1]).when(F.col(n) == 1, weights[n][1]).otherwise(0.0) for n in names), F.lit(prior))


BASE_FAILED = (f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures, base_failed, quality (posterior probability) and kept of every row.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows.  kept: not base_failed and a posterior of
    one half or more.  Null and blank texts have no words and fail; rows that repeat are judged alike; other columns are left out.
    Texts are read twice, for the counts of vote patterns and for the verdicts; nothing is shuffled but the pattern counts.
    """
    voted, odds = _model(measures(docs, key, text))
    out = voted.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("base_failed", F.expr(BASE_FAILED))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))


def passed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that `judged` keeps, with all their columns; measured beside the row, so no join is needed."""
    small_batches(docs.sparkSession)
    names = docs.columns
    inner = docs.select(*[F.col(f"`{c}`").alias("text" if c == text else f"c{i}") for i, c in enumerate(names)])
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            found = measure_step(data, at)
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(v.astype(np.int64)) for v in found.values()]], names=[*rows.schema.names, *found])

    _, odds = _model(measures(docs, key, text))
    beside = inner.mapInArrow(run, f"{schema}, {MEASURES}").withColumns({f"vote_{n}": v.cast("int") for n, v in rules().items()})
    return beside.where(~F.expr(BASE_FAILED) & (odds >= 0)).select(*inner.columns).toDF(*names)
