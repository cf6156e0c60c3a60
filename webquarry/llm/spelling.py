"""Spelling variants: words one edit apart, found by dense comparison of padded code-point matrices.

Two words are one insertion, deletion or replacement apart when their common prefix and suffix together reach the longer
length minus one.  A single edit touches one third of the shorter word and leaves the other two thirds, so words are
grouped by those; inside a group the words are rows of a matrix padded on the right (prefixes) and of one padded on the
left (suffixes), compared column by column, block against block.  Large groups are cut into blocks, and every pair of
blocks is a tile of its own.  A tile gives one row a word, not one a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import narrowed, width, written

LETTERS = "A-Za-z\u00C0-\u00FF"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a group that one block holds, on average.
BLOCK = 1024
#: Parts of a word; one edit leaves all but one of them.
PARTS = 3
#: A form occurs so many times as often as its variant.
FACTOR = 5


def occurrences(docs: DataFrame, shortest: int = 6, rare: int | None = 199, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word) for every run of letters of at least `shortest` code points in whole texts, A-Z lower-cased.

    Where `rare` divides the crc32 of `<key>:<run>`, the run loses its code point crc32 % length, and stays if it is still long
    enough; None leaves all runs as they are.  Null and empty texts give no rows, a null key counts as empty.  No shuffle and
    no Python: shorter runs are not even cut out.
    """
    rows = narrowed(docs, key, text)
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    ascii_only = F.length("run") == F.octet_length("run")
    runs = runs.select("doc_id", F.when(ascii_only, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("word"))
    if rare is None:
        return runs.select("word")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    at = F.pmod(h, F.length("word")).cast("int")
    cut = F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))
    return runs.select(F.when(h % rare == 0, cut).otherwise(F.col("word")).alias("word")).where(F.length("word") >= shortest)


def _shared_parts(word: Column) -> Column:
    """What a word shows to others: for the lengths m of itself and of itself less one, and each third f that an edit may touch."""
    shown = []
    for less in (0, 1):
        m = F.length(word) - less
        for f in range(PARTS):
            head = F.substring(word, F.lit(1), F.floor(m * f / PARTS).cast("int"))
            rest = (m - F.floor(m * (f + 1) / PARTS)).cast("int")
            tail = F.substring(word, F.length(word) - rest + 1, rest)
            shown.append(F.struct(m.alias("m"), F.lit(f).alias("f"), F.xxhash64(head, F.lit("\0"), tail).alias("shared")))
    return F.array(*shown)


def _layout(words: list[str], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, flush left and flush right, padded with zeros."""
    wide = max(1, int(n.max()))
    left = np.array(words, f"<U{wide}").view("<u4").reshape(len(words), wide)
    place = np.arange(wide)[None, :] - (wide - n)[:, None]
    return left, np.where(place >= 0, np.take_along_axis(left, np.maximum(place, 0), axis=1), 0)


def _common(x: np.ndarray, y: np.ndarray, columns: range) -> np.ndarray:
    """Length of the run of equal columns for every row of x against every row of y."""
    same = np.ones((len(x), len(y)), bool)
    out = np.zeros((len(x), len(y)), np.int32)
    for c in columns:
        same &= x[:, c, None] == y[None, :, c]
        if not same.any():
            break
        out += same
    return out


def near(left: np.ndarray, right: np.ndarray, n: np.ndarray, x: slice, y: slice, m: int, f: int) -> np.ndarray:
    """Which words of x and y, the shorter of m code points, are one edit apart, and in part f first of those that show it."""
    wide = left.shape[1]
    shorter = np.minimum(n[x][:, None], n[y][None, :])
    longer = np.maximum(n[x][:, None], n[y][None, :])
    lead = np.minimum(_common(left[x], left[y], range(wide)), shorter)
    trail = np.minimum(_common(right[x], right[y], range(wide - 1, -1, -1)), shorter)
    hit = (shorter == m) & (longer <= m + 1) & (lead + trail >= longer - 1) & (lead < longer)
    shows = lambda k: (lead >= m * k // PARTS) & (trail >= m - m * (k + 1) // PARTS)
    hit &= shows(f)
    for k in range(f):
        hit &= ~shows(k)
    return hit


_FOUND = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _tile(words: list[str], counts: np.ndarray, n: np.ndarray, block: np.ndarray, m: int, f: int, lo: int, hi: int, out: list[tuple]) -> None:
    """Per word of a tile, how many near words it has there and the most frequent of them (ties: the smallest)."""
    order = sorted(range(len(words)), key=lambda i: (block[i], -counts[i], words[i]))  # inside a block the best come first
    words, counts, n = [words[i] for i in order], counts[order], n[order]
    cut = int((block == lo).sum()) if lo != hi else len(order)
    x, y = (slice(0, cut), slice(cut, len(order))) if lo != hi else (slice(0, cut), slice(0, cut))
    if x.stop == x.start or y.stop == y.start:
        return
    left, right = _layout(words, n)
    hit = near(left, right, n, x, y, m, f)
    for rows, start, others in ((hit, x.start, y.start), *([(hit.T, y.start, x.start)] if lo != hi else [])):
        total = rows.sum(axis=1)
        first = rows.argmax(axis=1)
        for i in np.flatnonzero(total).tolist():
            best = others + int(first[i])
            out.append((words[start + i], int(total[i]), int(counts[best]), words[best]))


_KEYS = ("m", "f", "shared", "lo", "hi")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles follow each other in sorted order; the last of a batch waits for the next batch."""

    def whole(table: pa.Table) -> Iterator[pa.RecordBatch]:
        keys = np.stack([table.column(c).to_numpy() for c in _KEYS])
        bounds = np.append(np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0))), table.num_rows).tolist()
        words, counts, block = table.column("word").to_pylist(), table.column("n").to_numpy(), table.column("block").to_numpy()
        n = pc.utf8_length(table.column("word")).to_numpy().astype(np.int64)
        out: list[tuple] = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a > 1:
                m, f, _, lo, hi = keys[:, a].tolist()
                _tile(words[a:b], counts[a:b], n[a:b], block[a:b], m, f, lo, hi, out)
        for k in range(0, len(out), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out[k : k + 8192]), _FOUND)], schema=_FOUND)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in _KEYS]
        start = next((i + 1 for i in range(batch.num_rows - 2, -1, -1) if any(c[i] != c[-1] for c in last)), 0)
        if start:
            yield from whole(pa.Table.from_batches([*held, batch.slice(0, start)]).combine_chunks())
            held = [batch.slice(start)]
        elif held and any(held[-1].column(held[-1].schema.get_field_index(c))[-1].as_py() != v[0] for c, v in zip(_KEYS, last)):
            yield from whole(pa.Table.from_batches(held).combine_chunks())
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield from whole(pa.Table.from_batches(held).combine_chunks())


def nearest(vocabulary: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) for every word of a table (word, n) that has a word one edit apart.

    Words are unique and not null.  A word is sent six times, and once more for each further block of a group beyond BLOCK
    words; groups without a pair of fitting lengths go no further.
    """
    shown = vocabulary.select("word", "n", F.explode(_shared_parts(F.col("word"))).alias("s")).select("word", "n", "s.*")
    groups = shown.groupBy("m", "f", "shared").agg(F.count(F.lit(1)).alias("size"), F.count(F.when(F.length("word") == F.col("m"), 1)).alias("short"))
    fitting = groups.where("size > 1 AND short > 0").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).drop("size", "short")
    dealt = shown.join(fitting, ["m", "f", "shared"]).withColumn("block", F.pmod(F.xxhash64("word"), "blocks").cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = tiles.select("m", "f", "shared", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "word", "n", "block")
    sorted_tiles = tiles.repartition(width(vocabulary), *_KEYS).sortWithinPartitions(*_KEYS)
    found = sorted_tiles.mapInArrow(_compared, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a table (word, form): the last word reached by following forms.  Forms must not run in circles.

    Each round replaces every pointer by its target's pointer, so chains halve; the rounds grow with the logarithm of the longest
    chain, which counts growing by FACTOR keep short.  Only words with a form take part.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = written(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def variants(words: DataFrame, least: int = 5, word: str = "word", n: str | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every distinct word that occurs `least` times in all.

    `n` names a column of counts, else every row counts once; rows of the same word add up, null words and counts are left out.
    n_near counts the words one edit apart; the form is the most frequent of them (ties: the smallest in code-point order) if it
    occurs at least FACTOR times as often, else null with a null form_n.  The root is the last word along the forms, or the word itself.
    An empty table gives none.  Counts are summed before the shuffle, so a frequent word is one row for each task; forms and
    roots are joins that Spark can split.
    """
    own = F.lit(1) if n is None else F.col(n).cast("long")
    rows = words.select(F.col(word).alias("word"), own.alias("own")).where("word IS NOT NULL AND own IS NOT NULL")
    vocabulary = written(rows.groupBy("word").agg(F.sum("own").alias("n")).where(F.col("n") >= least), "vocabulary")
    strong = F.col("best_n") >= FACTOR * F.col("n")
    linked = written(vocabulary.join(nearest(vocabulary), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"),
    ), "linked")
    ends = roots(linked.where("form IS NOT NULL").select("word", "form"))
    return linked.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
