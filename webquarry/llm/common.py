"""Shared pieces: folders for written tables, byte views of Arrow texts, word and shingle hashes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that one vectorised step works on; longer documents are a step of their own.
STEP_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and its Python workers.
BATCH_BYTES = 8 << 20

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.default_rng(20240229)
_BYTE_KEYS = _RNG.integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)
_LOWER_KEYS = _BYTE_KEYS.copy()
_LOWER_KEYS[65:91] = _BYTE_KEYS[97:123]
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one named by spark.checkpoint.dir, or below the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a table in the shared folder and read back: lineage ends here and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most from here on, so that a worker's memory does not follow the length of texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) <= 0 or int(now.rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def narrowed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Only the key and the text, under fixed names, so that other columns of any name do no harm."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 4 == 2


def bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text array and its n + 1 offsets; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    first, last = int(at[0]), int(at[-1])
    view = np.frombuffer(data, np.uint8)[first:last] if data is not None and last > first else np.zeros(0, np.uint8)
    return view, at - first


def steps(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about STEP_BYTES of text, as (slice, bytes, offsets)."""
    for batch in batches:
        data, at = bytes_of(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + STEP_BYTES, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int, base: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, STEP_BYTES + (1 << 16))
        have = np.full(size, U(base), U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte span; equal bytes give equal hashes wherever they stand."""
    sums = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER_KEYS if lower else _BYTE_KEYS)[data] * _powers(len(data), _BASE), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(len(data) + 1, _BASE_INV)[start] + (end - start).astype(U))


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each document the index of its first word (n + 1 entries)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, at)


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of `size` words inside a document, and its document's place in the step.

    A document with fewer words gives its whole sequence as one shingle; one without words gives none.
    """
    n = np.diff(first)
    total = len(words)
    out = np.zeros(max(0, total - size + 1), U)
    for k in range(size):
        out = mix(out * U(_BASE) + words[k : total - size + 1 + k]) if len(out) else out
    per_doc = np.maximum(n - size + 1, 0)
    keep = np.repeat(first[:-1], per_doc) + _ranges(per_doc)
    rows = np.repeat(np.arange(len(n)), per_doc)
    short = np.flatnonzero((n > 0) & (n < size))
    if not len(short):
        return out[keep], rows
    whole = np.array([_sequence(words[first[i] : first[i + 1]]) for i in short], U)
    hashes, rows = np.concatenate([out[keep], whole]), np.concatenate([rows, short])
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def _sequence(words: np.ndarray) -> np.uint64:
    out = np.full(1, len(words), U)
    for w in words:
        out = mix(out * U(_BASE) + w)
    return out[0]


def _ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, joined."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def distinct_per_row(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each row in ascending order, joined, and the n + 1 bounds; `rows` ascends."""
    bounds = np.searchsorted(rows, np.arange(n + 1))
    parts = [np.unique(hashes[bounds[i] : bounds[i + 1]]) for i in range(n)]
    sizes = np.fromiter(map(len, parts), np.int64, n)
    return (np.concatenate(parts) if n else np.zeros(0, U)), np.concatenate([[0], np.cumsum(sizes)])


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of `values` between consecutive bounds."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[at[1:]] - sums[at[:-1]]


def width(df: DataFrame, share: int = 1) -> int:
    """Partitions for a shuffle of `df`: as many as the session asks for at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), share)
