"""Near-duplicate groups by HyperMinHash: compressed registers, bands over them, corrected estimate, full check.

One hash per shingle: its first 9 bits pick one of 512 registers, of the rest the least value stays,
kept as the count of leading zeros and the next MANTISSA bits.  For the bands, an empty register takes the value of the
first filled one in an order of its own, so that short texts do not meet by a single common shingle.  A band is the
hash of some registers, as many as keep the chance of an equal band at the bound at MATCH or more; a pair at the bound
then shares none of the BANDS with a probability below 0.000002.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import U, bytes_of, distinct_per_row, mix, narrowed, shingles, span_hashes, steps, width, word_spans, written
from webquarry.llm.components import components

REGISTERS = 512
SLOT_BITS = 9
MANTISSA = 10
BANDS = 48
MATCH = 0.25
EMPTY = 0xFFFF
#: Pairs whose estimate is this many standard errors below the bound are not read in full.
SIGMAS = 6.0
#: Documents and bytes of a block of a large family, and columns of a block of the incidence matrix.
BLOCK = 256
BLOCK_BYTES = 4 << 20
COLUMNS = 4096


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document of a step, joined, and their n + 1 bounds."""
    start, end, first = word_spans(data, at)
    hashes, rows = shingles(span_hashes(data, start, end, lower=True), first, words)
    return distinct_per_row(hashes, rows, len(at) - 1)


def registers(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The registers of each sorted set, as rows of sixteen-bit values."""
    n = len(bounds) - 1
    rows = np.repeat(np.arange(n), np.diff(bounds))
    slot = rows * REGISTERS + (hashes >> U(64 - SLOT_BITS)).astype(np.int64)
    lead = np.flatnonzero(np.diff(slot, prepend=-1))  # sets are sorted, so the first of a register is its least
    rest = (hashes[lead] << U(SLOT_BITS)) | U(REGISTERS - 1)
    zeros = 63 - np.floor(np.log2(np.maximum(rest >> U(11), U(1)).astype(np.float64))).astype(np.int64) - 11
    shifted = rest << (zeros + 1).astype(U)
    out = np.full(n * REGISTERS, EMPTY, np.uint16)
    out[slot[lead]] = (zeros.astype(np.uint16) << MANTISSA) | (shifted >> U(64 - MANTISSA)).astype(np.uint16)
    return out.reshape(n, REGISTERS)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of register rows less the expected chance matches, and the registers it rests on.

    A chance match is two different least values in one cell of leading zeros and mantissa; the least of
    a set with x shingles per register lies near t with density x * exp(-x * t).
    """
    used = (a != EMPTY) | (b != EMPTY)
    equal = ((a == b) & (a != EMPTY)).sum(axis=1)
    x, y = np.maximum(n / REGISTERS, 1e-9), np.maximum(m / REGISTERS, 1e-9)
    chance = np.zeros(len(a))
    for k in range(48):
        hi, lo = 2.0**-k, 2.0 ** -(k + 1)
        chance += lo / 2**MANTISSA * x * y / (x + y) * (np.exp(-(x + y) * lo) - np.exp(-(x + y) * hi))
    count = np.maximum(used.sum(axis=1), 1)
    return np.clip((equal - REGISTERS * chance) / count, 0, 1), count


_ORDERS = np.random.default_rng(41).permuted(np.tile(np.arange(REGISTERS), (REGISTERS, 1)), axis=1)


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with every empty one filled from the first filled one in its order; rows without any stay."""
    out = regs.copy()
    some = np.flatnonzero((regs == EMPTY).any(axis=1) & (regs != EMPTY).any(axis=1))
    row, slot = np.nonzero(regs[some] == EMPTY)
    row = some[row]
    for k in range(REGISTERS):
        if not len(row):
            break
        found = regs[row, _ORDERS[slot, k]]
        out[row, slot] = found
        row, slot = row[found == EMPTY], slot[found == EMPTY]
    return out


def band_hashes(regs: np.ndarray, share: float) -> np.ndarray:
    """The hash of each band, as rows of BANDS values."""
    size = max(1, int(np.log(MATCH) / np.log(share))) if share < 1 else REGISTERS // BANDS
    columns = np.random.default_rng(43).permutation(np.tile(np.arange(REGISTERS), -(-size * BANDS // REGISTERS)))[: size * BANDS].reshape(BANDS, size)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), (len(regs), BANDS)).copy()
    for k in range(size):
        out = mix(out * U(0x9E3779B97F4A7C15) + regs[:, columns[:, k]])
    return out


def sketches(docs: DataFrame, words: int, share: float) -> DataFrame:
    """(doc_id, n_shingles, n_bytes, set_key, bands) of each row of (doc_id, text); set_key is 128 bits over the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in steps(batches):
            hashes, bounds = shingle_sets(data, at, words)
            bands = band_hashes(filled(registers(hashes, bounds)), share)
            sums = [np.concatenate([[U(0)], np.cumsum(mix(hashes ^ U(salt)))]) for salt in (0x5BD1E995, 0xC2B2AE3D27D4EB4F)]
            keys = np.stack([s[bounds[1:]] - s[bounds[:-1]] for s in sums], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), pa.array(np.diff(bounds)), pa.array(np.diff(at)),
                    pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([b.tobytes() for b in bands], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "n_bytes", "set_key", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, n_bytes long, set_key binary, bands binary")


def band_keys(reps: DataFrame) -> DataFrame:
    """(key, doc_id): one row for each band."""
    at = F.sequence(F.lit(0), F.lit(BANDS - 1))
    return reps.select(F.explode(F.transform(at, lambda i: F.xxhash64(F.substring("bands", i * 8 + 1, F.lit(8))))).alias("key"), "doc_id")


def _plausible(sets: list[np.ndarray], share: float) -> np.ndarray:
    """Which pairs of sets the corrected estimate of their registers does not rule out."""
    sizes = np.array([len(x) for x in sets], float)
    regs = registers(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    out = np.zeros((len(sets), len(sets)), bool)
    for i in range(len(sets)):
        found, count = estimate(np.broadcast_to(regs[i], regs.shape), regs, np.full(len(sets), sizes[i]), sizes)
        out[i] = (found + SIGMAS * np.sqrt(share * (1 - share) / count) >= share) & (np.minimum(sizes, sizes[i]) >= share * np.maximum(sizes, sizes[i]) * (1 - 1e-9))
    np.fill_diagonal(out, False)
    return out


def _shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Exact sizes of all intersections, by products of blocks of the incidence matrix."""
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    common = times[column] > 1
    row, column = row[common], (np.cumsum(times > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        block = np.zeros((len(sets), COLUMNS), np.float32)
        block[row[i:j], column[i:j] - lo] = 1
        out += block @ block.T  # whole numbers below 2 ** 24, so exact
    return out


def linked(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning edge to the smallest id of its group for each other set; groups are the components of the links among these sets."""
    near = _plausible(sets, percent / 100)
    some = np.flatnonzero(near.any(axis=1))
    if not len(some):
        return []
    sets, ids, near = [sets[i] for i in some], ids[some], near[np.ix_(some, some)]
    sizes = np.array([len(x) for x in sets], float)
    both = _shared_counts(sets)
    link = near & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both))
    label, last = ids.copy(), None
    while last is None or (label != last).any():
        last = label
        label = np.minimum(label, np.where(link, label[None, :], np.iinfo(np.int64).max).min(axis=1))
    return [(int(a), int(b)) for a, b in zip(label, ids) if a != b]


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compared(words: int, percent: int):
    """Edges of the families, or tiles of large ones, that one group holds."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["family", "i", "j", "doc_id", "text"]).combine_chunks().sort_by([("family", "ascending"), ("i", "ascending"), ("j", "ascending"), ("doc_id", "ascending")])
        tile = np.stack([rows.column(c).to_numpy() for c in ("family", "i", "j")])
        ids, texts = rows.column("doc_id").to_numpy(), rows.column("text")
        bounds = np.concatenate([[0], np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1, [rows.num_rows]])
        edges: list[tuple[int, int]] = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            data, at = bytes_of(texts.slice(lo, hi - lo))
            hashes, cut = shingle_sets(data, at, words)
            edges += linked(ids[lo:hi], [hashes[cut[k] : cut[k + 1]] for k in range(hi - lo)], percent)
        return pa.table([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], schema=_EDGES)

    return run


def _placed(families: DataFrame) -> DataFrame:
    """(doc_id, family, blocks, own) from (doc_id, family, n_bytes).

    A family of up to BLOCK documents and BLOCK_BYTES is one block; a larger one is cut into blocks by the hash of the key.
    """
    size = families.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    blocks = size.select("family", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES), F.lit(1)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    return families.join(blocks, "family").select("doc_id", "family", "blocks", own.alias("own"))


def _first_tiles(cand: DataFrame, bundles: int) -> DataFrame:
    """Small families, many to a group; of large ones each block together with the first."""
    tile = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("own") == 0, F.sequence(F.lit(1), F.col("blocks") - 1)).otherwise(F.array("own")))
    rows = cand.select("family", F.lit(0).alias("i"), tile.alias("j"), "blocks", "doc_id", "text")
    group = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("family"), F.lit(bundles))).otherwise(F.xxhash64("family", "j"))
    return rows.withColumn("group", group).drop("blocks")


def _open_tiles(cand: DataFrame, joined: DataFrame) -> DataFrame:
    """Of families of three blocks or more, the documents outside the largest group, against all blocks.

    What the first tiles have joined needs no further comparison, so a large group of near copies costs in proportion to its size.
    """
    large = cand.where("blocks > 2")
    labels = large.select("doc_id", "family").join(joined.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", "family", F.coalesce("component_id", "doc_id").alias("label"))
    sizes = labels.groupBy("family", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("rest"))
    main = main.withColumn("parts", F.ceil(F.col("rest") / BLOCK).cast("int")).where("parts > 0")
    part = F.when(F.col("label") != F.col("main"), F.pmod(F.xxhash64(F.lit("open"), "doc_id"), F.col("parts")).cast("int"))
    roles = labels.join(main, "family").select("doc_id", "parts", part.alias("part")).dropDuplicates(["doc_id"])
    rows = large.join(roles.hint("merge"), "doc_id")
    asking = rows.where("part IS NOT NULL").select("family", F.col("part").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), "doc_id", "text")
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: ~k.eqNullSafe(F.col("part")))
    asked = rows.select("family", F.explode(others).alias("i"), F.col("own").alias("j"), "doc_id", "text")
    return asking.unionByName(asked).withColumn("group", F.xxhash64("family", "i", "j"))


def kept_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs`, with all columns, whose key is the smallest of its group."""
    kept = near_duplicates(docs, key, text, words, percent).where("kept").select(F.col("doc_id").alias("kept_id"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").cast("long").alias("own_id"))
    return rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi").select("row.*")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; documents are linked where 100 * shared >= percent * all shingles.

    Words are runs without white space, A-Z in lower case.  A text with fewer than `words` words is one
    shingle; a null or blank text has none, links with nothing and stays.  `key` holds unique longs; a repeated key
    gives repeated rows, and a row with a null key stays unless another row has the same set.  Other columns are left out.

    Equal sets are one representative from the start, by an aggregate that combines before the shuffle.
    In each bucket (band key) all members hang on the smallest; what hangs together over any bucket is a
    family.  Inside a family the estimate rules pairs out and exact counts of shared shingles decide
    the others; a tile returns one edge for each document that it links, never its pairs.  A large family first meets its
    first block only, then the documents still outside its largest group meet all blocks.  So no pair that shares a bucket
    and could join two groups is left out, and hot keys meet only aggregates and equi-joins that Spark splits.  Texts are
    read again only for families.
    """
    base = narrowed(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = written(sketches(base, words, percent / 100), "sketches")
    classes = found.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"))
    bands = written(band_keys(classes), "bands")
    buckets = bands.groupBy("key").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").drop("last")
    star = bands.join(buckets, "key").where("doc_id <> leader").select(F.col("leader").alias("a"), F.col("doc_id").alias("b")).distinct()
    families = components(star).select(F.col("id").alias("doc_id"), F.col("component_id").alias("family"))
    sized = written(families.join(found.groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes")), "doc_id"), "sizes")
    # Families grow with the input, so they are never broadcast, however few they are.
    cand = written(base.join(_placed(sized).hint("merge"), "doc_id"), "families")
    bundles = width(docs, -(-(sized.agg(F.sum("n_bytes")).first()[0] or 0) // BLOCK_BYTES))
    compared = _compared(words, percent)
    joined = written(components(_first_tiles(cand, bundles).groupBy("group").applyInArrow(compared, "a long, b long")), "joined")
    more = _open_tiles(cand, joined).groupBy("group").applyInArrow(compared, "a long, b long")
    groups = components(joined.where("id <> component_id").select(F.col("component_id").alias("a"), F.col("id").alias("b")).unionByName(more))

    smallest = found.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    member = found.select("doc_id", "n_shingles", "set_key").join(smallest, "set_key", "left")
    return (
        member.join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "rep", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
