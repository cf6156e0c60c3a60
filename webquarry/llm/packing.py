"""Packing token pieces into sequences: Martello-Toth dominance reduction, then best fit.

Lengths are whole numbers up to the capacity, so the instance is its histogram, whatever the number of documents.  The driver
reduces and packs that histogram: a set of pieces that dominates every other set with its longest piece is fixed as a
sequence for good, as often as pieces last, and the instance shrinks; the rest goes, longest first, to the fullest sequence with room.  Both
steps treat all sequences in the same state together.  The plan is a table of runs: from which rank of a length on which
sequences are filled.  Pieces get their rank within their length by counts of each task and look their run up.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webquarry.llm.bpe import ROW_BYTES, WordBpe
from webquarry.llm.common import narrowed, span_hashes, steps, word_spans, written

CAPACITY = 4096
END = 1
#: Chunks between blanks that a worker keeps with their ids; beyond, the memory starts anew.
CACHE_CHUNKS = 600_000
#: Bits for the rank within a length in the keys that are searched.
RANK_BITS = 44
#: Marks that are a word of their own behind letters, and what the short way for Latin letters does not take.
_MARKS = ".,;:!?"
_BEYOND_LATIN = regex.compile(r"[^\u0000-\u00FF]")
#: Code points on which all tables agree with the library's (tested one by one); chunks with others go through the library itself.
_OTHER = regex.compile(r"[^\u0000-\u052F\u2000-\u206F\u3040-\u30FF\u4E00-\u9FFF\uAC00-\uD7A3]")


class ChunkBpe:
    """Ids of texts chunk by chunk between ASCII blanks, which no token crosses; every distinct chunk is encoded once.

    Chunks are known by 64-bit hashes of their bytes: two of a million different ones share theirs with a probability below 0.0000001.
    """

    def __init__(self, raw: bytes):
        self.model, self.library = WordBpe(raw), Tokenizer.from_str(raw.decode())
        self.library.no_truncation()
        self.library.no_padding()
        self._forget()

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.starts, self.sizes, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _words(self, chunk: str) -> tuple[str, ...] | list[str]:
        """The words of a chunk; Latin letters with or without marks behind them need no pattern."""
        core = chunk.rstrip(_MARKS)
        if core.isalpha() and (chunk.isascii() or not _BEYOND_LATIN.search(chunk)):
            return (core.lower(), chunk[len(core) :]) if len(core) < len(chunk) else (core.lower(),)
        return self.model.words(chunk)

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, joined, and their numbers; words of like length step together as the rows of one array."""
        raws = [w.encode() for w in words]
        n = np.fromiter(map(len, raws), np.int64, len(raws))
        special = {i: [self.model.special[w]] for i, w in enumerate(words) if w in self.model.special}
        single = {i: self.model.merge_long(raws[i]) for i in np.flatnonzero(n > ROW_BYTES).tolist()} | special
        counts, parts, order = np.zeros(len(words), np.int64), [], []
        low = 1
        for high in (6, 10, 16, ROW_BYTES):
            some = np.flatnonzero((n >= low) & (n <= high))
            low = high + 1
            for chunk in (some[a : a + 20_000] for a in range(0, len(some), 20_000)):
                rows = np.full((len(chunk), high), -1, np.int32)
                data = np.frombuffer(b"".join([raws[i] for i in chunk.tolist()]), np.uint8)
                rows[np.arange(high)[None, :] < n[chunk][:, None]] = self.model.inner[data]
                rows[np.arange(len(chunk)), n[chunk] - 1] = self.model.last[data[np.cumsum(n[chunk]) - 1]]
                rows = self.model.merge_rows(rows)
                real = rows >= 0
                real[[k for k, i in enumerate(chunk.tolist()) if i in single]] = False
                counts[chunk] = real.sum(axis=1)
                parts.append(rows[real])
                order.append(chunk)
        for i, ids in single.items():
            counts[i] = len(ids)
            parts.append(np.array(ids, np.int32))
            order.append(np.array([i]))
        pool = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        starts = np.zeros(len(words), np.int64)
        if order:  # a special word stands in its row's chunk with nothing and behind with its id, where it stays
            at = np.concatenate(order)
            size = counts[at]
            size[: len(at) - len(single)][np.isin(at[: len(at) - len(single)], list(single))] = 0
            starts[at] = np.cumsum(size) - size
        return gathered(pool, starts, counts), counts

    def _learn(self, new: list[str]) -> None:
        rare = {i: self.library.encode(c, add_special_tokens=False).ids for i, c in enumerate(new) if not c.isascii() and _OTHER.search(c)}
        listed = [() if i in rare else self._words(c) for i, c in enumerate(new)] if rare else list(map(self._words, new))
        place: dict[str, int] = {}
        flat = np.array([place.setdefault(w, len(place)) for words in listed for w in words], np.int64)
        ids, counts = self._merged(list(place))
        starts = np.cumsum(counts) - counts
        per_word = counts[flat]
        sizes = np.diff(np.concatenate([[0], np.cumsum(per_word)])[np.cumsum([0, *map(len, listed)])])
        pools = [self.pool, gathered(ids, starts[flat], per_word)]
        begins = len(self.pool) + np.cumsum(sizes) - sizes
        end = len(self.pool) + len(pools[1])
        for i, own in rare.items():
            begins[i], sizes[i] = end, len(own)
            pools.append(np.array(own, np.int32))
            end += len(own)
        self.starts, self.sizes = np.concatenate([self.starts, begins]), np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate(pools).astype(np.int32)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as UTF-8 bytes with n + 1 bounds, and the n + 1 bounds of the ids."""
        start, end, first = word_spans(data, at)
        keys, one, where = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) > CACHE_CHUNKS:
            self._forget()
        listed = keys.tolist()
        place = np.fromiter((self.known.get(k, -1) for k in listed), np.int64, len(listed))
        new = np.flatnonzero(place < 0)
        if len(new):
            raw, n = data.tobytes(), len(self.known)
            self._learn([raw[a:b].decode() for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())])
            place[new] = np.arange(n, n + len(new))
            self.known.update(zip(keys[new].tolist(), place[new].tolist()))
        place = place[where]
        sizes = self.sizes[place]
        return gathered(self.pool, self.starts[place], sizes), np.concatenate([[0], np.cumsum(sizes)])[first]


def gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `pool` one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


_MODELS: dict[int, ChunkBpe] = {}


def _model(raw: bytes) -> ChunkBpe:
    if hash(raw) not in _MODELS:
        _MODELS.clear()
        _MODELS[hash(raw)] = ChunkBpe(raw)
    return _MODELS[hash(raw)]


def _cut(ids: np.ndarray, bounds: np.ndarray, capacity: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids with the end mark, and of every piece: document, number, start in the document, place in the ids."""
    n = np.diff(bounds)
    out = np.full(len(ids) + len(n), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    pieces = -(-(n + 1) // capacity)
    doc = np.repeat(np.arange(len(n)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = number * capacity
    return out, doc, number, start, start + (bounds[:-1] + np.arange(len(n)))[doc]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids binary) of every piece; ids as little-endian unsigned 32-bit numbers.

    A document is the ids of its whole text (null: none) and `end`; documents beyond `capacity` are cut there.  `path` names the
    tokenizer file, which the driver reads and sends to the workers.  Repeated rows stay repeated; other columns are left out.
    No shuffle; memory is bounded by a step of about 1 MB of text (or one longer document) and the memory of chunks.
    """
    rows = narrowed(docs, key, text)
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file.value)
        for part, data, bounds in steps(batches):
            ids, doc, number, start, at = _cut(*model.encode(data, bounds), capacity, end)
            raw, bounds = ids.astype("<u4").tobytes(), np.append(at, len(ids))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(np.diff(bounds)), pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids binary")


class Plan:
    """Runs of ranks: pieces `rank`, `rank` + 1, ... of a length fill sequences `first`, `first` + 1, ... with `each` of them from `offset` on."""

    def __init__(self, counts: np.ndarray, capacity: int):
        """`counts[l]` pieces of length l."""
        self.capacity, self.left, self.taken = capacity, counts.astype(object), [0] * len(counts)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences, self.fixed = 0, 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()
        self.runs.sort()

    def _place(self, length: int, first: int, times: int, each: int, offset: int) -> None:
        self.runs.append((length, self.taken[length], first, each, offset))
        self.taken[length] += times * each
        self.left[length] -= times * each

    # reduction

    def dominant(self, j: int) -> dict[int, int] | None:
        """The set with a piece of length j that dominates every other one, as lengths with their numbers; None where that is not proven.

        A set dominates another if the other's pieces can be dealt into groups, each no longer than a piece of its own.
        """
        here = self.lengths
        room = self.capacity - j
        single = self.left[j] == 1  # then no further piece of this length
        top = bisect_left(here, room + 1)
        least: list[int] = []
        for x in here[:4]:
            least += [x] * int(min(3, self.left[x] - (x == j)))
        if not least or least[0] > room:
            return {j: 1}
        k = here[top - 1]
        if k == j and single:
            k = here[top - 2]  # exists, as the shortest fits
        pair = {j: 2} if k == j else {j: 1, k: 1}
        if k == room or len(least) < 2 or sum(least[:2]) > room:
            return pair  # all that can go with j fits in place of k
        if len(least) > 2 and sum(least[:3]) <= room:
            return None
        other = {x: int(self.left[x]) - (x == j) for x in here[:top]}
        fits = [x for x in here[:top] if other[x]]
        best, inner = 0, 0  # the longest pair, and the longest shorter piece of a pair
        for i, x in enumerate(fits):
            if (n := bisect_left(fits, room - x + 1)) and (n - 1 != i or other[x] > 1 or n > 1):
                y = fits[n - 1] if n - 1 != i or other[x] > 1 else fits[n - 2]
                best = max(best, x + y)
            mate = x if other[x] > 1 else fits[i + 1] if i + 1 < len(fits) else room
            if x + mate <= room:
                inner = max(inner, x)
        if k >= best:
            return pair  # no pair is longer than k
        second = [x for x in fits[: bisect_left(fits, room - k + 1)] if x != k or other[x] > 1]
        if second and inner <= second[-1]:  # of every pair the longer goes for k, the shorter for the second
            out = dict(pair)
            out[second[-1]] = out.get(second[-1], 0) + 1
            return out
        return None

    def _reduce(self) -> None:
        self.lengths = [l for l in range(1, self.capacity + 1) if self.left[l] > 0]
        again = True
        while again:
            again = False
            for j in self.lengths[::-1]:
                while self.left[j] > 0 and (found := self.dominant(j)):
                    times = min(self.left[l] // n for l, n in found.items())
                    offset = 0
                    for l, n in found.items():
                        self._place(l, self.sequences, times, n, offset)
                        offset += n * l
                    self.sequences += times
                    again = True
                    for l in found:
                        if not self.left[l]:
                            del self.lengths[bisect_left(self.lengths, l)]

    # best fit

    def _best_fit(self) -> None:
        """Longest first into the sequence with the least room that is enough; sequences with the same room are ranges of numbers."""
        rooms: list[int] = []
        open_: dict[int, list[tuple[int, int]]] = {}

        def put(room: int, first: int, times: int) -> None:
            if room and times:
                if room not in open_:
                    insort(rooms, room)
                open_.setdefault(room, []).append((first, times))

        for l in range(self.capacity, 0, -1):
            while self.left[l] > 0:
                at = bisect_left(rooms, l)
                if at < len(rooms):
                    room = rooms[at]
                    first, times = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                else:
                    room = self.capacity
                    first, times = self.sequences, -(-self.left[l] // (room // l))
                    self.sequences += times
                each = room // l
                full = min(times, self.left[l] // each)
                if full:
                    self._place(l, first, full, each, self.capacity - room)
                    put(room - each * l, first, full)
                if full < times and self.left[l] > 0:
                    rest = self.left[l]
                    self._place(l, first + full, 1, rest, self.capacity - room)
                    put(room - rest * l, first + full, 1)
                    full += 1
                put(room, first + full, times - full)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Search keys (length and first rank), first sequence, pieces a sequence, offset.

        A sequence's room at least halves whenever a length fills it, and every length starts three ranges of equal sequences at most, so
        there are no more than some capacity * log2(capacity) runs, however many pieces.
        """
        table = np.array(self.runs, np.int64).reshape(-1, 5)
        return table[:, 0] << RANK_BITS | table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return looked_up(self.arrays(), length, rank)


def looked_up(runs: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces given by length and rank."""
    keys, first, each, offset = runs
    at = np.searchsorted(keys, length << RANK_BITS | rank, "right") - 1
    i = rank - (keys[at] & ((1 << RANK_BITS) - 1))
    return first[at] + i // each[at], offset[at] + i % each[at] * length


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and the rank of each row among the task's rows of its length."""
    task, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for batch in batches:
        length = batch.column(0).to_numpy(zero_copy_only=False)
        order = np.argsort(length, kind="stable")
        by = length[order]
        starts = np.flatnonzero(np.append(True, by[1:] != by[:-1])) if len(by) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(by)))
        if len(by) and by[-1] >= len(seen):
            seen = np.concatenate([seen, np.zeros(by[-1] + 1 - len(seen), np.int64)])
        place = np.empty(len(by), np.int64)
        place[order] = np.arange(len(by)) - np.repeat(starts, sizes) + seen[by]
        seen[by[starts]] += sizes
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(by), task, np.int32)), pa.array(place)], names=["length", "row", "task", "place"])


def packed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of `pieces` with `sequence_id` and `offset`: as few sequences of at most `capacity` tokens as the method finds, without gaps.

    `length` is a whole number from 1 to `capacity`; rows with another length or none end the job with an error.  Other columns go
    along as they are (leave the ids behind where they are not needed); columns named like the two new ones are replaced.  Repeated rows are
    pieces of their own; an empty table gives none.  The rows are written to the shared folder with a rank of their own task; what is
    shuffled is one join on (length, task), so a length that a third of all pieces have is as many groups as tasks.  The driver gets a
    histogram of at most `capacity` rows, tasks a plan of bounded size.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    bad = F.col("length").isNull() | (F.col("length") < 1) | (F.col("length") > capacity)
    checked = F.when(bad, F.raise_error(F.lit(f"lengths must lie between 1 and {capacity}"))).otherwise(F.col("length")).cast("long")
    rows = pieces.select(checked.alias("length"), F.struct(*[f"`{c}`" for c in names]).alias("row"))
    kind = rows.schema["row"].dataType.simpleString()
    numbered = written(rows.mapInArrow(_numbered, f"length long, row {kind}, task int, place long"), "pieces")
    tallies = numbered.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in tallies.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    runs = pieces.sparkSession.sparkContext.broadcast(Plan(counts, capacity).arrays())
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    ranked = numbered.join(tallies.select("length", "task", before.alias("before")), ["length", "task"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, row, rank = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            sequence, offset = looked_up(runs.value, length, rank)
            yield pa.RecordBatch.from_arrays([row, pa.array(sequence), pa.array(offset)], names=["row", "sequence_id", "offset"])

    placed = ranked.select("length", "row", F.expr("before + place").alias("rank")).mapInArrow(run, f"row {kind}, sequence_id long, offset long")
    return placed.select("row.*", "sequence_id", "offset")


def sequences(placed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, n_tokens, ids array<long>) of packed pieces that carry their `ids`: what a training run reads.  A sequence is one bounded row."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = placed.groupBy("sequence_id").agg(joined.alias("parts"), F.sum("length").alias("n_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [b"".join(p["ids"] for p in parts) for parts in batch.column(2).to_pylist()]
            ids = pa.array([np.frombuffer(r, "<u4").astype(np.int64) for r in raws], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["sequence_id", "n_tokens", "ids"])

    return rows.select("sequence_id", "n_tokens", "parts").mapInArrow(run, "sequence_id long, n_tokens long, ids array<long>")
