"""Removal of repeated byte strings by bucket-pointer refinement over anchored suffixes.

A string of LENGTH bytes has one anchor: of its Q-grams the one with the least hash, leftmost on ties.  It
depends on the string alone, so equal strings share the anchor's Q-gram and its place.  The Q-grams at
anchors are the first buckets; only buckets that reach two documents go on.  There the text around the anchor
is refined: identifiers of 8 bytes are joined with the identifiers 8, 16 and 18 places later, each level
reusing the one before, until they stand for LENGTH bytes; sorting on them gives for each string the
smallest document that holds it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import U, mix, narrowed, steps, width

LENGTH = 50
Q = 20
BACK = LENGTH - Q
CONTEXT = BACK + LENGTH
SEGMENT = 1 << 20
PLACE = U((1 << 21) - 1)
#: Anchors that a task gathers before it combines and sends them.
GATHER = 1 << 19
#: Bytes of text for each group of buckets.
GROUP_BYTES = 8 << 20
#: (Document, bucket) pairs of one row on their way to the documents.
RUN = 4096


def anchors(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts joined in `data` with bounds `at`: place, Q-gram hash, first and last string start, and text of every anchor."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none.astype(U), none, none, none
    eight = np.ndarray((n - 7,), "<u8", buffer=np.ascontiguousarray(data), strides=(1,)).copy()
    h = eight[: n - Q + 1] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h += eight[8 : n - Q + 9]
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h += eight[12 : n - Q + 13]
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(32)
    least = (h & ~PLACE) | np.arange(len(h), dtype=U)
    for step in (1, 2, 4, 8, BACK + 1 - 16):
        least = np.minimum(least[:-step], least[step:])
    valid = np.zeros(len(least), bool)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo >= LENGTH:
            valid[lo : hi - LENGTH + 1] = True
    p = np.flatnonzero(valid)
    if not len(p):
        return none, none.astype(U), none, none, none
    place = (least[p] & PLACE).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(first[1:], len(p)) - 1
    a = place[first]
    return a, mix(h[a]), p[first], p[last], np.searchsorted(at, a, "right") - 1  # mixed, as a least hash is small


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Steps, where a long document comes in segments that overlap by LENGTH - 1 bytes; the last entry is the segment's offset."""
    for rows, data, at in steps(batches):
        if len(data) <= SEGMENT + LENGTH:
            yield rows, data, at, 0
            continue
        for lo in range(0, len(data), SEGMENT):  # more than a step is one document
            part = data[lo : lo + SEGMENT + LENGTH - 1]
            yield rows, part, np.array([0, len(part)]), lo


def _pack40(h: np.ndarray) -> bytes:
    """40 bits of each hash; the group of buckets, of bounded size, stands for others, and contexts are compared afterwards."""
    return np.ascontiguousarray(np.ascontiguousarray(h, U).view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unpack40(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view(U)


def _pack_ids(ids: np.ndarray) -> tuple[int, bytes]:
    """Ids as offsets from the least, in 4 bytes each where they fit."""
    base = int(ids.min())
    spread = int(ids.max()) - base
    return (base, (ids - base).astype(np.uint32).tobytes()) if spread < 1 << 32 else (0, ids.astype(np.int64).tobytes())


def _unpack_ids(base: int, raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint32).astype(np.int64) + base if len(raw) == 4 * n else np.frombuffer(raw, np.int64)


def _part(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U(32)) * U(parts) >> U(32)).astype(np.int64)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal values."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _by_doc(docs: np.ndarray, pack) -> Iterator[tuple[int, bytes]]:
    """(document, packed entries) for each document, `pack` taking the places of its entries."""
    if not len(docs):
        return
    order = np.argsort(docs, kind="stable")
    bounds = _runs(docs[order])
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield int(docs[order[lo]]), pack(order[lo:hi])


def _home(docs: np.ndarray, parts: int) -> np.ndarray:
    """The part to which what a document is told goes."""
    return _part(mix(docs.astype(U) * U(0x9E3779B97F4A7C15)), parts)


def _packed_pairs(docs: np.ndarray, h: np.ndarray, parts: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(part, base, documents, hashes): the pairs of one part in runs, so that rows follow pairs and not documents."""
    home = _home(docs, parts)
    order = np.lexsort((docs, home))
    docs, h, home = docs[order], h[order], home[order]
    cut = _runs(home)
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
        for a in range(lo, hi, RUN):
            b = min(a + RUN, hi)
            base, ids = _pack_ids(docs[a:b])
            yield int(home[a]), base, ids, _pack40(h[a:b])


_ASKS = pa.schema([("part", pa.int32()), ("told", pa.bool_()), ("hashes", pa.binary()), ("base", pa.int64()), ("docs", pa.binary()), ("known", pa.binary())])


def _asks(parts: int):
    """Buckets of each task: the smallest document of every bucket, and what the task already knows to be shared."""

    def flush(h: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
        h, d = h[new], d[new]
        bounds = _runs(h)
        lead, size = bounds[:-1], np.diff(bounds)
        rows: list[tuple] = []
        several = np.repeat(size > 1, size)
        for home, base, ids, raw in _packed_pairs(d[several], h[several], parts):
            rows.append((home, True, raw, base, ids, b""))
        h, d, known = h[lead], d[lead], size > 1
        part = _part(h, parts)
        cut = _runs(part)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            base, ids = _pack_ids(d[lo:hi])
            rows.append((int(part[lo]), False, _pack40(h[lo:hi]), base, ids, np.packbits(known[lo:hi]).tobytes()))
        for k in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 4096]), _ASKS)], schema=_ASKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, ds, n = [], [], 0
        for rows, data, at, _ in _segments(batches):
            _, h, _, _, doc = anchors(data, at)
            hs.append(h)
            ds.append(rows.column("doc_id").to_numpy(zero_copy_only=False)[doc])
            n += len(h)
            if n >= GATHER:
                yield from flush(np.concatenate(hs), np.concatenate(ds))
                hs, ds, n = [], [], 0
        if n:
            yield from flush(np.concatenate(hs), np.concatenate(ds))

    return run


_TOLD = pa.schema([("part", pa.int32()), ("base", pa.int64()), ("docs", pa.binary()), ("hashes", pa.binary())])
_SHARED = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])


def _answers(parts: int):
    """The buckets of one group that reach two documents, packed by the parts of the documents that asked."""

    def run(group: pa.Table) -> pa.Table:
        told_h, told_d, hs, ds, ks = [], [], [], [], []
        for told, raw, base, ids, known in zip(*(group.column(c).to_pylist() for c in ("told", "hashes", "base", "docs", "known"))):
            h = _unpack40(raw)
            d = _unpack_ids(base, ids, len(h))
            if told:
                told_h.append(h)
                told_d.append(d)
                continue
            hs.append(h)
            ds.append(d)
            ks.append(np.unpackbits(np.frombuffer(known, np.uint8), count=len(h)).astype(bool))
        if hs:
            h, d, k = np.concatenate(hs), np.concatenate(ds), np.concatenate(ks)
            order = np.argsort(h, kind="stable")
            h, d, k = h[order], d[order], k[order]
            size = np.diff(_runs(h))
            ask = np.repeat(size > 1, size) & ~k
            told_h.append(h[ask])
            told_d.append(d[ask])
        rows = list(_packed_pairs(np.concatenate(told_d), np.concatenate(told_h), parts)) if told_h else []
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), _TOLD)], schema=_TOLD) if rows else _TOLD.empty_table()

    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The packed pairs of a part, unpacked to one row for each document of a gathering."""

    def flush() -> Iterator[pa.RecordBatch]:
        d, h = np.concatenate(ds), np.concatenate(hs)
        out = list(_by_doc(d, lambda i: _pack40(h[i])))
        for k in range(0, len(out), RUN):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + RUN]), _SHARED)], schema=_SHARED)

    ds, hs, n = [], [], 0
    for batch in batches:
        for base, ids, raw in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("base", "docs", "hashes"))):
            hs.append(_unpack40(raw))
            ds.append(_unpack_ids(base, ids, len(hs[-1])))
            n += len(hs[-1])
            if n >= 2 * GATHER:
                yield from flush()
                ds, hs, n = [], [], 0
    if n:
        yield from flush()


#: `tag` is a checksum of the row's text, as rows with one key may hold different texts.
_ENTRY = np.dtype([("at", "<i8"), ("doc", "<i8"), ("tag", "<u4"), ("lo", "u1"), ("hi", "u1"), ("ctx", "u1", CONTEXT)])
_CUT = np.dtype([("at", "<i8"), ("mask", "<u4"), ("tag", "<u4")])
_CONTEXTS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("entries", pa.binary())])
_CUTS = pa.schema([("doc_id", pa.int64()), ("at", pa.int64()), ("mask", pa.int64()), ("tag", pa.int64())])


def _mask(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bits hi..lo: all starts of an anchor, counted back from it."""
    return (((U(1) << (lo.astype(U) + U(1))) - U(1)) & ~((U(1) << hi.astype(U)) - U(1))).astype(np.uint32)


def _cut_rows(e: np.ndarray) -> Iterator[tuple[int, bytes]]:
    cuts = np.zeros(len(e), _CUT)
    cuts["at"], cuts["tag"], cuts["mask"] = e["at"], e["tag"], _mask(e["lo"], e["hi"])
    return _by_doc(e["doc"], lambda i: cuts[i].tobytes())


def _pack_entries(e: np.ndarray) -> bytes:
    """Column by column and compressed, as most of it is text."""
    return len(e).to_bytes(4, "little") + pa.compress(b"".join(e[name].tobytes() for name in _ENTRY.names), codec="zstd", asbytes=True)


def _unpack_entries(raw: bytes) -> np.ndarray:
    out, at = np.zeros(int.from_bytes(raw[:4], "little"), _ENTRY), 0
    raw = pa.decompress(raw[4:], decompressed_size=len(out) * _ENTRY.itemsize, codec="zstd", asbytes=True)
    for name in _ENTRY.names:
        field = _ENTRY[name]
        out[name] = np.frombuffer(raw, field.base, len(out) * (field.itemsize // field.base.itemsize), at).reshape(out[name].shape)
        at += len(out) * field.itemsize
    return out


def _context_key(e: np.ndarray) -> np.ndarray:
    """64 bits for starts and context of each entry; the context holds the bucket's Q-gram."""
    key = mix((e["lo"].astype(U) << U(8)) ^ e["hi"].astype(U))
    words = np.ascontiguousarray(e["ctx"]).view("<u8")
    for k in range(words.shape[1]):
        key = mix(key * U(0x9E3779B97F4A7C15) + words[:, k])
    return key


def _contexts(parts: int):
    """The text around the shared anchors, once for each different context of a task."""

    def flush(e: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        key = _context_key(e)
        order = np.lexsort((e["doc"], key))
        e, h, key = e[order], h[order], key[order]
        bounds = _runs(key)
        least = np.repeat(e["doc"][bounds[:-1]], np.diff(bounds))
        beyond = e["doc"] > least
        rest = e[beyond]
        rows: list[tuple] = [(hash(doc) % parts, doc, raw) for doc, raw in _cut_rows(rest)]
        e = e[~beyond]
        part = _part(h[~beyond], parts)
        order = np.argsort(part, kind="stable")
        e, part = e[order], part[order]
        cut = _runs(part)
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            rows.append((int(part[lo]), None, _pack_entries(e[lo:hi])))
        for k in range(0, len(rows), 1024):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 1024]), _CONTEXTS)], schema=_CONTEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, hs, n = [], [], 0
        for rows, data, at, offset in _segments(b for b in (b.filter(b.column("shared").is_valid()) for b in batches) if b.num_rows):
            a, h, first, last, doc = anchors(data, at)
            if not len(a):
                continue
            told = [np.concatenate([_unpack40(x) for x in lists]) for lists in rows.column("shared").to_pylist()]
            owner = np.repeat(np.arange(len(told)), [len(x) for x in told])
            salt = lambda i: (i.astype(U) + U(1)) * U(0xD6E8FEB86659FD93)
            hit = np.flatnonzero(np.isin(mix((h & U((1 << 40) - 1)) ^ salt(doc)), mix(np.concatenate(told) ^ salt(owner))))
            e = np.zeros(len(hit), _ENTRY)
            a, first, last = a[hit], first[hit], last[hit]
            padded = np.concatenate([np.zeros(BACK, np.uint8), data, np.zeros(LENGTH, np.uint8)])
            place = np.arange(CONTEXT, dtype=np.int32)[None, :] - BACK
            inside = (place >= (first - a)[:, None]) & (place < (last - a)[:, None] + LENGTH)
            e["ctx"] = np.lib.stride_tricks.sliding_window_view(padded, CONTEXT)[a] * inside
            e["lo"], e["hi"], e["at"] = a - first, a - last, a - at[doc[hit]] + offset
            e["doc"] = rows.column("doc_id").to_numpy(zero_copy_only=False)[doc[hit]]
            e["tag"] = rows.column("tag").to_numpy(zero_copy_only=False).astype(np.uint32)[doc[hit]]
            held.append(e)
            hs.append(h[hit])
            n += len(e)
            if n * 8 >= GATHER:
                yield from flush(np.concatenate(held), np.concatenate(hs))
                held, hs, n = [], [], 0
        if n:
            yield from flush(np.concatenate(held), np.concatenate(hs))

    return run


def _identifiers(ctx: np.ndarray) -> np.ndarray:
    """For each context and each of its BACK + 1 places, the identifier of the LENGTH bytes from there."""
    n = len(ctx)
    out = np.zeros((n, BACK + 1), U)
    for lo in range(0, n, 4096):
        raw = np.ascontiguousarray(ctx[lo : lo + 4096])
        eight = np.ndarray((len(raw), CONTEXT - 7), "<u8", buffer=raw, strides=(CONTEXT, 1)).copy()
        join = lambda x, by: mix(mix(x[:, :-by]) * U(0x9E3779B97F4A7C15) + x[:, by:])
        out[lo : lo + 4096] = join(join(join(eight, 8), 16), LENGTH - 32)
    return out


def _refined(group: pa.Table) -> pa.Table:
    """Which strings of one group of buckets a smaller document holds too."""
    docs, cuts, held = [], [], []
    for doc, raw in zip(group.column("doc_id").to_pylist(), group.column("entries").to_pylist()):
        if doc is not None:
            cuts.append(np.frombuffer(raw, _CUT))
            docs.append(np.full(len(cuts[-1]), doc))
        else:
            held.append(_unpack_entries(raw))
    if held:
        e = np.concatenate(held)
        key = _context_key(e)
        order = np.lexsort((e["doc"], key))
        e, key = e[order], key[order]
        bounds = _runs(key)
        size = np.diff(bounds)
        lead = bounds[:-1]
        least = e["doc"][lead]
        starts = _identifiers(e["ctx"][lead])
        back = BACK - np.arange(BACK + 1)[None, :]  # place i of a context is the start BACK - i before the anchor
        valid = (back <= e["lo"][lead][:, None]) & (back >= e["hi"][lead][:, None])
        owner, place = np.nonzero(valid)
        ids = starts[owner, place]
        order = np.argsort(ids, kind="stable")
        runs = _runs(ids[order])
        least_here = np.repeat(np.minimum.reduceat(least[owner[order]], runs[:-1]), np.diff(runs))
        smaller = order[least_here < least[owner[order]]]
        mask = np.zeros(len(lead), np.uint64)
        np.bitwise_or.at(mask, owner[smaller], U(1) << (BACK - place[smaller]).astype(U))
        full = np.repeat(least, size) < e["doc"]
        mask = np.where(full, _mask(e["lo"], e["hi"]), np.repeat(mask, size).astype(np.uint32))
        some = mask > 0
        cuts.append(np.zeros(int(some.sum()), _CUT))
        cuts[-1]["at"], cuts[-1]["tag"], cuts[-1]["mask"] = e["at"][some], e["tag"][some], mask[some]
        docs.append(e["doc"][some])
    if not cuts:
        return _CUTS.empty_table()
    doc, cut = np.concatenate(docs), np.concatenate(cuts)
    return pa.table([pa.array(doc, pa.int64()), pa.array(cut["at"]), pa.array(cut["mask"].astype(np.int64)), pa.array(cut["tag"].astype(np.int64))], schema=_CUTS)


def _spans(at: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal removed runs, from anchors and the starts before them that are held elsewhere."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row, back = np.nonzero((mask[:, None] >> np.arange(BACK + 1)[None, :]) & 1)
    start = np.unique(at[row] - back)
    fresh = np.append(True, start[1:] > start[:-1] + LENGTH)
    first = np.flatnonzero(fresh)
    return start[first], start[np.append(first[1:], len(start)) - 1] + LENGTH


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, at in steps(batches):
        starts, ends, kept, bounds = [], [], [], [0]
        cuts = rows.column("cuts")
        cut = np.cumsum([0, *cuts.value_lengths().fill_null(0).to_pylist()])
        places, masks, tags = (np.asarray(cuts.flatten().field(name)) for name in ("at", "mask", "tag"))
        own = rows.column("tag").to_pylist()
        for i in range(rows.num_rows):
            raw = data[at[i] : at[i + 1]]
            mine = tags[cut[i] : cut[i + 1]] == own[i]
            s, e = _spans(places[cut[i] : cut[i + 1]][mine], masks[cut[i] : cut[i + 1]][mine])
            starts.append(s)
            ends.append(e)
            bounds.append(bounds[-1] + len(s))
            if len(s):
                stay = np.ones(len(raw), bool)
                for a, b in zip(s.tolist(), e.tolist()):
                    stay[a:b] = False
                raw = raw[stay]
            kept.append(raw.tobytes())
        spans = pa.StructArray.from_arrays([pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], names=["start", "end"])
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(np.array(bounds, np.int32)), spans), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<start, end>>, kept binary) of every row.

    Every byte covered by a string of 50 bytes that also starts in a document with a smaller key is
    removed; matches are judged on the input and never cross documents.  Null and short texts keep all they
    have.  Rows that share a key are one document's texts: they
    remove nothing from each other, and each loses what documents with smaller keys hold.  Rows with a null key are returned
    whole and remove nothing.  Kept bytes may split a character, so they are binary.  Other columns are left out.

    A task sends each bucket and each context once, for its smallest document; its other documents are told at once
    that it is shared.  So a passage that a third of all documents hold is one entry for each task's
    gathering.  What documents are told travels in runs by part.  Texts are shuffled by key once, to as many parts as
    their bytes ask for; both joins with them reuse that exchange.
    """
    rows = narrowed(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("long"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = width(docs, -(-total // GROUP_BYTES))
    named = rows.where("doc_id IS NOT NULL")
    asks = named.mapInArrow(_asks(parts), "part int, told boolean, hashes binary, base long, docs binary, known binary")
    answers = asks.groupBy("part").applyInArrow(_answers(parts), "part int, base long, docs binary, hashes binary")
    told = answers.repartition(parts, "part").mapInArrow(_told, "doc_id long, hashes binary")
    shared = told.repartition(parts, "doc_id").groupBy("doc_id").agg(F.collect_list("hashes").alias("shared"))  # as many as the document's own anchors
    placed = rows.withColumn("tag", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).repartition(parts, "doc_id")
    around = placed.join(shared, "doc_id", "left").select("doc_id", "text", "tag", "shared").mapInArrow(_contexts(parts), "part int, doc_id long, entries binary")
    refined = around.groupBy("part").applyInArrow(_refined, "doc_id long, at long, mask long, tag long").repartition(parts, "doc_id")
    cuts = refined.groupBy("doc_id").agg(F.collect_list(F.struct("at", "mask", "tag")).alias("cuts"))
    return placed.join(cuts, "doc_id", "left").select("doc_id", "text", "tag", "cuts").mapInArrow(_removed, "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary")
