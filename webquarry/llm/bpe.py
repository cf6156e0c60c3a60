"""BPE encoding and decoding with a contiguous rank array per word.

A word is a row of part ids and the ranks of its adjacent pairs.  The row is scanned for its least rank,
that boundary is deleted, the rest moves up and the two neighbouring ranks are looked up again, until no
pair has a rank.  Many distinct words step together as the rows of one array.  Words longer than
ROW_BYTES, for which repeated scans would be slow, go through a heap with the same result.
"""

from __future__ import annotations

import heapq
import itertools
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from tokenizers import Regex, normalizers, pre_tokenizers

from webquarry.llm.common import narrowed, steps

ROW_BYTES = 32
#: Words kept with their ids per Python worker; beyond, the memory starts anew.
CACHE_WORDS = 200_000
_NONE = np.int32(np.iinfo(np.int32).max)


def byte_letters() -> dict[int, str]:
    """The printable letter for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


class WordBpe:
    """A tokenizer file of the kind byte-level BPE with word ends, lower case, white space dropped.

    Raises ValueError where the file asks for steps that are not covered.
    """

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [p["type"] for p in splits] != ["Split", "ByteLevel"]:
            raise ValueError("only NFC, white space and lower case, then a split into byte-level words is covered")
        if spec.get("decoder") or spec.get("post_processor") or model.get("continuing_subword_prefix") or model.get("unk_token"):
            raise ValueError("decoders, post-processors, prefixes and unknown tokens are not covered")
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        pattern = splits[0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.seen: set[str] = set()
        self.strange: set[str] = set()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        letters, end = byte_letters(), model["end_of_word_suffix"] or ""
        self.inner = np.array([self.vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([self.vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made_by_rank = keys[order], order.astype(np.int32), made
        self.table = {int(k): r for r, k in enumerate(keys)}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes, self.pool, self.filled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), 0

    # words of a text

    def words(self, text: str) -> list[str]:
        if self.cut is None or "<" not in text:
            return self._plain(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            out.extend([part] if k % 2 else self._plain(part))
        return out

    def _plain(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Unicode tables of different ages agree on most letters; stretches between spaces with a code point on which they
        may not are normalised and split by the library whose tables count.
        """
        if text.isascii():
            return self.find(text.lower())
        letters = set(text)
        self.strange.update(filter(self._strange, letters - self.seen))
        self.seen |= letters
        if self.strange.isdisjoint(letters):
            return self._known_letters(text)
        out: list[str] = []
        for rare, parts in itertools.groupby(text.split(" "), key=lambda part: not self.strange.isdisjoint(part)):
            normal, split = self.library
            out += [w for part in parts for w, _ in split.pre_tokenize_str(normal.normalize_str(part))] if rare else self._known_letters(" ".join(parts))
        return out

    def _strange(self, c: str) -> bool:
        """A code point that Python's tables do not know, or a mark whose class the library's do not."""
        probe = f"x\u0323{c}\u0334"  # marks of the classes 220 and 1 around it
        return unicodedata.category(c) == "Cn" or unicodedata.combining(c) > 0 and unicodedata.normalize("NFC", probe) != self.library[0].normalize_str(probe)

    def _known_letters(self, text: str) -> list[str]:
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    # merges

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], _NONE)

    def merge_rows(self, parts: np.ndarray) -> np.ndarray:
        """Rows of part ids, -1 behind the end, merged in step."""
        out = np.full_like(parts, -1)
        live = np.arange(len(parts))
        ranks = self._rank(parts[:, :-1], parts[:, 1:])
        while len(live):
            at = ranks.argmin(axis=1)
            row = np.arange(len(live))
            least = ranks[row, at]
            done = least == _NONE
            if done.any():
                out[live[done], : parts.shape[1]] = parts[done]
                keep = ~done
                live, parts, ranks, at, least = live[keep], parts[keep], ranks[keep], at[keep], least[keep]
                row = np.arange(len(live))
                if not len(live):
                    break
            wide = np.arange(parts.shape[1] - 1)
            parts[row, at] = self.made_by_rank[least]
            moved = parts[:, 1:].copy()
            behind = wide[None, :] > at[:, None]
            parts[:, :-1] = np.where(behind, moved, parts[:, :-1])
            parts[:, -1] = -1
            ranks[:, :-1] = np.where(wide[None, :-1] >= at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            beyond = np.minimum(at + 1, parts.shape[1] - 1)
            ranks[row, np.minimum(at, ranks.shape[1] - 1)] = self._rank(parts[row, at], np.where(at + 1 < parts.shape[1], parts[row, beyond], -1))
            before = np.maximum(at - 1, 0)
            ranks[row, before] = np.where(at > 0, self._rank(parts[row, before], parts[row, at]), ranks[row, before])
        return out

    def merge_long(self, raw: bytes) -> list[int]:
        """The same merges for one long word, through a heap of (rank, place)."""
        ids = [*self.inner[np.frombuffer(raw[:-1], np.uint8)].tolist(), int(self.last[raw[-1]])]
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.table.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.made_by_rank[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] >= 0 and (r := self.table.get(ids[a] << 32 | ids[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[after[a]]))
        return [i for i in ids if i >= 0]

    def learn(self, words: list[str]) -> None:
        """Encodes words that are not known yet and keeps them."""
        raws = [w.encode() for w in words]
        found: list = [None] * len(words)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        low = 1
        for high in (8, 16, ROW_BYTES):
            some = np.flatnonzero((sizes >= low) & (sizes <= high))
            low = high + 1
            for chunk in np.array_split(some, max(1, len(some) // 20_000)):
                if not len(chunk):
                    continue
                data = np.frombuffer(b"".join(raws[i] for i in chunk), np.uint8)
                n = sizes[chunk]
                inside = np.arange(high)[None, :] < n[:, None]
                parts = np.full((len(chunk), high), -1, np.int32)
                parts[inside] = self.inner[data]
                ends = np.cumsum(n) - 1
                parts[np.arange(len(chunk)), n - 1] = self.last[data[ends]]
                merged = self.merge_rows(parts)
                for i, ids in zip(chunk, merged):
                    found[i] = ids[ids >= 0]
        for i in np.flatnonzero(sizes > ROW_BYTES):
            found[i] = np.array(self.merge_long(raws[i]), np.int32)
        for i, w in enumerate(words):
            if w in self.special:
                found[i] = np.array([self.special[w]], np.int32)
        counts = np.fromiter(map(len, found), np.int64, len(found))
        base = len(self.known)
        self.known.update(zip(words, range(base, base + len(words))))
        self.starts = np.concatenate([self.starts, self.filled + np.cumsum(counts) - counts])
        self.sizes = np.concatenate([self.sizes, counts])
        self.pool = np.concatenate([self.pool[: self.filled], *found]).astype(np.int32)
        self.filled = len(self.pool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, joined, and the n + 1 bounds."""
        listed = [self.words(t) for t in texts]
        flat = [w for words in listed for w in words]
        if len(self.known) > CACHE_WORDS:
            self._forget()
        new = list(set(flat).difference(self.known))
        if new:
            self.learn(new)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        sizes = self.sizes[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        ids = self.pool[np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(ends[-1])] if len(at) else np.zeros(0, np.int32)
        per_text = np.cumsum([0, *map(len, listed)])
        return ids, np.concatenate([[0], ends])[per_text]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The names of each text's ids, joined by a space; the file names no decoder."""
        names = [self.names[i] for i in ids.tolist()]
        return [" ".join(names[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


_LOADED: dict[int, WordBpe] = {}


def _model(file: Broadcast) -> WordBpe:
    raw = file.value
    if hash(raw) not in _LOADED:
        _LOADED.clear()
        _LOADED[hash(raw)] = WordBpe(raw)
    return _LOADED[hash(raw)]


def _mapped(df: DataFrame, path: str, schema: str, make: Callable[[WordBpe, pa.RecordBatch], dict]) -> DataFrame:
    with open(path, "rb") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file)
        for batch in batches:
            yield pa.RecordBatch.from_pydict(make(model, batch))

    return df.mapInArrow(run, schema)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row.

    `path` names the tokenizer file, read by the driver and sent to the workers.  Null texts count as
    empty and give no ids; repeated rows stay repeated; other columns are left out.  Strings of special
    tokens in a text become their ids, as the file's library has it.  No shuffle; memory is bounded by a
    step of about 1 MB of text (or one longer document) and the word memory.
    """
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(file)
        for rows, _, _ in steps(batches):
            ids, bounds = model.encode(_texts(rows))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), pa.array(model.decode(ids, bounds), pa.string())],
                names=["doc_id", "ids", "decoded"],
            )

    kept = narrowed(docs, key, text)
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row; nulls and repeated rows as in `round_trip`."""

    def make(model: WordBpe, batch: pa.RecordBatch) -> dict:
        ids, bounds = model.encode(_texts(batch))
        return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))}

    kept = narrowed(docs, key, text)
    return _mapped(kept, path, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with an id array; a null array gives an empty text."""

    def make(model: WordBpe, batch: pa.RecordBatch) -> dict:
        lists = [x or [] for x in batch.column("ids").to_pylist()]
        bounds = np.cumsum([0, *map(len, lists)])
        flat = np.array([i for x in lists for i in x], np.int32)
        return {"doc_id": batch.column("doc_id"), "text": pa.array(model.decode(flat, bounds), pa.string())}

    kept = encoded.selectExpr(f"`{key}` AS doc_id", f"`{ids}` AS ids")
    return _mapped(kept, path, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, text string", make)
