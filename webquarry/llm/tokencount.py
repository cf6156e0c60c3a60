"""Token counts that follow edits: segment trees over runs of pre-tokens, re-encoding only what an edit touches.

A leaf is a run of whole pre-tokens: text is only cut between a character that is no white space and a space or line
break, where no pre-token can reach across.  Inner nodes hold sums of characters and tokens.  An edit is found by going
down the character sums; the leaves it touches, with neighbours while their border is no longer such a cut, are
encoded again, and the sums above them are updated.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import small_batches, steps

LEAF = 256
_CUT = re.compile(r"(?s).{%d}.*?\S(?=[ \n])|.+" % (LEAF - 1))


def leaves(text: str) -> list[str]:
    return _CUT.findall(text)


class CountTree:
    """The leaves of one document and, as an implicit binary tree, the sums of their characters and tokens."""

    def __init__(self, texts: Sequence[str], tokens: Sequence[int]):
        self.texts = list(texts) or [""]
        self.base = 1 << (len(self.texts) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.base), [0] * (2 * self.base)
        for i, t in enumerate(self.texts):
            self.chars[self.base + i] = len(t)
        self.tokens[self.base : self.base + len(tokens)] = list(tokens)
        for k in range(self.base - 1, 0, -1):
            self._sum(k)

    def _sum(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def text(self) -> str:
        return "".join(self.texts)

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds the character at `place` (the last one beyond the end) and where the leaf begins."""
        start, k = 0, 1
        if place >= self.n_chars:
            place = max(0, self.n_chars - 1)
        while k < self.base:
            k *= 2
            if place - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return min(k - self.base, len(self.texts) - 1), start

    def edit(self, at: int, delete: int, insert: str, count: Callable[[str], int]) -> int:
        """Replaces `delete` characters at `at` by `insert`; returns how many characters were encoded again."""
        at = min(max(at, 0), self.n_chars)
        delete = min(max(delete, 0), self.n_chars - at)
        if not delete and not insert:
            return 0
        i, start = self.leaf_at(at)
        j, _ = self.leaf_at(at + delete - 1) if delete else (i, start)
        whole = "".join(self.texts[i : j + 1])
        region = whole[: at - start] + insert + whole[at - start + delete :]
        while i > 0 and (not region or region[0] not in " \n"):
            i -= 1
            region = self.texts[i] + region
        while j + 1 < len(self.texts) and (not region or region[-1].isspace()):
            j += 1
            region += self.texts[j]
        pieces = leaves(region)
        room = j - i + 1
        if len(pieces) > room:
            pieces[room - 1 :] = ["".join(pieces[room - 1 :])]
        for k in range(room):
            piece = pieces[k] if k < len(pieces) else ""
            self.texts[i + k] = piece
            self.chars[self.base + i + k], self.tokens[self.base + i + k] = len(piece), count(piece) if piece else 0
        lo, hi = (self.base + i) // 2, (self.base + j) // 2
        while lo:
            for k in range(lo, hi + 1):
                self._sum(k)
            lo, hi = lo // 2, hi // 2
        return len(region)


def _encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    key = (hash(raw), pattern)
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines())}
        _LOADED[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]


_LOADED: dict = {}


def with_edits(docs: DataFrame, edits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, edits) from a table of edits (key, seq, at, delete, insert), in the order of seq.

    Both sides are shuffled by key; the edits of one document stay together, as do its text and tree.
    """
    listed = edits.groupBy(F.col(key).alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "delete", "insert"))).alias("edits"))
    plain = F.transform("edits", lambda e: F.struct(e["at"].alias("at"), e["delete"].alias("delete"), e["insert"].alias("insert")))
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(listed, "doc_id", "left").withColumn("edits", plain)


def recounted(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_leaves, n_edits, n_tokens_after, n_reencoded, text_after) for rows (doc_id, text, edits).

    `edits` is an array of structs (at, delete, insert) in code points, applied one after the other, each on the text that
    the one before left; null fields count as 0 or empty, places beyond the end as the end.  `path` names the rank file, read by
    the driver and sent to the workers.  Null texts count as empty; repeated rows stay repeated; strings of special tokens are ordinary text.
    Memory is bounded by a step of texts; nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    with open(path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())  # bounded by the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(file.value, pattern).encode_ordinary
        count = lambda t: len(encode(t))
        for rows, _, _ in steps(batches):
            out = []
            for text, edits in zip(rows.column("text").to_pylist(), rows.column("edits").to_pylist()):
                parts = leaves(text or "")
                tree = CountTree(parts, [count(p) for p in parts])
                before, n_leaves, done = tree.n_tokens, len(parts), 0
                for e in edits or []:
                    done += tree.edit(e["at"] or 0, e["delete"] or 0, e["insert"] or "", count) if e else 0
                out.append((before, n_leaves, len(edits or []), tree.n_tokens, done, tree.text))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *[pa.array(np.array(c, np.int64)) for c in columns[:5]], pa.array(columns[5], pa.string())],
                names=["doc_id", "n_tokens", "n_leaves", "n_edits", "n_tokens_after", "n_reencoded", "text_after"],
            )

    kept = docs.select("doc_id", "text", "edits")
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_leaves long, n_edits long, n_tokens_after long, n_reencoded long, text_after string")
