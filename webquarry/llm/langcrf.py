"""Language of text by a linear-chain conditional random field over its words.

Features of a word are its affixes, character trigrams, length and, for words of the fitted lexicon, the word itself; the
transitions between languages are learned with them, from sequences that switch between sampled documents.
Forward-backward gives every word its distribution over languages; a document gets the language with the largest mean.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import small_batches, steps

#: Bounds of the fit: documents of each language (in expectation), with their whole texts; lexicon words of each language.
PER_LANGUAGE = 300
LEXICON = 1000
SLOTS = 1 << 16
ROUNDS = 25
SEQUENCE = 128
CHUNK = 64
#: Entries of the transfer matrices that are held at once; one chunk at least.
NUMBERS = 4 << 20
CACHE_WORDS = 200_000
UNKNOWN = "und"

#: Places of the chain hold so many trigrams at most; longer runs of letters, as of scripts without blanks, take several.
LETTERS = 24
_RUN = regex.compile(r"\p{L}+")


def pieces(text: str | None) -> list[str]:
    """The places of a text's chain: its runs of letters between the marks ^ and $, long ones cut.

    Neighbouring pieces of one run share two letters, so that every trigram of the run stands in exactly one of
    them and only true beginnings and ends carry a mark.
    """
    out = []
    for word in _RUN.findall(text.lower()) if text else ():
        out += [f"^{word}$"] if len(word) <= LETTERS else _cut(f"^{word}$")
    return out


def _cut(marked: str) -> list[str]:
    return [marked[i : i + LETTERS + 2] for i in range(0, len(marked) - 2, LETTERS)]


def features(piece: str, lexicon: frozenset[str] | set[str]) -> list[int]:
    """Slots of the trigrams, and of the affixes, the length and the lexicon entry where the marks show that they are the run's own."""
    opens, ends = piece.startswith("^"), piece.endswith("$")
    word = piece[opens : len(piece) - ends]
    names = [f"n{piece[i : i + 3]}" for i in range(len(piece) - 2)]
    names += [f"p{word[:k]}" for k in (1, 2, 3)] if opens else []
    names += [f"s{word[-k:]}" for k in (1, 2, 3)] if ends else []
    names.append(f"l{min(len(word), 12) if opens and ends else 12}")
    if opens and ends and piece in lexicon:
        names.append(f"w{word}")
    return [_slot(n) for n in names]


def _slot(name: str) -> int:
    return zlib.crc32(name.encode()) % SLOTS


class Model:
    """Languages, feature weights, transitions and lexicon; scores of pieces seen before are kept with it."""

    def __init__(self, languages: list[str], weights: np.ndarray, moves: np.ndarray, lexicon: frozenset[str]):
        self.languages, self.weights, self.moves, self.lexicon = languages, weights, moves, lexicon
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.languages)), np.float32)

    def emissions(self, listed: list[str]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self._forget()
        new = list(set(listed).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            slots = [features(w, self.lexicon) for w in new]
            sizes = np.fromiter(map(len, slots), np.int64, len(slots))
            flat = np.fromiter((s for x in slots for s in x), np.int64, int(sizes.sum()))
            self.rows = np.concatenate([self.rows, np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes, axis=0)])
        return self.rows[np.fromiter(map(self.known.__getitem__, listed), np.int64, len(listed))].astype(float)


def marginals(emissions: np.ndarray, moves: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution over labels of each word, and its forward message, by forward-backward over each document's chain.

    Chains are cut into chunks.  The transfer matrices of all chunks are multiplied up side by side; messages run over
    whole chunks, then inside all chunks side by side.  The result is that of one pass over each whole chain.  Steps are
    held for NUMBERS entries of chunks at once, also inside one long document.
    """
    n, k = emissions.shape
    if not n:
        return np.zeros((0, k)), np.zeros((0, k))
    bounds = bounds - bounds[0]
    lengths = np.diff(bounds)
    per_doc = -(-lengths // CHUNK)
    total = int(per_doc.sum())
    first = np.cumsum(per_doc) - per_doc
    nth = np.arange(total) - np.repeat(first, per_doc)
    start = np.repeat(bounds[:-1], per_doc) + nth * CHUNK
    size = np.minimum(CHUNK, np.repeat(bounds[1:], per_doc) - start)
    psi = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    move = np.exp(moves - moves.max())

    def steps_of(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """The steps of some chunks, and which of their places are words; other places change nothing."""
        inside = np.arange(CHUNK)[None, :] < size[lo:hi, None]
        here = psi[np.where(inside, start[lo:hi, None] + np.arange(CHUNK), 0)]
        step = move[None, None] * here[:, :, None, :]
        opens = nth[lo:hi] == 0
        step[opens, 0] = np.eye(k)[None] * here[opens, 0][:, None, :]
        step[~inside] = np.eye(k)
        return step, inside

    wide = max(1, NUMBERS // (CHUNK * k * k))
    slices = [(lo, min(total, lo + wide)) for lo in range(0, total, wide)]
    whole, step, inside = np.empty((total, k, k)), np.empty(0), np.empty(0)
    for lo, hi in slices:
        step, inside = steps_of(lo, hi)
        part = step[:, 0]
        for t in range(1, CHUNK):
            part = part @ step[:, t]
            part = part / part.sum(axis=(1, 2), keepdims=True)
        whole[lo:hi] = part
    ahead, behind = np.full((total, k), 1.0 / k), np.full((total, k), 1.0)
    longest = int(per_doc.max())
    for j in range(1, longest):
        c = first[per_doc > j] + j
        v = np.matmul(ahead[c - 1][:, None, :], whole[c - 1])[:, 0]
        ahead[c] = v / v.sum(axis=1, keepdims=True)
    for j in range(2, longest + 1):
        some = per_doc >= j
        c = first[some] + per_doc[some] - j
        v = np.matmul(whole[c + 1], behind[c + 1][:, :, None])[:, :, 0]
        behind[c] = v / v.sum(axis=1, keepdims=True)
    out, ahead_of = np.empty((n, k)), np.empty((n, k))
    for lo, hi in slices:
        if len(slices) > 1:
            step, inside = steps_of(lo, hi)
        forward = np.empty((hi - lo, CHUNK, k))
        v = ahead[lo:hi]
        for t in range(CHUNK):
            v = np.matmul(v[:, None, :], step[:, t])[:, 0]
            v = v / v.sum(axis=1, keepdims=True)
            forward[:, t] = v
        a, b = start[lo], start[hi - 1] + size[hi - 1]  # chunks follow one another as their words do
        ahead_of[a:b] = forward[inside]
        v = behind[lo:hi]
        for t in range(CHUNK - 1, -1, -1):
            forward[:, t] *= v
            v = np.matmul(step[:, t], v[:, :, None])[:, :, 0]
            v = v / v.sum(axis=1, keepdims=True)
        out[a:b] = forward[inside]
    return out / out.sum(axis=1, keepdims=True), ahead_of


def gradients(emissions: np.ndarray, moves: np.ndarray, bounds: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the log likelihood of the gold labels, by each word's emissions and by the transitions."""
    k = len(moves)
    p, ahead = marginals(emissions, moves, bounds)
    inner = np.ones(len(gold), bool)
    inner[bounds[:-1][np.diff(bounds) > 0]] = False
    at = np.flatnonzero(inner)
    by_moves = np.zeros((k, k))
    np.add.at(by_moves, (gold[at - 1], gold[at]), 1)
    onward = np.exp(emissions - emissions.max(axis=1, keepdims=True)) * p / np.maximum(ahead, 1e-300)  # emission times backward message
    wide = max(1, NUMBERS // (k * k))
    for some in (at[lo : lo + wide] for lo in range(0, len(at), wide)):
        pair = ahead[some - 1][:, :, None] * np.exp(moves)[None] * onward[some][:, None, :]
        by_moves -= (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    missing = -p
    missing[np.arange(len(gold)), gold] += 1
    return missing, by_moves


def fit(samples: list[tuple[str, list[str]]]) -> Model | None:
    """A model from (language, pieces of a whole text) pairs; None without any.

    Sequences of SEQUENCE pieces are put together from runs of different samples, so that transitions can be
    learned; every piece of every sample stands in one of them.  Full gradients of the log likelihood with Adam steps; the order of samples is given by the caller.
    """
    samples = [s for s in samples if s[1]]
    languages = sorted({s[0] for s in samples})
    if not languages:
        return None
    k, number = len(languages), {name: i for i, name in enumerate(languages)}
    counts = [Counter() for _ in languages]
    for name, listed in samples:
        counts[number[name]].update(listed)
    lexicon = frozenset(w for c in counts for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON])
    rng = np.random.default_rng(11)
    queue = [(number[name], listed, 0) for name, listed in samples]
    tokens, labels = [], []
    while queue:
        i = int(rng.integers(len(queue)))
        label, listed, at = queue[i]
        run = int(rng.integers(8, 80))
        tokens += listed[at : at + run]
        labels += [label] * len(listed[at : at + run])
        if at + run >= len(listed):
            queue[i] = queue[-1]
            queue.pop()
        else:
            queue[i] = (label, listed, at + run)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(tokens))}
    token, gold = np.array([vocabulary[w] for w in tokens]), np.array(labels)
    slots = [features(w, lexicon) for w in vocabulary]
    sizes = np.fromiter(map(len, slots), np.int64, len(slots))
    flat = np.fromiter((s for x in slots for s in x), np.int64, int(sizes.sum()))
    owner = np.repeat(np.arange(len(slots)), sizes)
    bounds = np.append(np.arange(0, len(token), SEQUENCE), len(token))
    weights, moves = np.zeros((SLOTS, k)), np.zeros((k, k))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    for r in range(1, ROUNDS + 1):
        emissions = np.add.reduceat(weights[flat], np.cumsum(sizes) - sizes, axis=0)[token]
        missing, by_moves = gradients(emissions, moves, bounds, gold)
        by_word = np.stack([np.bincount(token, missing[:, j], len(slots)) for j in range(k)], axis=1)
        grad = np.stack([np.bincount(flat, by_word[owner, j], SLOTS) for j in range(k)], axis=1) / len(token) - 1e-6 * weights
        grad_moves = by_moves / len(token) - 1e-4 * moves
        for value, g, m, v, rate in ((weights, grad, state[0], state[1], 0.3), (moves, grad_moves, state[2], state[3], 0.2)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Model(languages, weights.astype(np.float32), moves, lexicon)


def sampled(docs: DataFrame, key: str, text: str, language: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, list[str]]]:
    """Pieces of the whole texts of about `per_language` documents of each language, chosen by the hash of the key.

    The number of documents is what bounds the fit, which the driver runs; their texts are not cut.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(language).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))) for name, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    found = rows.where(draw < share).collect()  # per_language documents of each language
    return [(r["lang"], pieces(r["text"])) for r in sorted(found, key=lambda r: (str(r["doc_id"]), r["lang"], r["text"]))]


def _labelled(model: Model | None, texts: list[str | None]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """Pieces of each text, the distributions of all pieces over the languages, and the bounds of the texts in them."""
    listed = [pieces(t) if model else [] for t in texts]
    bounds = np.cumsum([0, *map(len, listed)])
    if not model or not bounds[-1]:
        return listed, np.zeros((0, 1)), bounds
    return listed, marginals(model.emissions([w for x in listed for w in x]), model.moves, bounds)[0], bounds


def _words(listed: list[str], p: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The runs of letters of a text, joined from their pieces, and the mean distribution of each."""
    heads = [i for i, w in enumerate(listed) if w[0] == "^"]
    ends = [*heads[1:], len(listed)]
    names = [(listed[a] + "".join(w[2:] for w in listed[a + 1 : b]))[1:-1] for a, b in zip(heads, ends)]
    return names, np.add.reduceat(p, heads, axis=0) / (np.array(ends) - heads)[:, None]


def predicted(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, runs) of every row from its whole text alone.

    A null text or one without a letter gives `und` with score 0 and no runs, as does every text without a model.  The score is the
    mean probability of the language over the chain.  `runs` are the stretches of words of one language, as (lang, first, end) in words
    of the text from 0, end exclusive: a text that switches has several.  Repeated rows are predicted alike; other columns are left out.
    No shuffle.
    """
    small_batches(docs.sparkSession)
    file: Broadcast = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS * languages weights
    fields = [("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = file.value
        for rows, _, _ in steps(batches):
            listed, p, bounds = _labelled(model, rows.column("text").to_pylist())
            names, scores = [UNKNOWN] * len(listed), np.zeros(len(listed))
            some = np.flatnonzero(np.diff(bounds))
            langs, firsts, ends, per_text = [], [], [], np.zeros(len(listed), np.int64)
            if len(some):
                mean = np.add.reduceat(p, bounds[some], axis=0) / np.diff(bounds)[some, None]
                for i, best, top in zip(some, mean.argmax(axis=1), mean.max(axis=1)):
                    names[i], scores[i] = model.languages[best], min(1.0, float(top))
                heads = np.flatnonzero(np.fromiter((w[0] == "^" for x in listed for w in x), bool, int(bounds[-1])))
                best = (np.add.reduceat(p, heads, axis=0) / np.diff(np.append(heads, bounds[-1]))[:, None]).argmax(axis=1)
                of = np.searchsorted(bounds, heads, "right") - 1  # the text of each word
                place = np.arange(len(heads)) - np.searchsorted(of, of)
                new = np.ones(len(heads), bool)
                new[1:] = (best[1:] != best[:-1]) | (place[1:] == 0)
                at = np.flatnonzero(new)
                langs, firsts = [model.languages[b] for b in best[at]], place[at]
                ends = firsts + np.diff(np.append(at, len(heads)))
                per_text = np.bincount(of[at], minlength=len(listed))
            spans = pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip((langs, firsts, ends), fields)], names=[n for n, _ in fields])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_text)]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), lists], names=["doc_id", "lang_pred", "score", "runs"])

    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, runs array<struct<lang:string,first:int,end:int>>")


def predicted_words(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, place, word, lang, probability) of every word, a maximal run of letters in lower case, of every row; place counts from 0.

    The language is the likeliest one at the word, given the whole text; a long run takes the mean over its pieces.  Texts without
    words, and every text without a model, give no rows; repeated rows give theirs again.  No shuffle.
    """
    small_batches(docs.sparkSession)
    file: Broadcast = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS * languages weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = file.value
        for rows, _, _ in steps(batches):
            listed, p, bounds = _labelled(model, rows.column("text").to_pylist())
            for i, one in enumerate(listed):
                if one:
                    names, mean = _words(one, p[bounds[i] : bounds[i + 1]])
                    owner = pa.array(np.full(len(names), i))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column("doc_id").take(owner), pa.array(np.arange(len(names), dtype=np.int32)), pa.array(names, pa.string()),
                         pa.array([model.languages[b] for b in mean.argmax(axis=1)], pa.string()), pa.array(mean.max(axis=1))],
                        names=["doc_id", "place", "word", "lang", "probability"],
                    )

    kept = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, place int, word string, lang string, probability double")
