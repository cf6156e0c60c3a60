"""Each operator against a brute-force version, on the small tables and on odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webquarry.llm import bpe, hyperminhash, langcrf, mixing, pii, quality, queries, substrings, tokencount, weaklinear
from webquarry.llm import pq as vectors

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, ties, a repeated row, and columns with clashing names."""
    line = "the quick brown fox jumps over the lazy dog and then it sleeps for a while under the old tree near the river "
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    rows = [
        (1, line * 3, "en", "a"), (2, line * 3, "en", None), (3, None, None, None), (4, "", "en", "b"), (5, " \n\t ", "de", "b"),
        (6, long, "en", "a"), (7, long + " tail", "de", "a"), (8, "hi", "en", "c"), (8, "hi", "en", "c"), (9, "ß😀 é " * 30, None, "c"),
        (None, line * 3, "en", "a"), (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {c: F.lit("x") for c in ("key", "a", "b", "size", "n", "part", "kept", "family", "group", "cuts", "vector", "score", "edits", "registers", "n_words", "c0", "of", "rate", "__own", "__of", "__rate", "__salt", "__copy", "__kept", "row", "id", "own", "from", "copy", "told", "tag", "own_id", "kept_id")}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


# ---- token counts -------------------------------------------------------------------------


def test_counts_follow_edits():
    with open(queries.BYTE_RANKS, "rb") as f:
        encode = tokencount._encoding(f.read(), queries.public_tokenizers.PATTERN).encode_ordinary
    count = lambda t: len(encode(t))
    draw = random.Random(5)
    letters = " \n\t\x1c\xa0ab'sé1!.."
    for _ in range(60):
        now = "".join(draw.choice(letters) for _ in range(draw.randrange(0, 2000)))
        parts = tokencount.leaves(now)
        assert "".join(parts) == now
        tree = tokencount.CountTree(parts, [count(p) for p in parts])
        for _ in range(20):
            at, delete = draw.randrange(0, len(now) + 2), draw.choice([0, 1, 5, 300, len(now)])
            insert = "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 3, 400])))
            tree.edit(at, delete, insert, count)
            at = min(at, len(now))
            now = now[:at] + insert + now[at + delete :]
            assert (tree.text, tree.n_chars, tree.n_tokens) == (now, len(now), count(now))


def test_edits_from_a_table(spark, odd):
    edits = spark.createDataFrame([(1, 2, 0, 4, "A "), (1, 1, 4, 5, "slow"), (3, 1, 0, 0, "new"), (99, 1, 0, 0, "x")], "doc_id long, seq int, at long, delete long, insert string")
    joined = tokencount.with_edits(odd.select("doc_id", "text"), edits)
    got = {r.doc_id: r for r in tokencount.recounted(joined, queries.BYTE_RANKS, queries.public_tokenizers.PATTERN).collect() if r.doc_id in (1, 3, 4)}
    assert got[1].text_after.startswith("A slow brown") and got[1].n_edits == 2
    assert (got[3].n_tokens, got[3].text_after) == (0, "new") and (got[4].n_tokens, got[4].n_edits) == (0, 0)


# ---- BPE ----------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, sf_dir, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    draw = random.Random(1)
    strange = ["<|endoftext|> a<|startoftext|>b <|x|>", "ΑΣ ΣΑΣ Σ", "İstanbul ẞ ﬁ", "don't WE'LL 'S", "a" * 3000, "ab" * 900 + "!!!" * 50, "１２３ ½ ²", "\x1c a\x85b\xa0c​"]
    strange += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0xA0, 0x500), draw.randrange(0x4E00, 0x9FFF), 0x20, 0x27])) for _ in range(100)) for _ in range(100)]
    rows = [*enumerate(strange), *((1000 + i, t) for i, t in texts(sf_dir).items())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.round_trip(df, queries.WORD_BPE).collect()}
    for i, t in rows:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert {r.doc_id: r.text for r in bpe.decode(bpe.encode(df, queries.WORD_BPE), queries.WORD_BPE).collect()} == {i: r.decoded for i, r in got.items()}
    assert bpe.round_trip(odd, queries.WORD_BPE).count() == 12


def test_long_words_merge_alike():
    with open(queries.WORD_BPE, "rb") as f:
        model = bpe.WordBpe(f.read())
    draw = random.Random(2)
    for _ in range(200):
        raw = "".join(draw.choice("aabcdehint") for _ in range(draw.randrange(1, bpe.ROW_BYTES + 1))).encode()
        row = np.full((1, bpe.ROW_BYTES), -1, np.int32)
        row[0, : len(raw)] = [*model.inner[list(raw[:-1])], model.last[raw[-1]]]
        merged = model.merge_rows(row)[0]
        assert merged[merged >= 0].tolist() == model.merge_long(raw)


# ---- near duplicates ----------------------------------------------------------------------


def brute_groups(docs, words, percent):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in docs:
        w = WORDS.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    holders, both = defaultdict(list), Counter()
    for i in sorted(sets):
        for g in sets[i]:
            both.update((j, i) for j in holders[g])
            holders[g].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_all_pairs(spark, words, percent):
    draw = random.Random(words)
    base = [[f"w{draw.randrange(400)}" for _ in range(draw.choice([2, 4, 12, 60, 200]))] for _ in range(40)]
    rows = []
    for k in range(330):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 6])):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()}
    assert got == brute_groups(rows, words, percent)


def test_large_families_are_tiled(spark, monkeypatch):
    monkeypatch.setattr(hyperminhash, "BLOCK", 16)
    draw = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(90):
        w = list(base)
        for _ in range(draw.choice([1, 3, 5])):
            w[draw.randrange(len(w))] = f"x{draw.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in hyperminhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()}
    assert got == brute_groups(rows, 3, 85)


def test_estimate_follows_similarity():
    rng = np.random.default_rng(3)
    pool = np.unique(rng.integers(0, 1 << 63, 6000, dtype=np.uint64) * np.uint64(2))
    for common in (0, 1000, 2000, 2800):
        a, b = np.sort(pool[:3000]), np.sort(pool[3000 - common : 6000 - common])
        regs = hyperminhash.registers(np.concatenate([a, b]), np.array([0, 3000, 6000]))
        found, _ = hyperminhash.estimate(regs[:1], regs[1:], np.array([3000.0]), np.array([3000.0]))
        assert abs(found[0] - common / (6000 - common)) < 0.12


def test_near_duplicates_of_odd_rows(odd, empty):
    got = hyperminhash.near_duplicates(odd).collect()
    by_id = {r.doc_id: r for r in got}
    assert len(got) == 12 and by_id[2].component_id == 1 and not by_id[2].kept
    assert by_id[7].component_id == 6 and all(by_id[i].kept for i in (3, 4, 5, 8)) and by_id[4].n_shingles == 0 and by_id[8].n_shingles == 1
    assert hyperminhash.near_duplicates(empty).count() == 0
    assert hyperminhash.kept_rows(odd).columns == odd.columns


# ---- repeated strings ---------------------------------------------------------------------


def brute_repeats(docs):
    first, out = {}, {}
    for i, t in sorted(docs):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 49):
            if first.setdefault(raw[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for k in range(len(raw)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeats_of(df):
    rows = substrings.drop_repeats(df).collect()
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows if r.doc_id is not None}


def test_repeats_equal_brute_force(spark, sf_dir, odd, empty):
    docs = texts(sf_dir)
    assert repeats_of(spark.read.parquet(f"{sf_dir}/documents.parquet")) == brute_repeats(docs.items())
    draw = random.Random(4)
    passages = ["".join(draw.choice("ab é") for _ in range(draw.choice([49, 50, 51, 120]))) for _ in range(6)]
    rows = [(k, "".join(draw.choice([*passages, "a" * draw.randrange(70), "xyz"]) for _ in range(draw.randrange(8)))) for k in range(60)]
    assert repeats_of(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)
    got = substrings.drop_repeats(odd).collect()
    assert len(got) == 12 and all(not r.spans for r in got if r.doc_id is None)
    assert {r.doc_id: len(r.kept) for r in got if r.doc_id in (2, 3, 4)} == {2: 0, 3: 0, 4: 0}
    assert substrings.drop_repeats(empty).count() == 0


def test_repeated_keys_of_different_texts(spark, monkeypatch):
    """Each row of a key loses what smaller keys hold, and nothing of its own key; runs and gatherings of any size agree."""
    draw = random.Random(3)
    text = lambda n: "".join(draw.choice("abcdefgh ") for _ in range(n))
    shared, other = text(130), text(130)
    rows = [(1, shared), (5, shared), (5, other), (5, other), (7, text(20) + other + text(30)), (-3, shared[:60]), (-3, text(90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for key, own in rows:
        held = {t[i : i + 50] for k, t in rows if k < key for i in range(len(t) - 49)}
        gone = {i + j for i in range(len(own) - 49) if own[i : i + 50] in held for j in range(50)}
        want.append((key, "".join(c for i, c in enumerate(own) if i not in gone)))
    for run, gather in ((4096, 1 << 19), (1, 3)):
        monkeypatch.setattr(substrings, "RUN", run)
        monkeypatch.setattr(substrings, "GATHER", gather)
        assert sorted((r.doc_id, bytes(r.kept).decode()) for r in substrings.drop_repeats(df).collect()) == sorted(want)


def test_clashing_columns_stay(odd):
    """Rows come back with every column as it was, whatever the names."""
    names = odd.columns
    mix, single = mixing.mixed(odd), hyperminhash.kept_rows(odd)
    assert mix.columns == names and single.columns == names
    extra = [c for c in names if c not in ("doc_id", "text", "lang", "source")]
    for out in (mix, single):
        got = out.collect()
        assert got and all(r[c] == "x" for r in got for c in extra)


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    monkeypatch.setattr("webquarry.llm.common.STEP_BYTES", 500)
    import pyarrow as pa

    text = "".join(random.Random(6).choice("abcdefg ") for _ in range(5000))
    parts = list(substrings._segments(iter([pa.RecordBatch.from_pydict({"text": [text]})])))
    assert len(parts) == 5 and all(len(p[1]) <= 1049 for p in parts)
    assert sum(max(0, len(p[1]) - 49) for p in parts) == 4951


# ---- mixing -------------------------------------------------------------------------------


def test_targets_fill_up_to_the_caps(spark):
    rows = [("a", 100), ("b", 10), ("c", 1000), (None, 50), ("z", 0)]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    size, weight = dict(rows), {"a": 5, "b": 2, "c": 1, "z": 5, None: 2}
    level = {s: 0.0 for s in size}
    rest, left = 1.5 * sum(size.values()), set(size)
    while left:
        total = sum(weight[s] for s in left)
        want = {s: rest * weight[s] / total for s in left}
        over = {s for s in left if want[s] > 2 * size[s]}
        if not over:
            level.update(want)
            break
        for s in over:
            level[s] = 2.0 * size[s]
            rest -= level[s]
        left -= over
    assert got == pytest.approx(level)


def test_mix_takes_what_it_plans(odd, empty):
    plan = Counter()
    for r in mixing.planned(odd).collect():
        assert 0 <= r.copies <= 2
        plan[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.mixed(odd).collect()) == +plan
    assert mixing.mixed(odd).columns == odd.columns and mixing.planned(empty).count() == 0


# ---- quality ------------------------------------------------------------------------------


def brute_measures(t):
    w = WORDS.findall(t or "")
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often, cover = Counter(grams), set()
    for k, g in enumerate(grams):
        if often[g] > 1:
            cover.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_measures_equal_brute_force(spark, sf_dir, odd, empty):
    docs = texts(sf_dir)
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == {i: brute_measures(t) for i, t in docs.items()}
    lines = [(k, "\n".join(random.Random(k).choice(["", "a b", " a b", "a b c d e f g h", "é", "*"]) for _ in range(12)) + "\n" * (k % 3)) for k in range(80)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.judged(spark.createDataFrame(lines, "doc_id long, text string")).collect()}
    assert got == {i: brute_measures(t) for i, t in lines}
    assert {r.doc_id: r.kept for r in quality.judged(odd).collect() if r.doc_id in (3, 4, 8)} == {3: False, 4: False, 8: False}
    assert quality.judged(empty).count() == 0 and quality.passed(odd).columns == odd.columns


def test_verdicts_agree_with_labels(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judged(docs).join(labels, "doc_id").where("NOT base_failed").select("kept", labels["quality"].alias("label")).collect()
    assert sum(r.kept == (r.label == 1) for r in rows) / len(rows) > 0.97
    assert sum(r.kept for r in rows if r.label == 1) / sum(r.label == 1 for r in rows) > 0.98


def test_scorer_agrees_with_labels(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = weaklinear.scored(docs).join(labels, "doc_id").select("good", "quality").collect()
    assert sum(r.good == (r.quality == 1) for r in rows) / len(rows) > 0.95
    assert {r.doc_id: r.good for r in weaklinear.scored(odd).collect() if r.doc_id in (3, 4, 5)} == {3: False, 4: False, 5: False}
    assert weaklinear.scored(empty).count() == 0


# ---- vectors ------------------------------------------------------------------------------


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    x = np.concatenate([centres[rng.integers(30, size=300)] + 0.15 * rng.normal(size=(300, 24)), rng.normal(size=(200, 24))]).astype(np.float32)
    x[10:20] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [float("nan")] + [1.0] * 23), (1003, [float("inf")] + [1.0] * 23), (1004, [None] + [1.0] * 23), (1005, []), (1006, [1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    link = unit @ unit.T >= 0.9
    np.fill_diagonal(link, False)
    label = np.arange(len(x))
    for _ in range(len(x)):
        label = np.minimum(label, np.where(link, label[None, :], len(x)).min(axis=1))
    found = sum(got[i][0] for i in range(len(x)))
    assert found >= 0.9 * link.sum() and all(got[i][0] <= link[i].sum() for i in range(len(x)))
    assert sum(got[i] == (link[i].sum(), label[i], label[i] == i) for i in range(len(x))) >= 0.97 * len(x)
    assert all(got[i] == (0, i, True) for i in range(1000, 1007))
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vector_links_without_clusters_are_whole_on_request(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    aside = rng.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    both = np.concatenate([x, 0.9001 * x + np.sqrt(1 - 0.9001**2) * aside])
    near = (both @ both.T >= 0.9) & ~np.eye(len(both), dtype=bool)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<double>")
    links = {p: {r.vec_id: r.n_links for r in vectors.near_duplicates(df, probes=p).collect()} for p in (1, None)}
    assert [links[None][i] for i in range(len(both))] == near.sum(axis=1).tolist()
    assert sum(links[1].values()) < sum(links[None].values())  # the choice of lists matters on such vectors
    index = vectors.Index(both, 1500**2)
    *_, sizes = index.encode(both[:100], None, np.sqrt(0.02))
    assert index.lists == 1500 and sizes.mean() < 300  # lists behind the plane are left out


def test_double_vectors_of_any_length(spark):
    rows = [(1, [1e300, 1e300]), (2, [1e300, 1.0001e300]), (3, [1e-60, 1e-60]), (4, [1.0, -1.0]), (5, [1.0, 2.0, 3.0]), (6, [1.0, 2.0, 3.01]),
            (7, [2.0]), (8, [5.0]), (9, [-1.0]), (10, []), (11, None), (12, [0.0, 0.0]), (13, [float("nan"), 1.0]), (14, [None, 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    linked = {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7, 8: 7}
    links = {1: 2, 2: 2, 3: 2, 5: 1, 6: 1, 7: 1, 8: 1}
    assert got == {i: (links.get(i, 0), linked.get(i, i), linked.get(i, i) == i) for i, _ in rows}


# ---- language -----------------------------------------------------------------------------


@pytest.mark.parametrize("numbers", [langcrf.NUMBERS, 1])
def test_marginals_equal_one_pass(monkeypatch, numbers):
    monkeypatch.setattr(langcrf, "NUMBERS", numbers)
    rng = np.random.default_rng(0)
    emissions, moves, bounds = rng.normal(size=(333, 3)), rng.normal(size=(3, 3)), np.array([0, 1, 200, 200, 333])
    got, _ = langcrf.marginals(emissions, moves, bounds)
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        e, n = np.exp(emissions[lo:hi]), hi - lo
        ahead, behind = np.ones((n, 3)), np.ones((n, 3))
        for t in range(n):
            ahead[t] = e[t] if t == 0 else (ahead[t - 1] @ np.exp(moves)) * e[t]
            ahead[t] /= ahead[t].sum()
        for t in range(n - 2, -1, -1):
            behind[t] = np.exp(moves) @ (e[t + 1] * behind[t + 1])
            behind[t] /= behind[t].sum()
        want = ahead * behind
        if n:
            assert np.allclose(got[lo:hi], want / want.sum(axis=1, keepdims=True))


def test_held_out_language(spark, odd, empty):
    rows = queries.op9_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 200 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    model = langcrf.fit([("x", ["^alpha$", "^beta$"] * 40), ("y", ["^gamma$", "^delta$"] * 40)])
    got = {r.doc_id: r for r in langcrf.predicted(odd, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and 0 <= got[1].score <= 1
    assert langcrf.fit([]) is None and {r.lang_pred for r in langcrf.predicted(odd, None).collect()} == {"und"}
    assert langcrf.predicted(empty, model).count() == 0 and langcrf.sampled(empty, "doc_id", "text", "lang") == []


# ---- personal data ------------------------------------------------------------------------


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m.group())) <= 15]


def test_spans_equal_plain_patterns(sf_dir):
    draw = random.Random(3)
    rows = [*texts(sf_dir).values(), *("".join(draw.choice("019.-+@ ()aZ%_é") for _ in range(draw.randrange(1, 60))) for _ in range(20_000))]
    rows += ["".join(draw.choice("0123456789 -") for _ in range(40)) for _ in range(8_000)]
    for t in rows:
        assert [x[:3] for x in pii.find(t) if x[0] in pii.BASE] == brute_spans(t)


def test_digests_of_the_query(spark, sf_dir):
    docs = texts(sf_dir)
    got = {r.doc_id: r for r in queries.op10_pii(spark, sf_dir).collect()}
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        base = brute_spans(t)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in base) for k in pii.BASE]
        assert got[i].spans == ",".join(f"{k}:{a}:{b}" for k, a, b, _ in pii.find(t))


def test_checks_and_context(odd, empty):
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    kinds = lambda t: [x[0] for x in pii.find(t)]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"] and kinds("DE89 3704 0044 0532 0130 01") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("phone 555-010-9999") == ["local_phone"] and kinds("555-010-9999") == []
    assert pii.masked_text("write to a.b@c.de or +1 (802) 555-9869") == "write to <email> or <phone>"
    assert pii.spans(odd).count() == 12 and pii.masked(odd).columns == odd.columns and pii.spans(empty).count() == 0
    assert {r.doc_id for r in pii.masked(odd).where("text IS NULL").collect()} == {3, None}


# ---- components ---------------------------------------------------------------------------


def test_components_of_chains_stars_and_loops(spark):
    from webquarry.llm.components import components

    draw = random.Random(12)
    chain = list(range(100, 160))
    draw.shuffle(chain)
    edges = [*zip(chain, chain[1:]), *((7, k) for k in range(8, 20)), *((k, 3) for k in range(15, 18)), (5, 5), (40, 41), (41, 40), (40, 41)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 160)}, **{k: 3 for k in [3, *range(7, 20)]}, 40: 40, 41: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_iban_before_further_words():
    cut = lambda t: [t[a:b] for k, a, b, _ in pii.find(t) if k == "iban"]
    assert cut("IBAN DE89370400440532013000 BIC COBADEFF") == ["DE89370400440532013000"]
    assert cut("DE89 3704 0044 0532 0130 00 EUR 500") == ["DE89 3704 0044 0532 0130 00"]
    assert cut("GB82 WEST 1234 5698 7654 32 A note") == ["GB82 WEST 1234 5698 7654 32"]
    assert cut("DE89370400440532013000 GB82WEST12345698765432") == ["DE89370400440532013000", "GB82WEST12345698765432"]
    assert cut("REF AB12 DE89 3704 0044 0532 0130 00 X") == ["DE89 3704 0044 0532 0130 00"]  # behind a run that fails
    assert cut("DE89 3704 0044 0532 0130 01 EUR") == cut("DE89370400440532013000EUR") == cut("DE89370400440532013000eur") == []
    assert pii.masked_text("pay DE89370400440532013000 BIC COBADEFF") == "pay <iban> BIC COBADEFF"


def test_scorer_is_fitted_on_whole_texts(spark, monkeypatch):
    seen, train = [], weaklinear._train
    monkeypatch.setattr(weaklinear, "_train", lambda sample: seen.extend(sample) or train(sample))
    texts = [(1, "clean words " * 300 + "TAIL#1 " * 400), (2, "short and clean"), (3, "")]
    assert weaklinear.scored(spark.createDataFrame(texts, "doc_id long, text string")).count() == 3
    assert sorted(int(s[1].sum()) for _, s in seen) == [3 * 3, 3 * 1000]
    (tail,) = np.unique(weaklinear.slots(np.frombuffer(b"TAIL#1", np.uint8), np.array([0, 6]))[0][:, 0])
    assert [int(s[1][s[0] == tail].sum()) for _, s in seen if s[1].sum() > 9] == [400]


def test_every_code_point_is_encoded_as_by_the_library():
    with open(queries.WORD_BPE, "rb") as f:
        model = bpe.WordBpe(f.read())
    library = Tokenizer.from_file(queries.WORD_BPE)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    lines = [" ".join(f"a{c}b {c}1" for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    lines += [f"x{c}\u0307\u0323y Σ{c}Σ" for c in points[:0x20000:7]]  # marks that compose or change places
    for lo in range(0, len(lines), 5000):
        ids, bounds = model.encode(lines[lo : lo + 5000])
        for line, a, b, want in zip(lines[lo:], bounds, bounds[1:], library.encode_batch(lines[lo : lo + 5000], add_special_tokens=False)):
            assert ids[a:b].tolist() == want.ids, line


def test_every_trigram_of_a_long_run_counts():
    run = "".join(chr(0x4E00 + k) for k in range(1000))
    for n in (1, 2, 23, 24, 25, 26, 47, 48, 49, 1000):
        parts = langcrf.pieces(run[:n])
        marked = f"^{run[:n]}$"
        assert len(parts) == -(-n // langcrf.LETTERS)
        assert [p[i : i + 3] for p in parts for i in range(len(p) - 2)] == [marked[i : i + 3] for i in range(n)]  # each once, across cuts too
        assert [p[0] == "^" for p in parts] == [True] + [False] * (len(parts) - 1) and [p[-1] == "$" for p in parts] == [False] * (len(parts) - 1) + [True]
        assert langcrf._words(parts, np.ones((len(parts), 2)))[0] == [run[:n]]
    assert langcrf.pieces("Abc " + "d" * 24 + " 7 ef") == ["^abc$", f"^{'d' * 24}$", "^ef$"] and langcrf.pieces(None) == langcrf.pieces("1 ^$") == []
    inner, none = langcrf.pieces(run)[5], frozenset()
    assert {langcrf._slot(f"{kind}{run[120:121]}") for kind in "ps"}.isdisjoint(langcrf.features(inner, none))  # no false beginning
    assert langcrf._slot(f"p{run[0]}") in langcrf.features(langcrf.pieces(run)[0], none) and langcrf._slot(f"s{run[-1]}") in langcrf.features(langcrf.pieces(run)[-1], none)


def chain(emissions, moves):
    """Log partition and marginals of one chain by adding up every path of labels."""
    n, k = emissions.shape
    total, seen = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        w = np.exp(sum(emissions[t, y] for t, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += w
        for t, y in enumerate(path):
            seen[t, y] += w
    return np.log(total), seen / total


def test_language_gradients_equal_differences():
    rng = np.random.default_rng(3)
    bounds, gold = np.array([0, 5, 9]), rng.integers(0, 3, 9)
    emissions, moves = rng.normal(size=(9, 3)), rng.normal(size=(3, 3))

    def likelihood(e, m):
        out = 0.0
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            y = gold[lo:hi]
            out += e[np.arange(lo, hi), y].sum() + m[y[:-1], y[1:]].sum() - chain(e[lo:hi], m)[0]
        return out

    for value, got in zip((emissions, moves), langcrf.gradients(emissions, moves, bounds, gold)):
        for at in np.ndindex(value.shape):
            here = value[at]
            value[at] = here + 1e-5
            up = likelihood(emissions, moves)
            value[at] = here - 1e-5
            down = likelihood(emissions, moves)
            value[at] = here
            assert abs((up - down) / 2e-5 - got[at]) < 1e-6


def test_language_prediction_equals_all_paths(spark):
    latin, greek = "the cat sat on a mat with two more cats", "η γατα καθισε στο χαλι με δυο ακομα γατες"
    model = langcrf.fit([("el", langcrf.pieces(greek) * 40), ("en", langcrf.pieces(latin) * 40)])
    rows = [(1, "the cat"), (2, "η γατα on a mat"), (3, greek + " " + latin), (4, "the " + "χαλι" * 9 + " cats"), (5, "12 34"), (6, None), (7, "mat"), (7, "mat")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in langcrf.predicted(docs, model).collect()}
    words = langcrf.predicted_words(docs, model).collect()
    assert len(found) == 7 and sum(w.doc_id == 7 for w in words) == 2
    for doc, text in dict(rows).items():
        parts = langcrf.pieces(text)
        if not parts:
            assert (found[doc].lang_pred, found[doc].score, found[doc].runs) == ("und", 0.0, []) and not any(w.doc_id == doc for w in words)
            continue
        of = [k - 1 for k in np.cumsum([x[0] == "^" for x in parts])]
        slots = [langcrf.features(x, model.lexicon) for x in parts]
        _, want = chain(np.array([model.weights[x].sum(axis=0) for x in slots], float), model.moves) if len(parts) < 15 else (0, langcrf.marginals(model.emissions(parts), model.moves, np.array([0, len(parts)]))[0])
        assert found[doc].lang_pred == model.languages[want.mean(axis=0).argmax()] and abs(found[doc].score - want.mean(axis=0).max()) < 1e-6
        by_word = [want[[i for i, o in enumerate(of) if o == k]].mean(axis=0) for k in range(max(of) + 1)]
        got = sorted({(w.place, w.word, w.lang): w.probability for w in words if w.doc_id == doc}.items())
        assert [x[0] for x in got] == [(k, w, model.languages[q.argmax()]) for k, (w, q) in enumerate(zip(text.split(), by_word))]
        assert np.allclose([x[1] for x in got], [q.max() for q in by_word])
        assert [lang for lang, a, b in found[doc].runs for _ in range(a, b)] == [x[0][2] for x in got]
    assert [(r.lang, r.first, r.end) for r in found[3].runs] == [("el", 0, 9), ("en", 9, 19)]  # a text that switches
    assert [(r.lang, r.first, r.end) for r in found[4].runs] == [("en", 0, 1), ("el", 1, 2), ("en", 2, 3)]


def test_language_is_fitted_on_whole_texts(spark):
    docs = spark.createDataFrame([(1, "head " * 500 + "tail", "en"), (2, None, "en"), (3, "kopf", "de"), (4, "lost", None)], "doc_id long, text string, lang string")
    got = langcrf.sampled(docs, "doc_id", "text", "lang")
    assert [(lang, len(x), x[-1]) for lang, x in got] == [("en", 501, "^tail$"), ("de", 1, "^kopf$")]
