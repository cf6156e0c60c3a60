"""Centroid clustering, packing and spelling variants against brute force, on the small tables and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from check_oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from webquarry.llm import geokmeans, packing, queries, spelling
from webquarry.llm.common import bytes_of

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("name", ["op11_clusters", "op13_spelling"])
def test_same_as_sql(spark, sf_dir, name):
    line = compare(spark, connect(sf_dir), sf_dir, name, entry.queries()[name], entry.oracle_sql()[name])
    assert line.startswith("ok"), line


# ---- clusters -----------------------------------------------------------------------------


def brute_clusters(rows, dim, k, rounds):
    kept = [(i, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(col) // len(members[n]) for col in zip(*members[n])] if members[n] else c for n, c in enumerate(centroids)]
    return sorted((i, near(v)[1], near(v)[0]) for i, v in kept), centroids


@pytest.mark.parametrize(("dim", "k", "rounds", "size"), [(3, 7, 5, 1.0), (3, 1, 2, 1.0), (5, 12, 9, 0.01), (2, 6, 4, 200_000.0), (4, 300, 3, 0.1)])
def test_clusters_equal_plain_rounds(spark, dim, k, rounds, size):
    draw = random.Random(dim * k)
    middle = [[draw.uniform(-size, size) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [draw.gauss(c, size / 8) for c in draw.choice(middle)]) for i in range(160)]
    rows += [(200 + i, rows[3][1]) for i in range(20)]  # ties
    got = geokmeans.clustered(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), dim=dim, k=k, rounds=rounds)
    want, centroids = brute_clusters(rows, dim, k, rounds)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.assigned.collect()) == want
    assert {r.cluster: (r.centroid, r.n, r.inertia) for r in got.centroids.collect()} == {
        c: (centroids[c], sum(w[1] == c for w in want), sum(w[2] for w in want if w[1] == c)) for c in {w[1] for w in want}
    }
    assert got.inertia == sum(w[2] for w in want)


def test_bounds_fall_enough_and_less_than_the_drift():
    rng = np.random.default_rng(1)
    tighter = 0
    for dim in (1, 2, 3, 16):
        for _ in range(40):
            old = rng.integers(-50, 50, (4, dim))
            new = old + rng.integers(-20, 20, (4, dim))
            radius = rng.uniform(0, 60, 4)
            loose, drift = geokmeans.loosened(old, new, radius), np.sqrt(((new - old) ** 2).sum(axis=1))
            for i in range(4):
                others = [j for j in range(4) if j != i]
                x = rng.normal(size=(500, dim))
                x = old[i] + radius[i] * x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 1, (500, 1)) ** (1 / dim)
                fall = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
                assert fall <= loose[i]
                tighter += loose[i] < drift[others].max() - 1e-6
    assert tighter > 100


def test_bounds_spare_scans(monkeypatch):
    """Later rounds scan few vectors of well parted clusters, and all of them give the exact result."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c * 900, 60, (200, 8)) for c in range(5)]).astype(np.int64)
    now = geokmeans.Round(x[[0, 200, 400, 600, 800]])
    cluster, upper, lower = now.scanned(x)
    seen = []
    for _ in range(4):
        means = np.stack([x[cluster == c].sum(axis=0) // (cluster == c).sum() for c in range(5)])
        radius = np.array([upper[cluster == c].max() for c in range(5)])
        now = geokmeans.Round(means, np.sqrt(((means - now.centroids) ** 2).sum(axis=1)), geokmeans.loosened(now.centroids, means, radius))
        scan = geokmeans.Round.scanned
        monkeypatch.setattr(geokmeans.Round, "scanned", lambda self, v, scan=scan: seen.append(len(v)) or scan(self, v))
        cluster, upper, lower = now.moved(x, cluster, upper, lower)
        monkeypatch.setattr(geokmeans.Round, "scanned", scan)
        assert (cluster == scan(now, x)[0]).all()
    assert sum(seen) < len(x) // 10


def test_clusters_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [3.0, -0.001], None), (4, None, "b"), (5, [], "b"), (6, [1.0], "c"), (7, [float("nan"), 1.0], "c"), (8, [float("inf"), 1.0], "c"), (9, [None, 1.0], "c"), (10, [-7.5, 0.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    df = df.withColumns({c: F.lit(3) for c in ("id", "x", "v", "h", "cluster", "distance", "sums", "upper")})
    got = geokmeans.clustered(df, dim=2, k=3, rounds=2)
    assert Counter(r.vec_id for r in got.assigned.collect()) == Counter([1, 1, None, 10])
    none = geokmeans.clustered(df.limit(0), dim=2)
    assert none.assigned.count() == 0 and none.centroids.count() == 0 and none.assigned.columns == got.assigned.columns
    with pytest.raises(Exception, match="may not fit a long"):
        geokmeans.clustered(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), dim=2)


# ---- packing ------------------------------------------------------------------------------


def test_chunks_equal_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    with open(queries.WORD_BPE, "rb") as f:
        model = packing.ChunkBpe(f.read())
    points = [c for c in [*range(0x3000), *range(0x3040, 0x3100), *range(0x4E00, 0xA000, 7), *range(0xA000, 0xD800, 5), *range(0xE000, 0x11000), *range(0x11000, 0x2F000, 11)]]
    draw = random.Random(7)
    texts = [f"a{chr(c)}b {chr(c)}1 A{chr(c)}" for c in points]
    texts += ["".join(draw.choice([" ", "\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\xa0", " ", "'s", "Ab", "é", "é", "9", "!!", "՘", "<|endoftext|>", "<|"]) for _ in range(60)) for _ in range(300)]
    ids, bounds = model.encode(*bytes_of(pa.array(texts)))
    for t, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def placed_ok(rows, capacity):
    """Sequences are full without gaps or overlaps and within the capacity; returns their number."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def least_sequences(lengths, capacity):
    """The least number, by trying all; for small instances."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def put(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            rest = list(rooms)
            rest.remove(r)
            put(i + 1, [*rest, r - lengths[i]])
        put(i + 1, [*rooms, capacity - lengths[i]])

    put(0, [])
    return best[0]


def planned(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = packing.Plan(counts, capacity)
    rows = []
    for l in np.flatnonzero(counts).tolist():
        s, o = plan.look_up(np.full(counts[l], l), np.arange(counts[l]))
        rows += [type("Row", (), {"sequence_id": int(a), "offset": int(b), "length": l}) for a, b in zip(s, o)]
    assert len(rows) == len(lengths)
    return plan, placed_ok(rows, capacity)


def test_fixed_sets_are_never_worse():
    """After the reduction an optimal packing of the rest is an optimal packing of all."""
    draw, fixed = random.Random(3), 0
    for _ in range(250):
        capacity = draw.choice([7, 10, 20, 33])
        low = draw.choice([1, capacity // 5 + 1, capacity // 4 + 1, capacity // 3])
        lengths = [draw.randrange(low, capacity + 1) for _ in range(draw.randrange(1, 9))]
        plan, n = planned(lengths, capacity)
        fixed += plan.fixed
        rest = Counter(lengths)
        s = Counter()
        for l in set(lengths):
            seq, _ = plan.look_up(np.full(rest[l], l), np.arange(rest[l]))
            s[l] = int((seq < plan.fixed).sum())
        left = list((rest - s).elements())
        assert plan.fixed + least_sequences(left, capacity) == least_sequences(lengths, capacity)
        assert n <= least_sequences(lengths, capacity) + 1
    assert fixed > 300


@pytest.mark.parametrize("seed", range(6))
def test_plans_come_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 4097, 4000), rng.integers(1000, 3000, 5000), np.minimum(4096, rng.geometric(0.002, 8000)), np.repeat(rng.integers(1, 4097, 30), 400), np.full(1000, 1366), rng.integers(1300, 1500, 3000)][seed]
    plan, n = planned(lengths, 4096)
    assert n >= -(-int(lengths.sum()) // 4096)
    rooms = []
    for l in sorted(lengths.tolist(), reverse=True):  # plain first fit, longest first
        for i, r in enumerate(rooms):
            if r >= l:
                rooms[i] -= l
                break
        else:
            rooms.append(4096 - l)
    assert n <= len(rooms)
    assert len(plan.runs) <= 4096 * 12


def test_runs_do_not_grow_with_the_copies():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 4097, 20_000), minlength=4097)
    assert len(packing.Plan(counts * 1_000_000, 4096).runs) < 3 * len(packing.Plan(counts, 4096).runs)


def test_packing_query_equals_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.WORD_BPE)
    library.no_truncation()
    table = pq.read_table(f"{sf_dir}/documents.parquet")
    want = {}
    for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist()):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            part = ids[a : a + 4096]
            want[i, k] = (a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rows = queries.op12_packing(spark, sf_dir).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    assert placed_ok(rows, 4096) == -(-sum(w[1] for w in want.values()) // 4096)


def test_packing_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([(1, None), (1, None), (None, "a b c"), (3, ""), (4, long), (4, long), (None, None)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("length", "task", "place", "row", "n", "before", "rank", "ids", "piece", "start")})
    cut = packing.pieces(docs, queries.WORD_BPE)
    rows = packing.packed(cut.withColumns({c: F.lit("x") for c in ("task", "place", "row", "n", "before", "rank", "sequence_id")})).collect()
    placed_ok(rows, 4096)
    assert Counter((r.doc_id, r.length) for r in rows if r.doc_id != 4) == Counter([(1, 1), (1, 1), (None, 4), (3, 1), (None, 1)])
    assert {r.task for r in rows} == {"x"} and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    whole = packing.sequences(packing.packed(cut)).collect()
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in rows) and all(r.n_tokens == len(r.ids) for r in whole)
    assert packing.packed(cut.limit(0)).count() == 0
    with pytest.raises(Exception, match="lengths must lie"):
        packing.packed(spark.createDataFrame([(5000,)], "length long")).count()


# ---- spelling -----------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def brute_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and v != w and edits(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    root = {}
    for w in n:
        root[w] = w
        while form[root[w]] is not None:
            root[w] = form[root[w]]
    return {(w, form[w], root[w], n[w], len(near[w]), n.get(form[w])) for w in n}


@pytest.mark.parametrize("block", [spelling.BLOCK, 8])
def test_variants_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    draw, n = random.Random(5), {}
    for _ in range(900):
        w = "".join(draw.choice("abé") for _ in range(draw.choice([1, 2, 5, 6, 7, 8, 9])))
        n[w] = draw.choice([1, 1, 2, 5, 5, 30, 200, 1000])
    n |= {"x" * 500: 7, "x" * 499: 50, "x" * 498 + "yx": 3, "": 40}
    got = spelling.variants(spark.createDataFrame(list(n.items()), "word string, n long"), least=1, n="n")
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(n)


def test_occurrences_equal_the_definition(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/documents.parquet")
    docs = [*zip(table["doc_id"].to_pylist(), table["text"].to_pylist()), (10**6, "ÀÀÀÀÀÀ àààààà StRaßeN×÷ÿ abcdeſ ABCDEF"), (10**6 + 1, None), (10**6 + 2, ""), (None, "nullnull")]
    docs += [(2 * 10**6 + k, "Spellings") for k in range(2000)]
    want = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            run = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run
            want[run] += len(run) >= 6
    got = spelling.occurrences(spark.createDataFrame(docs, "doc_id long, text string")).groupBy("word").count().collect()
    assert {r.word: r["count"] for r in got} == +want and sum(n for w, n in want.items() if len(w) == 8 and edits(w, "spellings") == 1) > 0


def test_variants_of_odd_rows(spark):
    words = spark.createDataFrame([("lantern", 9), ("lantern", 1), (None, 4), ("lanterm", 2), ("lamterm", None), ("lanterns", 10)], "word string, n long")
    words = words.withColumns({c: F.lit("x") for c in ("own", "m", "f", "shared", "blocks", "best", "root", "form")})
    got = {tuple(r) for r in spelling.variants(words, least=2, n="n").collect()}
    assert got == {("lantern", None, "lantern", 10, 2, None), ("lanterm", "lantern", "lantern", 2, 1, 10), ("lanterns", None, "lanterns", 10, 1, None)}
    assert spelling.variants(words.limit(0), n="n").count() == 0
    assert spelling.variants(words.where("word = 'lanterm'"), least=1).collect()[0].n == 1
