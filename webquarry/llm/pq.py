"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table look-ups, exact cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import written
from webquarry.llm.components import components

COSINE = 0.9
#: The fit: vectors sampled by hash, most inverted lists, parts of a residual and codes of a part.
SAMPLE = 10_000
LISTS = 4096
PARTS = 8
CODES = 256
ROUNDS = 8
#: Lists that each vector searches; None for every list that may hold a link.
PROBES = 8
#: Vectors that are compared with all centres at once.
CODED = 1024
#: Rows of a list, and of its queries, that one group holds.
LIST_BLOCK = 1024
QUERY_BLOCK = 2048
PAIRS = 200_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - 0.5 * (centres * centres).sum(axis=1)).argmax(axis=1)


def _means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _nearest(x, centres)
        count = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class Index:
    """Coarse centres and the code books of residual parts."""

    def __init__(self, sample: np.ndarray, n: int):
        rng = np.random.default_rng(5)
        self.lists = int(max(1, min(LISTS, round(n**0.5), len(sample))))
        self.coarse = _means(sample, self.lists, rng)
        rest = sample - self.coarse[_nearest(sample, self.coarse)]
        self.cuts = np.linspace(0, sample.shape[1], PARTS + 1).astype(int)
        k = min(CODES, len(sample))
        self.books = [_means(rest[:, a:b], k, rng) if b > a else np.zeros((1, 0)) for a, b in zip(self.cuts[:-1], self.cuts[1:])]

    def searched(self, score: np.ndarray, own: np.ndarray, probes: int | None, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """The lists to search, joined, and their number for each vector.

        Without `probes` a list is left out only if no vector within `reach` can lie in it: behind the plane halfway between
        its centre and the vector's own, all points are nearer to the own centre.
        """
        if probes is not None:
            m = min(probes, self.lists)
            return np.argpartition(-score, m - 1, axis=1)[:, :m].ravel(), np.full(len(score), m)
        square = (self.coarse * self.coarse).sum(axis=1)
        between = np.sqrt(np.maximum(square[own][:, None] + square[None] - 2 * self.coarse[own] @ self.coarse.T, 0))
        near = score[np.arange(len(own)), own][:, None] - score <= reach * between + 1e-6
        return np.nonzero(near)[1], near.sum(axis=1)

    def encode(self, x: np.ndarray, probes: int | None = PROBES, reach: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, codes, distance from the decoded vector of each vector, the lists that each searches, joined, and their numbers."""
        score = x @ self.coarse.T - 0.5 * (self.coarse * self.coarse).sum(axis=1)
        own = score.argmax(axis=1)
        rest = x - self.coarse[own]
        codes = np.stack([_nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        back = np.concatenate([book[codes[:, p]] for p, book in enumerate(self.books)], axis=1)
        return own, codes, np.sqrt(((rest - back) ** 2).sum(axis=1)), *self.searched(score, own, probes, reach)

    def distances(self, queries: np.ndarray, lst: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded members of a list, by tables of squared part distances."""
        rest = queries - self.coarse[lst]
        out = np.zeros((len(queries), len(codes)))
        for p, (a, b, book) in enumerate(zip(self.cuts[:-1], self.cuts[1:], self.books)):
            part = rest[:, a:b]
            table = (part * part).sum(axis=1)[:, None] - 2 * part @ book.T + (book * book).sum(axis=1)[None, :]
            out += table[:, codes[:, p]]
        return np.sqrt(np.maximum(out, 0))


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _searched(file: Broadcast, dim: int, cosine: float):
    """Links inside one block of a list and of its queries: per vector the weight of its links, and the smallest vector they join it to here."""
    reach = np.sqrt(2 - 2 * cosine) + 1e-9

    def run(group: pa.Table) -> pa.Table:
        index = file.value
        rows = group.combine_chunks()
        lst = int(rows.column("list")[0].as_py())
        query = rows.column("query").to_numpy(zero_copy_only=False)
        vec = lambda t: _unit(_vectors(t.column("vector").combine_chunks(), dim))
        members, asking = rows.filter(pa.array(~query)), rows.filter(pa.array(query))
        y, x = vec(members), vec(asking)
        yid, xid = members.column("id").to_numpy(), asking.column("id").to_numpy()
        yw, xw = members.column("weight").to_numpy(), asking.column("weight").to_numpy()
        x_list = asking.column("own").to_numpy()
        y_probes = members.column("probes").combine_chunks()
        y_searches = np.repeat(np.arange(len(yid)), y_probes.value_lengths().to_numpy()) * index.lists + y_probes.flatten().to_numpy()
        codes = np.frombuffer(b"".join(members.column("codes").to_pylist()), np.uint8).reshape(len(yid), -1)
        err = members.column("err").to_numpy()
        xs, ys = [], []
        for lo in range(0, len(xid), 512):
            near = index.distances(x[lo : lo + 512], lst, codes) <= reach + err[None, :]  # by the triangle inequality none is lost
            near &= xid[lo : lo + 512, None] != yid[None, :]
            i, j = np.nonzero(near)
            for k in range(0, len(i), PAIRS):
                a, b = i[k : k + PAIRS] + lo, j[k : k + PAIRS]
                true = np.einsum("ij,ij->i", x[a], y[b]) >= cosine
                xs.append(a[true])
                ys.append(b[true])
        i = np.concatenate(xs) if xs else np.zeros(0, np.int64)
        j = np.concatenate(ys) if ys else np.zeros(0, np.int64)
        count_x = np.bincount(i, yw[j], len(xid))
        unseen = ~np.isin(j * index.lists + x_list[i], y_searches)  # the member does not search the query's list itself
        count_y = np.bincount(j[unseen], xw[i[unseen]], len(yid))
        label_x, label_y, last = xid.copy(), yid.copy(), None
        while last is None or (label_x != last).any():
            last = label_x.copy()
            np.minimum.at(label_y, j, label_x[i])
            np.minimum.at(label_x, i, label_y[j])
        some_x, some_y = np.unique(i), np.unique(j)
        return pa.table({
            "id": pa.array(np.concatenate([xid[some_x], yid[some_y]]), pa.int64()),
            "n": pa.array(np.concatenate([count_x[some_x], count_y[some_y]]).astype(np.int64), pa.int64()),
            "label": pa.array(np.concatenate([label_x[some_x], label_y[some_y]]), pa.int64()),
        })

    return run


def _links(classes: DataFrame, dim: int, n: int, cosine: float, probes: int | None) -> DataFrame:
    """(id, n, label): the links of the `n` representatives of length `dim`, as sums and labels by block."""
    sample = classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").toArrow()
    index = Index(_unit(_vectors(sample.column("vector").combine_chunks(), dim)), n)
    file = classes.sparkSession.sparkContext.broadcast(index)  # LISTS + CODES vectors at most
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-9

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(lo, CODED) for whole in batches for lo in range(0, whole.num_rows, CODED)):
            own, codes, err, lists, sizes = file.value.encode(_unit(_vectors(batch.column("vector"), dim)), probes, reach)
            searched = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(lists.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("weight"), batch.column("vector"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), searched],
                names=["id", "weight", "vector", "own", "codes", "err", "probes"],
            )

    coded = written(classes.select("id", "weight", "vector").mapInArrow(code, "id long, weight long, vector array<double>, own int, codes binary, err double, probes array<int>"), "coded")
    asked = coded.select("id", "weight", "vector", "own", F.explode("probes").alias("list"))
    sizes = coded.groupBy(F.col("own").alias("list")).agg(F.count("*").alias("n")).join(asked.groupBy("list").agg(F.count("*").alias("m")), "list")
    plan = F.broadcast(sizes.select("list", F.ceil(F.col("n") / LIST_BLOCK).cast("int").alias("nl"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("nq")))  # a row for each of LISTS lists
    members = coded.join(plan, coded["own"] == plan["list"]).select(
        "list", F.pmod(F.xxhash64("id"), "nl").cast("int").alias("lb"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb"),
        F.lit(False).alias("query"), "id", "weight", "vector", "own", "codes", "err", "probes",
    )
    queries = asked.join(plan, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("lb"), F.pmod(F.xxhash64("id"), "nq").cast("int").alias("qb"),
        F.lit(True).alias("query"), "id", "weight", "vector", "own", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("err"), F.lit(None).cast("array<int>").alias("probes"),
    )
    return written(members.unionByName(queries).groupBy("list", "lb", "qb").applyInArrow(_searched(file, dim, cosine), "id long, n long, label long"), "links")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE, probes: int | None = PROBES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; vectors with a cosine of `cosine` or more in double precision are linked.

    Vectors that are null, empty, all zero, or hold null or non-finite components link with nothing.  Vectors of different
    lengths never link; every length has an index of its own, one after the other, so lengths are expected to be few.  Equal vectors are one weighted representative, so copies count as links without being compared.
    The index is fitted on up to SAMPLE vectors and holds all; every vector searches `probes` lists, and a pair
    counts if either finds the other; with `probes` None it searches every list that the plane halfway between two centres cannot
    exclude, and no link is lost, at the price of more lists the less the vectors cluster.  Look-ups rule pairs out by the triangle inequality with the member's own coding
    error, so only the choice of lists can lose a link.  Large lists are cut into blocks; blocks return sums and one
    label for each vector, never pairs.  `key` holds unique longs; other columns are left out.
    """
    base = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & sound, F.lit(False))
    named = written(base.select("vec_id", F.when(usable, F.col("vector")).alias("vector"), F.when(usable, F.xxhash64("vector")).alias("k1"), F.when(usable, F.xxhash64(F.lit(1), "vector")).alias("k2")), "vectors")
    classes = written(named.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("vector").alias("vector")), "classes")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy(F.size("vector").alias("dim")).count().collect()}  # one row for each length
    if not sizes:
        return named.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = reduce(DataFrame.unionByName, [_links(classes.where(F.size("vector") == dim), dim, n, cosine, probes) for dim, n in sorted(sizes.items())])
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("label").alias("a"), F.col("id").alias("b")))
    reps = classes.select("k1", "k2", "id", "weight").join(counts, "id", "left").join(groups, "id", "left")
    return (
        named.select("vec_id", "k1", "k2").join(reps, ["k1", "k2"], "left")
        .select("vec_id", (F.coalesce("n", F.lit(0)) + F.coalesce(F.col("weight") - 1, F.lit(0))).alias("n_links"), F.coalesce("component_id", "id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
