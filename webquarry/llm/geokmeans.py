"""Centroid clustering in whole numbers, with distance bounds loosened by plane geometry.

Every vector keeps an upper bound of the distance to its own centroid and a lower bound of the distance to all others.
When centroids move, the upper bound grows by its centroid's drift.  The lower bound need not fall by the largest drift: the
members of a cluster lie in a sphere, and how much nearer another centroid can come to any point of it depends on the direction
in which that centroid moved.  With A and B its old and new place, M their midpoint and D their distance, the points that
come nearer by 2a or more lie on one side of a branch of a hyperbola with foci A and B, hence in the cone at M around
the direction of the move whose half angle has the cosine 2a / D.  So no point of a sphere that M sees at an angle of at least t from that
direction comes nearer by more than D cos t.  Vectors whose bounds cross are ambiguous and scanned exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webquarry.llm.common import shared_folder, small_batches

#: Room for rounding in the bounds; they are never trusted closer than this.
SLACK = 1e-9
#: Rows that are scanned against all centroids at once.
SCAN = 8192


@dataclass(frozen=True)
class Clustering:
    """`assigned` (key, cluster, distance) of every kept vector; `centroids` (cluster, centroid, n, inertia) of clusters with members; their sum."""

    assigned: DataFrame
    centroids: DataFrame
    inertia: int


def loosened(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much at most any other centroid can come nearer to a point of its sphere.

    Spheres have the old centroids as centres.  Negative radii stand for clusters without members.
    """
    old, new = old.astype(float), new.astype(float)
    drift = np.sqrt(((new - old) ** 2).sum(axis=1))
    axis = (new - old) / np.where(drift > 0, drift, 1)[:, None]
    mid = (old + new) / 2
    out = np.zeros(len(old))
    for i, r in enumerate(np.maximum(radius, 0) * (1 + SLACK) + SLACK):
        v = old[i] - mid
        dist = np.sqrt((v * v).sum(axis=1))
        far = np.where(dist > r, dist, 1)
        along = (v * axis).sum(axis=1) / far
        across = np.sqrt(np.maximum(0, 1 - along * along))
        sin = np.minimum(1, r / far)
        cos = np.sqrt(1 - sin * sin)
        ahead = (along >= cos) | (dist <= r)  # the move's direction itself meets the sphere
        gain = drift * np.where(ahead, 1, np.clip(along * cos + across * sin, 0, 1))
        gain[i] = 0
        out[i] = gain.max(initial=0) * (1 + SLACK) + SLACK
    return out


def _limit(dim: int) -> int:
    """The largest component for which every squared distance fits a long."""
    return int(((2**63 - 1) / max(1, dim)) ** 0.5 / 2) - 1


def _exact(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances as whole numbers; by a float product where that is exact."""
    dim = x.shape[1]
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if dim * (2 * most) ** 2 < 2**52:
        xf, cf = x.astype(float), centroids.astype(float)
        return ((xf * xf).sum(axis=1)[:, None] - 2 * (xf @ cf.T) + (cf * cf).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def _own(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(axis=1)


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of whole numbers as bytes, of the narrowest kind that holds the batch."""
    kind = next(k for k in (np.int16, np.int32, np.int64) if len(x) == 0 or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
    raw, step = x.astype(kind).tobytes(), x.shape[1] * np.dtype(kind).itemsize
    return pa.array([raw[i : i + step] for i in range(0, step * len(x), step)], pa.binary())


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    raws = column.to_pylist()
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    out = np.empty((len(raws), dim), np.int64)
    for size in np.unique(sizes).tolist():
        some = np.flatnonzero(sizes == size)
        kind = {2: np.int16, 4: np.int32, 8: np.int64}[size // dim]
        out[some] = np.frombuffer(b"".join([raws[i] for i in some.tolist()]), kind).reshape(-1, dim)
    return out


@dataclass(frozen=True)
class Round:
    """What the tasks of one round need to know: bounded by the number of clusters times the dimensions."""

    centroids: np.ndarray
    drift: np.ndarray | None = None
    loose: np.ndarray | None = None

    def half_gaps(self) -> np.ndarray:
        """Half the distance from each centroid to the nearest other one: a nearer point can have no nearer centroid."""
        gaps = np.sqrt(_exact(self.centroids, self.centroids).astype(float))
        np.fill_diagonal(gaps, np.inf)
        return gaps.min(axis=1) / 2 * (1 - SLACK)

    def scanned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid (ties: the smaller number), distance to it, and distance to the second nearest."""
        cluster, upper, lower = np.zeros(len(x), np.int64), np.zeros(len(x)), np.full(len(x), np.inf)
        for a in range(0, len(x), SCAN):
            d = _exact(x[a : a + SCAN], self.centroids)
            row, b = np.arange(len(d)), a + len(d)
            cluster[a:b] = d.argmin(axis=1)
            upper[a:b] = np.sqrt(d[row, cluster[a:b]].astype(float))
            if d.shape[1] > 1:
                rest = d.copy()
                rest[row, cluster[a:b]] = np.iinfo(np.int64).max
                lower[a:b] = np.sqrt(rest.min(axis=1).astype(float))
        return cluster, upper, lower

    def moved(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same after the centroids moved; only vectors whose bounds cross are scanned."""
        upper, lower = (upper + self.drift[cluster]) * (1 + SLACK), lower - self.loose[cluster]
        bound = np.maximum(lower, self.half_gaps()[cluster])
        doubt = np.flatnonzero(upper * (1 + SLACK) >= bound)
        upper[doubt] = np.sqrt(_own(x[doubt], self.centroids, cluster[doubt]).astype(float))
        doubt = doubt[upper[doubt] * (1 + SLACK) >= bound[doubt]]
        cluster[doubt], upper[doubt], lower[doubt] = self.scanned(x[doubt])
        return cluster, upper, lower


def _tallied(now: Round, dim: int, read):
    """Rows of a round, and behind them one row with the task's sums: components, members, squared distances and radius by cluster."""
    k = len(now.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, radius, kind = np.zeros((k, dim + 2), np.int64), np.full(k, -1.0), None
        for batch in batches:
            kind = batch.schema.field("id").type
            for a in range(0, batch.num_rows, SCAN):
                rows = batch.slice(a, SCAN)
                x, (cluster, upper, lower) = read(rows)
                distance = _own(x, now.centroids, cluster)
                order = np.argsort(cluster, kind="stable")
                here, first = np.unique(cluster[order], return_index=True)
                sums[here, :dim] += np.add.reduceat(x[order], first, axis=0)
                sums[here, dim] += np.diff(np.append(first, len(order)))
                sums[here, dim + 1] += np.add.reduceat(distance[order], first)
                np.maximum.at(radius, cluster, upper)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), _pack(x), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower), pa.array(distance), pa.nulls(len(x), pa.list_(pa.int64())), pa.nulls(len(x), pa.list_(pa.float64()))],
                    names=["id", "x", "cluster", "upper", "lower", "distance", "sums", "radii"],
                )
        if kind is not None:
            none = [pa.nulls(1, t) for t in (kind, pa.binary(), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.ravel().tolist()], pa.list_(pa.int64())), pa.array([radius.tolist()], pa.list_(pa.float64()))], names=["id", "x", "cluster", "upper", "lower", "distance", "sums", "radii"])

    return run


def _first_round(now: Round, dim: int):
    def read(rows: pa.RecordBatch):
        x = np.asarray(rows.column(1).flatten(), np.int64).reshape(-1, dim)
        return x, now.scanned(x)

    return _tallied(now, dim, read)


def _next_round(now: Round, dim: int):
    def read(rows: pa.RecordBatch):
        x = _unpack(rows.column(1), dim)
        cluster, upper, lower = (rows.column(c).to_numpy(zero_copy_only=False).copy() for c in (2, 3, 4))
        return x, now.moved(x, cluster.astype(np.int64), upper, lower)

    return _tallied(now, dim, read)


def _kept(df: DataFrame) -> DataFrame:
    """A round's rows in a table of the shared folder, compressed: the next round starts from there if executors are lost."""
    path = shared_folder(df.sparkSession, "clusters")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _totals(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and radii of all tasks, added on executors; k * (dim + 2) and k numbers come back."""
    sums, radii = np.zeros(k * (dim + 2), np.int64), np.full(k, -1.0)
    each = F.concat(
        F.transform("sums", lambda v, i: F.struct(i.alias("i"), v.alias("sum"), F.lit(None).cast("double").alias("radius"))),
        F.transform("radii", lambda v, i: F.struct(i.alias("i"), F.lit(None).cast("long").alias("sum"), v.alias("radius"))),
    )
    rows = state.where("sums IS NOT NULL").select(F.inline(each)).groupBy("i").agg(F.sum("sum").alias("sum"), F.max("radius").alias("radius"))
    for r in rows.collect():
        sums[r.i] = r["sum"]
        if r.i < k:
            radii[r.i] = r.radius
    return sums.reshape(k, dim + 2), radii


def clustered(vectors: DataFrame, dim: int = 64, k: int = 40, rounds: int = 5, scale: int = 256, seed: int = 2, key: str = "vec_id", vector: str = "embedding") -> Clustering:
    """Vectors of `dim` finite components, taken as whole numbers floor(scale * x), dealt to k centroids.

    Centroids start as the k vectors with the least sha256 of `seed:key` (ties: the smaller vector; a null key counts as empty).
    A round assigns every vector to the nearest centroid (squared distance; ties: the smaller number) and replaces centroids with
    members by floor(sum / count); after `rounds` of them vectors are assigned once more.  All sums and distances are whole
    numbers, so the result does not depend on the layout.  Vectors that are null, of another length, or that hold null or non-finite components are
    left out; repeated keys are rows of their own; fewer vectors than k give as many centroids; none give empty tables.  Raises
    ValueError for components so large that a squared distance may not fit a long.  Other columns are left out.

    Each round reads the table of the round before, writes its own in the shared folder, and moves no vector: only one row of sums
    for each task is shuffled.  The driver holds the centroids.
    """
    small_batches(vectors.sparkSession)
    whole = F.transform(F.col("v"), lambda x: F.floor(x.cast("double") * scale))
    limit = _limit(dim)
    inside = F.forall("v", lambda x: F.abs(x.cast("double") * scale) <= limit - 1)
    named = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"))
    usable = named.where(F.size("v") == dim).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))))
    rows = usable.select("id", F.when(inside, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {limit}: squared distances may not fit a long"))).alias("x"))
    start = rows.select("x", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256).alias("h")).orderBy("h", "x").limit(k).collect()
    kind = rows.schema["id"].dataType.simpleString()
    spark = vectors.sparkSession
    if not start:
        return Clustering(
            spark.createDataFrame([], f"`{key}` {kind}, cluster int, distance long"), spark.createDataFrame([], "cluster int, centroid array<long>, n long, inertia long"), 0,
        )
    now = Round(np.array([r.x for r in start], np.int64))
    schema = f"id {kind}, x binary, cluster int, upper double, lower double, distance long, sums array<long>, radii array<double>"
    state = _kept(rows.mapInArrow(_first_round(now, dim), schema))
    for _ in range(rounds):
        sums, radii = _totals(state, len(start), dim)
        count = sums[:, dim]
        means = np.where(count[:, None] > 0, sums[:, :dim] // np.maximum(count, 1)[:, None], now.centroids)
        drift = np.sqrt(((means - now.centroids).astype(float) ** 2).sum(axis=1)) * (1 + SLACK)
        now = Round(means, drift, loosened(now.centroids, means, radii))
        state = _kept(state.where("x IS NOT NULL").select("id", "x", "cluster", "upper", "lower").mapInArrow(_next_round(now, dim), schema))
    sums, _ = _totals(state, len(start), dim)
    members = [(c, now.centroids[c].tolist(), int(s[dim]), int(s[dim + 1])) for c, s in enumerate(sums) if s[dim]]
    return Clustering(
        state.where("x IS NOT NULL").select(F.col("id").alias(key), "cluster", "distance"),
        spark.createDataFrame(members, "cluster int, centroid array<long>, n long, inertia long"), sum(m[3] for m in members),
    )
