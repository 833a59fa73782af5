"""Centroid clustering by exponion search: exact integer k-means whose vectors look only at centroids near their own.

Every vector keeps an upper bound on the distance to its centroid and a lower bound on that to all others.  Where the
upper bound is below the lower one, or below half the way to the centroid's nearest neighbour, nothing is
computed.  Else the distance is made exact, and only centroids inside the ball around the vector's centroid
of twice that distance plus the way to its nearest neighbour are scanned: a prefix of that centroid's list of
others, sorted by distance.  The ball holds the nearest and the second nearest centroid; its radius counts
as inside, so ties are seen and go to the smaller number.  Squared distances are exact integers; bounds are
widened by more than their rounding.

Vectors travel in blocks with their bounds, rewritten once a round without any shuffle; centroids and
their sums (STARTS x 66 numbers) are all that meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import discard, settle
from .workers import lean

#: Components of a vector, what they are multiplied by, centroids and rounds of the query.
WIDTH, SCALE, STARTS, ROUNDS = 64, 256, 40, 5
#: Vectors of a block row, and of the blocks handled at once.
BLOCK, AT_ONCE = 1024, 1 << 14
#: Greatest scaled component: squared distances then fit in 64 bits.
GREATEST = 1 << 27
#: Up to this component sums of products are exact in doubles.
_EXACT = 1 << 22
_SLACK = 1e-9

BLOCK_ROW = "vectors int, ids binary, absent binary, points binary, cluster binary, upper binary, lower binary, sums array<long>"


@dataclass
class Centroids:
    """points (k x WIDTH, int64), the others of each by distance, those distances, and how far each moved in the last round."""

    points: np.ndarray
    others: np.ndarray
    ways: np.ndarray
    moved: np.ndarray

    @staticmethod
    def of(points: np.ndarray, before: np.ndarray | None = None) -> "Centroids":
        k = len(points)
        between = np.sqrt(squares(points, points).astype(float))
        np.fill_diagonal(between, -1.0)  # each leads its own list
        others = np.argsort(between, axis=1, kind="stable")
        ways = np.take_along_axis(between, others, 1)
        moved = np.zeros(k) if before is None else np.sqrt(((points - before) ** 2).sum(1).astype(float)) * (1 + _SLACK)
        return Centroids(points, others, ways, moved)

    @property
    def nearest_way(self) -> np.ndarray:
        return self.ways[:, 1] if len(self.points) > 1 else np.full(len(self.points), np.inf)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a to all of b."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    if max(np.abs(a).max(), np.abs(b).max()) <= _EXACT:
        x, y = a.astype(float), b.astype(float)
        return ((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], 1)


def search_all(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, exact squared distance, upper and lower bound of each vector, by scanning all centroids."""
    found = squares(x, centroids.points)
    cluster = found.argmin(1)
    distance = np.take_along_axis(found, cluster[:, None], 1)[:, 0]
    np.put_along_axis(found, cluster[:, None], np.iinfo(np.int64).max, 1)
    upper = np.sqrt(distance.astype(float)) * (1 + _SLACK)
    lower = np.sqrt(found.min(1).astype(float)) * (1 - _SLACK) if len(centroids.points) > 1 else np.full(len(x), np.inf)
    return cluster, distance, upper, lower


def search_balls(x: np.ndarray, centroids: Centroids, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """New cluster, upper and lower bound of each vector after the centroids moved, and how many distances were computed."""
    cluster = cluster.copy()
    k = len(centroids.points)
    upper = upper + centroids.moved[cluster]
    most = np.argsort(centroids.moved)[::-1]
    others_moved = np.where(cluster == most[0], centroids.moved[most[1]] if k > 1 else 0.0, centroids.moved[most[0]])
    lower = lower - others_moved
    half = centroids.nearest_way * (0.5 - _SLACK)
    computed = 0
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
    if len(open_):
        gap = x[open_] - centroids.points[cluster[open_]]
        upper[open_] = np.sqrt((gap * gap).sum(1).astype(float)) * (1 + _SLACK)
        computed += len(open_)
        open_ = open_[upper[open_] >= np.maximum(lower[open_], half[cluster[open_]])]
    for own in np.unique(cluster[open_]):
        rows = open_[cluster[open_] == own]
        radius = (2 * upper[rows] + centroids.nearest_way[own]) * (1 + _SLACK)
        inside = np.searchsorted(centroids.ways[own], radius, "right")  # the radius itself is inside
        width = np.minimum(k, 1 << np.ceil(np.log2(np.maximum(inside, 2))).astype(int))
        for w in np.unique(width):
            part = rows[width == w]
            scanned = np.sort(centroids.others[own, :w])  # in the order of numbers, so that the first least is the smallest
            computed += len(part) * len(scanned)
            found = squares(x[part], centroids.points[scanned])
            best = found.argmin(1)
            upper[part] = np.sqrt(np.take_along_axis(found, best[:, None], 1)[:, 0].astype(float)) * (1 + _SLACK)
            np.put_along_axis(found, best[:, None], np.iinfo(np.int64).max, 1)
            lower[part] = np.sqrt(found.min(1).astype(float)) * (1 - _SLACK) if k > 1 else np.inf
            cluster[part] = scanned[best]
    return cluster, upper, lower, computed


def kept_vectors(embedding: Column) -> Column:
    """Whether a vector has WIDTH components, none null or non-finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) == WIDTH) & finite, F.lit(False))


def _scaled(values: np.ndarray) -> np.ndarray:
    points = np.floor(values * SCALE)
    if len(points) and np.abs(points).max() > GREATEST:
        raise ValueError(f"components beyond {GREATEST // SCALE} have squared distances that no long holds")
    return points.astype(np.int64)


@lean
def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of kept rows (vec_id, embedding: array of double) as block rows without clusters."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, values = batch.column(0), batch.column(1).flatten().to_numpy().reshape(-1, WIDTH)
        points = _scaled(values)
        absent = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy().astype(np.int64)
        for low in range(0, len(ids), BLOCK):
            yield _block_row(ids[low : low + BLOCK], absent[low : low + BLOCK], points[low : low + BLOCK], None)


def _block_row(ids: np.ndarray, absent: np.ndarray, points: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, sums: list[int] | None = None) -> pa.RecordBatch:
    small = points.astype(np.int16) if len(points) and np.abs(points).max() < 1 << 15 else points.astype(np.int32)
    blobs = [ids.tobytes(), absent.astype(bool).tobytes(), small.tobytes()]
    blobs += [None] * 3 if state is None else [state[0].astype(np.int16).tobytes(), state[1].astype(np.float64).tobytes(), state[2].astype(np.float64).tobytes()]
    columns = [pa.array([len(ids)], pa.int32()), *(pa.array([b], pa.binary()) for b in blobs), pa.array([sums], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in BLOCK_ROW.split(", ")])


def _read(batch: pa.RecordBatch, rows: range) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray | None]:
    sizes = [batch["vectors"][r].as_py() for r in rows]
    raw = {name: [batch[name][r].as_py() for r in rows] for name in ("ids", "absent", "points", "cluster", "upper", "lower")}
    points = np.concatenate([np.frombuffer(b, np.int16 if len(b) == 2 * WIDTH * n else np.int32).astype(np.int64) for b, n in zip(raw["points"], sizes, strict=True)])
    joined = lambda name, kind: np.concatenate([np.frombuffer(b, kind) for b in raw[name]])
    state = (None, None, None) if raw["cluster"][0] is None else (joined("cluster", np.int16).astype(np.int64), joined("upper", float).copy(), joined("lower", float).copy())
    return sizes, joined("ids", np.int64), joined("absent", bool), points.reshape(-1, WIDTH), *state


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for low in range(0, batch.num_rows, AT_ONCE // BLOCK):
            yield _read(batch, range(low, min(batch.num_rows, low + AT_ONCE // BLOCK)))


def _assign(shared) -> Callable:
    """Blocks with new clusters and bounds, and one row with the sums of components and the numbers of vectors by cluster."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Centroids = shared.value
        k = len(own.points)
        sums = np.zeros((k, WIDTH + 1), np.int64)
        for sizes, ids, absent, x, cluster, upper, lower in _pieces(batches):
            if cluster is None:
                cluster, _, upper, lower = search_all(x, own)
            else:
                cluster, upper, lower, _ = search_balls(x, own, cluster, upper, lower)
            np.add.at(sums[:, WIDTH], cluster, 1)
            order = np.argsort(cluster, kind="stable")
            used, first = np.unique(cluster[order], return_index=True)
            sums[used, :WIDTH] += np.add.reduceat(x[order], first)
            at = 0
            for n in sizes:
                piece = slice(at, at + n)
                yield _block_row(ids[piece], absent[piece], x[piece], (cluster[piece], upper[piece], lower[piece]))
                at += n
        if sums[:, WIDTH].any():
            none = np.zeros(0, np.int64)
            yield _block_row(none, none, none, None, sums.ravel().tolist())

    return run


def _finish(shared) -> Callable:
    """(vec_id, cluster, distance) of each vector."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Centroids = shared.value
        for _, ids, absent, x, cluster, upper, lower in _pieces(batches):
            if cluster is None:
                cluster = search_all(x, own)[0]
            else:
                cluster = search_balls(x, own, cluster, upper, lower)[0]
            gap = x - own.points[cluster]
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=absent), pa.array(cluster.astype(np.int32)), pa.array((gap * gap).sum(1))], names=["vec_id", "cluster", "distance"])

    return run


def starting_points(kept: DataFrame, starts: int) -> np.ndarray:
    """The scaled vectors of the `starts` ids with the smallest sha256 of 2:<vec_id>; of equal ids the smaller vector leads."""
    name = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(name.alias("name"), "embedding").where("name is not null").orderBy("name", "embedding").limit(starts).collect()  # starts rows
    return _scaled(np.array([r["embedding"] for r in rows], float).reshape(-1, WIDTH))


def centroid_clusters(vectors: DataFrame, starts: int = STARTS, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the kept rows of vectors (vec_id, embedding).

    Kept are vectors of WIDTH components, none null or non-finite; a component x counts as floor(SCALE * x).  Each
    round gives every vector to its nearest centroid (ties: the smaller number) and moves non-empty centroids to
    the floors of their vectors' means.  Where fewer than `starts` vectors are kept, each starts a centroid; vectors
    with a null vec_id start none, and where no other is kept there are no rows.  Repeated rows count as often
    as they occur; other columns are ignored; no rows give no rows; scaled components beyond 2^27 raise
    an error, for no long holds their distances.
    """
    spark = vectors.sparkSession
    kept = vectors.where(kept_vectors(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    points = starting_points(kept, starts)
    shape = "vec_id long, cluster int, distance long"
    if not len(points):
        found = spark.createDataFrame([], shape)
        return found.select("*", *[F.lit(0).cast("long").alias(c) for c in ("cluster_inertia", "inertia")], F.lit("").alias("centroid_sha256"))
    k = len(points)
    blocks = settle(kept.mapInArrow(_blocks, BLOCK_ROW), "blocks")
    centroids = Centroids.of(points)
    for _ in range(rounds):
        then = settle(blocks.where("vectors > 0").mapInArrow(_assign(spark.sparkContext.broadcast(centroids)), BLOCK_ROW), "blocks")
        discard(blocks)
        blocks = then
        sums = np.zeros(k * (WIDTH + 1), np.int64)
        for r in blocks.where("vectors = 0").select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():  # k * (WIDTH + 1) rows
            sums[r["at"]] = r["v"]
        sums = sums.reshape(k, WIDTH + 1)
        many = sums[:, WIDTH :]
        points = np.where(many > 0, sums[:, :WIDTH] // np.maximum(many, 1), centroids.points)
        centroids = Centroids.of(points, centroids.points)
    found = settle(blocks.where("vectors > 0").mapInArrow(_finish(spark.sparkContext.broadcast(centroids)), shape), "clusters")
    discard(blocks)
    inertia = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}  # k rows
    whole = sum(inertia.values())
    named = [(c, inertia.get(c, 0), whole, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.points.tolist())]
    ends = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
