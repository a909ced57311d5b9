"""Centroid clustering in exact integers, with Drake's adaptive bounds instead of all distances in every round.

Each vector keeps an upper bound of the distance to its own centroid, lower bounds for several nearest others, and one
remainder bound for all the rest. Moved centroids widen the bounds. Where the upper bound lies under all lower ones, the
vector stays without a distance being computed; else listed centroids whose bounds don't clear it are measured, and all of
them only where the remainder bound doesn't either. Bounds are doubles kept on the safe side, so whatever they can't order
strictly, ties among it, is decided by exact squared distances. Lists get shorter where no vector has used their ends.

State is a table that each round replaces; sums over clusters change by the vectors that moved, and come as a few rows a
task. Only k centroids meet at the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import discard, materialise
from causeway.llm.vectors import matrix

#: Listed lower bounds at first, at most.
LISTED = 4
#: Components lie within this, so that no squared distance of up to 2^12 dimensions exceeds a long.
LARGEST = 1 << 24
#: Relative slack of bounds, far above the rounding of a few square roots and sums; what it leaves open is measured exactly.
SLACK = 1e-11
#: Vectors worked on at once.
BLOCK = 4096


@dataclass(frozen=True)
class Centroids:
    """points: k rows of whole numbers. moved: the distance each moved in the last update. sums, counts: over each cluster's vectors."""

    points: np.ndarray
    moved: np.ndarray
    sums: np.ndarray
    counts: np.ndarray


def whole_vectors(table: DataFrame, dim: int, scale: int, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, x (array<long>): floor(scale * component) of the vectors with dim components, none null or non-finite; rows without id are left out.

    Components beyond LARGEST after scaling are an error, as distances would not fit a long.
    """
    v = F.col("vector")
    picked = table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = picked.where(F.col("id").isNotNull() & (F.size(v) == dim) & F.coalesce(finite, F.lit(False)))
    floor = lambda x: F.when(F.abs(x * scale) < LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component beyond {LARGEST / scale:g}")).cast("long"))
    return sound.select("id", F.transform(v, floor).alias("x"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digests of their ids, in that order; equal ids go by their vectors. Fewer vectors, fewer centroids."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    top = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.array([r["x"] for r in top], dtype="i8").reshape(len(top), len(top[0]["x"]) if top else 0)


def squared(x: np.ndarray, points: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to the points named for each in the rows of which."""
    out = np.empty(which.shape, "i8")
    for i in range(which.shape[1]):
        apart = x - points[which[:, i]]
        out[:, i] = np.einsum("ij,ij->i", apart, apart)
    return out


def scan(x: np.ndarray, points: np.ndarray, listed: int) -> tuple[np.ndarray, ...]:
    """own, upper, near, lower, rest from distances to all points; equal ones go to the smaller number."""
    k = len(points)
    d = np.stack([squared(x, points, np.full((len(x), 1), c))[:, 0] for c in range(k)], axis=1)
    order = np.argsort(d, axis=1, kind="stable")
    far = np.sqrt(np.take_along_axis(d, order, axis=1).astype("f8"))
    near = order[:, 1 : 1 + listed].astype("i4")
    rest = far[:, 1 + listed] * (1 - SLACK) if k > 1 + listed else np.full(len(x), np.inf)
    return order[:, 0].astype("i4"), far[:, 0] * (1 + SLACK), near, far[:, 1 : 1 + listed] * (1 - SLACK), rest


def refine(x: np.ndarray, own: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, rest: np.ndarray, points: np.ndarray, moved: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """Bounds of a block after centroids moved, and how many listed places were used."""
    k, listed = len(points), near.shape[1]
    # The remainder moves by the largest step of a centroid that is neither own nor listed.
    outside = np.ones((len(x), k), bool)
    outside[np.arange(len(x)), own] = False
    np.put_along_axis(outside, near.astype("i8"), False, axis=1)
    rest = rest - np.where(outside, moved, 0).max(axis=1, initial=0)
    rest = rest - SLACK * np.abs(np.where(np.isfinite(rest), rest, 0))
    rest = np.where(outside.any(axis=1), rest, np.inf)
    lower = (lower - moved[near]) - SLACK * np.abs(lower)
    upper = (upper + moved[own]) * (1 + SLACK)
    least = np.minimum(lower.min(axis=1, initial=np.inf), rest)
    open_ = np.flatnonzero(upper >= least)
    used = 0
    if len(open_):
        # The own distance, measured anew, may certify the order at once.
        exact = squared(x[open_], points, own[open_, None])[:, 0]
        upper[open_] = np.sqrt(exact.astype("f8")) * (1 + SLACK)
        keep = upper[open_] >= least[open_]
        open_, exact = open_[keep], exact[keep]
    if len(open_):
        beyond = rest[open_] <= upper[open_]
        some, exact = open_[~beyond], exact[~beyond]
        if len(some) and listed:
            ask = lower[some] <= upper[some, None]
            used = int((ask * np.arange(1, listed + 1)).max())
            d = np.full(ask.shape, np.iinfo("i8").max)
            for i in range(listed):
                at = np.flatnonzero(ask[:, i])
                d[at, i] = squared(x[some[at]], points, near[some[at], i][:, None])[:, 0]
            # Own and listed centroids in order of distance, then number; unmeasured ones keep their bounds.
            names = np.concatenate([own[some][:, None], near[some]], axis=1)
            dist = np.concatenate([exact[:, None], d], axis=1)
            bound = np.where(dist < np.iinfo("i8").max, np.sqrt(dist.astype("f8")) * (1 - SLACK), np.concatenate([np.zeros((len(some), 1)), lower[some]], axis=1))
            first = np.lexsort((names, dist), axis=1)[:, 0]
            rows = np.arange(len(some))
            own[some], upper[some] = names[rows, first], np.sqrt(dist[rows, first].astype("f8")) * (1 + SLACK)
            bound[rows, first] = -1
            others = np.argsort(bound, axis=1, kind="stable")[:, 1:]
            near[some], lower[some] = np.take_along_axis(names, others, axis=1), np.take_along_axis(bound, others, axis=1)
        full = open_[beyond]
        if len(full):
            used = listed
            own[full], upper[full], near[full], lower[full], rest[full] = scan(x[full], points, listed)
    return (own, upper, near, lower, rest), used


STATE = "id long, x array<long>, own int, upper double, near array<int>, lower array<double>, rest double, at int, n long, sums array<long>, used int, cost long"
KINDS = {"own": pa.int32(), "upper": pa.float64(), "rest": pa.float64(), "at": pa.int32(), "n": pa.int64(), "used": pa.int32(), "cost": pa.int64()}


def lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    rows, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).reshape(-1), kind))


def state_batch(ids: pa.Array, x: pa.Array, bounds: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    """Rows of vectors; the columns of summaries are null."""
    own, upper, near, lower, rest = bounds
    n = len(own)
    columns = [ids, x, pa.array(own, pa.int32()), pa.array(upper), lists(near, pa.int32()), lists(lower, pa.float64()), pa.array(rest)]
    columns += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


NAMES = [c.split()[0] for c in STATE.split(", ")]


def summary_batch(sums: np.ndarray, counts: np.ndarray, used: int, cost: np.ndarray) -> pa.RecordBatch:
    """A row for each cluster: the change of its sum and count in this task, the places used and the squared distances summed."""
    k = len(counts)
    empty = {"id": pa.int64(), "x": pa.list_(pa.int64()), "own": pa.int32(), "upper": pa.float64(), "near": pa.list_(pa.int32()), "lower": pa.list_(pa.float64()), "rest": pa.float64()}
    columns = [pa.nulls(k, kind) for kind in empty.values()]
    columns += [pa.array(np.arange(k), pa.int32()), pa.array(counts, pa.int64()), lists(sums, pa.int64()), pa.array([used] * k, pa.int32()), pa.array(cost, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=NAMES)


def step(rows: DataFrame, centroids: Centroids, listed: int, first: bool, last: bool) -> DataFrame:
    """State after one assignment. The first one scans; the last one also sums exact distances."""
    points, moved = centroids.points, centroids.moved

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = points.shape
        sums, counts, cost, used = np.zeros((k, dim), "i8"), np.zeros(k, "i8"), np.zeros(k, "i8"), 0
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(start, BLOCK)
                x = matrix(batch.column("x")).astype("i8")
                if first:
                    bounds = scan(x, points, listed)
                    np.add.at(sums, bounds[0], x)
                    np.add.at(counts, bounds[0], 1)
                else:
                    before = batch.column("own").to_numpy().copy()
                    near, lower = matrix(batch.column("near")).astype("i4"), matrix(batch.column("lower"))
                    rest = batch.column("rest").to_numpy().copy()
                    if near.shape[1] > listed:  # bounds beyond the list join the remainder
                        rest = np.minimum(rest, lower[:, listed:].min(axis=1))
                        near, lower = near[:, :listed].copy(), lower[:, :listed].copy()
                    bounds, places = refine(x, before.copy(), batch.column("upper").to_numpy().copy(), near, lower, rest, points, moved)
                    used = max(used, places)
                    other = np.flatnonzero(bounds[0] != before)
                    np.add.at(sums, bounds[0][other], x[other])
                    np.subtract.at(sums, before[other], x[other])
                    np.add.at(counts, bounds[0][other], 1)
                    np.subtract.at(counts, before[other], 1)
                if last:
                    np.add.at(cost, bounds[0], squared(x, points, bounds[0][:, None])[:, 0])
                yield state_batch(batch.column("id"), batch.column("x"), bounds)
        yield summary_batch(sums, counts, used, cost)

    return rows.mapInArrow(assign, STATE)


def summed(state: DataFrame, k: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Changes of sums and counts, costs and places used, over all tasks: k * dim numbers meet here."""
    parts = state.where("at IS NOT NULL")
    each = parts.select("at", F.posexplode("sums").alias("j", "s")).groupBy("at", "j").agg(F.sum("s").alias("s")).collect()
    totals = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.max("used").alias("used")).collect()
    sums, counts, cost = np.zeros((k, dim), "i8"), np.zeros(k, "i8"), np.zeros(k, "i8")
    for r in each:
        sums[r["at"], r["j"]] = r["s"]
    for r in totals:
        counts[r["at"]], cost[r["at"]] = r["n"], r["cost"]
    return sums, counts, cost, max((r["used"] for r in totals), default=0)


def moved_to(before: Centroids, sums: np.ndarray, counts: np.ndarray) -> Centroids:
    """Each non-empty cluster's floor of the mean, component by component; empty ones stay."""
    points = before.points.copy()
    held = counts > 0
    points[held] = sums[held] // counts[held, None]
    apart = points - before.points
    return Centroids(points, np.sqrt((apart * apart).sum(axis=1).astype("f8")) * (1 + SLACK), sums, counts)


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance (squared, to its centroid), cluster_inertia, inertia, centroid (array<long>) and centroid_sha256.

    Vectors that are null, of another length than dim or hold null or non-finite components, and rows without vec_id, take
    no part; zero vectors do. Rows that repeat a vec_id are vectors of their own. With fewer than k vectors each is a first
    centroid, with none there are no rows. Equal distances go to the smaller number. Once no centroid moves, later rounds
    would change nothing and are left out. Only vec_id and embedding are read.
    """
    vectors = materialise(whole_vectors(table, dim, scale), "whole")
    points = first_centroids(vectors, k, seed)
    k = len(points)
    spark = table.sparkSession
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    now = Centroids(points, np.zeros(k), np.zeros((k, dim), "i8"), np.zeros(k, "i8"))
    listed, state, settled = min(LISTED, k - 1), None, False
    for r in range(rounds + 1):
        last = r == rounds or settled
        new = materialise(step(vectors if state is None else state.where("at IS NULL"), now, listed, state is None, last), "bounds")
        discard(vectors if state is None else state)
        state = new
        sums, counts, cost, used = summed(state, k, dim)
        if last:
            break
        if r:
            listed = min(listed, max(used, k // 8, 1))
        now = moved_to(now, now.sums + sums, now.counts + counts)
        settled = not now.moved.any()
    names = [(c, int(cost[c]), int(cost.sum()), [int(v) for v in p], hashlib.sha256(",".join(map(str, p.tolist())).encode()).hexdigest()) for c, p in enumerate(now.points)]
    known = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    found = state.where("at IS NULL").select(F.col("id").alias("vec_id"), F.col("own").alias("cluster"), "x")
    joined = found.join(F.broadcast(known), "cluster")  # k rows
    distance = F.aggregate(F.zip_with("x", "centroid", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda a, b: a + b)
    return joined.select("vec_id", "cluster", distance.alias("distance"), "cluster_inertia", "inertia", "centroid", "centroid_sha256")
