"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, merged results.

Coarse centres, fitted on a bounded sample, deal distinct vectors to cells; a cell beyond a shard's size is split by a hash.
Each shard's graph is built in numpy, level by level, and stored as flat neighbour arrays in one row of a table in the shared folder. A
query asks the shards of its nearest cells. How many those must be is measured: some queries are answered by comparison
with every row, and enough cells are asked that nearly all of their true neighbours lie in them. The results of the same
queries then show the recall of the whole search; where it is too low, the search is repeated with more breadth.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import discard, materialise
from causeway.llm.vectors import by_id, distinct_vectors, matrix, usable

#: Distinct vectors that a shard aims at, links a node (twice as many at the bottom), breadth of the search in building and asking.
SHARD_ROWS, LINKS, BUILD_BREADTH, ASK_BREADTH = 16_384, 16, 64, 128
#: Queries that meet a shard at a time.
QUERY_BLOCK = 4096
#: Rows that centres are fitted on at most, rows a centre at least, rounds of the fit.
SAMPLE, SAMPLE_ROWS, FIT_ROUNDS = 20_000, 8, 8
#: Queries answered by comparison with every row, the share of their neighbours that must lie in the cells asked, and that must be found.
AUDITED, COVER, RECALL = 200, 0.98, 0.95


class Graph:
    """Flat neighbour arrays: links[level][node] has node numbers, then -1. Vectors are centred, so that rounding of norms doesn't decide in tight groups."""

    def __init__(self, vectors: np.ndarray, links: list[np.ndarray] | None = None, entry: int = 0):
        self.centre = vectors.mean(axis=0)
        self.vectors = np.ascontiguousarray(vectors - self.centre, "f8")
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        self.links, self.entry = links or [], entry
        self.stamp, self.now = np.zeros(len(vectors), "i4"), 0

    def near(self, q: np.ndarray, starts: list[tuple[float, int]], breadth: int, level: int) -> list[tuple[float, int]]:
        """(distance without the query's own norm, node) of the nearest found on a level, nearest first."""
        self.now += 1
        stamp, now, table, vectors, norms = self.stamp, self.now, self.links[level], self.vectors, self.norms
        stamp[[n for _, n in starts]] = now
        open_, best = list(starts), [(-d, n) for d, n in starts]
        heapq.heapify(open_)
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= breadth:
                break
            next_ = table[node]
            next_ = next_[next_ >= 0]
            next_ = next_[stamp[next_] != now]
            if not len(next_):
                continue
            stamp[next_] = now
            for e, n in zip((norms[next_] - 2 * (vectors[next_] @ q)).tolist(), next_.tolist()):
                if len(best) < breadth:
                    heapq.heappush(best, (-e, n))
                    heapq.heappush(open_, (e, n))
                elif e < -best[0][0]:
                    heapq.heapreplace(best, (-e, n))
                    heapq.heappush(open_, (e, n))
        return sorted((-d, n) for d, n in best)

    def descend(self, q: np.ndarray, to_level: int) -> list[tuple[float, int]]:
        at = [(float(self.norms[self.entry] - 2 * (self.vectors[self.entry] @ q)), self.entry)]
        for level in range(len(self.links) - 1, to_level, -1):
            at = self.near(q, at, 1, level)[:1]
        return at

    def build(self, seed: int = 3) -> Graph:
        """Levels of geometrically falling size. On each, a node's links are spread over its nearest nodes there and its nearest among those of the level above, both found exactly in blocks, so groups of any tightness hold together; links also run back."""
        n = len(self.vectors)
        levels = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int), 8)
        self.entry, self.links = int(np.argmax(levels)), []
        for level in range(int(levels.max()) + 1):
            here, above = np.flatnonzero(levels >= level), np.flatnonzero(levels > level)
            table = np.full((n, LINKS * (2 if level == 0 else 1)), -1, "i4")
            ways = [self.spread(part, [(here, BUILD_BREADTH), (above, LINKS)], LINKS) for part in np.array_split(here, max(1, len(here) // 512))]
            start = np.repeat(here, LINKS)
            end = np.concatenate(ways).ravel()
            start, end = start[end >= 0], end[end >= 0]
            pairs = np.unique(np.concatenate([start * n + end, end * n + start]))
            start, end = pairs // n, pairs % n
            far = self.norms[end] - 2 * np.einsum("ij,ij->i", self.vectors[start], self.vectors[end])
            order = np.lexsort((far, start))
            start, end = start[order], end[order]
            place = np.arange(len(start)) - np.searchsorted(start, start)
            kept = place < BUILD_BREADTH
            pool = np.full((n, BUILD_BREADTH), -1, "i4")
            pool[start[kept], place[kept]] = end[kept]
            for part in np.array_split(here, max(1, len(here) // 512)):
                table[part] = self.spread_over(part, pool[part], table.shape[1])
            self.links.append(table)
        return self

    def spread(self, nodes: np.ndarray, among: list[tuple[np.ndarray, int]], most: int) -> np.ndarray:
        """Links of nodes, most a row, from the nearest in each of the sets among (nodes, how many)."""
        found = []
        for others, count in among:
            if len(others):
                far = self.norms[others] - 2 * (self.vectors[nodes] @ self.vectors[others].T)
                far[nodes[:, None] == others] = np.inf
                count = min(count, len(others))
                near = np.argpartition(far, count - 1, axis=1)[:, :count]
                found.append(np.where(np.isinf(np.take_along_axis(far, near, axis=1)), -1, others[near]))
        pool = np.sort(np.concatenate(found, axis=1), axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        return self.spread_over(nodes, pool, most)

    def spread_over(self, nodes: np.ndarray, pool: np.ndarray, most: int) -> np.ndarray:
        """For each node, of its pool (-1: none) those nearer to it than to any chosen before; free places go to the nearest left."""
        v, size = self.vectors[pool], self.norms[pool]
        to = size - 2 * np.einsum("ij,ikj->ik", self.vectors[nodes], v) + self.norms[nodes, None]
        to[pool < 0] = np.inf
        order = np.argsort(to, axis=1, kind="stable")
        pool, to, size = (np.take_along_axis(x, order, axis=1) for x in (pool, to, size))
        v = np.take_along_axis(v, order[:, :, None], axis=1)
        between = size[:, :, None] + size[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
        open_, chosen = pool >= 0, np.zeros(pool.shape, "?")
        for i in range(pool.shape[1]):
            take = open_[:, i] & (chosen.sum(axis=1) < most)
            chosen[:, i] = take
            open_ &= ~take[:, None] | (between[:, i, :] >= to)
        left = np.argsort(np.where(chosen, 0, np.where(pool >= 0, 1, 2)), axis=1, kind="stable")[:, :most]
        out = np.full((len(nodes), most), -1, "i4")
        out[:, : left.shape[1]] = np.take_along_axis(pool, left, axis=1)
        return out

    def ask(self, q: np.ndarray, breadth: int) -> np.ndarray:
        """The nodes found by a search, breadth of them where there are as many; the caller cuts them by exact distances."""
        q = q - self.centre
        return np.array([n for _, n in self.near(q, self.descend(q, 0), breadth, 0)], "i8")


def centres_of(sample: np.ndarray, count: int) -> np.ndarray:
    """count means of a sample by Lloyd's rounds; an empty one stays where it is."""
    centres = sample[np.random.default_rng(5).permutation(len(sample))[:count]].copy()
    for _ in range(FIT_ROUNDS):
        at = nearest_cells(sample, centres)[:, 0]
        sums, n = np.zeros_like(centres), np.bincount(at, minlength=len(centres))
        np.add.at(sums, at, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest_cells(points: np.ndarray, centres: np.ndarray, count: int = 1) -> np.ndarray:
    """The numbers of the nearest centres of each point, nearest first."""
    far = np.einsum("ij,ij->i", centres, centres) - 2 * (points @ centres.T)
    if count == 1:
        return far.argmin(axis=1)[:, None]
    return np.argsort(far, axis=1, kind="stable")[:, :count]


def in_cells(rows: DataFrame, centres: dict[int, np.ndarray], count: dict[int, int] | None = None) -> DataFrame:
    """rows (id, dim, vector) with the array cells: the nearest one, or as many as count says for the dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cells = batch.column("dim").to_numpy(), [None] * batch.num_rows
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                near = nearest_cells(matrix(batch.column("vector").take(pa.array(at))), centres[d], count[d] if count else 1)
                for i, x in zip(at.tolist(), near.tolist()):
                    cells[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int32()))], names=[*batch.schema.names, "cells"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, schema + ", cells array<int>")


def exact(rows: DataFrame, asked: list, k: int) -> dict[int, list[tuple[float, int, int]]]:
    """(distance, id, cell) of the k nearest rows of each asked query (at most AUDITED, as rows id, dim, vector), by comparison with all."""
    of = {d: [r for r in asked if r["dim"] == d] for d in {r["dim"] for r in asked}}
    points = {d: (np.array([r["id"] for r in rs]), np.array([r["vector"] for r in rs])) for d, rs in of.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int, int]]] = {r["id"]: [] for r in asked}
        for batch in batches:
            dims, ids, cells = batch.column("dim").to_numpy(), batch.column("ids").to_pylist(), batch.column("cell").to_pylist()
            for d in np.intersect1d(np.unique(dims), list(points)):
                at = np.flatnonzero(dims == d)
                v = matrix(batch.column("vector").take(pa.array(at)))
                for own, q in zip(*points[d]):
                    far = np.sqrt(((v - q) ** 2).sum(axis=1))
                    near = np.argsort(far, kind="stable")[: 2 * k + 2] if len(far) > 2 * k + 2 else np.arange(len(far))
                    near = np.flatnonzero(far <= far[near].max()) if len(near) else near
                    found = [(float(far[i]), n, cells[at[i]]) for i in near for n in ids[at[i]] if n != own]
                    best[int(own)] = sorted(best[int(own)] + found)[:k]
        flat = [(q, *x) for q, xs in best.items() for x in xs]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int32()))], names=["q", "far", "id", "cell"])

    found: dict[int, list] = {r["id"]: [] for r in asked}
    top = rows.select("ids", "dim", "vector", "cell").mapInArrow(run, "q long, far double, id long, cell int")
    place = F.row_number().over(Window.partitionBy("q").orderBy("far", "id"))
    for r in top.withColumn("r", place).where(F.col("r") <= k).collect():  # AUDITED * k rows
        found[r["q"]].append((r["far"], r["id"], r["cell"]))
    return found


def search(table: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <id>, score: the k nearest rows of table found for each row of queries, by Euclidean distance.

    A query's own id is no candidate of it; ties go to smaller ids; with fewer candidates, all come. Vectors that are
    null, empty, zero or hold null or non-finite components take no part on either side. Vectors of different lengths
    don't meet. Copies are one node with the k + 1 smallest ids, which is all that k results can need. Repeated rows of an
    id are one row, of different vectors the smallest. Only the two named columns are read, so others may have any name. A
    recall below RECALL after all attempts is an error, never a result.
    """
    rows = materialise(distinct_vectors(by_id(usable(table, id, vector)), k + 1).drop("n").withColumn("id", F.col("ids")[0]), "vectors")
    asked = materialise(by_id(usable(queries, id, vector)).select("id", "dim", "vector"), "queries")
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length of vectors
    order = F.xxhash64("id")
    centres = {}
    for d, n in counts.items():
        shards = -(-n // SHARD_ROWS)
        sample = rows.where(F.col("dim") == d).orderBy(order, "id").limit(min(SAMPLE, 64 * shards if shards > 1 else 1)).select("vector").collect()
        centres[d] = centres_of(np.array([r["vector"] for r in sample]), max(1, min(shards, len(sample) // SAMPLE_ROWS)))
    dealt = in_cells(rows, centres).withColumn("cell", F.col("cells")[0]).drop("cells")
    sizes = materialise(dealt.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("parts")), "cells")  # as many rows as centres
    dealt = dealt.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("part", F.pmod(order, F.col("parts")).cast("int"))
    dealt = materialise(dealt.select("dim", "cell", "part", "id", "ids", "vector"), "dealt")
    stored = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("vectors", pa.binary()), ("entry", pa.int64()), ("links", pa.list_(pa.binary())), ("ids", pa.binary()), ("sizes", pa.binary())])

    def build(key: tuple, part: pa.Table) -> pa.Table:
        found = matrix(part.column("vector"))
        graph = Graph(found).build()
        ids = part.column("ids").combine_chunks()
        data = {c: [x.as_py()] for c, x in zip(("dim", "cell", "part"), key)} | {"vectors": [found.tobytes()], "entry": [graph.entry], "links": [[x.tobytes() for x in graph.links]]}
        data |= {"ids": [ids.flatten().to_numpy().astype("i8").tobytes()], "sizes": [np.diff(ids.offsets.to_numpy()).astype("i8").tobytes()]}
        return pa.table(data, schema=stored)

    keys = ["dim", "cell", "part"]
    shards = sum(-(-n // SHARD_ROWS) + len(centres[d]) for d, n in counts.items())
    placed = dealt.repartition(4 * max(1, shards), *keys)  # several partitions a shard, so that few share a task
    index = materialise(placed.groupBy(*keys).applyInArrow(build, "dim int, cell int, part int, vectors binary, entry long, links array<binary>, ids binary, sizes binary"), "graphs")

    judged = [r for r in asked.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(AUDITED).collect() if r["dim"] in counts]
    true = exact(dealt, judged, k)
    probes = {}
    for d in counts:
        of = [r for r in judged if r["dim"] == d]
        probes[d] = len(centres[d])
        if of and probes[d] > 1:
            cells = nearest_cells(np.array([r["vector"] for r in of]), centres[d], len(centres[d]))
            needed = np.sort([int(np.flatnonzero(cells[i] == c)[0]) + 1 for i, r in enumerate(of) for _, _, c in true[r["id"]]])
            if len(needed):
                probes[d] = int(needed[min(len(needed) - 1, int(np.ceil(COVER * len(needed))) - 1)])
    asked = asked.where(F.col("dim").isin(*counts)) if counts else asked.limit(0)
    met = in_cells(asked, centres, probes).withColumn("cell", F.explode("cells")).drop("cells").join(F.broadcast(sizes), ["dim", "cell"])
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    blocks = F.broadcast(met.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks")))  # a row a shard of SHARD_ROWS rows
    met = met.join(blocks, keys).withColumn("block", F.pmod(order, F.col("blocks")).cast("int")).drop("blocks")
    held = index.join(blocks, keys).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))

    def searched(breadth: int) -> DataFrame:
        def ask(key: tuple, shard: pa.Table, wanted: pa.Table) -> pa.Table:
            out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
            if shard.num_rows and wanted.num_rows:
                row = shard.to_pylist()[0]
                vectors = np.frombuffer(row["vectors"], "f8").reshape(-1, row["dim"])
                n = len(vectors)
                graph = Graph(vectors, [np.frombuffer(x, "i4").reshape(n, -1) for x in row["links"]], row["entry"])
                ids, size = np.frombuffer(row["ids"], "i8"), np.frombuffer(row["sizes"], "i8")
                first = np.cumsum(size) - size
                for own, q in zip(wanted.column("id").to_pylist(), matrix(wanted.column("vector"))):
                    nodes = graph.ask(q, max(breadth, k + 1))
                    far = np.sqrt(((vectors[nodes] - q) ** 2).sum(axis=1))
                    nearest = far <= np.partition(far, min(k, len(far) - 1))[min(k, len(far) - 1)]  # k + 1 nodes, and ties of the last
                    far, nodes = far[nearest], nodes[nearest]
                    pairs = sorted((d, i) for d, x in zip(far.tolist(), nodes.tolist()) for i in ids[first[x] : first[x] + size[x]].tolist() if i != own)[:k]
                    out["query_id"] += [own] * len(pairs)
                    out["vec_id"] += [i for _, i in pairs]
                    out["score"] += [d for d, _ in pairs]
            return pa.table(out, schema=pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())]))

        groups = [*keys, "block"]
        spread = 4 * max(1, shards)
        found = held.repartition(spread, *groups).groupBy(*groups).cogroup(met.repartition(spread, *groups).groupBy(*groups)).applyInArrow(ask, "query_id long, vec_id long, score double")
        return materialise(found.withColumn("rank", place).where(F.col("rank") <= k), "found")

    breadth, recall = ASK_BREADTH, 0.0
    for _ in range(3):
        ranked = searched(breadth)
        got: dict[int, set] = {}
        for r in ranked.where(F.col("query_id").isin([r["id"] for r in judged])).select("query_id", "vec_id").collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        shares = [len({i for _, i, _ in xs} & got.get(q, set())) / len(xs) for q, xs in true.items() if xs]
        recall = float(np.mean(shares)) if shares else 1.0
        if recall >= RECALL:
            break
        discard(ranked)
        breadth *= 2
    else:
        raise RuntimeError(f"recall {recall:.3f} at breadth {breadth // 2}, below {RECALL}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id), "score")
