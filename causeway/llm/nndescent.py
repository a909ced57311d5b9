"""Near-duplicate embeddings by NN-descent over cells of near vectors, with links counted by tiles and recall audited.

Distinct vectors are gathered around leaders within half of the threshold's angle, so that all members of a leader are links
of each other; leaders are gathered around hubs, so that all members of a hub lie within the threshold's angle of it and
are one component. Blocks of equal random projections are searched greedily, pass after pass, until leaders stop getting
fewer. A random graph over hubs is refined: in each round a hub goes to all its neighbours; those that meet there are
neighbours of neighbours and are compared. The measure is the angle less both radii, so edges within the threshold are all
that may hold links. Lists whose last neighbour is still such an edge are saturated and get twice the room; a descent ends
when none is and little changes. Leaders of each hub, and of hubs with an edge, are then compared tile by tile: a pair of
tiles gives a count for each leader, not a row for each link, so a dense group of any cosine costs its products alone.
Pairs of leaders whose members may differ are settled among the members, by tiles as well. The links of a sample of rows
are counted among all rows, and so are the nearest hubs of a sample of hubs; where the descent has found too few, it goes
on from more projections.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import bound_batches, discard, groups_of, join_classes, materialise
from causeway.llm.vectors import by_id, matrix, unit, usable
from causeway.operators.components import components

#: Neighbours a leader at first, projection tables, rows compared with each other in a block, rounds of a descent but for saturated lists.
NEIGHBOURS, TABLES, BLOCK, ROUNDS = 12, 4, 256, 10
#: A round after the first that adds less than this share of edges within the threshold is the last, if no list is saturated.
SETTLED = 0.02
#: Passes that draw copies together end when leaders fall by less than this share.
GATHERED = 0.02
#: Mean share of a sampled row's links that must be found, most rows sampled of each kind, and descents before it is an error.
RECALL, SAMPLED, DESCENTS = 0.98, 2000, 4
#: Angles nearer than this are decided by cosines of members.
MARGIN = 1e-6
#: Share of sampled hubs' nearest others, of those within NEAR times the threshold's angle, that the graph should hold; below it a descent is repeated, but isn't an error where links pass.
NEAREST, NEAR = 0.9, 2.0
#: Counts that a task adds up before it gives them.
ADDED = 200_000
#: Rows that a task of sorted blocks aims at.
TASK_ROWS = 8192
#: Rows of a tile at most, and bytes of its vectors.
TILE_ROWS, TILE_BYTES = 1024, 4 << 20

log = logging.getLogger(__name__)

EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64()), ("w", pa.float64())])
EDGES = "u long, v long, s double, w double"


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


def sorted_runs(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """Rows in ranges of the keys and of the column h, sorted. A key that fills a third of all rows spans several tasks."""
    return rows.repartitionByRange(max(1, -(-count // TASK_ROWS)), *keys, "h").sortWithinPartitions(*keys, "h")


def pieces(borders: np.ndarray) -> list[tuple[int, int]]:
    """Groups cut into blocks of about BLOCK rows."""
    out = []
    for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
        cut = np.linspace(a, b, -(-(b - a) // BLOCK) + 1).astype(int).tolist()
        out += [(x, y) for x, y in zip(cut, cut[1:]) if y - x > 1]
    return out


def projected(rows: DataFrame, count: int, tables: int, seed: int) -> DataFrame:
    """id, dim, vector, r, t, code, h: every row once a table, with the sides of random hyperplanes it lies on."""
    bits = min(60, max(0, int(np.ceil(np.log2(max(1, count) / (BLOCK / 2))))))
    tables = tables if bits else 1

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = batch.column("dim").to_numpy()
            code = np.zeros((batch.num_rows, tables), "i8")
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                planes = np.random.default_rng([seed, d]).normal(size=(d, tables * bits))
                side = (matrix(batch.column("vector").take(pa.array(at))) @ planes > 0).reshape(len(at), tables, bits)
                code[at] = (side << np.arange(bits)).sum(axis=2) if bits else 0
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "dim", "vector", "r")), pa.array(list(code), pa.list_(pa.int64()))], names=["id", "dim", "vector", "r", "codes"])

    coded = rows.select("id", "dim", "vector", "r").mapInArrow(codes, "id long, dim int, vector array<double>, r double, codes array<long>")
    return coded.select("id", "dim", "vector", "r", F.posexplode("codes").alias("t", "code"), F.xxhash64("id", F.lit(seed)).alias("h"))


def proposals(rows: DataFrame, count: int, most: float, seed: int) -> DataFrame:
    """id, to: rows that lie with their radius r within the angle most of another of their block, and the one that takes them."""

    def work(batch: pa.RecordBatch, borders: np.ndarray) -> pa.RecordBatch:
        ids, r, points = batch.column("id").to_numpy(), batch.column("r").to_numpy(), matrix_of_equal(batch)
        out, to = [], []
        for a, b in pieces(borders):
            near = angles(points[a:b], points[a:b]) + r[a:b] <= most
            open_ = np.ones(b - a, "?")
            for i in range(b - a):
                if open_[i]:
                    open_[i] = False
                    taken = np.flatnonzero(near[i] & open_)
                    open_[taken] = False
                    out += ids[a + taken].tolist()
                    to += [int(ids[a + i])] * len(taken)
        return pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), pa.array(to, pa.int64())], names=["id", "to"])

    runs = sorted_runs(projected(rows, count, 1, seed), count, "dim", "t", "code")
    return runs.select("dim", "t", "code", "id", "r", "vector").mapInArrow(lambda batches: groups_of(batches, ("dim", "t", "code"), work), "id long, to long")


def matrix_of_equal(batch: pa.RecordBatch) -> np.ndarray:
    """Vectors as a matrix; those of fewer dimensions than the batch's longest are filled up with zeros."""
    dims = batch.column("dim").to_numpy()
    if dims.min() == dims.max():
        return matrix(batch.column("vector"))
    out = np.zeros((len(dims), dims.max()))
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        out[at, :d] = matrix(batch.column("vector").take(pa.array(at)))
    return out


def gathered(rows: DataFrame, count: int, most: float) -> DataFrame:
    """id, leader, angle (to the leader, with the row's own radius, at most `most`) for every row of rows (id, dim, vector, r).

    Blocks propose; a leader goes to another one with all its members, each measured against the new one, or stays.
    """
    held = materialise(rows.select("id", F.col("id").alias("leader"), F.col("r").alias("angle")), "members")
    left = count
    for pass_ in range(64):
        leaders = rows.join(held.where("id = leader").select("id"), "id")
        wanted = materialise(proposals(leaders, left, most, 101 + pass_), "proposals")
        if not wanted.limit(1).count():
            discard(wanted)
            break
        moving = held.join(wanted.withColumnRenamed("id", "leader"), "leader").join(rows.select("id", "vector", "r"), "id")
        moving = moving.join(rows.select(F.col("id").alias("to"), F.col("vector").alias("other")), "to")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = np.zeros(batch.num_rows)
                size = batch.column("dim").to_numpy()
                for d in np.unique(size):
                    at = np.flatnonzero(size == d)
                    x, y = (matrix(batch.column(c).take(pa.array(at))) for c in ("vector", "other"))
                    far[at] = np.arccos(np.clip(np.einsum("ij,ij->i", x, y), -1, 1)) + batch.column("r").to_numpy()[at]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("leader"), batch.column("to"), pa.array(far)], names=["id", "leader", "to", "far"])

        measured = materialise(moving.select("id", "leader", "to", "r", F.size("vector").alias("dim"), "vector", "other").mapInArrow(measure, "id long, leader long, to long, far double"), "measured")
        fits = measured.groupBy("leader").agg(F.max("far").alias("m")).where(F.col("m") <= most).select("leader")
        moved = measured.join(fits, "leader").select("id", F.col("to").alias("__to"), "far")
        new = held.join(moved, "id", "left").select("id", F.coalesce("__to", "leader").alias("leader"), F.coalesce("far", "angle").alias("angle"))
        new = materialise(new, "members")
        now = new.where("id = leader").count()
        discard(held, wanted, measured)
        held, before, left = new, left, now
        if before - now <= GATHERED * before:
            break
    return held


def top_pairs(ids: np.ndarray, unit: np.ndarray, r: np.ndarray, floor: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, ...]:
    """(u, v, s, w): for each row, its best others in this block that beat its list's last, as many as the list has room.

    s is the angle less both radii, negated, and w the sum of the radii.
    """
    near = r[:, None] + r - angles(unit, unit)
    np.fill_diagonal(near, -9)
    most = min(int(room.max()), len(ids) - 1)
    best = np.argpartition(-near, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(near, best, axis=1)
    row, col = np.nonzero(value > floor[:, None])
    return ids[row], ids[best[row, col]], value[row, col], r[row] + r[best[row, col]]


def compared(batch: pa.RecordBatch, borders: np.ndarray) -> pa.RecordBatch:
    ids, r, floor, room, dim = (batch.column(c).to_numpy() for c in ("id", "r", "floor", "room", "dim"))
    unit = matrix_of_equal(batch)
    found = [top_pairs(ids[a:b], unit[a:b, : dim[a]], r[a:b], floor[a:b], room[a:b]) for a, b in pieces(borders)]
    columns = [np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in range(4)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype("i8") if i < 2 else c) for i, c in enumerate(columns)], schema=EDGE)


def first_graph(rows: DataFrame, count: int, tables: int, seed: int) -> DataFrame:
    """Edges between rows that random hyperplanes put into one block."""
    runs = sorted_runs(projected(rows, count, tables, seed), count * tables, "dim", "t", "code")
    asked = runs.select("dim", "t", "code", "id", "vector", "r", F.lit(-9.0).alias("floor"), F.lit(NEIGHBOURS).alias("room"))
    return asked.mapInArrow(lambda batches: groups_of(batches, ("dim", "t", "code"), compared), EDGES)


def shortened(edges: DataFrame, rooms: DataFrame | None) -> DataFrame:
    """The best edges of each u: as many as its list has room."""
    best = edges.groupBy("u", "v").agg(F.max("s").alias("s"), F.max("w").alias("w"))
    placed = best.withColumn("place", F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v")))
    if rooms is None:
        return placed.where(F.col("place") <= NEIGHBOURS).withColumn("room", F.lit(NEIGHBOURS)).drop("place")
    kept = placed.join(rooms, "u", "left").withColumn("room", F.coalesce("room", F.lit(NEIGHBOURS))).where("place <= room")
    return kept.select("u", "v", "s", "w", "room")


def descent(rows: DataFrame, count: int, graph: DataFrame, theta: float, seed: int) -> DataFrame:
    """The graph after rounds in which rows have met at their neighbours, until no list is saturated; pivots of many are cut into blocks."""
    round_ = 0
    while True:
        lists = graph.groupBy("u").agg(F.min("s").alias("last"), F.count(F.lit(1)).alias("n"), F.max("room").alias("room"), F.collect_list("v").alias("at"))
        full = F.col("n") >= F.col("room")
        saturated = full & (F.col("last") >= -theta)
        lists = materialise(lists.select(F.col("u").alias("id"), F.when(saturated, F.col("room") * 2).otherwise(F.col("room")).alias("room"), F.when(full & ~saturated, F.col("last")).otherwise(F.lit(-9.0)).alias("floor"), saturated.alias("saturated"), "at"), "lists")
        sums = lists.agg(F.count_if("saturated").alias("saturated"), F.sum(F.size("at") + 1).alias("sent")).first()
        sent = rows.join(lists, "id").select("id", "dim", "vector", "r", "floor", "room", F.explode(F.concat("at", F.array("id"))).alias("pivot"), F.xxhash64("id", F.lit(seed + round_)).alias("h"))
        runs = sorted_runs(sent, sums["sent"] or 0, "pivot").select("pivot", "id", "dim", "vector", "r", "floor", "room")
        met = runs.mapInArrow(lambda batches: groups_of(batches, ("pivot",), compared), EDGES)
        new = materialise(shortened(graph.select("u", "v", "s", "w").union(met), lists.select(F.col("id").alias("u"), "room")), "graph")
        near = new.where(F.col("s") >= -theta)
        fresh, total = near.join(graph, ["u", "v"], "left_anti").count(), near.count()
        discard(graph, lists)
        graph = new
        round_ += 1
        # Each round gives saturated lists twice the room, so in the end none is.
        if not sums["saturated"] and round_ > 1 and (fresh <= SETTLED * total or round_ >= ROUNDS):
            return graph


def tiled(rows: DataFrame, count: int) -> DataFrame:
    """at, tile, dim, ids, sizes, radii, vectors: the rows (at, id, dim, size, r, vector) of each `at`, packed into tiles of bounded size, named by their first ids."""
    schema = pa.schema([("at", pa.int64()), ("tile", pa.int64()), ("dim", pa.int32()), *((c, pa.binary()) for c in ("ids", "sizes", "radii", "vectors"))])

    def work(batch: pa.RecordBatch, borders: np.ndarray) -> pa.RecordBatch:
        at, ids, size, r, dims = (batch.column(c).to_numpy() for c in ("at", "id", "size", "r", "dim"))
        out: list[tuple] = []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            most = max(64, min(TILE_ROWS, TILE_BYTES // (8 * int(dims[a]))))
            for x in range(a, b, most):
                y = min(b, x + most)
                out.append((int(at[a]), int(ids[x]), int(dims[a]), ids[x:y].astype("i8").tobytes(), size[x:y].astype("i8").tobytes(), r[x:y].astype("f8").tobytes(), matrix(batch.column("vector").slice(x, y - x)).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], schema.field(i).type) for i in range(len(schema))], schema=schema)

    runs = sorted_runs(rows.withColumn("h", F.xxhash64("id")), count, "at").select("at", "id", "dim", "size", "r", "vector")
    return materialise(runs.mapInArrow(lambda batches: groups_of(batches, ("at",), work), "at long, tile long, dim int, ids binary, sizes binary, radii binary, vectors binary"), "tiles")


def tile_pairs(pairs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Both tiles, columns ending in _u and _v, of every pair of tiles of pairs (u, v); of u = v each pair once.

    Names of tiles are paired before the tiles themselves join, so that a large `at` is dealt over many tasks.
    """
    names = tiles.select("at", "tile")
    named = pairs.join(names.select(F.col("at").alias("u"), F.col("tile").alias("tile_u")), "u").join(names.select(F.col("at").alias("v"), F.col("tile").alias("tile_v")), "v")
    named = named.where("u != v OR tile_u <= tile_v")
    for side in "uv":
        named = named.join(tiles.select(F.col("at").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("tile", "dim", "ids", "sizes", "radii", "vectors"))), [side, f"tile_{side}"])
    columns = ("ids", "sizes", "radii", "vectors")
    return named.where("dim_u = dim_v").select("u", "v", (F.col("u").eqNullSafe(F.col("v")) & (F.col("tile_u") == F.col("tile_v"))).alias("same"), *(f"{c}_{k}" for k in "uv" for c in columns))


LINKS = "kind int, a long, b long, links long"


def counted(met: DataFrame, least: float, theta: float) -> DataFrame:
    """What pairs of tiles give, by kind: 0, rows a with so many links; 1, that a member of a is linked with one of b; 2, rows a and b whose members are still open.

    Rows without radius are single vectors, decided by their cosine; others are links for all their members, for none, or open.
    """

    def of_kind(kind: int, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, "i4")), pa.array(a), pa.array(b), pa.array(links)], names=["kind", "a", "b", "links"])

    def added(counts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        at, place = np.unique(np.concatenate([i for i, _ in counts]), return_inverse=True)
        links = np.zeros(len(at), "i8")
        np.add.at(links, place, np.concatenate([c for _, c in counts]))
        return of_kind(0, at, np.zeros(len(at), "i8"), links)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        edges: set[tuple[int, int]] = set()
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k] for c in batch.schema.names}
                read = lambda c, t: np.frombuffer(row[c].as_buffer(), t)  # noqa: E731, B023
                (ids, n, r, x), (others, m, q, y) = ([read(f"{c}_{side}", t) for c, t in (("ids", "i8"), ("sizes", "i8"), ("radii", "f8"), ("vectors", "f8"))] for side in "uv")
                cosine = x.reshape(len(ids), -1) @ y.reshape(len(others), -1).T
                near = cosine >= least
                open_ = np.zeros((0, 2), int)
                if r.any() or q.any():
                    width = r[:, None] + q
                    angle = np.arccos(np.clip(cosine, -1, 1))
                    wide = width > 0
                    sure = angle + width <= theta - MARGIN
                    maybe = wide & ~sure & (angle - width <= theta + MARGIN)
                    near = np.where(wide, sure, near)
                    if row["same"].as_py():
                        maybe = np.triu(maybe, 1)
                    open_ = np.argwhere(maybe)
                if row["same"].as_py():
                    np.fill_diagonal(near, False)
                    parts = [(ids, near @ m)]
                else:
                    parts = [(ids, near @ m), (others, n @ near)]
                for i, c in parts:
                    if c.any():
                        counts.append((i[c > 0], c[c > 0]))
                        edges.add((row["u"].as_py(), row["v"].as_py()))
                        waiting += len(counts[-1][0])
                if len(open_):
                    yield of_kind(2, ids[open_[:, 0]], others[open_[:, 1]], np.zeros(len(open_), "i8"))
                if waiting > ADDED:
                    yield added(counts)
                    counts, waiting = [], 0
        if counts:
            yield added(counts)
        if edges:
            u, v = np.array(sorted(edges), "i8").T
            yield of_kind(1, u, v, np.zeros(len(u), "i8"))

    return met.mapInArrow(compare, LINKS)


def links_of(graph: DataFrame, rows: DataFrame, held: DataFrame, leaders: DataFrame, cells: DataFrame, least: float, theta: float) -> tuple[DataFrame, DataFrame]:
    """(id, links) beyond a row's own leader for rows that have any, (u, v): hubs with linked members."""
    pairs = graph.where(F.col("s") >= -theta - MARGIN).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    own = cells.groupBy("hub").count().where("count > 1").select(F.col("hub").alias("u"), F.col("hub").alias("v"))
    pairs = materialise(pairs.unionByName(own), "pairs")
    asked = pairs.select(F.explode(F.array("u", "v")).alias("hub")).distinct()
    members = leaders.join(cells.select(F.col("leader").alias("id"), "hub"), "id").join(asked, "hub").select(F.col("hub").alias("at"), "id", "dim", "size", "r", "vector")
    found = materialise(counted(tile_pairs(pairs, tiled(members, leaders.count())), least, theta).groupBy("kind", "a", "b").agg(F.sum("links").alias("links")), "links")
    by_leader = found.where("kind = 0").select(F.col("a").alias("leader"), "links")
    links = held.join(by_leader, "leader").select("id", "links")
    edges = found.where("kind = 1 AND a != b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    open_ = found.where("kind = 2").select(F.col("a").alias("u"), F.col("b").alias("v"))
    asked = open_.select(F.explode(F.array("u", "v")).alias("leader")).distinct()
    single = held.join(asked, "leader").join(rows, "id").select(F.col("leader").alias("at"), "id", "dim", F.col("n").alias("size"), F.lit(0.0).alias("r"), "vector")
    among = materialise(counted(tile_pairs(open_, tiled(single, held.count())), least, theta).groupBy("kind", "a", "b").agg(F.sum("links").alias("links")), "links")
    links = links.union(among.where("kind = 0").select(F.col("a").alias("id"), "links")).groupBy("id").agg(F.sum("links").alias("links"))
    of = lambda side: cells.select(F.col("leader").alias(side), F.col("hub").alias(f"hub_{side}"))
    across = among.where("kind = 1").join(of("a"), "a").join(of("b"), "b").select(F.col("hub_a").alias("u"), F.col("hub_b").alias("v"))
    return links, edges.union(across.where("u != v")).distinct()


def nearest_found(hubs: DataFrame, graph: DataFrame, count: int, seed: int, near: float) -> tuple[float | None, float | None]:
    """The share of sampled hubs whose nearest other hub, by the measure of the graph, is among their neighbours, in either direction: of those whose nearest lies within near, and of all; None where there are none.

    At most SAMPLED hubs reach the driver and go to the tasks; each task gives a row for each.
    """
    picked = hubs.select("id", "dim", "r", "vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(SAMPLED, 200 + int(count**0.5))).collect()
    asked = {d: [np.array([r[c] for r in picked if r["dim"] == d]) for c in ("id", "r", "vector")] for d in {r["dim"] for r in picked}}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: (np.full(len(a[0]), 9.0), np.full(len(a[0]), -1)) for d, a in asked.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.intersect1d(np.unique(dims), list(asked)):
                at = pa.array(np.flatnonzero(dims == d))
                ids, r = (batch.column(c).take(at).to_numpy() for c in ("id", "r"))
                far = angles(asked[d][2], matrix(batch.column("vector").take(at))) - r - asked[d][1][:, None]
                far[asked[d][0][:, None] == ids] = 9
                nearest = far.argmin(axis=1)
                least = far[np.arange(len(nearest)), nearest]
                better = least < best[d][0]
                best[d][0][better], best[d][1][better] = least[better], ids[nearest[better]]
        for d, (far, to) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[d][0]), pa.array(to), pa.array(far)], names=["id", "to", "far"])

    if not picked:
        return None, None
    top = hubs.select("id", "dim", "r", "vector").mapInArrow(run, "id long, to long, far double").where("to >= 0 OR far < 9").groupBy("id").agg(F.min_by("to", "far").alias("to"), F.min("far").alias("far"))
    both = graph.select("u", "v", "s").union(graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
    kept = top.join(both.groupBy(F.col("u").alias("id")).agg(F.max("s").alias("s")), "id", "left")
    # Ties are as good: the best neighbour known is compared with the nearest there is.
    hit, close = F.col("s") >= -F.col("far") - 1e-9, F.col("far") <= near
    n, found, n_near, found_near = kept.agg(F.count(F.lit(1)), F.count_if(hit), F.count_if(close), F.count_if(hit & close)).first()
    return found_near / n_near if n_near else None, found / n if n else None


def audit(rows: DataFrame, links: DataFrame, count: int, least: float, seed: int) -> float | None:
    """The mean share of its links that a sampled row's `links` (id, n_links) has, or None if no sampled row has links.

    Rows are taken by a hash, some of all rows and some of those with links found, more of a larger table; every row of the
    table is compared with them.
    """
    most = min(SAMPLED, 200 + int(count**0.5))
    order = F.xxhash64("id", F.lit(seed))
    known = rows.join(links, "id", "left").select("id", "dim", "vector", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # At most 2 * SAMPLED vectors reach the driver and go to the tasks.
    picked = {r["id"]: r for part in (known, known.where("n_links > 0")) for r in part.orderBy(order, "id").limit(most).collect()}
    asked: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["dim"] for r in picked.values()}:
        of = [r for r in picked.values() if r["dim"] == d]
        asked[d] = np.array([r["id"] for r in of]), np.array([r["vector"] for r in of])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {d: np.zeros(len(ids), "i8") for d, (ids, _) in asked.items()}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.intersect1d(np.unique(dims), list(asked)):
                at = pa.array(np.flatnonzero(dims == d))
                near = matrix(batch.column("vector").take(at)) @ asked[d][1].T >= least
                near &= batch.column("id").take(at).to_numpy()[:, None] != asked[d][0]
                total[d] += batch.column("n").take(at).to_numpy() @ near
        for d, n in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked[d][0]), pa.array(n)], names=["id", "n"])

    sums = rows.select("id", "n", "dim", "vector").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    true = {r["id"]: r["n"] for r in sums.where("n > 0").collect()} if asked else {}
    return float(np.mean([min(1.0, picked[i]["n_links"] / n) for i, n in true.items()])) if true else None


def near_duplicates(table: DataFrame, least: float = 0.95, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """<id>, n_links, component_id, kept for every row of table.

    Rows are linked where the cosine of their vectors is at least `least` (above 0). Vectors that are null, empty, zero or
    hold null or non-finite components have no links and are their own component; so have rows with a null id, whose
    component is null and which aren't kept. Vectors of different lengths aren't compared. Copies are one row of the
    graph, with their number; repeated rows of an id count as one vector, its smallest. Only the two named columns are
    read, so others may have any name. A descent whose audit fails DESCENTS times is an error, never a result.
    """
    spark = table.sparkSession
    bound_batches(spark, 4096)
    theta = float(np.arccos(least))
    found = materialise(by_id(usable(table, id, vector)), "vectors")
    classes = materialise(found.groupBy("vector", "dim").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "classes")
    rows = materialise(unit(classes), "units")
    count = rows.count()
    held = gathered(rows.withColumn("r", F.lit(0.0)), count, (theta - MARGIN) / 2)
    round_up = F.when(F.col("r") > 0, F.col("r") + MARGIN).otherwise(0.0)
    sizes = held.join(rows.select("id", "n"), "id").groupBy(F.col("leader").alias("id")).agg(F.sum("n").alias("size"), F.max("angle").alias("r"))
    leaders = materialise(sizes.join(rows.select("id", "dim", "vector"), "id").withColumn("r", round_up), "leaders")
    cells = gathered(leaders, leaders.count(), theta - MARGIN).select(F.col("id").alias("leader"), F.col("leader").alias("hub"), "angle")
    radii = cells.groupBy(F.col("hub").alias("id")).agg(F.max("angle").alias("r"))
    hubs = materialise(leaders.drop("r", "size").join(radii, "id").withColumn("r", round_up), "hubs")
    n_hubs = hubs.count()
    graph = materialise(shortened(first_graph(hubs, n_hubs, TABLES, 11), None), "graph")
    for attempt in range(DESCENTS):
        graph = descent(hubs, n_hubs, graph, theta, 1000 * attempt)
        links, edges = links_of(graph, rows, held, leaders, cells, least, theta)
        own = held.join(leaders.select(F.col("id").alias("leader"), "size"), "leader").join(links, "id", "left")
        links = materialise(own.select("id", (F.col("size") + F.coalesce("links", F.lit(0))).alias("size")).join(rows.select("id", "n"), "id").select("id", (F.col("size") - F.col("n")).alias("n_links")), "counts")
        recall, (nearest, of_all) = audit(rows, links, count, least, 7 + attempt), nearest_found(hubs, graph, n_hubs, 7 + attempt, NEAR * theta)
        log.info("descent %d over %d hubs of %d vectors: recall of links %s, of nearest hubs %s, of those however far %s", attempt + 1, n_hubs, count, recall, nearest, of_all)
        missed = recall is not None and recall < RECALL
        if not missed and (nearest is None or nearest >= NEAREST or attempt == DESCENTS - 1):
            break
        more = first_graph(hubs, n_hubs, TABLES * 2 ** (attempt + 1), 12 + attempt)
        rooms = graph.groupBy("u").agg(F.max("room").alias("room"))
        graph = materialise(shortened(graph.select("u", "v", "s", "w").union(more), rooms), "graph")
    else:
        raise RuntimeError(f"the descent finds {recall:.3f} of a sampled row's links, fewer than {RECALL}")
    merged = components(edges, "u", "v").withColumnsRenamed({"node": "hub", "component": "c"})
    named = held.join(cells.select("leader", "hub"), "leader").join(merged, "hub", "left").select("id", F.coalesce("c", "hub").alias("c"))
    least_id = materialise(named.groupBy("c").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")), "least")
    named = join_classes(named, least_id, "c").drop("n").join(links, "id").join(classes.select("id", "n", "vector"), "id")
    named = materialise(named.select("vector", "n", (F.col("n_links") + F.col("n") - 1).alias("links"), F.col("component").alias("c")), "named")
    of = join_classes(found.drop("dim"), named, "vector").select(F.col("id").alias("i"), "links", "c")
    all_rows = table.select(F.col(id).cast("long").alias("i")).join(of, "i", "left")
    component = F.coalesce("c", "i")
    return all_rows.select(F.col("i").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("i") == component, F.lit(False)).alias("kept"))
