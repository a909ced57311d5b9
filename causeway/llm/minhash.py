"""Near-duplicate documents: universal hash minima, banding, verification on full sets, components.

Documents with equal shingle sets are one class first; its smallest doc_id stands for it. Minima are banded, and what
shares a bucket is compared in three rounds, each of which confirms links on full shingle sets and merges components:
(1) every member with the bucket centre it meets most often; (2) the members of a block of each document's largest
bucket; (3) all pairs of different components that share a bucket, block by block. Blocks are searched by minima first;
only documents with a promising pair come again with their full sets. Then pairs are taken by falling estimate and need no
look once confirmed links join them, so a block gives fewer links than it has members, and a large group of copies costs
stars. Pairs inside a component are never formed. What round (3) sends grows with the square of the unlike components that
share one bucket, over BLOCK; six equal minima of unlike documents are what makes such a bucket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import bound_batches, groups_of, join_classes, materialise, small_batches
from causeway.operators.components import components

#: Hash minima: BANDS bands of ROWS each. At similarity 0.8 a pair shares no bucket with probability 6e-5.
BANDS, ROWS = 32, 6
#: Estimates come from one byte a minimum; four deviations below the threshold are still looked at.
DEVIATIONS = 4.0
#: Members of a bucket compared in one block.
BLOCK = 256
#: Ids broadcast at most (16 bytes each); beyond it the join is shuffled.
BROADCAST_IDS = 1_000_000
CACHED_WORDS, CACHED_SETS = 100_000, 10_000
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@lru_cache(maxsize=4)
def universal(count: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Factors (odd) and summands of count multiply-add hashes of 64 bits."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, count, dtype="u8") * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, dtype="u8")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Sketcher:
    """Shingle sets and minima of texts; caches hashes of words and minima of sets that repeat."""

    def __init__(self, width: int):
        self.width = width
        self.words: dict[str, int] = {}
        self.sets: dict[bytes, tuple[np.ndarray, bytes]] = {}
        self.factors, self.summands = universal(BANDS * ROWS)

    def hashes(self, words: list[str]) -> np.ndarray:
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(known.__getitem__, words), "u8", len(words))

    def shingles(self, text: str | None) -> np.ndarray:
        """The distinct shingles of a whole text as sorted 64-bit hashes."""
        words = WORD.findall(text.translate(LOWER)) if text else []
        if not words:
            return np.zeros(0, "u8")
        h = self.hashes(words)
        n = min(self.width, len(words))
        rolled = np.full(len(h) - n + 1, n, "u8")
        for k in range(n):
            rolled = mixed(rolled) + h[k : len(h) - n + 1 + k]
        return np.unique(mixed(rolled))

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), np.iinfo("u8").max, "u8")
        for at in range(0, len(shingles), 512):
            part = shingles[None, at : at + 512] * self.factors[:, None]
            part += self.summands[:, None]
            np.minimum(least, part.min(axis=1), out=least)
        return least

    def sketch(self, text: str | None) -> tuple[bytes | None, int, np.ndarray, bytes]:
        """(key of the set, its size, a bucket for each band, a byte for each minimum)."""
        shingles = self.shingles(text)
        if not len(shingles):
            return None, 0, np.zeros(0, "i8"), b""
        key = xxhash.xxh3_128_digest(shingles.tobytes())
        if key not in self.sets:
            if len(self.sets) >= CACHED_SETS:
                self.sets.clear()
            least = self.minima(shingles)
            bands = np.arange(BANDS, dtype="u8")
            for k in range(ROWS):
                bands = mixed(bands) + least.reshape(BANDS, ROWS)[:, k]
            self.sets[key] = mixed(bands).view("i8"), (mixed(least) >> np.uint64(56)).astype("u1").tobytes()
        return key, len(shingles), *self.sets[key]


def sketches(docs: DataFrame, width: int, text: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width)
        for batch in small_batches(batches, "__text"):
            rows = [sketcher.sketch(t) for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.binary())],
                names=["doc_id", "key", "n", "bands", "bytes"],
            )

    return picked.mapInArrow(run, "doc_id long, key binary, n long, bands array<long>, bytes binary")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int, text: str) -> DataFrame:
    """doc_id, set (hashes as bytes) of the documents in ids (doc_id, key): of an id's texts the one whose set has the key."""
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    small = ids.count() <= BROADCAST_IDS
    picked = picked.join(F.broadcast(ids) if small else ids, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(width)
        for batch in small_batches(batches, "__text"):
            sets = [sketcher.shingles(t).tobytes() for t in batch.column("__text").to_pylist()]
            right = pa.array([xxhash.xxh3_128_digest(s) == k for s, k in zip(sets, batch.column("key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "set"]).filter(right)

    return picked.mapInArrow(run, "doc_id long, set binary").dropDuplicates(["doc_id"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs u, v whose full sets are similar enough; a v that many u share is dealt to parts of BLOCK rows."""
    parts = materialise(pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "parts")
    hot = F.broadcast(parts.where("parts > 1"))  # at most one in BLOCK pairs
    dealt = pairs.join(hot, "v", "left").withColumn("part", F.pmod(F.xxhash64("u"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = sets.withColumnsRenamed({"doc_id": "v", "set": "set_v"}).join(parts, "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left = dealt.join(sets.withColumnsRenamed({"doc_id": "u", "set": "set_u"}), "u")
    both = left.join(copies, ["v", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            u, v = batch.column("u"), batch.column("v")
            keep = np.zeros(batch.num_rows, "?")
            for i, (set_u, set_v) in enumerate(zip(batch.column("set_u"), batch.column("set_v"))):
                if v[i].as_py() != last:
                    last, held = v[i].as_py(), np.frombuffer(set_v.as_py(), "u8")
                ours = np.frombuffer(set_u.as_py(), "u8")
                shared = len(np.intersect1d(ours, held, assume_unique=True))
                keep[i] = 100 * shared >= percent * (len(ours) + len(held) - shared)
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(keep))

    return both.select("u", "v", "set_u", "set_v").mapInArrow(run, "u long, v long")


def estimated(pairs: DataFrame, reps: DataFrame, least: float, percent: int) -> DataFrame:
    """u, v, agree (equal bytes of minima) for pairs that may be similar enough by size and estimate."""
    a = reps.select(F.col("doc_id").alias("u"), F.col("n").alias("n_u"), F.col("bytes").alias("bytes_u"))
    b = reps.select(F.col("doc_id").alias("v"), F.col("n").alias("n_v"), F.col("bytes").alias("bytes_v"))
    near = pairs.join(a, "u").join(b, "v").where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "u1").reshape(-1, BANDS * ROWS) for c in ("bytes_u", "bytes_v"))
            agree = (x == y).sum(axis=1).astype("i4")
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(agree)], names=["u", "v", "agree"]).filter(pa.array(agree >= least))

    return near.select("u", "v", "bytes_u", "bytes_v").mapInArrow(run, "u long, v long, agree int")


def cells(members: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, x, y, rest, doc_id, component: the blocks of buckets with several components.

    The component of a bucket's centre is its main one, the others are the rest. A block of main members meets each
    block of the rest, and blocks of the rest meet each other.
    """
    named = members.join(classes.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    centre = named.where(F.col("doc_id") == F.col("centre")).select("bucket", F.col("component").alias("main"))
    held = named.join(centre, "bucket").withColumn("rest", F.col("component") != F.col("main"))
    sizes = held.groupBy("bucket").agg(F.sum(F.col("rest").cast("long")).alias("n_rest"), F.count(F.lit(1)).alias("n_all")).where("n_rest > 0")
    blocks = sizes.select("bucket", F.ceil((F.col("n_all") - F.col("n_rest")) / BLOCK).cast("int").alias("mains"), F.ceil(F.col("n_rest") / BLOCK).cast("int").alias("rests"))
    placed = held.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("doc_id", "bucket"), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int"))
    mains, rests = F.sequence(F.lit(0), F.col("mains") - 1), F.sequence(F.lit(0), F.col("rests") - 1)
    mixed_cells = F.transform(mains, lambda i: F.struct(i.alias("x"), F.col("block").alias("y")))
    rest_cells = F.transform(rests, lambda j: F.struct((-1 - F.least(F.col("block"), j)).alias("x"), F.greatest(F.col("block"), j).alias("y")))
    main_cells = F.transform(rests, lambda j: F.struct(F.col("block").alias("x"), j.alias("y")))
    spread = placed.withColumn("at", F.explode(F.when(F.col("rest"), F.concat(mixed_cells, rest_cells)).otherwise(main_cells)))
    return spread.select("bucket", "at.x", "at.y", "rest", "doc_id", "component")


def own_cells(members: DataFrame, classes: DataFrame) -> DataFrame:
    """As cells(), but each document of a bucket with several components is in one block of its largest such bucket alone."""
    named = members.join(classes.withColumnsRenamed({"node": "doc_id"}), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    sizes = named.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    largest = named.join(sizes, "bucket").groupBy("doc_id", "component").agg(F.max(F.struct("size", "bucket")).alias("b"))
    block = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("b.size") / BLOCK)).cast("int")
    return largest.select(F.col("b.bucket").alias("bucket"), (-1 - block).alias("x"), block.alias("y"), F.lit(True).alias("rest"), "doc_id", "component")


def cell_links(spread: DataFrame, reps: DataFrame, sets: DataFrame, least: float, percent: int, everywhere: bool) -> DataFrame:
    """u, v: links confirmed on full sets that join components inside each cell.

    A cell's promising pairs of different components are taken by falling estimate, and passed over only if confirmed
    links of the cell join them already. Where a pair shares several buckets, all but the first band are spared
    (everywhere). Sets are sent only for documents with a promising pair in the cell.
    """
    keys = ("bucket", "x", "y")

    class Cells:
        """Columns of a batch of whole cells."""

        def __init__(self, batch: pa.RecordBatch):
            self.bucket, self.x, self.ids, self.component, self.n = (batch.column(c).to_numpy() for c in ("bucket", "x", "doc_id", "component", "n"))
            self.rest = batch.column("rest").to_numpy(zero_copy_only=False)
            self.data = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), "u1").reshape(-1, BANDS * ROWS)
            self.bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)

        def promising(self, a: int, b: int) -> list[tuple[int, int, int]]:
            """(equal bytes, i, j) of pairs of different components of one cell that may be similar enough."""
            found: list[tuple[int, int, int]] = []
            rest, ids, component, n, data, bands = (c[a:b] for c in (self.rest, self.ids, self.component, self.n, self.data, self.bands))
            apart, band = self.x[a] >= 0, int(np.argmax(bands[0] == self.bucket[a]))
            for i in np.flatnonzero(rest):
                ok = (component != component[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i]))
                ok &= ~rest if apart else ids > ids[i]
                at = np.flatnonzero(ok)
                if everywhere and band and len(at):
                    at = at[~(bands[at, :band] == bands[i, :band]).any(axis=1)]
                if len(at):
                    agree = (data[at] == data[i]).sum(axis=1)
                    found += [(int(s), a + int(i), a + int(j)) for s, j in zip(agree, at) if s >= least]
            return found

    def search(batch: pa.RecordBatch, borders: np.ndarray) -> pa.RecordBatch:
        held, wanted = Cells(batch), set()
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            if b - a > 1:
                wanted.update(k for _, i, j in held.promising(a, b) for k in (i, j))
        return batch.select([*keys, "doc_id"]).take(pa.array(sorted(wanted), pa.int64()))

    def confirm(batch: pa.RecordBatch, borders: np.ndarray) -> pa.RecordBatch:
        held, out = Cells(batch), []
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            top: dict[int, int] = {}
            full: dict[int, np.ndarray] = {}

            def root(x: int) -> int:
                while top.setdefault(x, x) != x:  # noqa: B023
                    top[x] = x = top[top[x]]  # noqa: B023
                return x

            for _, i, j in sorted(held.promising(a, b), reverse=True) if b - a > 1 else ():
                x, y = root(int(held.component[i])), root(int(held.component[j]))
                if x == y:
                    continue
                for k in (i, j):
                    if k not in full:
                        full[k] = np.frombuffer(batch.column("set")[k].as_buffer(), "u8")
                shared = len(np.intersect1d(full[i], full[j], assume_unique=True))
                if 100 * shared >= percent * (len(full[i]) + len(full[j]) - shared):
                    top[x] = y
                    out.append((int(max(held.ids[i], held.ids[j])), int(min(held.ids[i], held.ids[j]))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["u", "v"])

    columns = (*keys, "rest", "doc_id", "component", "n", "bytes", "bands")
    dealt = spread.join(reps, "doc_id").select(*columns).repartition(*keys).sortWithinPartitions(*keys)
    found = materialise(dealt.mapInArrow(lambda batches: groups_of(batches, keys, search), "bucket long, x int, y int, doc_id long"), "promising")
    again = spread.join(found, [*keys, "doc_id"], "left_semi").join(reps, "doc_id").join(sets, "doc_id")
    again = again.select(*columns, "set").repartition(*keys).sortWithinPartitions(*keys)
    return again.mapInArrow(lambda batches: groups_of(batches, keys, confirm), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Documents are linked where 100 * shared shingles >= percent * all shingles of both. component_id is the smallest
    doc_id reachable over links; kept says whether that is the row's own. Null and empty texts, and those without words,
    have no shingles and are linked with nothing. Rows with a null doc_id have a null component_id and aren't kept.
    Repeated rows of a doc_id count as one document and are returned as often as they come; where their texts differ, each
    row has its own set, and a document stands for others by the set of smallest digest. Only doc_id and the text
    are read, so other columns may have any name.
    """
    least = BANDS * ROWS * (percent / 100 - DEVIATIONS * (percent / 100 * (1 - percent / 100) / (BANDS * ROWS)) ** 0.5)
    drawn = materialise(sketches(docs, width, text), "sketches")
    classes = drawn.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = materialise(classes, "classes")
    chosen = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.min("key").alias("key"))
    reps = drawn.join(chosen, ["doc_id", "key"]).select("doc_id", "key", "n", "bands", "bytes").dropDuplicates(["doc_id"])
    reps = materialise(reps, "reps")
    banded = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("last")).where("centre < last").drop("last")
    members = materialise(banded.join(shared, "bucket"), "buckets")
    sets = materialise(shingle_sets(docs, members.select("doc_id").distinct().join(reps.select("doc_id", "key"), "doc_id"), width, text), "sets")

    reps = reps.drop("key")
    met = members.where("doc_id != centre").groupBy(F.col("doc_id").alias("u"), F.col("centre").alias("v")).agg(F.count(F.lit(1)).alias("bands"))
    best = met.groupBy("u").agg(F.max(F.struct("bands", (-F.col("v")).alias("v"))).alias("b")).select("u", (-F.col("b.v")).alias("v"))
    best = estimated(best, reps, least, percent).select("u", "v")
    links = materialise(confirmed(best, sets, percent), "links")
    merged = components(links, "u", "v")
    for cut, everywhere in ((own_cells, False), (cells, True)):
        more = cell_links(materialise(cut(members, merged), "cells"), reps, sets, least, percent, everywhere)
        links = materialise(merged.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), "links")
        merged = components(links, "u", "v")
    named = classes.join(merged.withColumnRenamed("node", "rep"), "rep", "left").select("key", "n", F.coalesce("component", "rep").alias("c"))
    short = drawn.select("doc_id", "key", F.col("n").alias("n_shingles"))
    rows = join_classes(short.where("key IS NOT NULL AND doc_id IS NOT NULL"), materialise(named, "named"), "key").select("doc_id", "n_shingles", "c")
    alone = short.where("key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("c"))
    rows = rows.unionByName(alone)
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
