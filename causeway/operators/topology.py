"""Folding along arrows over many tasks: what a cell can settle is settled in one task, only values at borders move.

Items are nodes with arguments, bounded by a key (an instance, a scope). A key of up to CELL_ROWS items is one cell, so
however deep it is, one pass settles it. Of a larger key, nodes that wait for no other are taken off rank by rank while
that takes off a share worth a round; each item is folded once, in its rank, and each value is sent once to the cells that
ask for it. What is left, if still large, is cut into cells along the depth of a forest in which each node hangs on its
first argument, found by pointer doubling; then rounds alternate between folding the cells that have news and sending values
to the cells that ask for them. A chain takes a round for each of its cells. The result doesn't depend on how cells are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.plans.storage import discard, in_place, stored, stored_with

#: Items of a cell, at about 1 kB each in the task that folds it.
CELL_ROWS = 100_000
#: Ranges of depth of a key at most, from which cells are made.
RANGES = 4096
#: Nodes of a key that are left for each that a rank takes off, at most; a thinner rank ends the ranks.
THIN = 64
#: Items of a cell of a rank, which needs no others of its rank, so that all cores have some.
RANK_ROWS = 20_000
#: Rows that a task gives at once.
OUT_ROWS = 50_000

#: What a fold needs: masks of the output from (code, masks of the arguments, mask of all assignments), None if it has none.
Compute = Callable[[str | None, list[list[int]], int], "list[int] | None"]


def depths(items: DataFrame) -> tuple[DataFrame, int]:
    """(key, node, depth; the largest depth): steps to the root of the forest in which a node hangs on its first argument that is a node.

    Each round doubles the steps. On or behind a cycle of the forest depths mean nothing, and rounds end by the number of nodes.
    """
    nodes = items.select("key", "node").distinct()
    asked = items.select("key", "node", F.posexplode("args").alias("pos", "arg")).join(nodes.withColumnRenamed("node", "arg"), ["key", "arg"])
    parents = asked.groupBy("key", "node").agg(F.min(F.struct("pos", "arg"))["arg"].alias("up"))
    state, (count, left) = stored_with(nodes.join(parents, ["key", "node"], "left").withColumn("depth", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "depths", F.count("up"))
    for _ in range(count.bit_length() + 1):
        if not left:
            break
        above = state.select("key", F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        moved = state.where("up IS NOT NULL").join(above, ["key", "up"]).select("key", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"))
        before = state
        state, (_, left) = stored_with(state.where("up IS NULL").unionByName(moved), "depths", F.count("up"))
        discard(before)
    return state.select("key", "node", "depth"), state.agg(F.max("depth")).first()[0] or 0


def in_cells(items: DataFrame) -> tuple[DataFrame, bool]:
    """(items with a column cell, whether any key has several): items are key, node, args and others; those of a node share a cell."""
    sizes = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= CELL_ROWS:
        return items.withColumn("cell", F.lit(0).cast("long")), False
    large = F.broadcast(sizes.where(F.col("n") > CELL_ROWS).select("key"))  # at most one for each CELL_ROWS items
    big = stored(items.join(large, "key", "left_semi"), "large")
    found, deepest = depths(big)
    ranged = stored(found.withColumn("range", F.floor(F.col("depth") / (1 + deepest // RANGES))), "ranges")
    counts = ranged.groupBy("key", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
    placed = counts.select("key", "range", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / CELL_ROWS).alias("group"), F.ceil(F.col("n") / CELL_ROWS).alias("parts"))
    cell = F.col("group") * (1 << 20) + F.pmod(F.xxhash64("node"), F.col("parts"))
    cells = ranged.join(F.broadcast(placed), ["key", "range"]).select("key", "node", cell.cast("long").alias("cell"))
    return stored(big.join(cells, ["key", "node"]).unionByName(items.join(large, "key", "left_anti").withColumn("cell", F.lit(0).cast("long"))), "items"), True


VALUES = "key string, block long, cell long, var string, value int, mask long, level int"


def settle(every: int, known: dict, level: dict, items: list, forced: dict, compute: Compute) -> Iterator[tuple[str, str | None, list[int]]]:
    """(node, code, masks) of the items (code, node, args) that follow from what is known; adds them to known and level."""
    left: dict[str, int] = {}
    codes: dict[str, str | None] = {}
    waits: dict[str, list[int]] = {}
    missing, ready = [0] * len(items), []
    for i, (code, node, args) in enumerate(items):
        left[node] = left.get(node, 0) + 1
        codes[node] = code
        if args is None:
            continue
        open_ = {a for a in args if a not in known}
        missing[i] = len(open_)
        for a in open_:
            waits.setdefault(a, []).append(i)
        if not open_:
            ready.append(i)
    sums: dict[str, list[int]] = {}
    while ready:
        code, node, args = items[ready.pop()]
        masks = compute(code, [known[a] for a in args], every)
        if masks is None:
            continue
        sums[node] = [a | b for a, b in zip(sums[node], masks)] if node in sums else masks
        level[node] = max([level.get(node, 1), *(level[a] + 1 for a in args)])
        left[node] -= 1
        if left[node]:
            continue
        masks = sums[node]
        for value, mask in forced.get(node, ()):
            masks = [m | mask if x == value else m & ~mask for x, m in enumerate(masks)]
        known[node] = masks
        yield node, codes[node], masks
        for i in waits.get(node, ()):
            missing[i] -= 1
            if not missing[i]:
                ready.append(i)


#: Bits of a block.
WORD, LOW = 64, (1 << 64) - 1


def signed(mask: int) -> int:
    return mask - (1 << WORD) if mask >> WORD - 1 else mask


def fold_with(compute: Compute, domain: Callable[[str | None], tuple[int, ...]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task over rows sorted by key, block and cell: kind 0 has known values, 1 items, 2 values that are forced.

    A node is settled when all its items are, and has the values that any of them gives.
    """

    def close(at: tuple, known: dict, level: dict, items: list, forced: dict, out: list) -> None:
        for node, code, masks in settle(at[3] & LOW, known, level, items, forced, compute):
            for x in domain(code):
                out.append((*at[:3], node, x, signed(masks[x]), level[node]))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32())
        columns = list(zip(*rows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in VALUES.split(", ")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, level, items, forced, out = None, {}, {}, [], {}, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "block", "cell", "everything", "kind", "code", "var", "args", "value", "mask", "level")]
            for *here, kind, code, var, args, value, mask, lev in zip(*columns):
                if at is None or here[:3] != list(at[:3]):
                    if at is not None:
                        close(at, known, level, items, forced, out)
                    at, known, level, items, forced = tuple(here), {}, {}, [], {}
                    if len(out) >= OUT_ROWS:
                        yield batch_of(out)
                        out = []
                if kind == 0:
                    known.setdefault(var, [0, 0, 0])[value] |= mask & LOW
                    level[var] = lev
                elif kind == 1:
                    items.append((code, var, args))
                else:
                    forced.setdefault(var, []).append((value, mask & LOW))
        if at is not None:
            close(at, known, level, items, forced, out)
        yield batch_of(out)

    return task


PACKED = "inst string, var string, bits array<long>"


def fold_packed(compute: Compute) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The task of settled_whole() over rows sorted by inst; all blocks of a mask are one integer."""
    kinds = pa.schema([("inst", pa.string()), ("var", pa.string()), ("bits", pa.list_(pa.int64()))])

    def joined(column: pa.ListArray) -> list[tuple[int, int]]:
        """Of each row the number of words and the integer they make; a null makes 0."""
        flat, ends = column.values.to_numpy(zero_copy_only=False).tobytes(), [8 * x for x in column.offsets.to_pylist()]
        return [((y - x) // 8, int.from_bytes(flat[x:y], "little")) for x, y in zip(ends, ends[1:])]

    def close(inst: str, size: int, every: int, free: list, items: list, forced: dict, out: list) -> None:
        known: dict[str, list[int]] = {}
        for var, ones in free:
            masks = known.setdefault(var, [0, 0, 0])
            known[var] = [masks[0] | every & ~ones, masks[1] | ones, 0]
        out.extend((inst, var, masks[1].to_bytes(8 * size, "little")) for var, masks in known.items())
        level = dict.fromkeys(known, 0)
        for node, _, masks in settle(every, known, level, [item for item in items if item[1] not in known], forced, compute):
            out.append((inst, node, masks[1].to_bytes(8 * size, "little")))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        insts, names, bits = list(zip(*rows)) or [()] * len(kinds)
        ends = np.cumsum([0, *(len(x) // 8 for x in bits)], dtype=np.int32)
        words = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(bits), np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(list(insts), pa.string()), pa.array(list(names), pa.string()), words.cast(kinds.field("bits").type)], schema=kinds)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, every, free, items, forced, out = None, 0, 0, [], [], {}, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("inst", "kind", "code", "var", "args")] + [joined(batch.column(c)) for c in ("bits", "clear")]
            for inst, kind, code, var, args, (words, bits), (_, clear) in zip(*columns):
                if inst != at:
                    if at is not None:
                        close(at, size, every, free, items, forced, out)
                    at, size, every, free, items, forced = inst, 0, 0, [], [], {}
                    if len(out) >= OUT_ROWS:
                        yield batch_of(out)
                        out = []
                if kind == 0:
                    free.append((var, bits))
                elif kind == 1:
                    items.append((code, var, args))
                elif kind == 2:
                    forced.setdefault(var, []).extend(((1, bits), (0, clear)))
                else:
                    size, every = words, bits
        if at is not None:
            close(at, size, every, free, items, forced, out)
        yield batch_of(out)

    return task


def settled_whole(items: DataFrame, spans: DataFrame, given: DataFrame, compute: Compute, by: tuple[str, ...] = ("inst",)) -> DataFrame:
    """inst, var, bits (assignments that make it 1, an array of blocks) of each variable that follows, given ones among them, of small models over two values, as a plan that isn't stored.

    An instance is folded in one task with all its blocks at once: each item is a row, however many blocks there are. So
    instances must be bounded, as the grid's are; larger ones are for settled(). items: inst, code, var, args. spans: inst,
    bits of all assignments. given: inst, kind, var, bits, clear: kind 0 free variables, kind 2 variables set to 1 under
    bits and to 0 under clear. by: columns of all three that rows lie by, inst the last; others may say what holds an inst.
    """
    none = {c: F.lit(None).cast(t) for c, t in (("code", "string"), ("var", "string"), ("args", "array<string>"), ("bits", "array<long>"), ("clear", "array<long>"))}
    shaped = lambda rows, kind=None: rows.select(*by, (F.col("kind") if kind is None else F.lit(kind)).alias("kind"), *[F.col(c) if c in rows.columns else x.alias(c) for c, x in none.items()])
    rows = shaped(items, 1).unionByName(shaped(spans, 3)).unionByName(shaped(given))
    return in_place(rows, *by).sortWithinPartitions(*by).drop(*by[:-1]).mapInArrow(fold_packed(compute), PACKED)


def ranks(items: DataFrame) -> tuple[DataFrame | None, list[int]]:
    """(key, node, rank; by rank, its nodes): rank 0 waits for no node, a later one for nodes of earlier ranks alone, one at least of the last.

    Ranks end where no key has more than CELL_ROWS nodes left, or where the next one is thin; nodes left have no rank.
    """
    nodes = items.select("key", "node").distinct()
    asked = items.select("key", "node", F.explode("args").alias("arg")).distinct()
    waits = asked.join(nodes.withColumnRenamed("node", "arg"), ["key", "arg"], "left_semi").groupBy("key", "node").agg(F.collect_list("arg").alias("waits"))
    ready = F.count_if(F.size("waits") == 0)
    state, (left, found) = stored_with(nodes.join(waits, ["key", "node"], "left").withColumn("waits", F.coalesce("waits", F.array().cast("array<string>"))), "waits", ready)
    parts, counts = [], []
    while found and found * THIN >= left:
        now = state.where("size(waits) = 0").select("key", "node")
        parts.append(now.withColumn("rank", F.lit(len(parts))))
        counts.append(found)
        if left - found <= CELL_ROWS:  # of all keys together, so of each
            break
        known = now.select("key", F.col("node").alias("arg"), F.lit(True).alias("known"))
        each = state.select("key", "node", F.explode("waits").alias("arg")).join(known, ["key", "arg"], "left")
        still = F.collect_list(F.when(F.col("known").isNull(), F.col("arg")))
        state, (left, found) = stored_with(each.groupBy("key", "node").agg(still.alias("waits")), "waits", ready)
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out, counts


COLUMNS = {"code": "string", "args": "array<string>", "value": "int", "mask": "long", "level": "int"}


def filled(rows: DataFrame, kind: int) -> DataFrame:
    """Rows as fold_with() takes them."""
    return rows.select("key", "block", "cell", "everything", F.lit(kind).alias("kind"), "var", *[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()])


def folded(rows: DataFrame, compute: Compute, domain: Callable[[str | None], tuple[int, ...]]) -> tuple[DataFrame, int]:
    order = ("key", "block", "cell")
    new, (count,) = stored_with(in_place(rows, *order).sortWithinPartitions(*order).mapInArrow(fold_with(compute, domain), VALUES), "settled")
    return new, count


def ranked(items: DataFrame, spans: DataFrame, start: DataFrame, compute: Compute, domain: Callable[[str | None], tuple[int, ...]], forced: DataFrame | None) -> tuple[DataFrame, list[DataFrame]]:
    """(items left, values by rank) of large keys, a rank after the other.

    A node is folded once, when all nodes it waits for were, in every block: what has no value then never gets one.
    """
    found, counts = ranks(items)
    if found is None:
        return items, []
    parts = F.element_at(F.array(*[F.lit(-(-n // RANK_ROWS)) for n in counts]), F.col("rank") + 1)
    found = stored(found.withColumn("cell", F.col("rank") * F.lit(1 << 20).cast("long") + F.pmod(F.xxhash64("key", "node"), parts)), "ranks")
    rest = stored(items.join(found, ["key", "node"], "left_anti"), "items")
    own = stored(items.join(found, ["key", "node"]).sortWithinPartitions("rank"), "items")
    asks = own.select("key", "rank", "cell", F.explode("args").alias("var")).distinct()
    asks = stored(asks.join(found.select("key", F.col("node").alias("var"), F.col("rank").alias("from")), ["key", "var"], "left").withColumn("from", F.coalesce("from", F.lit(-1))).sortWithinPartitions("from"), "asks")
    sent = [stored(asks.where("from = -1").join(start, ["key", "var"]).drop("from").sortWithinPartitions("rank"), "sent")]
    values: list[DataFrame] = []
    for rank in range(len(counts)):
        here = own.where(F.col("rank") == rank).join(spans, "key")
        rows = filled(here.withColumnRenamed("node", "var"), 1)
        got = items.sparkSession.read.schema(sent[0].schema).parquet(*[part.stored_at for part in sent]).where(F.col("rank") == rank)  # one scan, however many
        rows = rows.unionByName(filled(got.join(spans, ["key", "block"]), 0))
        if forced is not None:
            rows = rows.unionByName(filled(here.select("key", "block", "cell", "everything", F.col("node").alias("var")).distinct().join(forced, ["key", "block", "var"]), 2))
        new, _ = folded(rows, compute, domain)
        values.append(new.drop("cell"))
        if rank + 1 < len(counts):
            sent.append(stored(asks.where(F.col("from") == rank).join(values[-1], ["key", "var"]).select(sent[0].columns).sortWithinPartitions("rank"), "sent"))
    discard(own, asks, *sent)
    return rest, values


def settled(items: DataFrame, spans: DataFrame, start: DataFrame, compute: Compute, domain: Callable[[str | None], tuple[int, ...]], forced: DataFrame | None = None) -> DataFrame:
    """key, block, var, value, mask, level of every node that follows from start, as a stored table or several.

    items: key, code, node, args (null where they can't be read, which leaves the node unsettled). spans: key, block,
    everything (the mask of all assignments), a row or more for each key. start: values already known; none of them may be a
    node. forced: key, block, var, value, mask.
    """
    items, early = stored(items, "items"), []
    start = start.select("key", "block", "var", "value", "mask", "level")
    sizes = items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) > CELL_ROWS:
        large = F.broadcast(sizes.where(F.col("n") > CELL_ROWS).select("key"))  # at most one for each CELL_ROWS items
        rest, early = ranked(stored(items.join(large, "key", "left_semi"), "large"), spans, start, compute, domain, forced)
        items = rest.unionByName(items.join(large, "key", "left_anti"))
        for part in early:
            start = start.unionByName(part)
    items, split = in_cells(items)
    if split:
        owner = items.select("key", F.col("node").alias("arg"), F.col("cell").alias("home")).distinct()
        asks = items.select("key", "cell", F.explode("args").alias("arg")).distinct()
        border = stored(asks.join(owner, ["key", "arg"]).where("cell != home").select("key", "cell", F.col("arg").alias("var")), "border")
    values, parts, active = start, [], None
    while True:
        if active is None:
            open_ = items.join(spans, "key")
        else:
            done = values.select("key", "block", F.col("var").alias("node")).distinct()
            open_ = items.join(F.broadcast(active), ["key", "cell"]).join(spans, ["key", "block"]).join(done, ["key", "block", "node"], "left_anti")  # a row for each cell and block with news
        asked = open_.select("key", "block", "cell", "everything", F.explode("args").alias("var")).distinct()
        rows = filled(open_.withColumnRenamed("node", "var"), 1).unionByName(filled(asked.join(values, ["key", "block", "var"]), 0))
        if forced is not None:
            own = open_.select("key", "block", "cell", "everything", F.col("node").alias("var")).distinct()
            rows = rows.unionByName(filled(own.join(forced, ["key", "block", "var"]), 2))
        new, count = folded(rows, compute, domain)
        parts.append(new.drop("cell"))
        if not split or not count:
            break
        values = values.unionByName(new.drop("cell"))
        active = stored(new.select("key", "block", "var").join(border, ["key", "var"]).select("key", "block", "cell").distinct(), "active")
    out = parts[0]
    for part in (*parts[1:], *early):
        out = out.unionByName(part)
    return out
