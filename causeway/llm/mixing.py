"""Mixing sources to target weights: a random order in each source, distributed prefix sums, an exact cut.

Every row gets a hash-random key; a source's order is that of its keys. Ranges of keys are summed first; their running
sums and the running sums inside a range give each row the words before it, so no task holds more than a range. A
source whose budget exceeds its size is repeated whole, and the last repetition is cut where the budget ends.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.llm.common import materialise

#: Rows that a range of keys aims at, over all sources.
RANGE_ROWS = 50_000
#: Sources broadcast at most (about 100 bytes each); beyond it the join is shuffled.
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_of(place: Column, weights: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))


def running_sums(rows: DataFrame, order: list[Column], sums: dict[str, Column], label: str) -> DataFrame:
    """rows with, for each name of sums, the sum over all rows before it in the order, which has no ties.

    Ranges of the order are sorted and summed in tasks of their own; only a row for each range meets in one task.
    """
    names = {f"__o{i}": o for i, o in enumerate(order)}
    keyed = rows.withColumns(names).repartitionByRange(*names).sortWithinPartitions(*names)
    keyed = materialise(keyed.withColumns({"__range": F.spark_partition_id(), **{f"__{n}": c for n, c in sums.items()}}), label)
    totals = keyed.groupBy("__range").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in sums])
    every = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks
    totals = totals.select("__range", *[F.coalesce(F.sum(f"__{n}").over(every), F.lit(0)).alias(f"__b_{n}") for n in sums])
    inside = Window.partitionBy("__range").orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    found = keyed.withColumns({n: F.coalesce(F.sum(f"__{n}").over(inside), F.lit(0)) for n in sums}).join(F.broadcast(totals), "__range")
    return found.select(*rows.columns, *[(F.col(n) + F.col(f"__b_{n}")).cast("long").alias(n) for n in sums])


def targets(totals: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, target from source, source_size.

    Sources by code point, null last, take weights in turn; together they get the sum of all sizes. No target exceeds
    most times its source's size; the excess is shared out again by weight. Sources at their bound come first in the
    order of size to weight, so running sums over that order find them all at once. There may be any number of sources:
    both orders are cut into ranges.
    """
    by_name = [F.col("source").isNull(), F.col("source")]
    placed = running_sums(totals, by_name, {"place": F.lit(1).cast("long")}, "places").withColumn("w", weight_of(F.col("place") + 1, weights)).drop("place")
    shared = lcm(*weights)
    order = [F.col("source_size") * (F.lit(shared) / F.col("w")).cast("long"), *by_name]
    left = running_sums(placed, order, {"n_before": F.col("source_size"), "w_before": F.col("w")}, "ratios")
    every = placed.agg(F.sum("source_size").alias("n"), F.sum("w").alias("w")).first()
    left = left.withColumns({"rest": F.lit(every["n"] or 0) - most * F.col("n_before"), "share": F.lit(every["w"] or 0) - F.col("w_before")})
    bound = materialise(left.withColumn("bound", F.col("w") * F.col("rest") > most * F.col("source_size") * F.col("share")).drop("n_before", "w_before"), "bounds")
    # The first row that isn't bound has the level that holds for all after it.
    level = bound.where("NOT bound").agg(F.max("rest").alias("rest"), F.max("share").alias("share")).first()
    target = F.when(F.col("bound"), (most * F.col("source_size")).cast("double")).otherwise((F.col("w") * F.lit(level["rest"] or 0)).cast("double") / F.lit(level["share"] or 1))
    return bound.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def shuffle_key(doc_id: Column, text: Column, seed: str) -> Column:
    """A row's key from its doc_id, or from its text where it has none, so that rows without id spread over all ranges."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))))
    return F.md5(F.concat(F.lit(f"{seed}:"), named).cast("binary"))


def placed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: str) -> DataFrame:
    """doc_id, source, size, key, source_size, target, epochs (whole repetitions) and rest (words the cut leaves for a row and all after it)."""
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), shuffle_key(F.col("doc_id"), F.col("text"), seed).alias("key"))
    sized = materialise(sized, "sizes")
    count, digits = sized.count(), 1
    while 16**digits * RANGE_ROWS < count:
        digits += 1
    sized = sized.withColumn("range", F.substring("key", 1, digits))
    ranges = sized.groupBy("source", "range").agg(F.sum("size").alias("n"))
    in_source = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.withColumn("before", F.coalesce(F.sum("n").over(in_source), F.lit(0))).drop("n")
    budget = targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    known = before.join(budget.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    known = known.withColumnsRenamed({"source": "s", "range": "r"})
    in_range = Window.partitionBy("source", "range").orderBy("key", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    running = sized.withColumn("inside", F.coalesce(F.sum("size").over(in_range), F.lit(0)))
    joined = running.join(known, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    words = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = words - epochs * F.col("source_size") - F.col("before") - F.col("inside")
    return joined.select("doc_id", "source", "size", "key", "source_size", "target", epochs.alias("epochs"), rest.alias("rest"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words the mix takes of the row, repeats counted), a row for each of docs.

    Null texts and texts without words have size 0 and take 0. Null is a source of its own. Keys depend on seed
    and doc_id alone (on the text where doc_id is null), so reruns agree; rows that repeat a doc_id share a key and are
    ordered by size. The sizes are written
    once as a narrow table; texts are never shuffled. Only doc_id, source and text are read.
    """
    taken = F.col("size") * F.col("epochs") + F.greatest(F.lit(0).cast("long"), F.least("size", "rest"))
    return placed(docs, weights, most, seed).select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def draw(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix") -> DataFrame:
    """The rows of docs as often as the mix takes them, whole: the row that the cut goes through comes once more if half of it fits.

    A source's cut is a key, so rows are drawn where they lie, by a join with one row a source. Rows that share the key
    of the cut are treated alike. Texts without words aren't drawn.
    """
    rows = placed(docs, weights, most, seed)
    at_cut = (F.col("rest") > 0) & (F.col("rest") <= F.col("size"))
    cuts = rows.groupBy("source").agg(F.max("epochs").alias("__epochs"), F.max(F.when(at_cut, F.col("key"))).alias("__cut"), F.max(F.when(at_cut, 2 * F.col("rest") >= F.col("size"))).alias("__half"))
    cuts = materialise(cuts.withColumnRenamed("source", "__source"), "cuts")
    joined = docs.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts, F.col("source").eqNullSafe(F.col("__source")))
    key = shuffle_key(F.col("doc_id"), F.col("text"), seed)
    once_more = F.coalesce((key < F.col("__cut")) | ((key == F.col("__cut")) & F.col("__half")), F.lit(False))
    times = F.when(word_count(F.col("text")) > 0, F.col("__epochs").cast("int") + once_more.cast("int")).otherwise(F.lit(0))
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), times))).select(*docs.columns)
