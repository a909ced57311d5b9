r"""Dropping lines that many documents share: hashes of normalised lines are counted over all documents, lines drop by place.

Lines are exploded and hashed without their texts; distinct documents are counted for each hash. The places of the lines
that go come back to each text, which is put together from the slices between them: whole texts are shuffled once, for
that join, and lines never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import join_classes, materialise

#: The white space stripped from both ends of a line, `[\x20\x09-\x0D]`.
BLANKS = " \t\n\v\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Shared lines up to which they are broadcast (24 bytes each); beyond it lines and hashes meet by shuffle, hot hashes apart.
BROADCAST_LINES = 200_000


def lines_of(text: Column) -> Column:
    r"""The text split at \n; a null or empty one is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def hashed(names: tuple[str, str], *columns: Column) -> dict[str, Column]:
    """128 bits of the columns, as two whole numbers."""
    return {names[0]: F.xxhash64(*columns), names[1]: F.xxhash64(F.lit(1), *columns)}


def long_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, r1, r2 (the row's hash), pos, h1, h2 of every line whose key has min_chars code points or more."""
    rows = docs.select("doc_id", "text").withColumns(hashed(("r1", "r2"), F.col("doc_id"), F.col("text")))
    each = rows.select("doc_id", "r1", "r2", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    # Lengths are those of the key: changing case keeps them.
    keyed = each.where((F.char_length("line") >= min_chars) & (F.char_length(F.btrim("line", F.lit(BLANKS))) >= min_chars)).withColumn("key", line_key(F.col("line")))
    return keyed.withColumns(hashed(("h1", "h2"), F.col("key"))).select("doc_id", "r1", "r2", "pos", "h1", "h2")


def shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """h1, h2, n (lines), keeper (largest doc_id): hashes of the keys found in min_docs documents or more.

    Lines are first counted for each hash and document, so no task meets more rows of a hot line than there are parts.
    """
    in_doc = long_lines(docs, min_chars).groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    every = in_doc.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.count("doc_id").alias("docs"), F.max("doc_id").alias("keeper"))
    return every.where(F.col("docs") >= min_docs).drop("docs")


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    r"""doc_id, text (kept lines joined by \n), n_lines, n_dropped and the columns named in keep, a row for each of docs.

    Null and empty texts are one empty line and stay as the empty text; a text that loses all lines is empty, too. A
    document is a doc_id: rows that repeat one count once, and all its lines stay if it is the largest that holds them, be
    they repeated within it or not. Rows without doc_id count as no document and are never the largest, so they lose
    every shared line. Only doc_id, text and keep are read; other columns may have any names.
    """
    shared = materialise(shared_lines(docs, min_chars, min_docs), "shared")
    lines = long_lines(docs, min_chars)
    if shared.count() <= BROADCAST_LINES:
        met = lines.join(F.broadcast(shared.drop("n")), ["h1", "h2"])
    else:
        met = join_classes(lines, shared, ["h1", "h2"])
    gone = met.where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = gone.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("pos")).alias("__gone"))
    rows = docs.select("doc_id", "text", *[c for c in keep if c not in ("doc_id", "text")]).withColumns(hashed(("r1", "r2"), F.col("doc_id"), F.col("text")))
    joined = rows.join(places, ["r1", "r2"], "left").withColumn("__lines", lines_of(F.col("text")))
    # A slice of lines runs from behind a gap up to the next one.
    gaps = F.concat("__gone", F.array(F.size("__lines")))
    slices = F.zip_with(F.concat(F.array(F.lit(-1)), F.col("__gone")), gaps, lambda a, b: F.slice("__lines", a + 2, b - a - 1))
    text = F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(slices), "\n"))
    n_dropped = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone"))
    return joined.select("doc_id", text.alias("text"), F.size("__lines").cast("long").alias("n_lines"), n_dropped.cast("long").alias("n_dropped"), *[c for c in keep if c not in ("doc_id", "text")])
