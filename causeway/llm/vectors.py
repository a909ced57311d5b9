"""Embeddings as the search operators see them: usable vectors, and classes of equal ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which the copies of one vector are dealt before they meet.
SALTS = 32


def usable(table: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id, vector (array<double>), dim. Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, are left out."""
    v = F.col("vector")
    picked = table.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return picked.where(F.col("id").isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("vector"))


def by_id(rows: DataFrame) -> DataFrame:
    """One row an id: of different vectors, the smallest."""
    return rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("dim", F.size("vector"))


def distinct_vectors(rows: DataFrame, ids: int) -> DataFrame:
    """vector, dim, ids (the smallest `ids` of the rows that share it), n: a row for each distinct vector.

    Copies are ranked in parts first, so a vector that fills a third of the table sends few rows on.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    first = Window.partitionBy("vector", "salt").orderBy("id")
    counts = salted.groupBy("vector").agg(F.count(F.lit(1)).alias("n"))
    part = salted.withColumn("r", F.row_number().over(first)).where(F.col("r") <= ids)
    ranked = part.withColumn("r", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("r") <= ids)
    return ranked.groupBy("vector", "dim").agg(F.array_sort(F.collect_list("id")).alias("ids")).join(counts, "vector")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of equal length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(flat):
        return np.zeros((0, 0))
    return flat.flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(len(flat), -1)


def unit(rows: DataFrame) -> DataFrame:
    """id, n, dim, vector with vectors scaled to length 1; the largest component comes out first, so tiny and huge ones neither vanish nor overflow."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(sizes):
                flat = flat / np.repeat(np.maximum.reduceat(np.abs(flat), starts), sizes)
                flat = flat / np.repeat(np.sqrt(np.add.reduceat(flat * flat, starts)), sizes)
            vectors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "n", "dim")), vectors], names=["id", "n", "dim", "vector"])

    return rows.select("id", "n", "dim", "vector").mapInArrow(scale, "id long, n long, dim int, vector array<double>")
