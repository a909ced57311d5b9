"""What the corpus operators share: tables in the cluster's shared folder and bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.plans.storage import discard, shared_dir, written as materialise

__all__ = ["bound_batches", "discard", "groups_of", "join_classes", "materialise", "shared_dir", "small_batches"]


#: Rows from which a key is hot.
HOT_ROWS = 20_000


def join_classes(rows: DataFrame, classes: DataFrame, key: str | list[str]) -> DataFrame:
    """rows joined to classes, which have a row for each key and in n how many rows share it.

    Hot keys are joined where the rows lie; as each has HOT_ROWS rows, at most one in HOT_ROWS rows is broadcast.
    """
    hot = F.broadcast(classes.where(F.col("n") >= HOT_ROWS))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(classes.where(F.col("n") < HOT_ROWS), key)
    return rows.join(hot, key).unionByName(rest)


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: keeps the Arrow batches sent to Python small for this session, unless the user has set them already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def small_batches(batches: Iterable[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Splits batches so that the texts of each have about limit bytes; a longer text stands alone, whole."""
    for batch in batches:
        start, held = 0, 0
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_pylist()
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows or not sizes:
            yield batch.slice(start)


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], work: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """work(rows, borders) over rows sorted by integer keys, so that a group is never cut: borders has where each begins, and the end.

    Many small groups go through one call, which costs far less than a call a group.
    """
    waiting: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        at = np.stack([rows.column(k).to_numpy() for k in keys], axis=1)
        return work(rows, np.concatenate([[0], np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, [len(at)]]))

    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        other = np.flatnonzero((at != at[-1]).any(axis=1))
        start = int(other[-1]) + 1 if len(other) else 0
        if waiting and (start or any(waiting[-1].column(k)[-1] != batch.column(k)[0] for k in keys)):
            waiting.append(batch.slice(0, start))
            yield done()
            waiting = []
        elif start:
            waiting.append(batch.slice(0, start))
            yield done()
            waiting = []
        waiting.append(batch.slice(start))
    if waiting:
        yield done()
