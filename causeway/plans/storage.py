"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which the driver and all executors share.

    Only on a local master, as in tests, a temporary folder takes its place where it is unset; elsewhere that is an error,
    as executors would scatter their parts over their own disks.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="causeway-")
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table given in the code, as a local relation of the plan."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = to_arrow_schema(spark.createDataFrame(pa.table({"x": pa.array([], pa.int32())})).select(*[F.lit(None).cast(c.split(" ", 1)[1]).alias(n) for c, n in zip(schema.split(", "), names)]).schema)
    columns = list(zip(*rows)) or [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(list(c), kinds.field(n).type) for c, n in zip(columns, names)], names=names))


#: Bytes in files of a side that joins may broadcast without a mark.
SMALL = 256 * 1024
GUESSES = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
#: What the settings were, then an entry for each further user of marked_broadcasts(): only the last one out sets them back.
MARKED: list[dict] = []
LOCK = threading.Lock()


@contextmanager
def marked_broadcasts(spark: SparkSession) -> Iterator[None]:
    """While it lasts, joins broadcast only sides that are marked for it or very small.

    Spark takes up to 10 MB of files for a small side, but ids compress to a twentieth, and a plan of many joins has many
    such sides at once, all of which pass through the driver.
    """
    with LOCK:
        if not MARKED:
            MARKED.append({key: spark.conf.get(key, None) for key in GUESSES})
            for key in GUESSES:
                if not (MARKED[0][key] or "").startswith("-"):
                    spark.conf.set(key, SMALL)
        else:
            MARKED.append({})
    try:
        yield
    finally:
        with LOCK:
            if len(MARKED) == 1:
                for key, value in MARKED[0].items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)
            del MARKED[-1]


#: Local property of threads in gathered(): the number of buckets.
BUCKETS = "causeway.buckets"
#: Columns that name an instance; a table's first one of them is what its buckets are of.
INSTANCES = ("inst", "key", "world")
HELD = "instance_held"
#: Settings while any thread is in gathered(): joins on an instance and more take rows where they lie.
IN_PLACE = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
GATHERED: list[dict] = []


@contextmanager
def gathered(spark: SparkSession, buckets: int) -> Iterator[None]:
    """While it lasts, tables that stored() writes lie in buckets of their instances, so joins and groups by instance and more move no rows.

    It is for very many small instances, as a bucket holds its instances whole; threads of together() take part.
    """
    sc = spark.sparkContext
    outer = sc.getLocalProperty(BUCKETS)
    with LOCK:
        GATHERED.append({} if GATHERED else {key: spark.conf.get(key) for key in IN_PLACE})
        for key, value in IN_PLACE.items():
            spark.conf.set(key, value)
    sc.setLocalProperty(BUCKETS, str(buckets))
    try:
        yield
    finally:
        sc.setLocalProperty(BUCKETS, outer)
        with LOCK:
            if len(GATHERED) == 1:
                for key, value in GATHERED[0].items():
                    spark.conf.set(key, value)
            del GATHERED[-1]


def buckets_of(spark: SparkSession) -> int | None:
    """The number of buckets inside gathered()."""
    found = spark.sparkContext.getLocalProperty(BUCKETS)
    return int(found) if found else None


def in_place(df: DataFrame, *columns: str) -> DataFrame:
    """df with the rows of equal columns, the first of which is an instance, in one task."""
    buckets = buckets_of(df.sparkSession)
    return df.repartition(buckets, columns[0]) if buckets else df.repartition(*columns)


#: Jobs that together() runs at once.
THREADS = 4


def together(spark: SparkSession, steps: dict[str, Callable[[], object]]) -> dict:
    """The results of steps that don't need each other, by name; their jobs share the cluster, so small ones don't wait in line."""
    with marked_broadcasts(spark), ThreadPoolExecutor(THREADS) as pool:
        begun = {name: pool.submit(inheritable_thread_target(spark)(step)) for name, step in steps.items()}
        return {name: future.result() for name, future in begun.items()}


def stored_all(tables: dict[str, DataFrame], label: str) -> dict[str, DataFrame]:
    """stored() of tables by name, together."""
    spark = next(iter(tables.values())).sparkSession
    return together(spark, {name: lambda name=name, t=t: stored(t, f"{label}-{name}") for name, t in tables.items()})


def stored_with(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, tuple]:
    """stored(), and aggregates of its rows from the same job: their count, then metrics."""
    seen = Observation()
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(f"m{i}") for i, m in enumerate(metrics)]), label)
    got = seen.get
    return out, (got["n"], *(got[f"m{i}"] for i in range(len(metrics))))


#: Of tables in buckets: ids of records are drawn at random, so only a codec that counts symbols makes them smaller.
CODEC = "zstd"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as a table and read back: cuts the lineage of loops and survives lost executors."""
    spark = df.sparkSession
    mark, buckets = uuid.uuid4().hex, buckets_of(spark)
    path = f"{shared_dir(spark)}/causeway-{label}-{mark}"
    column = next((c for c in INSTANCES if c in df.columns), None) if buckets else None
    if column is None:
        df.write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        name = f"causeway_{mark}"
        # The column has another name in the files: an alias is what unions know equal buckets by.
        in_place(df, column).withColumnRenamed(column, HELD).write.bucketBy(buckets, HELD).option("compression", CODEC).option("path", path).format("parquet").saveAsTable(name)
        out = spark.table(name).withColumnRenamed(HELD, column)
        spark.sql(f"DROP TABLE {name}")  # of the catalog alone: its files lie at path, and out knows them
    out.stored_at = path
    return out


def stored(df: DataFrame, label: str) -> DataFrame:
    """written(), with joins as in marked_broadcasts()."""
    with marked_broadcasts(df.sparkSession):
        return written(df, label)


def discard(*tables: DataFrame | None) -> None:
    """Deletes the files of tables made by stored() that no later result reads, such as a loop's last but one."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
