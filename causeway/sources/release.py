"""Releases of models as text files in shards, and manifests of what files hold: digests, sizes, signs of people or machines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a released file must not hold: home folders of two kinds of systems, mail addresses.
IDENTIFYING = (r"/(?:Users|home)/", r"[A-Za-z]:\\Users\\", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
#: Models of a shard, which is a file.
SHARD_MODELS = 50


def lines_of(equations: DataFrame) -> DataFrame:
    """shard, seed, family, n, k, line of equations (family, n, seed, k, output, code, args): 'output = code(args)'; a shard holds SHARD_MODELS seeds in a row."""
    call = F.concat("output", F.lit(" = "), "code", F.lit("("), F.array_join("args", ", "), F.lit(")"))
    line = F.concat_ws(" ", "family", F.concat(F.lit("n"), "n"), F.concat(F.lit("seed"), "seed"), call)
    return equations.select(F.floor(F.col("seed") / SHARD_MODELS).cast("long").alias("shard"), "seed", "family", "n", "k", line.alias("line"))


def write_shards(lines: DataFrame, folder: str) -> None:
    """Each shard of lines as one text file, in the order of seed, family, n and k; shards that lines lack stay as they are.

    A shard's lines are at most SHARD_MODELS models', so a file never grows with the table.
    """
    order = ("shard", "seed", "family", "n", "k")
    rows = lines.repartition("shard").sortWithinPartitions(*order).select("shard", "line")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").text(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """shard, line of a release; a condition on shard reads the shards it names alone."""
    return spark.read.schema("line string, shard long").text(folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """shard, bytes, sha256, identifying of each file under folder: its digest, and whether its text matches IDENTIFYING, in any case of letters."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    found = F.col("content").cast("string").rlike("(?i)" + "|".join(IDENTIFYING))
    return files.select(F.col("shard").cast("long").alias("shard"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), found.alias("identifying"))
