"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, sources are mixed, texts become ids.

Stages read the columns of documents alone; others, whatever their names, are dropped. Null, empty and very long texts,
rows without id or source, repeated rows and empty tables pass through every stage as its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import bpe, minhash, mixing, toxicity
from causeway.llm.common import materialise
from causeway.llm.queries import BYTE_BPE, table, tokenizer

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold, by a model fitted on the labels of this stage's input.

    Null and empty texts get the score of an empty bag. Every row is judged by its own whole text, so repeated rows stay or
    go together. Where labels lack one of both values, or there are no rows, the model is untrained and scores everything
    near one half: nothing goes.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group on five-word shingles with a similarity of 0.8 or more.

    Rows without id and texts without words, null and empty ones among them, stay. Repeated rows of an id that is kept stay
    all; those of one that isn't go all.
    """
    found = minhash.near_duplicates(docs, width=5, percent=80)
    gone = materialise(found.where("doc_id IS NOT NULL AND NOT kept").select("doc_id").distinct(), "gone")
    small = gone.count() <= minhash.BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; one that the cut goes through is taken once more if half of it fits.

    Null is a source of its own. Texts without words have no size and aren't taken. Rows that repeat an id share its place in
    the order.
    """
    return mixing.draw(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row with digests of ids and of the text decoded from them; a null or empty text has none."""
    encoded = bpe.roundtrip(docs, tokenizer(BYTE_BPE), keep=("doc_id", "source"))
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encoded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "ids")


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_copies), ("source_mixing", mix_sources), ("bpe_encoding", encode)]

#: The stages' learnt scores, minima and ids can't be expressed in SQL; tests/llm/test_pipeline.py holds run() and each stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents; each one's rows are a table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
