"""Token ids on disk: ids ranked by frequency, byte-aligned variable-length coding, control bytes kept apart.

A block holds whole documents: two bits an id in the control bytes tell how many bytes (1 to 4) its rank takes in the
data bytes, so that frequent ids take one. Blocks lie in the order of the documents in a Parquet container, which
gives atomic commits on any store; the rank table is a table beside it. Decoding is numpy table lookup: a control byte
gives four lengths, their running sum gives offsets, and shifted bytes give ranks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import bound_batches, materialise, shared_dir, small_batches

#: Ids a block aims at; a longer document makes a longer block.
BLOCK_IDS = 65_536
#: Distinct chunks kept with their ids in a Python worker; beyond it, the cache starts anew.
CACHED_CHUNKS = 2_000_000
#: New chunks that the library gets in one text.
JOINED = 100
#: The character between them.
MARK = "\x01"
#: Marks behind a word that are encoded apart from it, but for those that an added token holds. An apostrophe may begin a pre-token with letters.
MARKS = ".,;:!?%&*$#+=~^@`|\"()[]{}<>-_/\\"
#: Lengths of the four ranks that a control byte describes.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype("u1") + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of ranks below 2**32."""
    ranks = ranks.astype("<u4")
    size = 1 + (ranks > 0xFF).astype("u1") + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, "u1")
    codes[: len(ranks)] = size - 1
    control = codes[::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    used = np.arange(4) < size[:, None]
    return control.tobytes(), ranks.view("u1").reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    size = LENGTHS[np.frombuffer(control, "u1")].ravel()[:n].astype("i8")
    start = np.cumsum(size) - size
    padded = np.frombuffer(data + b"\0\0\0", "u1")
    out = padded[start].astype("<u4")
    for k in (1, 2, 3):
        at = np.flatnonzero(size > k)
        out[at] |= padded[start[at] + k].astype("<u4") << np.uint32(8 * k)
    return out


# Fixed value: the pre-token pattern of a vocabulary of words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def of_words(tokenizer: dict) -> bool:
    """Whether no pre-token of a tokenizer file crosses a blank or joins a letter or digit to a mark, and no id depends on what stands around a chunk.

    So it is for pre-tokens by WORDS with blanks removed, a normalizer that composes, lower-cases or makes blanks of white
    space alone, added tokens without blanks that take none beside them, and a model without dropout or unknown ids.
    """
    before, after = tokenizer.get("normalizer"), tokenizer.get("pre_tokenizer") or {}
    steps = before.get("normalizers", [before]) if before else []
    blank = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    plain = all(s.get("type") in ("NFC", "Lowercase") or s == blank for s in steps)
    cut = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    parts = after.get("pretokenizers", [])
    split = len(parts) == 2 and parts[0] == cut and parts[1].get("type") == "ByteLevel" and not parts[1].get("add_prefix_space") and parts[1].get("use_regex") is False
    added = all(not any(c.isspace() for c in t["content"]) and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized")) for t in tokenizer.get("added_tokens", []))
    model = tokenizer.get("model", {})
    return plain and split and added and model.get("type", "BPE") == "BPE" and not (model.get("dropout") or model.get("unk_token") or model.get("byte_fallback"))


class LibraryEncoder:
    """Ids by the tokenizers library. Vocabularies of words, as of_words() has them, are encoded chunk by chunk, others by whole texts.

    Blank-separated chunks of the former encode alone and are cached, and so are a word and the marks behind it. New chunks go to the
    library in one text, MARK between them: its id, which no other character gives, tells where a chunk's ids end.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            declared = json.load(file)
        self.by_chunks = of_words(declared)
        held = {c for t in declared.get("added_tokens", []) for c in t["content"]}
        self.marks = "".join(c for c in MARKS if c not in held)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.cache: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def learn(self, chunks: list[str]) -> None:
        """Puts the ids of chunks into the cache; those that hold MARK, and all where it gives other than one id, go alone."""
        for i in range(0, len(chunks), JOINED):
            part = chunks[i : i + JOINED]
            joined = f" {MARK} ".join(part)
            if len(self.mark) == 1 and joined.count(MARK) == len(part) - 1:
                ids = self.ids(joined)
                ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
                if len(ends) == len(part):
                    raw, at = ids.tobytes(), 0
                    for c, end in zip(part, (4 * ends).tolist()):
                        self.cache[c] = raw[at:end]
                        at = end + 4
                    continue
            for c in part:
                self.cache[c] = self.ids(c).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if not self.by_chunks:
            return [self.ids(t or "").tobytes() for t in texts]
        # Only these blanks cut; all others the library treats itself.
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if t else [] for t in texts]
        distinct: set[str] = set().union(*split)
        new = distinct.difference(self.cache)
        if len(self.cache) + len(new) > CACHED_CHUNKS:
            self.cache.clear()
            new = distinct
        cut, needed = {}, set()
        for c in new:
            word = c.rstrip(self.marks)
            # Lower-casing may end in an accent, which joins marks; beyond Latin letters the library may class characters otherwise.
            if word and word != c and word[-1] < "\u0250" and word[-1].lower().isalnum():
                cut[c] = (word, c[len(word) :])
                needed.update(cut[c])
            else:
                needed.add(c)
        self.learn([c for c in needed if c not in self.cache])
        get = self.cache.__getitem__
        for c, (word, marks) in cut.items():
            self.cache[c] = get(word) + get(marks)
        return [b"".join(map(get, chunks)) for chunks in split]


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return LibraryEncoder(path)


def binaries(size: np.ndarray, data: bytes | np.ndarray) -> pa.Array:
    """Binary values of these sizes that lie one behind the other in data."""
    if memoryview(data).nbytes >= 1 << 31:
        raise ValueError("a batch's ids take 2 GB or more")
    ends = np.zeros(len(size) + 1, "<i4")
    np.cumsum(size, out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def tokenised(docs: DataFrame, path: str, end_id: int, text: str = "text") -> DataFrame:
    """doc_id, n, width, data: every text's ids and end_id before ranks are known, each in width bytes (2 where they fit, else 4).

    A null text counts as empty and has end_id alone. Texts are encoded whole; repeated rows are kept.
    """
    bound_batches(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("__text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        for batch in small_batches(batches, "__text"):
            found = encoder.encode(batch.column("__text").to_pylist())
            n = np.array([len(x) // 4 + 1 for x in found], "i8")
            ids = np.frombuffer(b"".join(x + end for x in found), "<u4")
            width = 2 if ids.max(initial=0) < 1 << 16 else 4
            data = binaries(n * width, ids.astype(f"<u{width}"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(np.full(len(n), width, "i4")), data], names=["doc_id", "n", "width", "data"])

    return picked.mapInArrow(run, "doc_id long, n long, width int, data binary")


def widened(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The ids of each row of a batch of tokenised()."""
    return [np.frombuffer(data, f"<u{width}") for width, data in zip(batch.column("width").to_pylist(), batch.column("data").to_pylist())]


def frequencies(tokens: DataFrame) -> DataFrame:
    """id, count over all documents; a row per id and task is shuffled at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, "i8")
        for batch in batches:
            rows = widened(batch)
            for width in (2, 4):
                same = [x for x in rows if x.itemsize == width]
                if same:
                    found = np.bincount(np.concatenate(same), minlength=len(total))
                    found[: len(total)] += total
                    total = found
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i8")), pa.array(total[at].astype("i8"))], names=["id", "count"])

    return tokens.select("width", "data").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def write_ids(docs: DataFrame, path: str, end_id: int, text: str = "text", to: str | None = None) -> str:
    """Writes the ids of all documents in ascending doc_id order (null first, rows of one id by length and hash); returns the folder.

    blocks: part, seq, start (ids before it in its part), doc_ids, lengths, control, data. ranks: id, rank.
    The rank table has a row per id of the vocabulary at most; that bounds what the driver holds. An empty table gives
    files without rows.
    """
    spark = docs.sparkSession
    to = to or f"{shared_dir(spark)}/causeway-ids-{uuid.uuid4().hex}"
    tokens = materialise(tokenised(docs, path, end_id, text), "tokens")
    counted = sorted(frequencies(tokens).collect(), key=lambda r: (-r["count"], r["id"]))
    ranked = pd.DataFrame({"id": np.array([r["id"] for r in counted], "i8"), "rank": np.arange(len(counted), dtype="i8")})
    spark.createDataFrame(ranked, "id long, rank long").coalesce(1).write.parquet(f"{to}/ranks")
    rank = np.zeros(int(ranked["id"].max()) + 1 if len(ranked) else 1, "u4")
    rank[ranked["id"]] = ranked["rank"]
    schema = "part int, seq int, start long, n_ids long, doc_ids binary, lengths binary, control binary, data binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, start, held = TaskContext.get().partitionId(), 0, 0, []

        def block() -> pa.RecordBatch:
            nonlocal seq, start, held
            ids = np.concatenate([x for _, x in held])
            control, data = pack(rank[ids])
            known = np.array([d is not None for d, _ in held])
            row = [part, seq, start, len(ids), np.array([d or 0 for d, _ in held], "<i8").tobytes() + known.tobytes(), np.array([len(x) for _, x in held], "<i8").tobytes(), control, data]
            seq, start, held = seq + 1, start + len(ids), []
            return pa.RecordBatch.from_pylist([dict(zip(names, row))], schema=arrow)

        arrow = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), *((c, pa.binary()) for c in names[4:])])
        waiting = 0
        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), widened(batch)):
                held.append((doc, ids))
                waiting += len(ids)
                if waiting >= BLOCK_IDS:
                    yield block()
                    waiting = 0
        if held:
            yield block()

    order = ["doc_id", "n", F.xxhash64("data")]  # rows that share an id, or have none, may lie in several ranges
    ordered = tokens.repartitionByRange(*order).sortWithinPartitions(*order, "data")
    ordered.mapInArrow(run, schema).write.option("parquet.block.size", 16 << 20).parquet(f"{to}/blocks")
    return to


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids binary (uint32, little-endian) from files of write_ids()."""
    bound_batches(spark)
    blocks = spark.read.parquet(f"{folder}/blocks")
    # A row per file part and per id of the vocabulary; neither grows with the number of documents.
    parts = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before = dict(zip((p for p, _ in parts), np.cumsum([0, *(n for _, n in parts)]).tolist()))
    ranks = spark.read.parquet(f"{folder}/ranks").collect()
    table = np.zeros(len(ranks) + 1, "<u4")
    for r in ranks:
        table[r["rank"]] = r["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, start, n, docs, lengths, control, data = (batch.column(c)[row].as_py() for c in ("part", "start", "n_ids", "doc_ids", "lengths", "control", "data"))
                ids = table[unpack(control, data, n)]
                size = np.frombuffer(lengths, "<i8")
                ends = np.cumsum(size)
                known = np.frombuffer(docs, "?", offset=8 * len(size))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(docs, "<i8", len(size)), mask=~known), pa.array(before[part] + start + ends - size), pa.array(size), binaries(4 * size, ids)],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
