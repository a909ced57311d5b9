"""Toxicity scores from a bag of subwords: averaged embeddings into a linear softmax, trained jointly in numpy.

A word is the mean of vectors of itself and of its character n-grams, so a misspelling that was never seen shares most
of its vector with the word it comes from. A window of WINDOW neighbouring words, of which one begins at every word, is the
mean of its words; a linear softmax scores windows. A document's logit is the mean of its windows' logits, weighted by
their own softmax: the weights sum to 1, so neither a text's length nor where a word stands changes it, and a few words
weigh the same in a long text. Gradients run through windows and words to the n-gram vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import bound_batches, small_batches

BUCKETS, DIMENSIONS, NGRAMS, WINDOW = 1 << 17, 8, (3, 4, 5), 2  # n-gram vectors and their length, n, words of a window
#: Scores from which a document counts as toxic.
THRESHOLD = 0.7
#: Words kept with their scores in a Python worker; beyond it, the cache starts anew.
CACHED_WORDS = 200_000
EDGES = ".,;:!?#%&*$|\"'()[]{}<>-_/\\"


def word_of(token: str) -> str:
    return token.strip(EDGES).lower() or token


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, number of the word) of every n-gram of '<word>' and every whole word, sorted by word."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    size = np.fromiter(map(len, marked), "i8", len(marked))
    owner = np.repeat(np.arange(len(words)), size)
    ids, owners = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), "u8", len(words)) % BUCKETS], [np.arange(len(words))]
    for n in NGRAMS:
        if len(codes) < n:
            continue
        rolled = np.full(len(codes) - n + 1, n, "u8")
        for k in range(n):
            rolled = (rolled * np.uint64(0x9E3779B97F4A7C15)) ^ codes[k : len(codes) - n + 1 + k]
        rolled *= np.uint64(0xC2B2AE3D27D4EB4F)
        whole = np.flatnonzero(owner[: len(rolled)] == owner[n - 1 :])
        ids.append((rolled[whole] >> np.uint64(33)) % np.uint64(BUCKETS))
        owners.append(owner[whole])
    flat, who = np.concatenate(ids).astype("i4"), np.concatenate(owners)
    order = np.argsort(who, kind="stable")
    return flat[order], who[order]


def gram_lists(words: list[str], step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one word after the other, and where each word begins; made in parts to keep memory low."""
    flat, sizes = [np.zeros(0, "i4")], [np.zeros(0, "i8")]
    for at in range(0, len(words), step):
        part = words[at : at + step]
        ids, who = features(part)
        flat.append(ids)
        sizes.append(np.bincount(who, minlength=len(part)))
    return np.concatenate(flat), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


@dataclass
class Model:
    """vectors: BUCKETS x DIMENSIONS; weights: DIMENSIONS x 2; bias: 2; words of a window."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    width: int = WINDOW

    def table(self) -> tuple[np.ndarray, float]:
        """The logit of each bucket (label 1 against 0) and of nothing: averages are linear, so logits can be averaged instead."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype("f8"), float(self.bias[1] - self.bias[0])


def pooled(z: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mean of the logits of each run, weighted by their softmax; the weights)."""
    size = np.diff(np.append(starts, len(z)))
    e = np.exp(z - np.repeat(np.maximum.reduceat(z, starts), size))
    weight = e / np.repeat(np.add.reduceat(e, starts), size)
    return np.add.reduceat(weight * z, starts), weight


def windows(sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end) of every window of texts of so many words one after the other, and where each text's windows begin.

    A text of fewer words is one window, also one without words.
    """
    count = np.maximum(1, sizes - width + 1)
    starts = np.cumsum(count) - count
    offset = np.cumsum(sizes) - sizes
    first = np.repeat(offset - starts, count) + np.arange(count.sum())
    return first, first + np.repeat(np.minimum(sizes, width), count), starts


class Batch:
    """Words of some documents (numbers of words in sequence) with the n-grams behind them."""

    def __init__(self, docs: list[np.ndarray], flat: np.ndarray, first: np.ndarray, width: int):
        self.words, self.local = np.unique(np.concatenate(docs), return_inverse=True)
        self.size = first[self.words + 1] - first[self.words]
        self.starts = np.cumsum(self.size) - self.size
        self.grams = flat[np.repeat(first[self.words] - self.starts, self.size) + np.arange(self.size.sum())]
        self.begin, self.end, self.of = windows(np.array([len(d) for d in docs]), width)
        self.room = np.maximum(self.end - self.begin, 1)

    def forward(self, model: Model) -> np.ndarray:
        """Logits of the documents; keeps the windows' means, logits and weights."""
        if len(self.words):
            vectors = np.add.reduceat(model.vectors[self.grams], self.starts, axis=0).astype("f8") / self.size[:, None]
        else:
            vectors = np.zeros((0, model.vectors.shape[1]))
        sums = np.concatenate([np.zeros((1, vectors.shape[1])), np.cumsum(vectors[self.local], axis=0)])
        self.mean = (sums[self.end] - sums[self.begin]) / self.room[:, None]
        self.z = self.mean @ (model.weights[:, 1] - model.weights[:, 0]) + float(model.bias[1] - model.bias[0])
        self.logit, self.weight = pooled(self.z, self.of)
        return self.logit

    def backward(self, model: Model, wrong: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of a loss with the derivative wrong by the logits: (weights, bias, buckets hit, their vectors)."""
        count = np.diff(np.append(self.of, len(self.z)))
        dz = np.repeat(wrong, count) * self.weight * (1 + self.z - np.repeat(self.logit, count))
        by_weight = self.mean.T @ dz
        size = len(self.local) + 1
        edges = np.bincount(self.begin, dz / self.room, size) - np.bincount(self.end, dz / self.room, size)
        to_word = np.bincount(self.local, np.cumsum(edges)[:-1], len(self.words)) / np.maximum(self.size, 1)
        pull = np.bincount(self.grams, np.repeat(to_word, self.size), len(model.vectors))
        hit = np.flatnonzero(pull)
        return np.stack([-by_weight, by_weight], axis=1), np.array([-dz.sum(), dz.sum()]), hit, pull[hit, None] * (model.weights[:, 1] - model.weights[:, 0])


def train(texts: list[str], labels: list[int], epochs: int = 5, steps: int = 240, batch: int = 64, rate: float = 0.3, seed: int = 7, width: int = WINDOW) -> Model:
    """Fits all parts of the model together by AdaGrad; both labels weigh the same in the loss.

    There are `epochs` passes over the rows, or as many as `steps` batches take where rows are few.
    """
    rng = np.random.default_rng(seed)
    model = Model(rng.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS)).astype("f4"), rng.normal(0, 0.5, (DIMENSIONS, 2)).astype("f4"), np.zeros(2, "f4"), width)
    number: dict[str, int] = {}
    known: dict[str, int] = {}
    for t in texts:
        for w in t.split():
            if w not in known:
                known[w] = number.setdefault(word_of(w), len(number))
    docs = [np.array([known[w] for w in t.split()], "i4") for t in texts]
    y = np.array(labels)
    if not len(y) or y.min() == y.max():
        return model
    flat, first = gram_lists(list(number))
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    past_v, past_w, past_b = np.full(model.vectors.shape, 1e-5, "f4"), np.full(model.weights.shape, 1e-3, "f4"), np.full(2, 1e-3, "f4")
    for _ in range(max(epochs, -(-steps * batch // len(docs)))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            part = Batch([docs[i] for i in picked], flat, first, width)
            logit = part.forward(model)
            wrong = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[picked]) * weight[picked] / len(picked)
            by_weights, by_bias, hit, by_vectors = (g.astype("f4") if g.dtype.kind == "f" else g for g in part.backward(model, wrong))
            past_v[hit] += by_vectors**2
            model.vectors[hit] -= rate * by_vectors / np.sqrt(past_v[hit])
            for grad, past, value in ((by_weights, past_w, model.weights), (by_bias, past_b, model.bias)):
                past += grad**2
                value -= rate * grad / np.sqrt(past)
    return model


class Scorer:
    def __init__(self, table: np.ndarray, bias: float, width: int):
        self.table, self.bias, self.width = table, bias, width
        self.cache: dict[str, float] = {}

    def learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.cache]
        if len(self.cache) + len(new) > CACHED_WORDS:
            self.cache.clear()
            new = list(tokens)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            flat, who = features([word_of(t) for t in part])
            total, count = np.bincount(who, self.table[flat], len(part)), np.bincount(who, minlength=len(part))
            self.cache.update(zip(part, (total / count).tolist()))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        split = [t.split() if t else [] for t in texts]
        if not split:
            return np.zeros(0)
        distinct: set[str] = set()
        for words in split:
            distinct.update(words)
        self.learn(distinct)
        get = self.cache.__getitem__
        sizes = np.array([len(words) for words in split])
        sums = np.concatenate([[0.0], np.cumsum(np.fromiter((get(w) for words in split for w in words), "f8", sizes.sum()))])
        begin, end, of = windows(sizes, self.width)
        z = (sums[end] - sums[begin]) / np.maximum(end - begin, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(pooled(z, of)[0], -50, 50)))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", most: int = 2500, most_chars: int = 16_000_000) -> Model:
    """Fits a model on labelled rows that aren't held out.

    At most `most` rows of each label, in the order of a hash of doc_id, and most_chars characters in all, so the task that
    fits holds a bounded sample, and the driver none of it; texts in it are whole. Null labels, texts or ids are left out.
    Repeated rows of an id count as one: of its labels the largest, of its texts the smallest. Without both labels the model
    stays untrained.
    """
    bound_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("__y")).where(F.col("__y").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("__y").alias("__y"))
    parts = []
    for y in (0, 1):
        picked = known.where(F.col("__y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        parts.append(picked)
    sample = docs.select("doc_id", F.col(text).cast("string").alias("__text")).where(F.col("__text").isNotNull()).join(F.broadcast(parts[0].union(parts[1])), "doc_id")  # 2 * most rows
    sample = sample.groupBy("doc_id", "__y").agg(F.min("__text").alias("__text"))
    sized = sample.withColumn("__room", F.length("__text"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = sized.orderBy(*order).limit(2 * most).coalesce(1).sortWithinPartitions(*order).select("__y", "__room", "__text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, left = [], [], most_chars
        for batch in small_batches(batches, "__text"):
            for y, room, text in zip(*(batch.column(c).to_pylist() for c in ("__y", "__room", "__text"))):
                if room <= left:
                    texts.append(text)
                    marks.append(y)
                    left -= room
        model = train(texts, marks)
        yield pa.RecordBatch.from_pydict({c: [x.tobytes()] for c, x in (("vectors", model.vectors), ("weights", model.weights), ("bias", model.bias))})

    found = chosen.mapInArrow(run, "vectors binary, weights binary, bias binary").collect()  # one row of fixed size
    if not found:
        return train([], [])
    of = lambda c: np.frombuffer(bytes(found[0][c]), "f4").copy()
    return Model(of("vectors").reshape(BUCKETS, DIMENSIONS), of("weights").reshape(DIMENSIONS, 2), of("bias"))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep and score (0 to 1), a row for every row of docs.

    Null and empty texts get the score of an empty bag. Texts are scored whole, however long; repeated rows are kept.
    Only the named columns are read, so others may have any name.
    """
    bound_batches(docs.sparkSession)
    (table, bias), width = model.table(), model.width  # of fixed size
    picked = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [*picked.select(*keep).schema.fields, T.StructField("score", T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(table, bias, width)
        for batch in small_batches(batches, "__text", 500_000):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scorer.scores(batch.column("__text").to_pylist()), pa.float64())], names=[*keep, "score"])

    return picked.mapInArrow(run, T.StructType(fields))
