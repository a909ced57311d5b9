"""Byte-level BPE encoding and decoding by a depth-first walk over the trie of distinct words.

The BPE encoding of a prefix is the encoding of a shorter prefix and one last token. So one token a trie node,
its *last token*, states the encoding of every prefix: a token that is a suffix of the node's path is the last
one if it stays apart from the last token of the node where it begins. Sorted words with the lengths of their
common prefixes are that trie in depth-first order; a prefix that many words share is worked out once.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.common import bound_batches, small_batches

#: Fixed value: the pattern by which byte-level BPE splits a text before the merges.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Distinct words kept with their ids in a Python worker; beyond it, the cache starts anew.
CACHED_WORDS = 200_000
#: Answers about pairs of tokens, and tokens that end a text, kept in a worker.
ANSWERS = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and the questions asked of them while prefixes grow."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        ids = spec["model"]["vocab"]
        self.text = {i: bytes(letters[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts: dict[int, tuple[int, int]] = {}
        self.age = dict.fromkeys(self.text, 0)  # 0: a single byte, else 1 + the number of its merge
        self.made: dict[tuple[int, int], int] = {}  # the age at which a pair becomes one token
        for k, merge in enumerate(spec["model"]["merges"], 1):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (ids[a], ids[b]), ids[a + b]
            self.made.setdefault(pair, k)
            if whole not in self.parts:
                self.parts[whole], self.age[whole] = pair, k
        self.by_bytes = {b: i for i, b in self.text.items() if i in self.parts or len(b) == 1}
        self.prefixes = {b[:k] for b in self.by_bytes for k in range(1, len(b) + 1)}
        self._apart: dict[tuple[int, int], bool] = {}
        self.steps: dict[tuple[bytes, int], tuple[bytes, list[tuple[int, int]]]] = {}
        self._suffixes: dict[bytes, list[tuple[int, int]]] = {}
        self._own: dict[int, bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether two tokens side by side stay two: going back in time, no merge ever joins what meets at their border."""
        known = self._apart.get((left, right))
        if known is not None:
            return known
        key, until, age = (left, right), len(self.age) + 1, self.age
        while True:
            if self.made.get((left, right), until) < until:
                answer = False
                break
            if age[left] > age[right]:
                until, left = age[left], self.parts[left][1]
            elif age[right]:  # of equal merges the left one comes first
                until, right = age[right] + 1, self.parts[right][0]
            else:
                answer = True
                break
        if len(self._apart) > ANSWERS:
            self._apart.clear()
        self._apart[key] = answer
        return answer

    def reachable(self, token: int) -> bool:
        """Whether the bytes of a token, alone, become that token; others appear in no encoding."""
        if token not in self._own:
            parts = self.parts.get(token)
            self._own[token] = parts is None or (self.reachable(parts[0]) and self.reachable(parts[1]) and self._joins(token))
        return self._own[token]

    def _joins(self, token: int) -> bool:
        left, right = self.parts[token]
        age, until = self.age, self.age[token]
        while True:  # as in apart(), but the merge itself is allowed to happen
            if age[left] > age[right]:
                until, left = age[left], self.parts[left][1]
            elif age[right]:
                until, right = age[right] + 1, self.parts[right][0]
            else:
                return True
            if self.made.get((left, right), until) < until:
                return False

    def ends(self, tail: bytes) -> list[tuple[int, int]]:
        """(length, token) of the tokens that tail ends with, longest first."""
        found = self._suffixes.get(tail)
        if found is None:
            if len(self._suffixes) > ANSWERS:
                self._suffixes.clear()
            found = [(len(tail) - k, t) for k in range(len(tail)) if (t := self.by_bytes.get(tail[k:])) is not None and self.reachable(t)]
            self._suffixes[tail] = found
        return found

    def step(self, asked: tuple[bytes, int]) -> tuple[bytes, list[tuple[int, int]]]:
        """(the longest beginning of a token that ends at the next byte, ends() of it) from (that before the byte, the byte)."""
        before, byte = asked
        tail = before + bytes((byte,))
        while tail and tail not in self.prefixes:
            tail = tail[1:]
        if len(self.steps) > ANSWERS:
            self.steps.clear()
        found = self.steps[asked] = tail, self.ends(tail)
        return found


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(vocab: Vocabulary, words: Iterable[bytes]) -> dict[bytes, list[int]]:
    """The ids of each distinct word; every edge of their trie is walked once."""
    out: dict[bytes, list[int]] = {}
    steps, known, apart, step = vocab.steps, vocab._apart, vocab.apart, vocab.step
    last, size, tail, before = [-1], [0], [b""], b""  # by depth: last token, its length, longest beginning of a token that ends here
    for word in sorted(set(words)):
        depth, most = 0, min(len(before), len(word))
        while depth < most and before[depth] == word[depth]:
            depth += 1
        del last[depth + 1 :], size[depth + 1 :], tail[depth + 1 :]
        at = tail[-1]
        for d in range(depth + 1, len(word) + 1):
            asked = at, word[d - 1]
            found = steps.get(asked)
            at, ends = found if found is not None else step(asked)
            for n, token in ends:
                if n == d:
                    break
                pair = last[d - n], token
                stays = known.get(pair)
                if apart(*pair) if stays is None else stays:
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            size.append(n)
            tail.append(at)
        ids, d = [], len(word)
        while d:
            ids.append(last[d])
            d -= size[d]
        ids.reverse()
        out[word], before = ids, word
    return out


class Encoder:
    """Whole texts to ids and back. Strings of special tokens inside a text become their ids, as in the library."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.find = regex.compile(WORDS).findall
        self.special = self.vocab.special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, bytes] = {}
        table = self.vocab.text | {i: s.encode() for s, i in self.special.items()}
        self.table = [table.get(i, b"") for i in range(max(table) + 1)]

    def words(self, text: str) -> list[str]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.find(text)
        out: list[str] = []
        for k, piece in enumerate(self.cut.split(text)):
            if k % 2:
                out.append("\0special:" + piece)
            else:
                out += self.find(piece)
        return out

    def learn(self, words: set[str]) -> None:
        cache = self.cache
        new = {w: w.encode() for w in words if w not in cache}
        if len(cache) + len(new) > CACHED_WORDS and cache:
            cache.clear()
            new = {w: w.encode() for w in words}
        marks = {w for w in new if w.startswith("\0special:")} if self.special else set()
        for w in marks:
            cache[w] = np.array([self.special[w[9:]]] if w[9:] in self.special else [], "<i4").tobytes()
            del new[w]
        known = encode_words(self.vocab, new.values())
        ids = [known[b] for b in new.values()]
        flat, at = np.fromiter(chain.from_iterable(ids), "<i4").tobytes(), 0
        for w, own in zip(new, ids):
            end = at + 4 * len(own)
            cache[w], at = flat[at:end], end

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [self.words(t) if t else [] for t in texts]
        distinct: set[str] = set()
        for words in split:
            distinct.update(words)
        self.learn(distinct)
        get = self.cache.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), "<i4") for words in split]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def roundtrip(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, ids array<int> and decoded string for every row of docs.

    A null text counts as empty: no ids, an empty decoded text. Very long texts are encoded whole. Repeated rows are
    kept. Only the columns named are read, so others may have any name.
    """
    bound_batches(docs.sparkSession)
    picked = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [*picked.select(*keep).schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in small_batches(batches, "__text"):
            ids = enc.encode(batch.column("__text").to_pylist())
            offsets = np.zeros(len(ids) + 1, "i4")
            np.cumsum([len(x) for x in ids], out=offsets[1:])
            flat = np.concatenate([*ids, np.empty(0, "<i4")])
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists, pa.array([enc.decode(x) for x in ids], pa.string())], names=[*keep, "ids", "decoded"])

    return picked.mapInArrow(run, T.StructType(fields))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text, from what roundtrip() returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
