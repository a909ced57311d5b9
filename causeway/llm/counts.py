"""Token counts from two compiled finite-state machines; no ids are made.

1. A splitter finds where pre-tokens begin. It is a transducer of eight states over classes of characters. A batch of
   texts is cut into chunks of equal length; every chunk's *state map* (from each state to the state after it) is
   computed in step for all chunks, the maps are composed by a parallel prefix scan, and each chunk is then replayed
   from the state that the scan gives it.
2. A counter reads the bytes of a pre-token. Its states are what later bytes can depend on: the longest beginning of a
   token that ends here, and the last tokens and relative counts at the borders inside it. Every transition carries the
   change of the number of tokens. States are compiled when first reached and shared by all words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.llm.bpe import Vocabulary, vocabulary
from causeway.llm.common import bound_batches, small_batches

# Classes of characters. APOS2 and APOS3 are apostrophes that could begin a contraction of 2 or 3 characters.
SPACE, WHITE, LETTER, NUMBER, OTHER, APOS2, APOS3, END = range(8)
# States: what came before. FRESH: a pre-token has ended; SKIP1, SKIP2: so many characters of a contraction are left.
FRESH, AFTER_LETTER, AFTER_NUMBER, AFTER_OTHER, AFTER_SPACE, AFTER_WHITE, SKIP1, SKIP2 = range(8)
# Whether a pre-token begins at a character: never, always, or only if no white space (or end) follows.
NO, YES, IF_LAST = range(3)
#: Characters a chunk of the splitter.
CHUNK = 256
#: Words kept with their counts in a Python worker; beyond it, the cache starts anew.
CACHED_WORDS = 1_000_000
#: Compiled states of the counter in a Python worker; beyond it, compilation starts anew.
COMPILED_STATES = 200_000


def _compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """(next state, beginning) by state * 8 + class."""
    step, begins = np.zeros((8, 8), "u1"), np.zeros((8, 8), "u1")
    after = {SPACE: AFTER_SPACE, WHITE: AFTER_WHITE, LETTER: AFTER_LETTER, NUMBER: AFTER_NUMBER, OTHER: AFTER_OTHER, APOS2: AFTER_OTHER, APOS3: AFTER_OTHER, END: FRESH}
    same = {LETTER: AFTER_LETTER, NUMBER: AFTER_NUMBER, OTHER: AFTER_OTHER, APOS2: AFTER_OTHER, APOS3: AFTER_OTHER}
    for state in range(8):
        for kind in range(8):
            if kind == END:
                step[state, kind], begins[state, kind] = FRESH, NO
            elif state in (SKIP1, SKIP2):
                step[state, kind], begins[state, kind] = FRESH if state == SKIP1 else SKIP1, NO
            elif kind in (SPACE, WHITE):
                step[state, kind] = after[kind]
                begins[state, kind] = IF_LAST if state in (AFTER_SPACE, AFTER_WHITE) else YES
            else:
                joined = state == AFTER_SPACE or same[kind] == state
                begins[state, kind] = NO if joined else YES
                contraction = kind in (APOS2, APOS3) and not joined
                step[state, kind] = (SKIP1 if kind == APOS2 else SKIP2) if contraction else after[kind]
    return step.ravel(), begins.ravel()


STEP, BEGINS = _compile_splitter()


@lru_cache(maxsize=1)
def character_classes() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, "u1")
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            kinds[c] = LETTER if kind == "L" else NUMBER
        elif kind == "Z":
            kinds[c] = WHITE
    kinds[9:14] = kinds[0x85] = WHITE
    kinds[32] = SPACE
    return kinds


def compose(maps: np.ndarray) -> np.ndarray:
    """The state in which each chunk begins, from FRESH on: parallel prefix scan over the chunks' state maps."""
    scan, width = maps.copy(), 1
    while width < len(scan):  # scan[i] becomes the map of the chunks i - 2 * width + 1 .. i
        scan[width:] = np.take_along_axis(scan[width:], scan[:-width], axis=1)
        width *= 2
    return np.concatenate([[FRESH], scan[:-1, FRESH]]).astype("u1")


def beginnings(classes: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, given the classes of a run of texts that are each followed by END."""
    n = len(classes)
    lanes = np.full(-(-n // CHUNK) * CHUNK, END, "u1")
    lanes[:n] = classes
    lanes = np.ascontiguousarray(lanes.reshape(-1, CHUNK).T)  # by position in the chunk, then chunk
    maps = np.tile(np.arange(8, dtype="u1"), (lanes.shape[1], 1))
    for row in lanes:
        maps = STEP[(maps << 3) | row[:, None]]
    state, flags = compose(maps), np.empty_like(lanes)
    for k, row in enumerate(lanes):
        at = (state << 3) | row
        flags[k], state = BEGINS[at], STEP[at]
    flags = flags.T.ravel()[:n]
    solid = np.concatenate([(classes[1:] != SPACE) & (classes[1:] != WHITE) & (classes[1:] != END), [False]])
    return np.flatnonzero((flags == YES) | (flags == IF_LAST) & solid)


def classify(text: str) -> np.ndarray:
    """Classes of the characters of text; apostrophes look up to two characters ahead."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    classes = character_classes()[codes]
    at = np.flatnonzero(codes == 39)
    if len(at):
        ahead = np.concatenate([codes, [0, 0]])
        one, two = ahead[at + 1], ahead[at + 2]
        classes[at[np.isin(one, [ord(c) for c in "stmd"])]] = APOS2
        is_three = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        classes[at[is_three]] = APOS3
    return classes


class Counter:
    """The transducer from bytes to changes of the token count, compiled on demand."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.reset()

    def reset(self) -> None:
        # A state: (tail, borders); borders has last token * 1024 + 512 + count relative to now, for each position from
        # tail's start to now; a word's start has token -1. Relative counts are less than a token's length.
        self.states: list[tuple[bytes, tuple[int, ...]]] = [(b"", (-512,))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        tail, borders = self.states[state]
        longer = tail + bytes([byte])
        p = len(longer)
        while longer[-p:] not in self.vocab.prefixes:
            p -= 1
        for n, token in self.vocab.ends(longer[-p:]):
            last, count = divmod(borders[len(longer) - n], 1024)
            if last < 0 or self.vocab.apart(last, token):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        change = count - 511
        kept = (*borders, token * 1024 + 512 + change)[-p - 1 :]
        key = (longer[-p:], tuple(x - change for x in kept))
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = (found, change)
        return move

    def count(self, word: bytes) -> int:
        if len(self.states) > COMPILED_STATES:
            self.reset()
        state = total = 0
        known = self.moves.get
        for byte in word:
            state, change = known(state << 8 | byte) or self.compile(state, byte)
            total += change
        return total


class TokenCounter:
    """Counts for batches of whole texts."""

    def __init__(self, path: str):
        self.counter = Counter(vocabulary(path))
        self.special = sorted(self.counter.vocab.special, key=len, reverse=True)
        self.cache: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The parts between strings of special tokens, and how many of those there are: one token each."""
        parts, marks = [text], 0
        for s in self.special:
            if s in text:
                split = [p.split(s) for p in parts]
                marks += sum(len(p) - 1 for p in split)
                parts = [x for p in split for x in p]
        return parts, marks

    def counts(self, texts: list[str | None]) -> np.ndarray:
        total, owner, parts = np.zeros(len(texts), "i8"), [], []
        for i, text in enumerate(texts):
            if text:
                found, total[i] = self.pieces(text)
                parts += found
                owner += [i] * len(found)
        if not parts:
            return total
        joined = "\0".join(parts) + "\0"
        classes = classify(joined)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        classes[ends] = END
        at = beginnings(classes)
        which = np.searchsorted(ends, at)
        stop = np.minimum(np.concatenate([at[1:], [len(joined)]]), ends[which])
        words = [joined[a:b] for a, b in zip(at.tolist(), stop.tolist())]
        cache = self.cache
        if len(cache) > CACHED_WORDS:
            cache.clear()
        count = self.counter.count
        for w in set(words):
            if w not in cache:
                cache[w] = count(w.encode())
        each = np.fromiter(map(cache.__getitem__, words), "i8", len(words))
        np.add.at(total, np.array(owner), np.bincount(which, each, len(parts)).astype("i8"))
        return total


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns keep, n_bytes, n_tokens and over_limit for every row of docs.

    A null or empty text has 0 bytes and 0 tokens. Texts are counted whole, however long; repeated rows are kept. Only
    the named columns are read, so others may have any name.
    """
    bound_batches(docs.sparkSession)
    picked = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    fields = [*picked.select(*keep).schema.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)
        for batch in small_batches(batches, "__text", 2_000_000):
            texts = batch.column("__text")
            size = pa.compute.binary_length(texts).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), size, pa.array(counter.counts(texts.to_pylist()))], names=[*keep, "n_bytes", "n_tokens"])

    return picked.mapInArrow(run, T.StructType(fields)).withColumn("over_limit", F.col("n_tokens") > limit)
