"""URL rules judged by a cascade of Bloom filters: exact over the corpus's own keys, without a join.

Keys are a host (or a domain above it) followed by the beginning of the path. Level 1 holds the keys listed by rules.
Of all keys that the corpus's URLs have, those that level 1 takes wrongly are held by level 2, listed keys that level 2
takes are held by level 3, and so on until a level takes nothing wrongly. A key is listed if the number of levels
passed in a row is odd. A second cascade over the listed keys tells those that block. All of it is DataFrame expressions;
a filter is one array value, so plans don't grow with the rules.

Level 1 is sized from the universe: its bits a key grow with the logarithm of how many keys the corpus may have for each
listed one, so that it takes about as many keys wrongly as are listed, and all later levels, which hold those, are of the
size of the rule list, not of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import discard, materialise

#: Bits a key of a cascade's first level at least, of its later levels, and the share of keys that a bit a key leaves of false ones.
BITS_A_KEY, LATER_BITS, LEFT = 10, 2, 0.6185
#: Bytes of a filter at most, as its words come to the driver and go to every task; more rules than that are an error.
MOST_BYTES = 256 << 20


@dataclass(frozen=True)
class Rule:
    """An allow or block verdict for a host with its subdomains, where the path begins with path."""

    verdict: str
    host: str
    path: str

    @property
    def key(self) -> str:
        return self.host + self.path


def parse_rules(lines: list[str]) -> list[Rule]:
    """Rules from lines like 'allow org/' or 'block example.org/en/1'."""
    out = []
    for line in lines:
        verdict, key = line.split(" ", 1)
        host, slash, path = key.partition("/")
        if verdict not in ("allow", "block"):
            raise ValueError(f"neither allow nor block: {line}")
        out.append(Rule(verdict, host, slash + path))
    return out


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or a URL without '://'."""
    after = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + F.lit(3)), "#", 1))
    after = F.substring_index(after, "?", 1)
    cut = F.locate("/", after)
    host = F.when(cut > 0, F.substr(after, F.lit(1), cut - 1)).otherwise(after)
    path = F.when(cut > 0, F.substr(after, cut)).otherwise(F.lit(""))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(F.when(after.isNotNull(), path), F.lit(""))


def keys_of(host: Column, path: Column, hosts: list[str], lengths: list[int]) -> Column:
    """The keys by which a rule can fit: the host and each domain above it, with each beginning of the path that has a rule's length.

    Only domains with as many labels as some rule's host are of use, so a URL has few keys whatever its length.
    """
    labels = sorted({h.count(".") + 1 for h in hosts})
    count = F.size(F.split(host, r"\."))
    at_level = [F.when(count >= n, F.substring_index(host, ".", -n)) for n in labels]
    domains = F.filter(F.array(*at_level), lambda d: d.isNotNull() & (d != ""))
    begins = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(domains, lambda d: F.transform(begins, lambda p: F.concat(d, p))))


def positions(key: Column, bits: int, level: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * 1000 + i)), F.lit(bits).cast("long")) for i in range(hashes)]


@dataclass(frozen=True)
class Level:
    """A Bloom filter as 64-bit words, held as one array literal."""

    number: int
    size: int
    hashes: int
    words: Column

    def takes(self, key: Column) -> Column:
        tests = [F.getbit(F.element_at(self.words, (F.floor(p / 64) + 1).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1 for p in positions(key, 64 * self.size, self.number, self.hashes)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def build_level(keys: DataFrame, number: int, count: int, bits: int) -> Level:
    """The filter of the column key with bits a key; only its words come to the driver."""
    size, hashes = max(1, -(-count * bits // 64)), max(1, round(bits * log(2)))
    if 8 * size > MOST_BYTES:
        raise ValueError(f"a filter of {8 * size} bytes for {count} keys, over {MOST_BYTES}")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), 64 * size, number, hashes))).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 64).cast("long").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(p, 64) AS INT)))").alias("bits")).toArrow()
    held = np.zeros(size, "i8")
    held[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return Level(number, size, hashes, F.lit(held))


def passes(key: Column, levels: list[Level]) -> Column:
    """Whether key is listed, for keys of the universe the cascade was built over."""
    out = F.lit(False)
    for level in reversed(levels):
        out = level.takes(key) & ~out
    return out


def listing(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.createDataFrame(pa.table({"key": pa.array(keys, pa.string())}))


def first_bits(listed: int, others: int) -> int:
    """Bits a key with which a filter of listed keys takes about as many of others wrongly."""
    return max(BITS_A_KEY, ceil(log(max(1.0, others / max(1, listed))) / -log(LEFT)))


def cascade(positive: DataFrame, universe: DataFrame, others: int, first: int = 0) -> list[Level]:
    """Levels that tell the keys of positive from all others of universe (of distinct keys, others at most).

    The universe is read once: what level 1 takes of it is stored without the listed keys, and later levels narrow that
    down; the only join is that of keys taken with the rule list. Levels are numbered from first, so that cascades use
    hashes of their own.
    """
    levels: list[Level] = []
    ours, other = positive, universe
    while True:
        count = ours.count()
        if not count:
            return levels
        levels.append(build_level(ours, first + len(levels), count, LATER_BITS if levels else first_bits(count, others)))
        taken = other.where(levels[-1].takes(F.col("key")))
        if len(levels) == 1:
            taken = taken.distinct().join(positive, "key", "left_anti")
        taken = materialise(taken, "taken")
        discard(other)
        ours, other = taken, ours


def build_cascades(urls: DataFrame, rules: list[Rule], url: str = "url") -> tuple[list[Level], list[Level]]:
    """(levels for the rules' keys over all keys of urls, levels for the blocking ones among the rules' keys).

    The rule list is the driver's own; of the corpus only counts and filter words reach it.
    """
    spark = urls.sparkSession
    verdicts = verdict_of(rules)
    listed = listing(spark, sorted(verdicts))
    host, path = split_url(F.col(url))
    lengths = sorted({len(r.path) for r in rules})
    universe = urls.select(F.explode(keys_of(host, path, [r.host for r in rules], lengths)).alias("key"))
    most = urls.count() * len({r.host.count(".") for r in rules}) * len(lengths)
    levels = cascade(listed, universe, most)
    return levels, cascade(listing(spark, sorted(k for k, v in verdicts.items() if v == "block")), listed, len(verdicts), 100)


def verdict_of(rules: list[Rule]) -> dict[str, str]:
    """Verdicts by key; where rules repeat a key, the last one counts."""
    return {r.key: r.verdict for r in rules}


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added; the longest rule that fits wins.

    A null URL, or one without '://', has an empty host and path, fits no rule (null) and gets the verdict otherwise.
    Every row is kept, repeated ones too. Columns of those four names are replaced.
    """
    host, path = split_url(F.col(url))
    named = pages.withColumns({"host": host, "path": path})
    if not rules:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})
    levels, blocking = build_cascades(pages.select(F.col(url).alias("url")), rules)
    keys = keys_of(F.col("host"), F.col("path"), [r.host for r in rules], sorted({len(r.path) for r in rules}))
    fitting = F.filter(keys, lambda k: passes(k, levels))
    best = F.aggregate(fitting, F.lit(None).cast("string"), lambda a, k: F.when(a.isNull() | (F.length(k) > F.length(a)), k).otherwise(a))
    verdict = F.when(F.col("rule").isNull(), F.lit(otherwise)).when(passes(F.col("rule"), blocking), F.lit("block")).otherwise(F.lit("allow"))
    return named.withColumn("rule", best).withColumn("verdict", verdict)
