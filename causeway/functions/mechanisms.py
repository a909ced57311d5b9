"""The library of finite mechanisms as tables: codes, signatures, truth rows and domains."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.plans.storage import literal

# The two domains.
DOMAINS = {"bool": (0, 1), "tri": (0, 1, 2)}
# Code, argument types, output type, function. Codes differ by name, not by table (ID and ID_ALIAS).
BASE: list[tuple[str, tuple[str, ...], str, Callable[..., int]]] = [
    ("ZERO", (), "bool", lambda: 0),
    ("ONE", (), "bool", lambda: 1),
    ("ID", ("bool",), "bool", lambda a: a),
    ("NOT", ("bool",), "bool", lambda a: 1 - a),
    ("AND", ("bool", "bool"), "bool", lambda a, b: a & b),
    ("OR", ("bool", "bool"), "bool", lambda a, b: a | b),
    ("XOR", ("bool", "bool"), "bool", lambda a, b: a ^ b),
    ("AND_NOT", ("bool", "bool"), "bool", lambda a, b: a & (1 - b)),
    ("XOR3", ("bool", "bool", "bool"), "bool", lambda a, b, c: a ^ b ^ c),
    ("MAJ3", ("bool", "bool", "bool"), "bool", lambda a, b, c: int(a + b + c >= 2)),
    ("TRI_ID", ("tri",), "tri", lambda a: a),
    ("BOOL_TO_TRI", ("bool",), "tri", lambda a: 2 * a),
    ("ID_ALIAS", ("bool",), "bool", lambda a: a),
]


class Library:
    """Declared mechanisms. A function is called once for each tuple of its finite domain and never again."""

    def __init__(self, declared: list[tuple[str, tuple[str, ...], str, Callable[..., int]]] = BASE):
        self.codes: dict[str, tuple[tuple[str, ...], str, dict[tuple[int, ...], int]]] = {}
        for code, signature, output, function in declared:
            self.declare(code, signature, output, function)

    def declare(self, code: str, signature: tuple[str, ...], output: str, function: Callable[..., int]) -> None:
        if code in self.codes:
            raise ValueError(f"code already in use: {code}")
        if not {*signature, output} <= set(DOMAINS):
            raise ValueError(f"unknown type in {code}")
        table = {args: function(*args) for args in product(*(DOMAINS[t] for t in signature))}
        if not set(table.values()) <= set(DOMAINS[output]):
            raise ValueError(f"{code} leaves its output domain")
        self.codes[code] = (signature, output, table)

    def with_constants(self, targets: dict[str, tuple[str, int]]) -> Library:
        """A copy with a fresh constant DO::<label>::<value> for each label: (type, value)."""
        out = Library([])
        out.codes = dict(self.codes)
        for label, (kind, value) in targets.items():
            out.declare(f"DO::{label}::{value}", (), kind, lambda value=value: value)
        return out

    def codes_table(self, spark: SparkSession) -> DataFrame:
        """code, arity, output_type."""
        return literal(spark, [(c, len(s), o) for c, (s, o, _) in self.codes.items()], "code string, arity int, output_type string")

    def signatures(self, spark: SparkSession) -> DataFrame:
        """code, pos (from 1), type."""
        return literal(spark, [(c, i, t) for c, (s, _, _) in self.codes.items() for i, t in enumerate(s, 1)], "code string, pos int, type string")

    def truth(self, spark: SparkSession) -> DataFrame:
        """code, row, a1, a2, a3 (null beyond the arity), value."""
        rows = [(c, i, *[*args, None, None, None][:3], v) for c, (_, _, t) in self.codes.items() for i, (args, v) in enumerate(t.items())]
        return literal(spark, rows, "code string, row int, a1 int, a2 int, a3 int, value int")

    def truth_slots(self, spark: SparkSession) -> DataFrame:
        """code, row, pos, required: truth rows by argument."""
        a = F.array("a1", "a2", "a3")
        return self.truth(spark).select("code", "row", F.posexplode(a).alias("p", "required")).where("required IS NOT NULL").select("code", "row", (F.col("p") + 1).alias("pos"), "required")


def domain_table(spark: SparkSession) -> DataFrame:
    return literal(spark, [(t, v) for t, vs in DOMAINS.items() for v in vs], "type string, value int")


def totality(library: Library, spark: SparkSession) -> DataFrame:
    """code, arity, rows, expected, total: whether each table covers the product of its domains within its output domain."""
    sizes = domain_table(spark).groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    expected = library.signatures(spark).join(sizes, "type").groupBy("code").agg(F.round(F.product("n")).cast("long").alias("expected"))
    rows = library.truth(spark).join(library.codes_table(spark), "code").join(domain_table(spark).withColumnRenamed("type", "output_type"), ["output_type", "value"]).groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
    joined = library.codes_table(spark).join(expected, "code", "left").join(rows, "code", "left").withColumn("expected", F.coalesce("expected", F.lit(1)))
    return joined.select("code", "arity", F.coalesce("rows", F.lit(0)).alias("rows"), "expected", (F.col("rows") == F.col("expected")).alias("total"))


def replacements(library: Library, spark: SparkSession) -> DataFrame:
    """code, replacement: the alphabetically first code, aliases apart, of the same signature and another table."""
    signature = library.signatures(spark).groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"]), ",").alias("sig"))
    table = library.truth(spark).groupBy("code").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "value"))), lambda x: x["value"].cast("string")), "").alias("tab"))
    known = library.codes_table(spark).join(signature, "code", "left").join(table, "code").withColumn("sig", F.concat_ws(">", F.coalesce("sig", F.lit("")), "output_type"))
    a, b = known.alias("a"), known.where("NOT endswith(code, '_ALIAS')").alias("b")
    return a.join(b, (F.col("a.sig") == F.col("b.sig")) & (F.col("a.tab") != F.col("b.tab"))).groupBy(F.col("a.code").alias("code")).agg(F.min("b.code").alias("replacement"))


def fraction(num: F.Column, den: F.Column) -> F.Column:
    """A reduced fraction as text, by Euclid's algorithm; whole numbers have no denominator."""
    num, den = num.cast("long"), den.cast("long")
    start = F.struct(F.abs(num).alias("a"), F.coalesce(den, F.lit(1).cast("long")).alias("b"))
    steps = F.sequence(F.lit(1), F.lit(64))
    last = F.aggregate(steps, start, lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.coalesce(F.try_mod(s["a"], s["b"]), F.lit(0)).cast("long").alias("b")))
    g = F.when(last["a"] == 0, 1).otherwise(last["a"])
    top, bottom = (num / g).cast("long"), (den / g).cast("long")
    return F.when(bottom == 1, top.cast("string")).otherwise(F.concat_ws("/", top.cast("string"), bottom.cast("string")))
