"""Libraries as tables, which may be partial or wrong: faults as rows, and what a missing row leaves undefined in a model.

Where a truth row is missing, a mechanism that asks for it gives no value, and neither does what depends on it, under those
assignments alone; all others are as under the whole library.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.mechanisms import Library, domain_table

#: Truth rows of a library that evaluation takes at most; a library is as large as its finite domains, not as the data.
MOST_ROWS = 1_000_000
#: Arguments of a code at most.
MOST_ARGUMENTS = 3


@dataclass(frozen=True)
class LibraryTables:
    """codes: code, output_type. signatures: code, pos (from 1), type. truth: code, args (array of values), value."""

    codes: DataFrame
    signatures: DataFrame
    truth: DataFrame

    @staticmethod
    def of(library: Library, spark: SparkSession) -> LibraryTables:
        args = F.filter(F.array("a1", "a2", "a3"), lambda x: x.isNotNull())
        return LibraryTables(library.codes_table(spark).select("code", "output_type"), library.signatures(spark), library.truth(spark).select("code", args.alias("args"), "value"))

    def library(self) -> Library:
        """The library that evaluation takes: sound rows of sound codes. Rows that faults() names are left out, a code of unknown types as a whole."""
        signature = F.transform(F.array_sort(F.collect_list(F.struct("pos", "type"))), lambda x: x["type"])
        named = self.codes.join(self.signatures.groupBy("code").agg(signature.alias("signature")), "code", "left")
        sound = named.join(self.faults().where("kind = 'unknown_type'").select("code"), "code", "left_anti")
        found, rows = sound.collect(), self.sound_rows().limit(MOST_ROWS + 1).collect()
        if len(rows) > MOST_ROWS:
            raise ValueError(f"a library of more than {MOST_ROWS} truth rows")
        out = Library([])
        out.codes = {r["code"]: (tuple(r["signature"] or ()), r["output_type"], {}) for r in found}
        for r in rows:
            out.codes[r["code"]][2][tuple(r["args"])] = r["value"]
        return out

    def wanted(self) -> DataFrame:
        """code, args: the product of each code's domains; codes of unknown types have none."""
        domains = domain_table(self.codes.sparkSession)
        last = self.signatures.groupBy("code").agg(F.max("pos").alias("arity"))
        rows = self.codes.select("code").join(last, "code", "left").select("code", F.coalesce("arity", F.lit(0)).alias("arity"), F.array().cast("array<int>").alias("args"))
        for pos in range(1, MOST_ARGUMENTS + 1):
            values = self.signatures.where(F.col("pos") == pos).join(domains, "type").select("code", F.col("value").alias("v"))
            longer = rows.where(F.col("arity") >= pos).join(values, "code").select("code", "arity", F.array_append("args", F.col("v")).alias("args"))
            rows = rows.where(F.col("arity") < pos).unionByName(longer)
        return rows.select("code", "args")

    def checked(self) -> DataFrame:
        """code, args, value, kind: each truth row of a declared code with its fault, if any."""
        domains = domain_table(self.codes.sparkSession).select(F.col("type").alias("output_type"), "value", F.lit(True).alias("inside"))
        wanted = self.wanted().withColumn("known", F.lit(True))
        given = self.truth.groupBy("code", "args").agg(F.countDistinct("value").alias("values"), F.min("value").alias("value"))
        rows = given.join(self.codes, "code").join(wanted, ["code", "args"], "left").join(domains, ["output_type", "value"], "left")
        kind = F.when(F.col("known").isNull(), "foreign_row").when(F.col("values") != 1, "conflicting_rows").when(F.col("inside").isNull(), "output_domain")
        return rows.select("code", "args", "value", kind.alias("kind"))

    def sound_rows(self) -> DataFrame:
        return self.checked().where("kind IS NULL").select("code", "args", "value")

    def faults(self) -> DataFrame:
        """kind, code, record: unknown_type, undeclared_code, missing_row, foreign_row, conflicting_rows (two values) and output_domain.

        A row repeated with the same value is no fault. Rows of codes of unknown types aren't checked.
        """
        types = domain_table(self.codes.sparkSession).select("type").distinct()
        used = self.codes.select("code", F.col("output_type").alias("type")).unionByName(self.signatures.select("code", "type"))
        odd = used.join(types, "type", "left_anti").groupBy("code").agg(F.min("type").alias("record"))
        fine = lambda rows: rows.join(odd.select("code"), "code", "left_anti")
        text = F.coalesce(F.array_join(F.transform("args", lambda x: x.cast("string")), ","), F.lit(""))
        parts = [
            odd.select(F.lit("unknown_type").alias("kind"), "code", "record"),
            self.truth.join(self.codes, "code", "left_anti").select(F.lit("undeclared_code").alias("kind"), "code", F.lit("").alias("record")).distinct(),
            fine(self.wanted().join(self.truth.select("code", "args"), ["code", "args"], "left_anti")).select(F.lit("missing_row").alias("kind"), "code", text.alias("record")),
            fine(self.checked().where("kind IS NOT NULL")).select("kind", "code", text.alias("record")),
        ]
        return reduce(DataFrame.unionByName, parts)


def undefined(tables: dict[str, DataFrame], values: DataFrame, spans: DataFrame) -> DataFrame:
    """inst, block, var, code, lacking, asked: assignments under which an owned variable has no value, as bits, and those among them under which all its arguments have one, so that the mechanism itself lacks a row.

    values as evaluation.evaluate() gives them, spans (inst, block, everything) all its blocks. Variables that have a value
    under every assignment get no row; one with several owners has a row for each.
    """
    known = values.groupBy("inst", "block", "var").agg(F.bit_or("mask").alias("known"))
    mech = tables["Mech"].select("inst", F.col("rid").alias("mech"), "code", F.col("output").alias("var"))
    every = mech.join(spans, "inst")
    has = every.join(known, ["inst", "block", "var"], "left")
    lacking = has.withColumn("lacking", F.col("everything").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0)))))
    lacking = lacking.where("lacking != 0").select("inst", "block", "mech", "code", "var", "everything", "lacking")
    slots = tables["Input"].select("inst", "mech", F.col("var").alias("arg"))
    args = lacking.select("inst", "block", "mech").join(slots, ["inst", "mech"]).join(known.withColumnRenamed("var", "arg"), ["inst", "block", "arg"], "left")
    met = args.groupBy("inst", "block", "mech").agg(F.bit_and(F.coalesce("known", F.lit(0))).alias("met"))
    found = lacking.join(met, ["inst", "block", "mech"], "left")
    return found.select("inst", "block", "var", "code", "lacking", F.col("lacking").bitwiseAND(F.coalesce("met", "everything")).alias("asked"))
