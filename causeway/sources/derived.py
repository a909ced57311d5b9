"""A model derived from the part table, whole and cut into four modules; it grows with the table.

Exogenous U0..U3 have index 0..3, endogenous V<k> has index k + 4. p_size picks the code and the arguments, which
always have smaller indices. Module k % 4 owns V<k>; module 1 also has a copy where k % 12 = 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.operators.diagram import SORTS, Diagram, from_equations, overlaps_from_left
from causeway.plans.storage import literal, stored, stored_all

# The code by p_size % 10, and its arity.
CODES = ("ZERO", "ONE", "ID", "NOT", "AND", "OR", "XOR", "AND_NOT", "XOR3", "MAJ3")
ARITIES = (0, 0, 1, 1, 2, 2, 2, 2, 3, 3)
# Another code of the same arity for a copy in conflict.
SWAPS = {"ZERO": "ONE", "ONE": "ZERO", "ID": "NOT", "NOT": "ID", "AND": "AND_NOT", "OR": "AND", "XOR": "AND", "AND_NOT": "AND", "XOR3": "MAJ3", "MAJ3": "XOR3"}


def name_of(index: F.Column) -> F.Column:
    return F.when(index < 4, F.concat(F.lit("U"), index)).otherwise(F.concat(F.lit("V"), index - 4))


def pick(values: tuple, at: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, output, code, args for each part."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").cast("long").alias("k"), F.col("p_size").cast("long").alias("s"))
    kind = F.col("s") % 10
    slots = F.slice(F.array(F.lit(1), F.lit(2), F.lit(3)), 1, pick(ARITIES, kind))
    args = F.transform(slots, lambda p: name_of((F.col("k") * 31 + 17 + F.when(F.col("k") % 7 == 0, 0).otherwise(17 * (p - 1)) + F.col("s") * 7) % (F.col("k") + 4)))
    return part.select("k", name_of(F.col("k") + 4).alias("output"), pick(CODES, kind).alias("code"), args.alias("args"))


def ground(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The whole model as one module, instance 'ground'."""
    eq = equations(spark, sf_dir)
    rows = eq.select(F.lit("ground").alias("inst"), F.lit("g").alias("module"), "output", "code", "args")
    exo = spark.range(4).select(F.concat(F.lit("U"), "id").alias("rid"), F.lit("exo").alias("role"))
    var = exo.union(eq.select(F.col("output").alias("rid"), F.lit("endo").alias("role")))
    variables = var.select(F.lit("ground").alias("inst"), F.lit("g").alias("module"), "rid", F.lit("bool").alias("type"), "role", F.lit(False).alias("is_boundary"))
    return stored_all({s: t.drop("module") for s, t in from_equations(variables, rows).items()}, "ground")


def modules(spark: SparkSession, sf_dir: str, conflict: bool = False) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Record tables of the four modules with their own ids, and by sort the ground id of each record (inst, module, rid, ground)."""
    eq = equations(spark, sf_dir)
    own = F.array((F.col("k") % 4).cast("int"))
    owners = F.explode(F.when((F.col("k") % 12 == 0) & (F.col("k") % 4 != 1), F.concat(own, F.array(F.lit(1)))).otherwise(own))
    held = eq.withColumn("owner", owners)
    if conflict:
        swap = F.create_map(*[F.lit(x) for kv in SWAPS.items() for x in kv])
        held = held.withColumn("code", F.when(F.col("owner") != F.col("k") % 4, swap[F.col("code")]).otherwise(F.col("code")))
    inst = F.lit("conflict" if conflict else "derived")
    module = F.concat(F.lit("m"), F.col("owner"))
    needed = held.select("owner", F.col("output").alias("v"), F.lit(True).alias("owned")).union(held.select("owner", F.explode("args"), F.lit(False)))
    needed = needed.union(spark.range(4).select(F.lit(0), F.concat(F.lit("U"), "id"), F.lit(False)))
    var = needed.groupBy("owner", "v").agg(F.max("owned").alias("owned"))
    exo = F.startswith("v", F.lit("U"))
    local = lambda v: F.concat(module, F.lit("_"), v)
    variables = var.select(inst.alias("inst"), module.alias("module"), local(F.col("v")).alias("rid"), F.lit("bool").alias("type"), F.when(exo, "exo").otherwise("endo").alias("role"), (~exo & ~F.col("owned")).alias("is_boundary"))
    rows = held.select(inst.alias("inst"), module.alias("module"), local(F.col("output")).alias("output"), "code", F.transform("args", lambda a: F.concat(F.concat(F.lit("m"), F.col("owner")), F.lit("_"), a)).alias("args"))
    records = from_equations(variables, rows)
    grounds = {s: records[s].select("inst", "module", "rid", F.regexp_replace("rid", "m[0-9]+_", "").alias("ground")) for s in SORTS}
    return records, grounds


def diagram(spark: SparkSession, sf_dir: str, conflict: bool = False) -> Diagram:
    """The four modules with an interface for each pair, on every record they share."""
    records, grounds = modules(spark, sf_dir, conflict)
    records = stored_all(records, "records")
    grounds = {s: records[s].select("inst", "module", "rid", F.regexp_replace("rid", "m[0-9]+_", "").alias("ground")) for s in SORTS}
    spans = None
    for s in SORTS:
        left, right = grounds[s].select("inst", F.col("module").alias("left"), F.col("rid").alias("left_rid"), "ground"), grounds[s].select("inst", F.col("module").alias("right"), F.col("rid").alias("right_rid"), "ground")
        both = left.join(right, ["inst", "ground"]).where("left < right")
        part = both.select("inst", F.concat_ws("-", "left", "right").alias("iface"), F.lit(s).alias("sort"), F.concat(F.lit(f"o:{s}:"), "ground").alias("rid"), "left_rid", "right_rid")
        spans = part if spans is None else spans.unionByName(part)
    names = [(f"m{i}", f"m{j}") for i in range(4) for j in range(i + 1, 4)]
    faces = literal(spark, [("conflict" if conflict else "derived", f"{a}-{b}", a, b) for a, b in names], "inst string, iface string, left string, right string")
    spans = stored(spans, "spans")
    return Diagram(records, faces, spans, overlaps_from_left(records, faces, spans))
