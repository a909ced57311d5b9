"""Exhaustive evaluation: for each variable and value, the set of assignments that give it, as bits of integers.

Assignments come in blocks of 64, a bit each, so an instance may have any number of them. A truth row holds where its
arguments' sets meet, and a value where one of its rows holds. Models are folded in topological order, small ones whole in
one task and large ones cell by cell, as topology has it; interventions force bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.mechanisms import DOMAINS, Library, domain_table, fraction
from causeway.operators.topology import settled, settled_whole

BITS = 64


def assignments(free: DataFrame) -> DataFrame:
    """inst, block, var, value, mask, everything: masks of the free variables (inst, var, type) and the mask of all assignments.

    Bit a % 64 of block a / 64 is the assignment with mixed-radix digits in the order of variable names, the first name
    changing fastest.
    """
    domains = domain_table(free.sparkSession).groupBy("type").agg(F.count(F.lit(1)).alias("size"))
    sized = free.join(F.broadcast(domains), "type")  # a row for each type
    lists = sized.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct("var", "size"))).alias("all"))
    product = lambda xs: F.aggregate(xs, F.lit(1).cast("long"), lambda a, x: a * x["size"])
    each = lists.select("inst", product(F.col("all")).alias("total"), F.posexplode("all").alias("i", "x"), "all")
    each = each.select("inst", "total", F.col("x.var").alias("var"), F.col("x.size").alias("size"), product(F.slice("all", 1, F.col("i"))).alias("place"))
    valued = each.withColumn("value", F.explode(F.sequence(F.lit(0), (F.col("size") - 1).cast("int"))))
    blocked = valued.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / BITS))))
    here = F.least(F.col("total") - F.col("block") * BITS, F.lit(BITS))
    bits = F.sequence(F.lit(0).cast("long"), here - 1)
    hits = F.filter(bits, lambda i: F.floor((F.col("block") * BITS + i) / F.col("place")) % F.col("size") == F.col("value"))
    return blocked.select("inst", "block", "var", "value", as_mask(hits).alias("mask"), as_mask(bits).alias("everything"))


def as_mask(bits: F.Column) -> F.Column:
    """The integer of 64 bits in which those of an array are set."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))))


def masks_of(library: Library):
    """What a fold asks of a library: the masks of each value of an output."""
    codes = library.codes

    def masks(code: str | None, given: list[list[int]], every: int) -> list[int] | None:
        if code not in codes or len(codes[code][0]) != len(given):
            return None
        out = [0, 0, 0]
        for values, value in codes[code][2].items():
            hit = every
            for known, x in zip(given, values):
                hit &= known[x]
            out[value] |= hit
        return out

    return masks


def arguments(slots: DataFrame, by: tuple[str, ...] = ("inst",)) -> DataFrame:
    """by, rid, all: the places (pos, var) of each mechanism of slots (by, mech, pos, var)."""
    return slots.groupBy(*by, F.col("mech").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("pos", "var"))).alias("all"))


def in_order() -> F.Column:
    """The argument list of places all; none where positions aren't 1, 2 and so on."""
    places = F.transform(F.coalesce("all", F.array().cast("array<struct<pos: int, var: string>>")), lambda x: x["pos"])
    ok = F.forall(F.transform(places, lambda p, i: p.eqNullSafe(i + 1)), lambda ok: ok)
    return F.when(ok, F.coalesce(F.transform("all", lambda x: x["var"]), F.array().cast("array<string>")))


def items_of(mech: DataFrame, slots: DataFrame, by: tuple[str, ...] = ("inst",)) -> DataFrame:
    """by, code, var, args: mechanisms with their argument lists, as settled_whole() takes them."""
    return mech.join(arguments(slots, by), [*by, "rid"], "left").select(*by, "code", F.col("output").alias("var"), in_order().alias("args"))


def evaluate_whole(mech: DataFrame, slots: DataFrame, spans: DataFrame, given: DataFrame, library: Library) -> DataFrame:
    """inst, var, bits of owned and free variables of small models over two values, as settled_whole() has it; spans and given as there."""
    return settled_whole(items_of(mech, slots), spans, given, masks_of(library))


def evaluate(mech: DataFrame, slots: DataFrame, start: DataFrame, library: Library, forced: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """inst, block, var, value, mask, level from mech (inst, rid, code, output), slots (inst, mech, pos, var) and the free variables' masks start (as of assignments(); without a block, all are in one).

    forced (inst, block, var, value, mask) sets owned variables under some assignments, as an intervention does. blocks
    (inst, block, everything) names all blocks where not those of start are meant; without it, instances without free
    variables have one assignment. A variable with several owners has every value that one of them gives, and what depends
    on it comes after all of them. Variables on or after a cycle, without owner, or with an owner of unknown code or of
    other positions than its code's get no row; a free variable's owners don't count.
    """
    if "block" not in start.columns:
        start = start.withColumn("block", F.lit(0).cast("long"))
    keyed = lambda rows: rows.withColumnRenamed("inst", "key")
    mech, spans = keyed(mech.select("inst", "rid", "code", "output")), start.select("inst", "block", "everything").distinct() if blocks is None else blocks.select("inst", "block", "everything")
    start = keyed(start.groupBy("inst", "block", "var", "value").agg(F.bit_or("mask").alias("mask")).withColumn("level", F.lit(0)))
    if blocks is not None:
        start = start.join(keyed(spans), ["key", "block"], "left_semi")
    named = mech.select("key").distinct().join(keyed(spans), "key", "left")
    spans = named.select("key", F.coalesce("block", F.lit(0).cast("long")).alias("block"), F.coalesce("everything", F.lit(1).cast("long")).alias("everything"))
    lists = arguments(slots).withColumnRenamed("inst", "key")
    owned = mech.join(start.select("key", F.col("var").alias("output")).distinct(), ["key", "output"], "left_anti")
    items = owned.join(lists, ["key", "rid"], "left").select("key", "code", F.col("output").alias("node"), in_order().alias("args"))
    masks, codes = masks_of(library), library.codes
    found = settled(items, spans, start, masks, lambda code: DOMAINS[codes[code][1]], None if forced is None else keyed(forced))
    return start.select("key", "block", "var", "value", "mask", "level").unionByName(found).withColumnRenamed("key", "inst")


def free_variables(tables: dict[str, DataFrame], closed: bool) -> DataFrame:
    """inst, var, type of exogenous and, in an open model, boundary variables."""
    rows = tables["Var"].where("role = 'exo'" if closed else "role = 'exo' OR is_boundary")
    return rows.select("inst", F.col("rid").alias("var"), "type")


def evaluate_tables(tables: dict[str, DataFrame], library: Library, closed: bool = True) -> DataFrame:
    return evaluate(tables["Mech"], tables["Input"], assignments(free_variables(tables, closed)), library)


def intervene(tables: dict[str, DataFrame], targets: DataFrame) -> dict[str, DataFrame]:
    """Surgery: the mechanisms of targets (inst, var, code, and module where tables have it) get the new code, and lose their Inputs and their effect's Deps."""
    own = ["inst", "module"] if "module" in tables["Mech"].columns else ["inst"]
    hit = targets.select(*own, F.col("var").alias("output"), F.col("code").alias("do_code"))
    mech = tables["Mech"].join(hit, [*own, "output"], "left").withColumn("code", F.coalesce("do_code", "code")).drop("do_code")
    cut = tables["Mech"].join(hit, [*own, "output"], "left_semi")
    slots = tables["Input"].join(cut.select(*own, F.col("rid").alias("mech")), [*own, "mech"], "left_anti")
    deps = tables["Dep"].join(hit.select(*own, F.col("output").alias("effect")), [*own, "effect"], "left_anti")
    return {"Var": tables["Var"], "Mech": mech.select(*tables["Mech"].columns), "Input": slots, "Dep": deps}


def laws(spark) -> DataFrame:
    """law, u_mask, num, den over four binary variables: exact masses as numerators over one denominator a law."""
    masks = spark.range(16).select(F.col("id").cast("int").alias("u_mask"))
    product = None
    for i in range(4):
        factor = F.when(F.col("u_mask").bitwiseAND(1 << i) > 0, i + 1).otherwise(4 - i)
        product = factor if product is None else product * factor
    parts = [("uniform", F.lit(1), 16), ("product", product, 625), ("correlated", F.col("u_mask").isin(0, 15).cast("int"), 2)]
    rows = [masks.select(F.lit(n).alias("law"), "u_mask", num.cast("long").alias("num"), F.lit(d).cast("long").alias("den")) for n, num, d in parts]
    return rows[0].union(rows[1]).union(rows[2])


def masses(values: DataFrame, law: DataFrame) -> DataFrame:
    """inst, law, var, value, num, den: the exact mass of each variable's value; the law (48 rows) is the small side."""
    hit = F.call_function("getbit", F.col("mask"), F.col("u_mask")) == 1
    return values.crossJoin(F.broadcast(law)).where(hit).groupBy("inst", "law", "var", "value", "den").agg(F.sum("num").alias("num")).select("inst", "law", "var", "value", "num", "den")


#: Lists of variables that an instance's atoms are digested in, so that no task holds all of a large model's.
ATOM_LISTS = 1024


def assignment_atoms(values: DataFrame, count: int = 16) -> DataFrame:
    """inst, u_mask, atom: the values of all variables in name order under each assignment, as a SHA-256 digest of digests."""
    digit = lambda v: F.aggregate(v, F.lit(0), lambda a, x: F.when(F.call_function("getbit", x["mask"], F.col("u_mask")) == 1, x["value"]).otherwise(a))
    held = values.where("value > 0").groupBy("inst", "var").agg(F.collect_list(F.struct("value", "mask")).alias("v"))
    lists = held.groupBy("inst", F.pmod(F.xxhash64("var"), F.lit(ATOM_LISTS)).alias("at")).agg(F.array_sort(F.collect_list(F.struct("var", "v"))).alias("all"))
    lists = lists.withColumn("u_mask", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    text = F.array_join(F.transform("all", lambda x: F.concat_ws("=", x["var"], digit(x["v"]).cast("string"))), ";")
    parts = lists.select("inst", "u_mask", "at", F.sha2(text.cast("binary"), 256).alias("part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "")
    return parts.groupBy("inst", "u_mask").agg(F.sha2(whole.cast("binary"), 256).alias("atom"))


def local_distance(start: DataFrame, local: DataFrame, pulled: DataFrame, law: DataFrame) -> DataFrame:
    """inst, law, n, den: twice the exact distance n/den, for each module, between what it makes of the law of its free variables and the law pulled back to it.

    start: values (inst, var, value, mask) of free variables; local: those that follow from them; pulled: those of the whole
    model. Masses are summed by the atoms of free variables first; each such atom is evaluated once, at its first assignment.
    """
    out, law = assignment_atoms(local), F.broadcast(law)  # 48 rows
    asked = out.select("inst", "u_mask").join(assignment_atoms(start), ["inst", "u_mask"], "left").fillna("", ["atom"])
    first = asked.groupBy("inst", "atom").agg(F.min("u_mask").alias("u_mask"))
    induced = asked.join(law, "u_mask").groupBy("inst", "atom", "law", "den").agg(F.sum("num").alias("num"))
    made = induced.join(first, ["inst", "atom"]).drop("atom").join(out, ["inst", "u_mask"])
    given = assignment_atoms(pulled).join(law, "u_mask")
    both = made.select("inst", "law", "den", "atom", "num").unionByName(given.select("inst", "law", "den", "atom", (-F.col("num")).alias("num")))
    apart = both.groupBy("inst", "law", "den", "atom").agg(F.sum("num").alias("d"))
    return apart.groupBy("inst", "law", "den").agg(F.sum(F.abs("d")).alias("n")).select("inst", "law", "n", (2 * F.col("den")).alias("den"))


def total_variation(a: DataFrame, b: DataFrame) -> DataFrame:
    """law, tv: half the sum of absolute differences of two mass tables (law, atom, num, den), exact, as text."""
    x = a.groupBy("law", "atom", "den").agg(F.sum("num").alias("x"))
    y = b.groupBy("law", "atom", "den").agg(F.sum("num").alias("y"))
    both = x.join(y, ["law", "atom", "den"], "full_outer")
    summed = both.groupBy("law", "den").agg(F.sum(F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)))).alias("n"))
    return summed.select("law", fraction(F.col("n"), 2 * F.col("den")).alias("tv"))
