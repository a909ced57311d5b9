"""Violations as rows: inst, stage, kind, record. A model is valid where none of its rows appear."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.mechanisms import DOMAINS, Library
from causeway.operators.diagram import ARROWS, ATTRIBUTES, SORTS, Diagram
from causeway.operators.topology import settled
from causeway.plans.storage import buckets_of, literal, stored


def issue(rows: DataFrame, stage: str, kind: str, record: str | F.Column, with_module: bool = False) -> DataFrame:
    record = F.col(record) if isinstance(record, str) else record
    return rows.select("inst", *(["module"] if with_module else []), F.lit(stage).alias("stage"), F.lit(kind).alias("kind"), record.cast("string").alias("record"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def structural_issues(tables: dict[str, DataFrame], library: Library, scope: list[str], stage: str) -> DataFrame:
    """Broken arrows, missing or illegal attributes, unknown codes and positions; scope names the columns that bound ids (inst, module).

    With a module in scope, issues name it, so that what follows can pass over broken modules alone.
    """
    own = "module" in scope
    spark = tables["Var"].sparkSession
    if set(tables) != set(SORTS):
        return literal(spark, [("", stage, "entity_tables", ",".join(sorted(tables)))], "inst string, stage string, kind string, record string")
    long = fields(tables, [*scope])
    ids = union([tables[sort].select(*scope, F.lit(sort).alias("to"), F.col("rid").alias("value")) for sort in SORTS]).distinct()
    name = F.concat_ws(".", "rid", "field")
    parts = [
        issue(long.where("to IS NOT NULL").join(ids, [*scope, "to", "value"], "left_anti"), stage, "structural_reference", name, own),
        issue(long.where("to IS NULL AND value IS NULL"), stage, "missing_attribute", name, own),
    ]
    bad = ~F.col("type").isin(*DOMAINS) | ~F.col("role").isin("exo", "endo")
    parts.append(issue(tables["Var"].where(bad), stage, "variable_attribute", "rid", own))
    known = F.broadcast(library.codes_table(spark).select("code"))  # a row for each declared code
    parts.append(issue(tables["Mech"].where("code IS NOT NULL").join(known, "code", "left_anti"), stage, "unknown_code", "rid", own))
    parts.append(issue(tables["Input"].where("pos < 1"), stage, "input_position", "rid", own))
    return union(parts)


def fields(tables: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys, sort, rid, field, value, to: every attribute and arrow of every record as a row; to is the sort that an arrow points to, null for attributes."""
    parts = []
    for sort in SORTS:
        named = [(c, None) for c in ATTRIBUTES[sort]] + list(ARROWS[sort].items())
        held = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"), F.lit(to).cast("string").alias("to")) for c, to in named]))
        parts.append(tables[sort].select(*keys, F.lit(sort).alias("sort"), "rid", held.alias("f")).select(*keys, "sort", "rid", "f.field", "f.value", "f.to"))
    return union(parts)


def edges(tables: dict[str, DataFrame], scope: list[str]) -> DataFrame:
    """scope, cause, effect from Inputs, distinct."""
    outputs = tables["Mech"].select(*scope, F.col("rid").alias("mech"), F.col("output").alias("effect"))
    return tables["Input"].join(outputs, [*scope, "mech"]).select(*scope, F.col("var").alias("cause"), "effect").distinct()


def model_issues(tables: dict[str, DataFrame], library: Library, scope: list[str], stage: str, closed: bool) -> DataFrame:
    """Owners, signatures, types, dependencies and cycles. A closed model has no boundary."""
    spark = tables["Var"].sparkSession
    var, mech, slots = tables["Var"], tables["Mech"], tables["Input"]
    boundary = F.lit(False) if closed else F.coalesce("is_boundary", F.lit(False))
    var = var.withColumn("b", boundary)
    parts = [issue(var.where("b AND role != 'endo'"), stage, "boundary_definition", "rid")]
    owners = mech.groupBy(*scope, F.col("output").alias("rid")).agg(F.count(F.lit(1)).alias("owners"))
    owned = var.join(owners, [*scope, "rid"], "left").withColumn("owners", F.coalesce("owners", F.lit(0))).withColumn("wanted", F.expr("role = 'endo' AND NOT b"))
    parts.append(issue(owned.where("wanted AND owners = 0"), stage, "missing_owner", "rid"))
    parts.append(issue(owned.where("wanted AND owners > 1"), stage, "duplicate_owner", "rid"))
    parts.append(issue(owned.where("NOT wanted AND owners > 0"), stage, "unexpected_owner", "rid"))
    codes, signature = F.broadcast(library.codes_table(spark)), F.broadcast(library.signatures(spark))  # a few rows for each declared code
    typed = mech.join(codes, "code").join(var.select(*scope, F.col("rid").alias("output"), "type"), [*scope, "output"])
    parts.append(issue(typed.where("type != output_type"), stage, "output_type", "rid"))
    named = slots.join(mech.join(codes, "code").select(*scope, F.col("rid").alias("mech"), "code", "arity"), [*scope, "mech"])
    held = named.groupBy(*scope, "mech").agg(F.countDistinct("pos").alias("n"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    full = mech.join(codes, "code").withColumnRenamed("rid", "mech").join(held, [*scope, "mech"], "left")
    parts.append(issue(full.where("coalesce(n, 0) != arity OR (arity > 0 AND (lo != 1 OR hi != arity))"), stage, "incomplete_signature", "mech"))
    parts.append(issue(slots.groupBy(*scope, "mech", "pos").count().where("count > 1"), stage, "duplicate_input", F.concat_ws(":", "mech", "pos")))
    args = named.join(signature, ["code", "pos"]).withColumnRenamed("type", "asked").join(var.select(*scope, F.col("rid").alias("var"), "type"), [*scope, "var"])
    parts.append(issue(args.where("type != asked"), stage, "input_type", "rid"))
    found = edges(tables, scope)
    deps = tables["Dep"].select(*scope, "cause", "effect").distinct()
    both = found.withColumn("n", F.lit(1)).unionByName(deps.withColumn("n", F.lit(-1)))
    differ = both.groupBy(*scope, "cause", "effect").agg(F.sum("n").alias("n")).where("n != 0").select(*scope).distinct()
    parts.append(issue(differ, stage, "dependency_mismatch", F.concat_ws("|", *scope)))
    ranks = levels(found, var.select(*scope, "rid"), scope)
    left = var.join(ranks, [*scope, "rid"], "left_anti").select(*scope).distinct()
    parts.append(issue(left, "acyclicity" if stage == "assembled" else stage, "cycle", F.concat_ws("|", *scope)))
    return union(parts)


def levels(found: DataFrame, nodes: DataFrame, scope: list[str]) -> DataFrame:
    """scope, rid, level: a node's level is one more than its highest cause's. Nodes on or after a cycle have none.

    A cause that isn't a node of the scope holds nothing back. Scopes may be of any size and depth, as topology has it.
    """
    alone = scope == ["inst"] and buckets_of(found.sparkSession) is not None  # a plain column keeps its buckets; it may not be null
    key = (F.col(scope[0]) if alone else F.to_json(F.struct(*scope))).alias("key")
    nodes = stored(nodes.select(key, "rid").distinct(), "nodes")
    arcs = found.select(key, F.col("cause").alias("rid"), F.col("effect").alias("node")).distinct().join(nodes, ["key", "rid"], "left_semi")
    caused = arcs.groupBy("key", "node").agg(F.collect_list("rid").alias("args")).join(nodes.withColumnRenamed("rid", "node"), ["key", "node"], "left_semi")
    caused = stored(caused.withColumn("code", F.lit(None).cast("string")), "caused")
    first = nodes.join(caused.withColumnRenamed("node", "rid"), ["key", "rid"], "left_anti").select("key", F.lit(0).cast("long").alias("block"), F.col("rid").alias("var"), F.lit(0).alias("value"), F.lit(0).cast("long").alias("mask"), F.lit(0).alias("level"))
    spans = caused.select("key").distinct().select("key", F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("everything"))
    later = settled(caused, spans, first, lambda code, given, every: [0], lambda code: (0,))
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in scope)
    named = first.unionByName(later)
    if alone:
        return named.select(F.col("key").alias(scope[0]), F.col("var").alias("rid"), "level")
    named = named.select(F.from_json("key", kinds).alias("s"), F.col("var").alias("rid"), "level")
    return named.select(*[F.col(f"s.{c}").alias(c) for c in scope], "rid", "level")


def cycle_witnesses(tables: dict[str, DataFrame], scope: list[str]) -> DataFrame:
    """scope, path, inputs: one closed path for each scope that has a cycle, and the smallest Input behind each of its edges.

    Peeling from causes leaves nodes on or after cycles; each has a cause that is left, and walking to the smallest one
    from the smallest node ends in a cycle. The walk is one task a scope, over an edge for each node.
    """
    outputs = tables["Mech"].select(*scope, F.col("rid").alias("mech"), F.col("output").alias("effect"))
    named = tables["Input"].join(outputs, [*scope, "mech"]).groupBy(*scope, F.col("var").alias("cause"), "effect").agg(F.min("rid").alias("input"))
    named = stored(named, "named")
    ranked = levels(named, tables["Var"].select(*scope, "rid"), scope).drop("level")
    core = named
    for column in ("cause", "effect"):
        core = core.join(ranked.withColumnRenamed("rid", column), [*scope, column], "left_anti")
    back = core.groupBy(*scope, "effect").agg(F.min(F.struct("cause", "input")).alias("b"))
    steps = back.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("effect", "b.cause", "b.input"))).alias("steps"))
    kinds = ", ".join(f"{c} {steps.schema[c].dataType.simpleString()}" for c in scope)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, inputs = [], []
            for steps in batch.column("steps").to_pylist():
                by = {s["effect"]: s for s in steps}
                node, seen = steps[0]["effect"], {}
                trail: list[str] = []
                while node not in seen:
                    seen[node] = len(trail)
                    trail.append(node)
                    node = by[node]["cause"]
                loop = [*trail[seen[node] :], node][::-1]  # causes come first
                paths.append(loop)
                inputs.append([by[e]["input"] for e in loop[1:]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in scope), pa.array(paths, pa.list_(pa.string())), pa.array(inputs, pa.list_(pa.string()))], names=[*scope, "path", "inputs"])

    return steps.select(*scope, "steps").mapInArrow(walk, f"{kinds}, path array<string>, inputs array<string>")


def diagram_issues(diagram: Diagram, library: Library) -> DataFrame:
    """Issues of modules and interfaces; a check that an earlier failure makes meaningless skips what failed."""
    scope = ["inst", "module"]
    structural = stored(structural_issues(diagram.records, library, scope, "local_module"), "issues")
    sound = {s: t.join(structural.select(*scope).distinct(), scope, "left_anti") for s, t in diagram.records.items()}
    structural = structural.drop("module")
    parts = [structural, model_issues(sound, library, scope, "local_module", closed=False)]
    if diagram.names is not None:
        parts.append(issue(diagram.names.where(~F.col("module").eqNullSafe(F.col("name"))), "local_module", "object_name", "module"))
    if diagram.strays is not None:
        known = sound["Var"].select(*scope).distinct()
        parts.append(issue(diagram.strays.join(known, scope, "left_semi"), "local_module", "boundary_definition", "rid"))
    parts.append(structural_issues(diagram.overlaps, library, ["inst", "iface"], "interface"))
    names = diagram.faces.groupBy("inst", "iface").count().where("count > 1")
    parts.append(issue(names, "interface", "interface_name", "iface"))
    once = stored(diagram.faces.join(names, ["inst", "iface"], "left_anti"), "faces")
    modules = diagram.records["Var"].select("inst", "module").union(diagram.records["Mech"].select("inst", "module")).distinct()
    # Both sides and all sorts go through each check together.
    sides = lambda t, *rest: t.select("inst", "iface", *rest, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).alias("at")) for s, c in (("left", "left"), ("right", "right"))])).alias("s")).select("inst", "iface", *rest, "s.side", F.col("s.at").alias("module"))
    ends = stored(sides(once), "ends")
    parts.append(issue(ends.join(modules, ["inst", "module"], "left_anti"), "interface", "interface_target", F.concat_ws(".", "iface", "side")))
    ends = ends.join(modules, ["inst", "module"], "left_semi")
    if diagram.maps is not None:
        lists = diagram.maps.groupBy("inst", "iface", "side").agg(F.array_sort(F.collect_set("sort")).alias("sorts"))
        lists = ends.join(lists, ["inst", "iface", "side"], "left").withColumn("odd", ~F.col("sorts").eqNullSafe(F.array(*map(F.lit, sorted(SORTS)))))
        parts.append(issue(lists.where("odd"), "interface", "map_sorts", F.concat_ws(".", "iface", "side")))
        ends = lists.where("NOT odd").select("inst", "iface", "side", "module")
    ends = stored(ends, "ends")
    legs = sides(diagram.spans.withColumnsRenamed({"left_rid": "left", "right_rid": "right"}), "sort", "rid").withColumnRenamed("module", "image")
    legs = stored(legs, "legs")
    used = legs.where("image IS NOT NULL").join(ends, ["inst", "iface", "side"])
    own = union([t.select("inst", "iface", F.lit(sort).alias("sort"), "rid") for sort, t in diagram.overlaps.items()])
    asked = own.join(ends.select("inst", "iface", "side"), ["inst", "iface"])
    key = ["inst", "iface", "side", "sort"]
    both = asked.select(*key, "rid", F.lit(1).alias("n")).unionByName(used.select(*key, "rid", F.lit(-1).alias("n")))
    missing = stored(both.groupBy(*key, "rid").agg(F.sum("n").alias("n")).where("n != 0").select(*key).distinct(), "missing")
    parts.append(issue(missing, "interface", "map_totality", F.concat_ws(".", "iface", "side", "sort")))
    used = stored(used.join(missing, key, "left_anti"), "used")
    parts.append(issue(used.groupBy(*key, "image").count().where("count > 1"), "interface", "map_injectivity", F.concat_ws(".", "iface", "side", "image")))
    targets = union([t.select("inst", "module", F.lit(sort).alias("sort"), F.col("rid").alias("image")) for sort, t in diagram.records.items()]).distinct()
    parts.append(issue(used.join(targets, ["inst", "module", "sort", "image"], "left_anti"), "interface", "map_reference", F.concat_ws(".", "iface", "side", "rid")))
    image = fields(diagram.records, ["inst", "module"]).withColumnsRenamed({"rid": "image", "value": "image_value"}).drop("to")
    met = used.join(fields(diagram.overlaps, ["inst", "iface"]), ["inst", "iface", "sort", "rid"]).join(image, ["inst", "module", "sort", "image", "field"])
    over = legs.select("inst", "iface", "side", F.col("sort").alias("to"), F.col("rid").alias("value"), F.col("image").alias("over"))
    met = met.join(over, ["inst", "iface", "side", "to", "value"], "left")
    differ = stored(met.where(~F.when(F.col("to").isNull(), F.col("value")).otherwise(F.col("over")).eqNullSafe(F.col("image_value"))), "differ")
    record = F.concat_ws(".", "iface", "side", "rid", "field")
    parts += [issue(differ.where("to IS NULL"), "interface", "attribute_mismatch", record), issue(differ.where("to IS NOT NULL"), "interface", "naturality", record)]
    return union(parts)
