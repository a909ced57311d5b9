"""Gluing modules along interfaces: identification pairs, classes, duplicate elimination, quotient tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from causeway.operators.components import components
from causeway.operators.diagram import ARROWS, ATTRIBUTES, SORTS, Diagram
from causeway.plans.storage import stored, stored_all


def tag(module: str | F.Column, rid: str | F.Column) -> F.Column:
    return F.concat_ws("|", module, rid)


def tags(diagram: Diagram) -> DataFrame:
    """inst, sort, module, rid, tag: every record of every module."""
    parts = [diagram.records[s].select("inst", F.lit(s).alias("sort"), "module", "rid") for s in SORTS]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return out.withColumn("tag", tag("module", "rid"))


def identifications(diagram: Diagram) -> DataFrame:
    """inst, sort, a, b, iface, rid: tags that an interface record makes one."""
    held = diagram.spans.join(diagram.faces, ["inst", "iface"])
    return held.select("inst", "sort", tag("left", "left_rid").alias("a"), tag("right", "right_rid").alias("b"), "iface", "rid")


def classes(all_tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """inst, sort, module, rid, tag, cid: cid is the smallest tag of a class, whatever order records come in."""
    key = lambda c: F.concat_ws("#", "sort", c)
    found = components(pairs.select("inst", key("a").alias("a"), key("b").alias("b")), within=("inst",))
    named = all_tags.withColumn("node", key("tag")).join(found, ["inst", "node"], "left")
    prefix = F.length("sort") + 2
    return named.withColumn("cid", F.when(F.col("component").isNull(), F.col("tag")).otherwise(F.substr("component", prefix))).drop("node", "component")


def arrows_to_classes(diagram: Diagram, qmap: DataFrame, sort: str) -> DataFrame:
    """Records of a sort with tag, own cid and arrows replaced by classes."""
    rows = diagram.records[sort].withColumn("tag", tag("module", "rid"))
    own = qmap.where(F.col("sort") == sort).select("inst", "tag", "cid")
    rows = rows.join(own, ["inst", "tag"])
    for column, to in ARROWS[sort].items():
        target = qmap.where(F.col("sort") == to).select("inst", F.col("tag").alias("__tag"), F.col("cid").alias("__cid"))
        rows = rows.withColumn("__tag", tag("module", column)).join(target, ["inst", "__tag"], "left").withColumn(column, F.col("__cid")).drop("__tag", "__cid")
    return rows


def merged(qmap: DataFrame, pairs: DataFrame, *sorts: str) -> DataFrame:
    """The class map after pairs (inst, sort, ca, cb) of classes of these sorts became one. A class is named by its smallest tag, so the smallest name is right."""
    key = lambda c: F.concat_ws("#", "sort", c)
    found = components(pairs.select("inst", key("ca").alias("a"), key("cb").alias("b")), within=("inst",))
    prefix = F.length("sort") + 2
    open_ = F.col("sort").isin(*sorts)
    named = qmap.where(open_).withColumn("node", key("cid")).join(found, ["inst", "node"], "left")
    named = named.withColumn("cid", F.when(F.col("component").isNull(), F.col("cid")).otherwise(F.substr("component", prefix)))
    return named.select(qmap.columns).unionByName(qmap.where(~open_))


def duplicate_pairs(diagram: Diagram, qmap: DataFrame) -> DataFrame:
    """As same_class_key(): Mechs of equal code, output class and ordered argument classes."""
    slots = diagram.records["Input"].select("inst", "pos", "rid", tag("module", "mech").alias("mtag"), tag("module", "var").alias("__tag"))
    of = qmap.where("sort = 'Var'").select("inst", F.col("tag").alias("__tag"), F.col("cid").alias("arg"))
    slots = slots.join(of, ["inst", "__tag"], "left")
    args = slots.groupBy("inst", F.col("mtag").alias("tag")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "rid", "arg"))), lambda x: x["arg"])).alias("args"))
    mechs = arrows_to_classes(diagram, qmap, "Mech").join(args, ["inst", "tag"], "left").withColumn("args", F.coalesce("args", F.lit("[]")))
    return same_class_key(mechs, "Mech", ["code", "output", "args"])


def same_key(rows: DataFrame, sort: str, key: list[str]) -> DataFrame:
    least = rows.groupBy("inst", *key).agg(F.min("tag").alias("b"))
    return rows.join(least, ["inst", *key]).where("tag != b").select("inst", F.lit(sort).alias("sort"), F.col("tag").alias("a"), "b")


def same_class_key(rows: DataFrame, sort: str, key: list[str]) -> DataFrame:
    """inst, sort, a, b, ca, cb: records of one key with the one of the smallest tag, and the classes of both. A key that is null in part is no key."""
    known = rows.dropna(subset=["inst", *key])
    least = known.groupBy("inst", *key).agg(F.min(F.struct("tag", "cid")).alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    both = known.join(least, ["inst", *key]).where("tag != least.tag")
    return both.select("inst", F.lit(sort).alias("sort"), F.col("tag").alias("a"), F.col("least.tag").alias("b"), F.col("cid").alias("ca"), F.col("least.cid").alias("cb"))


@dataclass(frozen=True)
class Assembly:
    """qmap: inst, sort, module, rid, tag, cid. tables: by sort, a row for each class. pairs: what was made one, and why."""

    qmap: DataFrame
    tables: dict[str, DataFrame]
    pairs: DataFrame


def quotient(diagram: Diagram, qmap: DataFrame, sorts: tuple[str, ...] = SORTS) -> dict[str, DataFrame]:
    """By sort, inst, rid (the class), attributes, arrows; members that disagree give several rows."""
    return {s: arrows_to_classes(diagram, qmap, s).select("inst", F.col("cid").alias("rid"), *ATTRIBUTES[s], *ARROWS[s]).distinct() for s in sorts}


def on_variables(qmap: DataFrame) -> DataFrame:
    """The class map of a diagram's identifications, had it interfaces on Var alone: classes of a sort come from its own pairs."""
    return qmap.withColumn("cid", F.when(F.col("sort") == "Var", F.col("cid")).otherwise(F.col("tag")))


def class_map(diagram: Diagram, deduplicate: bool, qmap: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes of all instances, what was made one). qmap: the classes of the diagram's identifications, where they are known.

    Deduplication is one pass: Mechs by their key, then Inputs and Deps by theirs.
    """
    pairs = identifications(diagram).select("inst", "sort", "a", "b")
    qmap = stored(classes(tags(diagram), pairs), "qmap") if qmap is None else qmap
    if deduplicate:
        mechs = stored(duplicate_pairs(diagram, qmap), "pairs")
        qmap = stored(merged(qmap, mechs, "Mech"), "qmap")
        ends = {"Input": ["mech", "pos", "var"], "Dep": ["cause", "effect"]}
        alike = stored_all({s: same_class_key(arrows_to_classes(diagram, qmap, s), s, key) for s, key in ends.items()}, "pairs")
        qmap = stored(merged(qmap, alike["Input"].unionByName(alike["Dep"]), "Input", "Dep"), "qmap")
        for found in (mechs, *alike.values()):
            pairs = pairs.unionByName(found.select("inst", "sort", "a", "b"))
    return qmap, pairs


def assemble(diagram: Diagram, deduplicate: bool, qmap: DataFrame | None = None) -> Assembly:
    """Classes, as of class_map(), and quotient of all instances."""
    qmap, pairs = class_map(diagram, deduplicate, qmap)
    return Assembly(qmap, stored_all(quotient(diagram, qmap), "quotient"), pairs)


def sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """inst, sort, n."""
    out = None
    for s in SORTS:
        part = tables[s].groupBy("inst").agg(F.countDistinct("rid").alias("n")).select("inst", F.lit(s).alias("sort"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def class_sizes(qmap: DataFrame) -> DataFrame:
    """inst, sort, n: as sizes() of the quotient, which has the classes of a sort as its records."""
    return qmap.groupBy("inst", "sort", "cid").agg(F.count(F.lit(1)).alias("members")).groupBy("inst", "sort").agg(F.count(F.lit(1)).alias("n"))


def fibers(qmap: DataFrame) -> DataFrame:
    """inst, module, sort, cid, n: classes that hold several records of one module (a warning, not an error)."""
    return qmap.groupBy("inst", "module", "sort", "cid").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
