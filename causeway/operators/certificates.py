"""Certificates of assemblies: a spanning forest with evidence for each edge, witnesses of failure, and checks of both.

Checks read the diagram and the certificate alone, never the assembler's pairs or issues. What doesn't hold is a row, so
damaged certificates are told from sound ones by counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.assembly import arrows_to_classes, identifications, same_key, tag, tags
from causeway.operators.components import components
from causeway.operators.diagram import ARROWS, ATTRIBUTES, SORTS, Diagram
from causeway.operators.validation import cycle_witnesses, edges, levels, union
from causeway.plans.storage import discard, literal, stored, stored_with

CHECKS = ("tags_total", "classes_tabled", "forest_justified", "forest_generates", "interfaces_respected", "duplicates_merged", "rows_descend", "ranks_ascend")


def node(column: str) -> F.Column:
    return F.concat_ws("#", "inst", "sort", column)


def keys(diagram: Diagram, qmap: DataFrame) -> DataFrame:
    """inst, sort, tag, key: records of equal keys are what elimination makes one; Vars have none."""
    args = arrows_to_classes(diagram, qmap, "Input").select("inst", "module", "rid", "pos", F.col("var").alias("arg")).join(
        diagram.records["Input"].select("inst", "module", "rid", tag("module", "mech").alias("tag")), ["inst", "module", "rid"]
    )
    args = args.groupBy("inst", "tag").agg(F.array_sort(F.collect_list(F.struct("pos", "arg"))).alias("args"))
    mech = arrows_to_classes(diagram, qmap, "Mech").join(args, ["inst", "tag"], "left")
    parts = [("Mech", mech, ("code", "output", "args")), *((s, arrows_to_classes(diagram, qmap, s), c) for s, c in (("Input", ("mech", "pos", "var")), ("Dep", ("cause", "effect"))))]
    return union([rows.select("inst", F.lit(s).alias("sort"), "tag", F.to_json(F.struct(*c), {"ignoreNullFields": "false"}).alias("key")) for s, rows, c in parts])


def evidence(diagram: Diagram, qmap: DataFrame, deduplicated: bool) -> DataFrame:
    """inst, sort, a, b, kind (interface, duplicate), iface, record: pairs that a forest may be made of."""
    pairs = identifications(diagram).select("inst", "sort", "a", "b", F.lit("interface").alias("kind"), "iface", F.col("rid").alias("record"))
    if not deduplicated:
        return pairs
    rows = stored(keys(diagram, qmap), "keys")
    alike = union([same_key(rows.where(F.col("sort") == s), s, ["key"]) for s in SORTS if s != "Var"])
    return pairs.unionByName(alike.select("inst", "sort", "a", "b", F.lit("duplicate").alias("kind"), F.lit(None).cast("string").alias("iface"), F.lit(None).cast("string").alias("record")))


def forest(pairs: DataFrame) -> DataFrame:
    """The pairs, interface pairs first, that join all that pairs join without a circle.

    In each round every component takes its least pair to another one, so components at least halve. Pairs are totally
    ordered, so what is taken holds no circle; a round is one aggregate and two joins.
    """
    fields = ("inst", "sort", "a", "b", "kind", "iface", "record")
    order = F.struct((F.col("kind") != "interface").alias("later"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), *fields)
    left = pairs.where("a != b").select(node("a").alias("u"), node("b").alias("v"), order.alias("e"))
    left, tree = stored(left.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("e").alias("e")), "left"), []
    while True:
        both = left.select(F.col("u").alias("c"), "u", "v", "e").union(left.select("v", "u", "v", "e"))
        taken, (count,) = stored_with(both.groupBy("c").agg(F.min(F.struct("e", "u", "v")).alias("m")).select("m.e", "m.u", "m.v").distinct(), "taken")
        if not count:
            break
        tree.append(taken)
        of = components(taken, "u", "v")
        named = left.join(of.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u").join(of.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v")
        before = left
        left = stored(named.where("cu != cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"), "e"), "left")
        discard(before)
    rows = union(tree) if tree else taken
    return rows.select("e.inst", "e.sort", "e.a", "e.b", "e.kind", "e.iface", "e.record")


def unjustified(diagram: Diagram, tree: DataFrame, alike: DataFrame | None) -> DataFrame:
    """Edges that neither are an interface's pair nor, after elimination (keys in alike), join records of one key."""
    ends = [F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")]
    given = identifications(diagram).select("inst", "sort", "iface", F.col("rid").alias("record"), *ends)
    wrong = tree.where("kind = 'interface'").withColumns({"lo": ends[0], "hi": ends[1]}).join(given, ["inst", "sort", "iface", "record", "lo", "hi"], "left_anti").select("inst")
    other = tree.where("kind != 'interface' OR kind IS NULL")
    if alike is None:
        return wrong.unionByName(other.select("inst"))
    for end in ("a", "b"):
        other = other.join(alike.select("inst", "sort", F.col("tag").alias(end), F.col("key").alias(f"key_{end}")), ["inst", "sort", end], "left")
    return wrong.unionByName(other.where("coalesce(kind != 'duplicate' OR key_a != key_b, true)").select("inst"))


def violations(diagram: Diagram, qmap: DataFrame, tables: dict[str, DataFrame], tree: DataFrame, deduplicated: bool) -> DataFrame:
    """inst, check, n: what doesn't hold of a class map, its quotient tables and its forest, a row for each check that finds something.

    forest_generates counts trees that hold several classes and classes that lie in several trees.
    """
    found: list[tuple[str, DataFrame]] = []
    every = tags(diagram).select("inst", "sort", "tag")
    mapped = qmap.select("inst", "sort", "tag", "cid")
    found += [("tags_total", every.join(mapped, ["inst", "sort", "tag"], "left_anti")), ("tags_total", mapped.join(every, ["inst", "sort", "tag"], "left_anti"))]
    tabled = union([tables[s].select("inst", F.lit(s).alias("sort"), F.col("rid").alias("cid")) for s in SORTS])
    named = mapped.select("inst", "sort", "cid").distinct()
    found += [("classes_tabled", named.join(tabled, ["inst", "sort", "cid"], "left_anti")), ("classes_tabled", tabled.distinct().join(named, ["inst", "sort", "cid"], "left_anti"))]
    alike = stored(keys(diagram, qmap), "keys") if deduplicated else None
    found.append(("forest_justified", unjustified(diagram, tree, alike)))
    trees = components(tree.select(node("a").alias("a"), node("b").alias("b")))
    grown = mapped.withColumn("node", node("tag")).join(trees, "node", "left").withColumn("tree", F.coalesce("component", "node"))
    grown = stored(grown.select("inst", "sort", "cid", "tree").distinct(), "grown")
    found += [("forest_generates", grown.groupBy("inst", "tree").count().where("count > 1")), ("forest_generates", grown.groupBy("inst", "sort", "cid").count().where("count > 1"))]
    held = diagram.spans.join(diagram.faces, ["inst", "iface"])
    for side in ("left", "right"):
        held = held.join(qmap.select("inst", "sort", F.col("module").alias(side), F.col("rid").alias(f"{side}_rid"), F.col("cid").alias(f"{side}_cid")), ["inst", "sort", side, f"{side}_rid"])
    found.append(("interfaces_respected", held.where("left_cid != right_cid")))
    if alike is not None:
        found.append(("duplicates_merged", alike.join(mapped, ["inst", "sort", "tag"]).groupBy("inst", "sort", "key").agg(F.countDistinct("cid").alias("n")).where("n > 1")))
    for s in SORTS:
        columns = ["inst", "rid", *ATTRIBUTES[s], *ARROWS[s]]
        rows = arrows_to_classes(diagram, qmap, s).withColumn("rid", F.col("cid")).select(*columns).distinct()
        found += [("rows_descend", rows.exceptAll(tables[s].select(*columns).distinct()))]
    causes = edges(tables, ["inst"])
    ranks = levels(causes, tables["Var"].select("inst", "rid"), ["inst"])
    for column in ("cause", "effect"):
        causes = causes.join(ranks.select("inst", F.col("rid").alias(column), F.col("level").alias(f"{column}_rank")), ["inst", column], "left")
    found.append(("ranks_ascend", causes.where("NOT coalesce(cause_rank < effect_rank, false)")))
    counted = union([rows.select("inst", F.lit(name).alias("check")) for name, rows in found])
    return counted.groupBy("inst", "check").agg(F.count(F.lit(1)).alias("n"))


def failure_witnesses(tables: dict[str, DataFrame]) -> DataFrame:
    """inst, kind, subject, records, others: records that show a failure of a closed model.

    missing_owner: the variable. duplicate_owner: its mechanisms, with their codes. duplicate_input: the Inputs of a mechanism
    at a position, which is in others. cycle: a closed path of variables, with an Input behind each edge.
    """
    none = F.array().cast("array<string>")
    owners = tables["Mech"].groupBy("inst", F.col("output").alias("rid")).agg(F.array_sort(F.collect_list(F.struct("rid", "code"))).alias("m"))
    owned = tables["Var"].where("role = 'endo'").select("inst", "rid").join(owners, ["inst", "rid"], "left")
    missing = owned.where("m IS NULL").select("inst", F.lit("missing_owner").alias("kind"), F.col("rid").alias("subject"), F.array("rid").alias("records"), none.alias("others"))
    twice = owned.where("size(m) > 1").select("inst", F.lit("duplicate_owner").alias("kind"), F.col("rid").alias("subject"), F.col("m.rid").alias("records"), F.col("m.code").alias("others"))
    slots = tables["Input"].groupBy("inst", "mech", "pos").agg(F.array_sort(F.collect_list("rid")).alias("records")).where("size(records) > 1")
    again = slots.select("inst", F.lit("duplicate_input").alias("kind"), F.col("mech").alias("subject"), "records", F.array(F.col("pos").cast("string")).alias("others"))
    loops = cycle_witnesses(tables, ["inst"]).select("inst", F.lit("cycle").alias("kind"), F.col("path")[0].alias("subject"), F.col("path").alias("records"), F.col("inputs").alias("others"))
    return union([missing, twice, again, loops])


def refuted(witnesses: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The witnesses that the tables don't bear out; kinds that have no check are refuted."""
    rows = stored(witnesses.withColumn("key", F.monotonically_increasing_id()), "witnesses")
    mech, slots = tables["Mech"], tables["Input"]
    endo = tables["Var"].where("role = 'endo'").select("inst", F.col("rid").alias("subject"))
    owned = mech.select("inst", F.col("output").alias("subject")).distinct()
    bare = rows.where("kind = 'missing_owner'").join(endo, ["inst", "subject"], "left_semi").join(owned, ["inst", "subject"], "left_anti").select("key")

    def borne(kind: str, parts: DataFrame, columns: list[str], truth: DataFrame, least: int) -> DataFrame:
        """Keys of witnesses of a kind all of whose parts (key, columns) are rows of truth, with at least so many distinct ones."""
        held = parts.join(truth.distinct(), columns, "left_semi").groupBy("key").agg(F.countDistinct(*columns).alias("n"))
        wanted = rows.where(F.col("kind") == kind).select("key", F.size(F.array_distinct("records")).alias("distinct"), F.size("records").alias("size"))
        size = F.col("size") - 1 if kind == "cycle" else F.col("distinct")
        return held.join(wanted, "key").where((F.col("n") == size) & (F.col("n") >= least)).select("key")

    def each(kind: str) -> DataFrame:
        return rows.where(F.col("kind") == kind).select("inst", "key", "subject", "records", "others", F.posexplode("records").alias("at", "rid"))

    of = each("duplicate_owner").select("inst", "key", "rid", F.col("subject").alias("output"), F.try_element_at("others", F.col("at") + 1).alias("code"))
    owners = borne("duplicate_owner", of, ["inst", "rid", "output", "code"], mech.select("inst", "rid", "output", "code"), 2)
    at = each("duplicate_input").select("inst", "key", "rid", F.col("subject").alias("mech"), F.try_element_at("others", F.lit(1)).alias("pos"))
    inputs = borne("duplicate_input", at, ["inst", "rid", "mech", "pos"], slots.select("inst", "rid", "mech", F.col("pos").cast("string").alias("pos")), 2)
    closed = rows.where("kind = 'cycle' AND size(records) >= 2 AND records[0] = try_element_at(records, -1) AND size(others) = size(records) - 1")
    steps = closed.select("inst", "key", "records", F.posexplode("others").alias("at", "rid"))
    steps = steps.select("inst", "key", "rid", F.try_element_at("records", F.col("at") + 1).alias("var"), F.try_element_at("records", F.col("at") + 2).alias("effect"))
    truth = slots.select("inst", "rid", "var", "mech").join(mech.select("inst", F.col("rid").alias("mech"), F.col("output").alias("effect")), ["inst", "mech"]).select("inst", "rid", "var", "effect")
    loops = borne("cycle", steps, ["inst", "rid", "var", "effect"], truth, 1)
    return rows.join(union([bare, owners, inputs, loops]), "key", "left_anti").select(*witnesses.columns)


def interface_witnesses(diagram: Diagram) -> DataFrame:
    """inst, kind, iface, side, sort, record, field: attributes that an interface record and its image don't share, and arrows that don't commute with a map."""
    found = []
    for side in ("left", "right"):
        legs = diagram.spans.join(diagram.faces, ["inst", "iface"]).select("inst", "iface", "sort", "rid", F.col(side).alias("module"), F.col(f"{side}_rid").alias("image"))
        for s in SORTS:
            columns = [*ATTRIBUTES[s], *ARROWS[s]]
            image = diagram.records[s].select("inst", "module", F.col("rid").alias("image"), *[F.col(c).alias(f"image_{c}") for c in columns])
            both = legs.where(F.col("sort") == s).join(diagram.overlaps[s].select("inst", "iface", "rid", *columns), ["inst", "iface", "rid"]).join(image, ["inst", "module", "image"])

            def add(rows: DataFrame, kind: str, field: str) -> None:
                found.append(rows.select("inst", F.lit(kind).alias("kind"), "iface", F.lit(side).alias("side"), "sort", F.col("rid").alias("record"), F.lit(field).alias("field")))

            for c in ATTRIBUTES[s]:
                add(both.where(~F.col(c).eqNullSafe(F.col(f"image_{c}"))), "attribute_mismatch", c)
            for c, to in ARROWS[s].items():
                over = legs.where(F.col("sort") == to).select("inst", "iface", F.col("rid").alias(c), F.col("image").alias("over"))
                add(both.join(over, ["inst", "iface", c], "left").where(~F.col("over").eqNullSafe(F.col(f"image_{c}"))), "naturality", c)
    return union(found)


def refuted_interface(witnesses: DataFrame, diagram: Diagram) -> DataFrame:
    """The interface witnesses that the diagram doesn't bear out: values and images are looked up in one table of fields."""
    def fields(tables: dict[str, DataFrame], owner: str, value: str) -> DataFrame:
        parts = []
        for s in SORTS:
            pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in (*ATTRIBUTES[s], *ARROWS[s])])).alias("f")
            parts.append(tables[s].select("inst", owner, F.lit(s).alias("sort"), "rid", pairs).select("inst", owner, "sort", F.col("rid"), "f.field", F.col("f.value").alias(value)))
        return union(parts)

    arrows = [(s, c, to) for s in SORTS for c, to in ARROWS[s].items()]
    legs = diagram.spans.join(diagram.faces, ["inst", "iface"])
    legs = union([legs.select("inst", "iface", F.lit(side).alias("side"), "sort", F.col("rid").alias("record"), F.col(side).alias("module"), F.col(f"{side}_rid").alias("image")) for side in ("left", "right")])
    rows = stored(witnesses.withColumn("key", F.monotonically_increasing_id()), "witnesses")
    own = fields(diagram.overlaps, "iface", "own").withColumnRenamed("rid", "record")
    image = fields(diagram.records, "module", "other").withColumnRenamed("rid", "image")
    seen = rows.join(legs, ["inst", "iface", "side", "sort", "record"]).join(own, ["inst", "iface", "sort", "record", "field"]).join(image, ["inst", "module", "sort", "image", "field"])
    differ = ~F.col("own").eqNullSafe(F.col("other"))
    plain = seen.where((F.col("kind") == "attribute_mismatch") & differ).join(F.broadcast(literal(rows.sparkSession, [(s, c) for s in SORTS for c in ATTRIBUTES[s]], "sort string, field string")), ["sort", "field"], "left_semi").select("key")
    # Arrows: the image of the record that the arrow names, under the same map, against the arrow of the image.
    to = F.broadcast(literal(rows.sparkSession, arrows, "sort string, field string, to string"))
    over = legs.select("inst", "iface", "side", F.col("sort").alias("to"), F.col("record").alias("own"), F.col("image").alias("over"))
    squares = seen.where("kind = 'naturality'").join(to, ["sort", "field"]).join(over, ["inst", "iface", "side", "to", "own"], "left")
    torn = squares.where(~F.col("over").eqNullSafe(F.col("other"))).select("key")
    return rows.join(plain.union(torn), "key", "left_anti").select(*witnesses.columns)
