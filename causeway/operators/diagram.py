"""Models as tables. Every table has `inst` first, so that one plan works on all instances together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns besides inst and module: rid, attributes, arrows (column -> sort it points to).
ATTRIBUTES = {"Var": ("type", "role"), "Mech": ("code",), "Input": ("pos",), "Dep": ()}
ARROWS = {"Var": {}, "Mech": {"output": "Var"}, "Input": {"mech": "Mech", "var": "Var"}, "Dep": {"cause": "Var", "effect": "Var"}}
SORTS = tuple(ATTRIBUTES)


@dataclass(frozen=True)
class Diagram:
    """records: by sort, (inst, module, rid, attributes, arrows), Var with is_boundary.

    faces: inst, iface, left, right. spans: inst, iface, sort, rid, left_rid, right_rid. overlaps: by sort, the
    interfaces' own records (inst, iface, rid, attributes, arrows). What tables can't show is given beside them, where a
    source has it: names, the name a module gives itself (inst, module, name); maps, the sorts of each map (inst, iface,
    side, sort); strays, boundary ids that no Var has (inst, module, rid).
    """

    records: dict[str, DataFrame]
    faces: DataFrame
    spans: DataFrame
    overlaps: dict[str, DataFrame]
    names: DataFrame | None = None
    maps: DataFrame | None = None
    strays: DataFrame | None = None

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Diagram:
        """The diagram with every table changed alike."""
        by_sort = lambda tables: {s: change(t) for s, t in tables.items()}
        return Diagram(by_sort(self.records), change(self.faces), change(self.spans), by_sort(self.overlaps), *(t if t is None else change(t) for t in (self.names, self.maps, self.strays)))

    def only(self, sorts: tuple[str, ...]) -> Diagram:
        """The diagram with interfaces on these sorts alone."""
        return replace(self, spans=self.spans.where(F.col("sort").isin(*sorts)), overlaps={s: d.where(F.lit(s in sorts)) for s, d in self.overlaps.items()})

    def renamed(self, inst: F.Column) -> Diagram:
        """The diagram under other instance names; an exploded array of names makes a copy for each."""
        return self.each(lambda t: t.withColumn("inst", inst))

    def among(self, chosen: DataFrame, suffix: str) -> Diagram:
        """The instances in chosen (inst), under their names with a suffix."""
        return self.each(lambda t: t.join(chosen.select("inst").distinct(), "inst", "left_semi").withColumn("inst", F.concat("inst", F.lit(suffix))))

    def beside(self, other: Diagram) -> Diagram:
        """Both diagrams' instances; names must differ."""
        by_sort = lambda a, b: {s: a[s].unionByName(b[s]) for s in a}
        return Diagram(by_sort(self.records, other.records), self.faces.unionByName(other.faces), self.spans.unionByName(other.spans), by_sort(self.overlaps, other.overlaps), *(b if a is None else a if b is None else a.unionByName(b) for a, b in ((self.names, other.names), (self.maps, other.maps), (self.strays, other.strays))))


def from_equations(variables: DataFrame, equations: DataFrame) -> dict[str, DataFrame]:
    """Record tables from variables (inst, module, rid, type, role, is_boundary) and equations (inst, module, output, code, args).

    One Mech an equation, one Input and one Dep an argument, repeated arguments kept.
    """
    slots = equations.select("inst", "module", "output", F.posexplode("args").alias("p", "arg")).withColumn("pos", F.col("p") + 1)
    return {
        "Var": variables.select("inst", "module", "rid", "type", "role", "is_boundary"),
        "Mech": equations.select("inst", "module", F.concat(F.lit("m:"), "output").alias("rid"), "code", "output"),
        "Input": slots.select("inst", "module", F.concat(F.lit("p:"), "output", F.lit(":"), "pos").alias("rid"), "pos", F.concat(F.lit("m:"), "output").alias("mech"), F.col("arg").alias("var")),
        "Dep": slots.select("inst", "module", F.concat(F.lit("d:"), "output", F.lit(":"), "pos").alias("rid"), F.col("arg").alias("cause"), F.col("output").alias("effect")),
    }


def overlaps_from_left(records: dict[str, DataFrame], faces: DataFrame, spans: DataFrame) -> dict[str, DataFrame]:
    """Interface records: attributes and arrows of the left image, arrows mapped back through the left leg."""
    out = {}
    for sort in SORTS:
        own = spans.where(F.col("sort") == sort).join(faces, ["inst", "iface"])
        image = records[sort].drop("is_boundary").withColumnsRenamed({"module": "left", "rid": "left_rid"})
        found = own.join(image, ["inst", "left", "left_rid"])
        for column, to in ARROWS[sort].items():
            leg = spans.where(F.col("sort") == to).select("inst", "iface", F.col("left_rid").alias(column), F.col("rid").alias("__to"))
            found = found.join(leg, ["inst", "iface", column], "left").withColumn(column, F.col("__to")).drop("__to")
        out[sort] = found.select("inst", "iface", "rid", *ATTRIBUTES[sort], *ARROWS[sort])
    return out


def common_spans(records: dict[str, DataFrame], faces: DataFrame, allowed: DataFrame) -> DataFrame:
    """Spans from equal ids in both modules, for the (inst, iface, sort) in allowed."""
    parts = []
    for sort in SORTS:
        ids = records[sort].select("inst", "module", "rid")
        left, right = ids.withColumnRenamed("module", "left"), ids.withColumnRenamed("module", "right")
        wanted = allowed.where(F.col("sort") == sort).join(faces, ["inst", "iface"])
        both = wanted.join(left, ["inst", "left"]).join(right, ["inst", "right", "rid"])
        parts.append(both.select("inst", "iface", "sort", F.concat(F.lit(f"o:{sort}:"), "rid").alias("rid"), F.col("rid").alias("left_rid"), F.col("rid").alias("right_rid")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
