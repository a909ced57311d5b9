"""Models and measurements in files for exchange: JSON documents of diagrams and libraries, lines of records, CSV.

A document holds a whole instance in one text, as its format demands, so a large diagram goes in volumes: documents of its
parts, each with all interfaces and a bounded share of the records. Lines, a record each, suit any model, too.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from causeway.functions.mechanisms import DOMAINS, Library
from causeway.operators import certificates as proofs
from causeway.operators import validation
from causeway.operators.assembly import Assembly
from causeway.operators.diagram import ARROWS, ATTRIBUTES, SORTS, Diagram
from causeway.plans.storage import stored

FIELDS = {s: tuple(sorted((*ATTRIBUTES[s], *ARROWS[s]))) for s in SORTS}
KEPT_NULLS = {"ignoreNullFields": "false"}


def kind(field: str) -> str:
    return "int" if field == "pos" else "string"


def by_sort(inner: dict[str, str]) -> str:
    return "struct<" + ", ".join(f"{s}: map<string, {inner[s]}>" for s in sorted(SORTS)) + ">"


DESCRIPTION = f"struct<boundary: array<string>, name: string, tables: {by_sort({s: 'struct<' + ', '.join(f'{f}: {kind(f)}' for f in FIELDS[s]) + '>' for s in SORTS})}>"
LEGS = by_sort({s: "string" for s in SORTS})
DOCUMENT = f"struct<interfaces: array<struct<description: {DESCRIPTION}, left: string, left_map: {LEGS}, name: string, right: string, right_map: {LEGS}>>, modules: map<string, {DESCRIPTION}>>"


def by_name(a: Column, b: Column) -> Column:
    return F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)


def entries(condition: Column, *columns: str) -> Column:
    """A map from the first column to the second over the rows of a group that meet the condition, keys in order."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.when(condition, F.struct(*columns)))))


def descriptions(tables: dict[str, DataFrame], owners: DataFrame, owner: str) -> DataFrame:
    """inst, owner, description for all owners, those without records included."""
    out = owners
    for sort in SORTS:
        rows = tables[sort].withColumn("fields", F.struct(*FIELDS[sort]))
        made = [entries(F.lit(True), "rid", "fields").alias(sort)]
        if sort == "Var":
            at = F.col("is_boundary") if "is_boundary" in rows.columns else F.lit(False)
            made.append(F.array_sort(F.collect_list(F.when(at, F.col("rid")))).alias("boundary"))
        out = out.join(rows.groupBy("inst", owner).agg(*made), ["inst", owner], "left")
    maps = [F.coalesce(s, F.create_map().cast(out.schema[s].dataType)).alias(s) for s in sorted(SORTS)]
    boundary = F.coalesce("boundary", F.array().cast("array<string>")).alias("boundary")
    return out.select("inst", owner, F.struct(boundary, F.col(owner).alias("name"), F.struct(*maps).alias("tables")).alias("description"))


#: Rows of a diagram's tables that one document holds, about, at 100 bytes of text each.
VOLUME_ROWS = 50_000
VOLUME = "#"


def in_volumes(diagram: Diagram, rows: int = VOLUME_ROWS) -> Diagram:
    """The diagram as instances of about so many rows, named with a number behind VOLUME: records are dealt by module and id, overlaps and spans by interface and id, and each volume has all faces."""
    tables = [(t, "module") for t in diagram.records.values()] + [(t, "iface") for t in (*diagram.overlaps.values(), diagram.spans)]
    sizes = validation.union([t.groupBy("inst").agg(F.count(F.lit(1)).alias("n")) for t, _ in tables]).groupBy("inst").agg(F.ceil(F.sum("n") / rows).cast("int").alias("volumes"))
    sizes = stored(sizes, "volumes")

    def named(t: DataFrame, volume: Column) -> DataFrame:
        return t.join(sizes, "inst").withColumn("volume", volume).withColumn("inst", F.concat_ws(VOLUME, "inst", "volume")).select(*t.columns)

    dealt = lambda t, owner: named(t, F.pmod(F.xxhash64(owner, "rid"), F.col("volumes")))
    by_sort = lambda tables, owner: {s: dealt(t, owner) for s, t in tables.items()}
    return Diagram(by_sort(diagram.records, "module"), named(diagram.faces, F.explode(F.sequence(F.lit(0), F.col("volumes") - 1))), dealt(diagram.spans, "iface"), by_sort(diagram.overlaps, "iface"))


def from_volumes(diagram: Diagram) -> Diagram:
    """The inverse of in_volumes()."""
    whole = diagram.renamed(F.regexp_replace("inst", f"{VOLUME}[0-9]+$", ""))
    return Diagram(whole.records, whole.faces.distinct(), whole.spans, whole.overlaps)


def documents(diagram: Diagram) -> DataFrame:
    """inst, document: each diagram as compact JSON with sorted keys. An id that a module or an overlap has twice is an error."""
    owners = None
    for sort in SORTS:
        own = diagram.records[sort].select("inst", "module")
        owners = own if owners is None else owners.unionByName(own)
    described = descriptions(diagram.records, owners.distinct(), "module")
    named = F.array_sort(F.collect_list(F.struct(F.col("module").alias("name"), "description")), by_name)
    modules = described.groupBy("inst").agg(F.map_from_entries(named).alias("modules"))
    overlaps = {s: d.select("inst", "iface", "rid", *FIELDS[s]) for s, d in diagram.overlaps.items()}
    faces = descriptions(overlaps, diagram.faces.select("inst", "iface"), "iface").join(diagram.faces, ["inst", "iface"])
    sides = [F.struct(*[entries((F.col("sort") == s) & F.col(f"{side}_rid").isNotNull(), "rid", f"{side}_rid").alias(s) for s in sorted(SORTS)]).alias(f"{side}_map") for side in ("left", "right")]
    faces = faces.join(diagram.spans.groupBy("inst", "iface").agg(*sides), ["inst", "iface"], "left")
    bare = F.struct(*[F.create_map().cast("map<string, string>").alias(s) for s in sorted(SORTS)])
    faces = faces.withColumns({f"{side}_map": F.coalesce(f"{side}_map", bare) for side in ("left", "right")})
    face = F.struct("description", "left", "left_map", F.col("iface").alias("name"), "right", "right_map")
    interfaces = faces.groupBy("inst").agg(F.array_sort(F.collect_list(face), by_name).alias("interfaces"))
    both = modules.join(interfaces, "inst", "left").withColumn("interfaces", F.coalesce("interfaces", F.array().cast(interfaces.schema["interfaces"].dataType)))
    return both.select("inst", F.to_json(F.struct("interfaces", "modules"), KEPT_NULLS).alias("document"))


def described_records(rows: DataFrame, owner: str, sort: str) -> DataFrame:
    """Records of one sort from inst, owner, description."""
    found = rows.select("inst", owner, F.col("description.boundary").alias("boundary"), F.explode(f"description.tables.{sort}").alias("rid", "fields"))
    at = [F.coalesce(F.array_contains("boundary", F.col("rid")), F.lit(False)).alias("is_boundary")] if sort == "Var" and owner == "module" else []
    return found.select("inst", owner, "rid", *[F.col(f"fields.{f}").alias(f) for f in (*ATTRIBUTES[sort], *ARROWS[sort])], *at)


def diagram_of(rows: DataFrame) -> Diagram:
    """The diagram of inst, document. A text that isn't such a document gives no records; a missing boundary is empty."""
    parsed = rows.select("inst", F.from_json("document", DOCUMENT).alias("d"))
    modules = parsed.select("inst", F.explode("d.modules").alias("module", "description"))
    faces = parsed.select("inst", F.explode("d.interfaces").alias("f")).select("inst", F.col("f.name").alias("iface"), "f.left", "f.right", "f.description", "f.left_map", "f.right_map")
    spans = None
    for sort in SORTS:
        empty = F.create_map().cast("map<string, string>")
        legs = faces.select("inst", "iface", *[F.coalesce(f"{side}_map.{sort}", empty).alias(side) for side in ("left", "right")])
        legs = legs.select("*", F.explode(F.array_union(F.map_keys("left"), F.map_keys("right"))).alias("rid"))
        part = legs.select("inst", "iface", F.lit(sort).alias("sort"), "rid", *[F.try_element_at(side, F.col("rid")).alias(f"{side}_rid") for side in ("left", "right")])
        spans = part if spans is None else spans.unionByName(part)
    records = {s: described_records(modules, "module", s) for s in SORTS}
    names = modules.select("inst", "module", F.col("description.name").alias("name"))
    legs = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(s).alias("sort"), F.col(f"{side}_map.{s}").isNotNull().alias("given")) for side in ("left", "right") for s in SORTS])).alias("leg")
    maps = faces.select("inst", "iface", legs).where("leg.given").select("inst", "iface", "leg.side", "leg.sort")
    strays = modules.select("inst", "module", F.explode("description.boundary").alias("rid")).join(records["Var"].select("inst", "module", "rid"), ["inst", "module", "rid"], "left_anti")
    return Diagram(records, faces.select("inst", "iface", "left", "right"), spans, {s: described_records(faces, "iface", s) for s in SORTS}, names, maps, strays)


def certificates(diagram: Diagram, glued: Assembly, library: Library, mode: str) -> DataFrame:
    """inst, document: what is needed to check an assembly, as compact JSON with sorted keys.

    classes (tag and class of every record), forest (edges that join each class without a circle, each with its evidence: an
    interface's record, or equal keys), tables (rows of the quotient; members that disagree give several), issues, witnesses
    (records that show a failure), valid, mode (raw or deduplicated), and rank: each variable's place in an order where
    causes come first; variables on or after a cycle have none.
    """
    out = glued.qmap.select("inst").distinct()

    def add(rows: DataFrame, name: str, *columns: str) -> None:
        nonlocal out
        lists = rows.groupBy("inst").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(lists, "inst", "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))

    add(glued.qmap.withColumn("class", F.col("cid")), "classes", "sort", "tag", "class")
    tree = proofs.forest(proofs.evidence(diagram, glued.qmap, mode == "deduplicated"))
    add(tree.withColumn("evidence", F.struct("kind", F.col("iface").alias("interface"), "record")), "forest", "sort", "a", "b", "evidence")
    add(proofs.failure_witnesses(glued.tables), "witnesses", "kind", "subject", "records", "others")
    for sort in SORTS:
        add(glued.tables[sort], sort, "rid", *FIELDS[sort])
    add(validation.model_issues(glued.tables, library, ["inst"], "assembled", closed=True), "issues", "stage", "kind", "record")
    ranks = validation.levels(validation.edges(glued.tables, ["inst"]), glued.tables["Var"].select("inst", "rid"), ["inst"])
    place = F.row_number().over(Window.partitionBy("inst").orderBy("level", "rid")) - 1
    ranked = ranks.withColumn("rank", place).groupBy("inst").agg(entries(F.lit(True), "rid", "rank").alias("rank"))
    whole = out.join(ranked, "inst", "left").withColumn("rank", F.coalesce("rank", F.create_map().cast("map<string, int>")))
    tables = F.struct(*sorted(SORTS)).alias("tables")
    fields = F.struct("classes", "forest", "issues", F.lit(mode).alias("mode"), "rank", tables, (F.size("issues") == 0).alias("valid"), "witnesses")
    return whole.select("inst", F.to_json(fields, KEPT_NULLS).alias("document"))


def library_document(library: Library) -> str:
    """A library as compact JSON with sorted keys; it has as many rows as its finite tables."""
    codes = {c: {"signature": list(s), "output_type": o, "table": [{"args": list(a), "value": v} for a, v in t.items()]} for c, (s, o, t) in library.codes.items()}
    return json.dumps({"domains": {t: list(v) for t, v in DOMAINS.items()}, "codes": codes}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def library_of(document: str) -> Library:
    """The inverse of library_document(); declarations are checked as always."""
    out = Library([])
    for code, entry in json.loads(document)["codes"].items():
        table = {tuple(r["args"]): r["value"] for r in entry["table"]}
        out.declare(code, tuple(entry["signature"]), entry["output_type"], lambda *a, table=table: table[a])
    return out


def write_documents(rows: DataFrame, folder: str, compressed: bool = False) -> None:
    """inst, document as JSON lines, gzip if compressed."""
    rows.select("inst", "document").write.option("compression", "gzip" if compressed else "none").json(folder)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("inst string, document string").json(folder)


def write_lines(diagram: Diagram, folder: str, compressed: bool = False) -> None:
    """Every table of a diagram as JSON lines, a record each, in a folder of its own."""
    for name, table in parts(diagram).items():
        table.write.option("compression", "gzip" if compressed else "none").option("ignoreNullFields", "false").json(f"{folder}/{name}")


def read_lines(spark: SparkSession, folder: str) -> Diagram:
    def table(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).json(f"{folder}/{name}")

    def own(sort: str) -> str:
        return "rid string, " + ", ".join(f"{f} {kind(f)}" for f in (*ATTRIBUTES[sort], *ARROWS[sort]))

    records = {s: table(f"records_{s}", f"inst string, module string, {own(s)}" + ", is_boundary boolean" * (s == "Var")) for s in SORTS}
    overlaps = {s: table(f"overlaps_{s}", f"inst string, iface string, {own(s)}") for s in SORTS}
    faces = table("faces", "inst string, iface string, left string, right string")
    return Diagram(records, faces, table("spans", "inst string, iface string, sort string, rid string, left_rid string, right_rid string"), overlaps)


def parts(diagram: Diagram) -> dict[str, DataFrame]:
    found = {f"records_{s}": t for s, t in diagram.records.items()} | {f"overlaps_{s}": t for s, t in diagram.overlaps.items()}
    return found | {"faces": diagram.faces, "spans": diagram.spans}


def write_csv(df: DataFrame, folder: str) -> None:
    """Measurements as CSV with a header; quotes are doubled; null and an empty text both read back as null."""
    df.write.option("header", True).option("escape", '"').csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str, multiline: bool = False) -> DataFrame:
    """The inverse of write_csv(); multiline, which keeps a file in one task, is for texts with line ends."""
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multiline).csv(folder)


def differing(one: Diagram, other: Diagram) -> DataFrame:
    """part, n, differing: rows of each table of one, and rows that only one of both has, repeats counted."""
    out, others = None, parts(other)
    for name, table in parts(one).items():
        columns = table.columns
        both = table.select(*columns, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(others[name].select(*columns, F.lit(0).alias("a"), F.lit(1).alias("b")))
        sums = both.groupBy(*columns).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        part = sums.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.abs(F.col("a") - F.col("b"))), F.lit(0)).alias("differing")).select(F.lit(name).alias("part"), "n", "differing")
        out = part if out is None else out.unionByName(part)
    return out
