"""Keeps the exact law of facts about texts up to date, and what a structural model says of them under interventions.

    python -m jobs.text_laws --documents DIR --output OUT --checkpoint CHECKPOINT [--config FILE]

Each text is an assignment of the model's exogenous variables: the config names a Spark SQL condition for each. A file
stream with a checkpoint takes the files that are new, counts assignments by group (a column of the table) and writes them
to OUT/counts, a partition for each batch; a batch that is run again after a failure replaces its own partition. Then all
counts together are each group's law, and the modules of the config, glued and checked, turn it into exact probabilities
of every variable under no and each intervention: OUT/answers, partitioned by scenario and replaced as a whole.

A run without new files changes nothing, and runs over growing input end as one run over all of it. A condition that is
null counts as false; null is a group of its own. Files are taken once, by name: rewriting one doesn't count it anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.mechanisms import Library, fraction
from causeway.operators import assembly, evaluation, validation
from causeway.operators.diagram import Diagram, from_equations, overlaps_from_left
from causeway.plans.storage import literal, stored
from jobs.common import command_line, log, write


def counted(texts: DataFrame, settings: dict) -> DataFrame:
    """grp, u_mask, n: assignments by group; bit i of u_mask is the i-th fact by name."""
    bits = [F.when(F.expr(text), 1 << i).otherwise(0) for i, (_, text) in enumerate(sorted(settings["facts"].items()))]
    mask = sum(bits[1:], bits[0])
    return texts.select(F.col(settings["group"]).cast("string").alias("grp"), mask.alias("u_mask")).groupBy("grp", "u_mask").agg(F.count(F.lit(1)).alias("n"))


def take_new(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict) -> int:
    """Counts of files not yet taken, as partitions of output/counts; the number of texts in them."""
    taken = 0

    def batch(texts: DataFrame, number: int) -> None:
        nonlocal taken
        found = stored(counted(texts, settings), "counts")
        rows = found.agg(F.sum("n")).first()[0] or 0
        # The batch's own partition is replaced, others stay.
        found.withColumn("batch", F.lit(number).cast("long")).coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/counts")
        log.info("batch %d: %d texts from %s", number, rows, documents)
        taken += rows

    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", settings["files_per_batch"]).parquet(documents)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return taken


def glued_model(spark: SparkSession, settings: dict) -> dict[str, DataFrame]:
    """The tables of the config's modules, glued along variables of equal names; a faulty model is an error. Its size is that of the config."""
    rows = [("model", m, f"{m}_{v}", code, [f"{m}_{a}" for a in args]) for m, eqs in settings["modules"].items() for v, (code, *args) in eqs.items()]
    held = {m: {*eqs, *(a for _, *args in eqs.values() for a in args)} for m, eqs in settings["modules"].items()}
    first = next(iter(held))
    held[first] |= set(settings["facts"])
    exo = set(settings["facts"])
    var = [("model", m, f"{m}_{v}", "bool", "exo" if v in exo else "endo", v not in exo and v not in settings["modules"][m]) for m, vs in held.items() for v in sorted(vs)]
    records = from_equations(literal(spark, var, "inst string, module string, rid string, type string, role string, is_boundary boolean"), literal(spark, rows, "inst string, module string, output string, code string, args array<string>"))
    pairs = [(a, b) for a in held for b in held if a < b]
    faces = literal(spark, [("model", f"{a}-{b}", a, b) for a, b in pairs], "inst string, iface string, left string, right string")
    spans = literal(spark, [("model", f"{a}-{b}", "Var", f"o:{v}", f"{a}_{v}", f"{b}_{v}") for a, b in pairs for v in sorted(held[a] & held[b])], "inst string, iface string, sort string, rid string, left_rid string, right_rid string")
    diagram = Diagram(records, faces, spans, overlaps_from_left(records, faces, spans))
    glued = assembly.assemble(diagram, deduplicate=True)
    issues = validation.diagram_issues(diagram, Library()).unionByName(validation.model_issues(glued.tables, Library(), ["inst"], "assembled", closed=True))
    found = [f"{r['kind']} {r['record']}" for r in issues.limit(5).collect()]
    if found:
        raise ValueError("the model of the config is faulty: " + ", ".join(found))
    return glued.tables


def inputs(var: DataFrame, settings: dict) -> DataFrame:
    """inst, var, value, mask, everything: the i-th fact by name holds in the assignments whose bit i is set."""
    facts = sorted(settings["facts"])
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    rows = [(f, x, signed(sum(1 << u for u in range(1 << len(facts)) if (u >> i & 1) == x)), signed((1 << (1 << len(facts))) - 1)) for i, f in enumerate(facts) for x in (0, 1)]
    masks = F.broadcast(literal(var.sparkSession, rows, "name string, value int, mask long, everything long"))  # two rows a fact
    return var.withColumn("name", F.substring_index("rid", "_", -1)).join(masks, "name").select("inst", F.col("rid").alias("var"), "value", "mask", "everything")


def answers(spark: SparkSession, counts: DataFrame, settings: dict) -> DataFrame:
    """scenario, grp, var, texts, ones, p: how many of a group's texts give each endogenous variable the value 1, and that share as a reduced fraction."""
    tables = glued_model(spark, settings)
    name = F.substring_index("rid", "_", -1)
    scenarios = [("observed", None, None), *((f"do_{v}_{x}", v, x) for v, x in settings["interventions"])]
    library = Library()
    for v, x in settings["interventions"]:
        library = library.with_constants({v: ("bool", x)})
    copies = {s: t.withColumn("inst", F.explode(F.array(*[F.lit(n) for n, _, _ in scenarios]))) for s, t in tables.items()}
    hits = literal(spark, [(n, v, f"DO::{v}::{x}") for n, v, x in scenarios if v], "inst string, name string, code string")
    targets = tables["Var"].select(F.col("rid").alias("var"), name.alias("name")).join(hits, "name").select("inst", "var", "code")
    changed = evaluation.intervene(copies, targets)
    values = evaluation.evaluate(changed["Mech"], changed["Input"], inputs(copies["Var"], settings), library)
    ones = values.where("value = 1 AND level > 0").select(F.col("inst").alias("scenario"), F.substring_index("var", "_", -1).alias("var"), "mask")
    law = counts.groupBy("grp", "u_mask").agg(F.sum("n").alias("n"))
    joined = law.join(F.broadcast(ones))  # a row for each scenario and variable of the config
    hit = F.call_function("getbit", F.col("mask"), F.col("u_mask"))
    found = joined.groupBy("scenario", "grp", "var").agg(F.sum("n").alias("texts"), F.sum(hit * F.col("n")).alias("ones"))
    return found.select("scenario", "grp", "var", "texts", "ones", fraction(F.col("ones"), F.col("texts")).alias("p"))


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict) -> dict[str, int]:
    """Takes what is new at documents and brings output/answers up to date; texts taken and rows written."""
    if len(settings["facts"]) > 6:
        raise ValueError("more than 6 facts: assignments don't fit one block of 64 bits")
    taken = take_new(spark, documents, output, checkpoint, settings)
    counts = spark.read.schema("grp string, u_mask int, n long, batch long").parquet(f"{output}/counts")
    return {"taken": taken, "answers": write(answers(spark, counts, settings), f"{output}/answers", ("scenario",))}


if __name__ == "__main__":
    paths = {"documents": "folder of Parquet files with texts, or a pattern of files or folders (a stream takes no single file)", "output": "folder of counts and answers", "checkpoint": "folder of the stream's checkpoint"}
    command_line("text_laws", __file__, paths, lambda spark, given, settings: run(spark, given.documents, given.output, given.checkpoint, settings) and None)
