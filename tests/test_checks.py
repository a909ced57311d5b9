"""Independent components, interventions as worlds, partitions without labels, releases and their manifests, on small cases."""

import hashlib
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from causeway.operators import assembly, interventions, reports
from causeway.operators.components import components, components_by_minima
from causeway.sources import fixtures, release


def test_both_algorithms_find_the_components(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)] + [("hub", f"s{i}") for i in range(40)]
    edges += [(None, "n1"), ("n2", None), ("n3", "n3"), edges[0]]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    want = {x: root(x) for x in up}
    df = spark.createDataFrame(edges, "a string, b string")
    for algorithm in (components, components_by_minima):
        assert {r["node"]: r["component"] for r in algorithm(df).collect()} == want
        assert algorithm(df.limit(0)).count() == 0


def test_stars_take_no_round(spark, monkeypatch):
    """Pairs that form stars, as copies in two modules do, are written once; a chain takes rounds."""
    from causeway.operators import components as module

    written, real = [], module.stored
    monkeypatch.setattr(module, "stored", lambda *a: written.append(1) or real(*a))
    stars = [("a", "b"), ("c", "a"), ("x", "y"), ("x", "y"), (None, "x")]
    assert {tuple(r) for r in components(spark.createDataFrame(stars, "a string, b string")).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert len(written) == 1
    assert {r["component"] for r in components(spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)], "a string, b string")).collect()} == {"n0"}
    assert len(written) > 2


def glued_example(spark):
    diagram = fixtures.diagram(spark, ("F01",))
    glued = assembly.assemble(diagram, deduplicate=True)
    named = glued.tables["Var"].select("inst", F.col("rid").alias("cid"), F.substring_index("rid", "|", -1).alias("ground"))
    return diagram, glued, named


def test_interventions_on_the_running_example(spark):
    """X, Y and Z set to 0 and 1: one model before and after gluing, with the values that follow; a wrong value and a lost copy show."""
    diagram, glued, named = glued_example(spark)
    planned = interventions.worlds(glued, named).cache()
    assert {(r["target"], r["value"]) for r in planned.collect()} == {(v, x) for v in "XYZ" for x in (0, 1)}
    flaws, again = interventions.isomorphism(diagram, glued, planned, True)
    assert flaws.count() == 0 and again.count() == 6
    free = glued.tables["Var"].where("role = 'exo'").select("inst", F.col("rid").alias("var"), F.substring_index("rid", "|", -1).alias("u"))
    masks = spark.createDataFrame([(u, x, m if x else 255 ^ m, 255) for u, m in (("UX", 0xAA), ("UY", 0xCC), ("UZ", 0xF0)) for x in (0, 1)], "u string, value int, mask long, everything long")
    values = interventions.values_in_worlds(glued, planned, free.join(masks, "u").drop("u"), again)
    got = {(r["world"].split("#", 1)[1], r["cid"].split("|")[1]): r["bits"] for r in values.collect()}
    for v in "XYZ":
        for x in (0, 1):
            want = {"UX": 0xAA, "UY": 0xCC, "UZ": 0xF0}
            want["X"] = want["UX"] if v != "X" else 255 * x
            want["Y"] = want["X"] ^ want["UY"] if v != "Y" else 255 * x
            want["Z"] = want["Y"] ^ want["UZ"] if v != "Z" else 255 * x
            assert {k: got[f"{v}#{x}", k] for k in want} == want
    wrong, _ = interventions.isomorphism(diagram, glued, planned, True, early=1 - F.col("value"))
    assert wrong.count() == 6
    lost, _ = interventions.isomorphism(diagram, glued, planned, True, missed=planned.select("world", F.lit("downstream").alias("module")))
    assert {r["world"].split("#")[1] for r in lost.collect()} >= {"Z"}


def test_worlds_share_the_mechanisms_of_their_model(spark, monkeypatch):
    """All worlds of a model are one fold with a row for each mechanism; a world without code has no values."""
    diagram, glued, named = glued_example(spark)
    planned = interventions.worlds(glued, named).cache()
    sizes, real = [], interventions.settled_whole
    monkeypatch.setattr(interventions, "settled_whole", lambda items, *rest: sizes.append(items.count()) or real(items, *rest))
    start = glued.tables["Var"].where("role = 'exo'").select("inst", F.col("rid").alias("var"), F.explode(F.array(F.lit(0), F.lit(1))).alias("value"), F.lit(1).cast("long").alias("everything"))
    start = start.withColumn("mask", F.when(F.col("value") == 0, 1).otherwise(0).cast("long"))
    codes = planned.where("NOT (target = 'Y' AND value = 1)").select("world", interventions.code_of(F.col("value")).alias("code"))
    got = {(r["world"].split("#", 1)[1], r["cid"].split("|")[1]): r["bits"] for r in interventions.values_in_worlds(glued, planned, start, codes).collect()}
    assert sizes == [3] and {w for w, _ in got} == {"X#0", "X#1", "Y#0", "Z#0", "Z#1"} and len(got) == 5 * 6
    assert [got[w, "Z"] for w in ("X#0", "X#1", "Y#0", "Z#0", "Z#1")] == [0, 1, 0, 0, 1]


def test_partition_digests_ignore_names_and_order(spark):
    diagram, glued, _ = glued_example(spark)
    digest = lambda qmap: {(r["sort"], r["digest"]) for r in reports.partition_digests(qmap).collect()}
    want = digest(glued.qmap)
    assert digest(glued.qmap.withColumn("cid", F.md5("cid")).orderBy(F.rand(3))) == want
    apart = glued.qmap.withColumn("cid", F.when((F.col("sort") == "Var") & F.endswith("tag", F.lit("|Y")), F.col("tag")).otherwise(F.col("cid")))
    assert {s for s, _ in want - digest(apart)} == {"Var"}
    joined = glued.qmap.withColumn("cid", F.when(F.col("sort") == "Mech", F.lit("one")).otherwise(F.col("cid")))
    assert {s for s, _ in want - digest(joined)} == {"Mech"}
    shuffled = replace(diagram, records={s: t.repartition(5).orderBy(F.rand(1)) for s, t in diagram.records.items()})
    assert digest(assembly.assemble(shuffled, deduplicate=True).qmap) == want


def test_release_in_shards(spark, tmp_path):
    """Files are as they were written, one shard is replaced without the others, a scan of one shard reads its folder, and what identifies someone shows."""
    folder = str(tmp_path / "release")
    rows = [("chain", 2, seed, k, f"V{k}", "ZERO" if k == 0 else "ID", [] if k == 0 else ["V0"]) for seed in (0, 49, 50, 120) for k in (0, 1)]
    lines = release.lines_of(spark.createDataFrame(rows, "family string, n int, seed int, k int, output string, code string, args array<string>"))
    release.write_shards(lines, folder)
    text = lambda *seeds: "".join(f"chain n2 seed{s} V0 = ZERO()\nchain n2 seed{s} V1 = ID(V0)\n" for s in seeds)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    first = {r["shard"]: tuple(r)[1:] for r in release.manifest(spark, folder).collect()}
    assert first == {s: (len(t), sha(t), False) for s, t in {0: text(0, 49), 1: text(50), 2: text(120)}.items()}
    release.write_shards(lines.where("shard = 1").withColumn("line", F.lit("Mail to SOMEONE@Example.ORG")), folder)
    again = {r["shard"]: tuple(r)[1:] for r in release.manifest(spark, folder).collect()}
    assert {s: r for s, r in again.items() if s != 1} == {s: r for s, r in first.items() if s != 1} and again[1][2]
    one = release.read_shards(spark, folder).where("shard = 2")
    assert [r["line"] for r in one.collect()] == text(120).splitlines()
    assert "shard" in (plan := one._jdf.queryExecution().executedPlan().toString())[plan.index("PartitionFilters") : plan.index("PushedFilters")]


@pytest.mark.parametrize("line", ["/home/x", "see /Users/a", "C:\\Users\\me", "a.b@c.de"])
def test_each_sign_of_a_person_is_found(spark, tmp_path, line):
    release.write_shards(spark.createDataFrame([(0, 0, "f", 1, 0, line), (1, 60, "f", 1, 0, "V0 = ID(U0) at home")], "shard long, seed int, family string, n int, k int, line string"), str(tmp_path / "r"))
    assert {r["shard"]: r["identifying"] for r in release.manifest(spark, str(tmp_path / "r")).collect()} == {0: True, 1: False}


def test_class_maps_are_found_once_and_quotients_not_at_all(spark, monkeypatch):
    """Sizes of classes need no quotient table, and variants share the closure of their identifications."""
    from causeway.plans import registry, storage

    labels = []
    monkeypatch.setattr(storage, "written", lambda df, label, whole=storage.written: labels.append(label) or whole(df, label))
    assert registry.QUERIES["quotient_sizes"](spark, "/root/testdata/sf0.001").count() == 16
    assert labels.count("qmap") == 5 and not [x for x in labels if x.startswith("quotient-")]


def test_correspondence_of_classes_and_ground_records(spark):
    """x has two ground records, A two classes, D none, and E is not asked for; records without origin belong to a class all the same."""
    held = [("Var", "x", "A"), ("Var", "x", "B"), ("Var", "x", "B"), ("Var", "y", "A"), ("Var", "z", "E"), ("Var", "v", "E"), ("Var", "w", None), ("Mech", "x", "A")]
    target = [("Var", g) for g in "ABD"] + [("Mech", "A")]
    found = reports.correspondence(spark.createDataFrame(held, "sort string, cid string, ground string"), spark.createDataFrame(target, "sort string, ground string"))
    assert {r["sort"]: (r["classes"], r["ambiguous"], r["doubled"], r["missing"]) for r in found.collect()} == {"Var": (5, 1, 1, 1), "Mech": (1, 0, 0, 0)}


def test_surgeries_share_a_gluing_and_an_evaluation(spark, monkeypatch):
    """The diagram is glued once before its surgeries, with no copy of it written, and both sides are evaluated at once."""
    from causeway.plans import registry, storage

    labels = []
    monkeypatch.setattr(storage, "written", lambda df, label, whole=storage.written: labels.append(label) or whole(df, label))
    assert registry.QUERIES["commutation"](spark, "/root/testdata/sf0.001").count() == 9
    assert labels.count("copies") == labels.count("settled") == 1
