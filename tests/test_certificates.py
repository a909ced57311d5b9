"""Forests and witnesses on small cases, and issues that only a document can show."""

import json

from causeway.operators import assembly, certificates, validation
from causeway.operators.diagram import SORTS
from causeway.plans.storage import literal
from causeway.sources import exchange, fixtures

PAIR = "inst string, sort string, a string, b string, kind string, iface string, record string"


def pair(a, b, kind="interface", inst="i"):
    return (inst, "Var", f"t{a:03}", f"t{b:03}", kind, None, None)


def test_forest_joins_all_without_circles(spark):
    path = [pair(i * 17 % 40, (i + 1) * 17 % 40) for i in range(39)]
    circle = [pair(i, (i + 1) % 6, inst="c") for i in range(6)]
    both = [pair(0, 1, "duplicate", "d"), pair(1, 0, "interface", "d"), pair(1, 2, "duplicate", "d"), pair(2, 2, "interface", "d")]
    found = certificates.forest(literal(spark, path + circle + both + both, PAIR)).collect()
    sizes = {i: sum(r["inst"] == i for r in found) for i in "icd"}
    assert sizes == {"i": 39, "c": 5, "d": 2}
    assert sorted(r["kind"] for r in found if r["inst"] == "d") == ["duplicate", "interface"]
    assert not certificates.forest(literal(spark, [], PAIR)).count()


def test_sound_certificates_of_fixtures(spark):
    whole = fixtures.diagram(spark, ("F01", "F03", "F10", "F11", "F12", "F19"))
    for dedup in (False, True):
        glued = assembly.assemble(whole, dedup)
        tree = certificates.forest(certificates.evidence(whole, glued.qmap, dedup))
        assert certificates.violations(whole, glued.qmap, glued.tables, tree, dedup).count() == 0


def test_witnesses(spark):
    glued = assembly.assemble(fixtures.diagram(spark, ("F02", "F04", "F05", "F06")), deduplicate=False)
    found = certificates.failure_witnesses(glued.tables)
    assert {(r["inst"], r["kind"]) for r in found.collect()} == {("F02", "missing_owner"), ("F04", "duplicate_input"), ("F05", "duplicate_owner"), ("F06", "cycle")}
    assert certificates.refuted(found, glued.tables).count() == 0
    assert certificates.refuted(found.selectExpr("inst", "'other' AS kind", "subject", "records", "others"), glued.tables).count() == 4
    whole = fixtures.diagram(spark, ("F07", "F08", "F09"))
    against = certificates.interface_witnesses(whole)
    assert {(r["inst"], r["kind"]) for r in against.collect()} == {("F07", "attribute_mismatch"), ("F08", "attribute_mismatch"), ("F09", "attribute_mismatch"), ("F09", "naturality")}
    assert certificates.refuted_interface(against, whole).count() == 0


def test_issues_that_only_a_document_shows(spark):
    document = json.loads(exchange.documents(fixtures.diagram(spark, ("F01",))).first()["document"])
    document["modules"]["upstream"]["name"] = "other"
    document["modules"]["upstream"]["boundary"] = ["nowhere"]
    face = document["interfaces"][0]
    del face["left_map"]["Dep"]
    face["right_map"]["Var"]["unasked"] = "Z"
    rows = spark.createDataFrame([("i", json.dumps(document))], "inst string, document string")
    found = validation.diagram_issues(exchange.diagram_of(rows), fixtures.library()).collect()
    assert sorted((r["kind"], r["record"]) for r in found) == [("boundary_definition", "nowhere"), ("map_sorts", "i0.left"), ("map_totality", "i0.right.Var"), ("object_name", "upstream")]
    assert set(SORTS) == set(face["right_map"])
