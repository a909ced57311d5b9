"""Exchange files: what is read equals what was written."""

import json

from causeway.functions.mechanisms import Library
from causeway.operators import assembly
from causeway.sources import derived, exchange, fixtures


def test_documents_roundtrip(spark, tmp_path):
    whole = fixtures.diagram(spark, ("F01", "F02", "F11", "F18"))
    exchange.write_documents(exchange.documents(whole), str(tmp_path / "d"), compressed=True)
    rows = exchange.read_documents(spark, str(tmp_path / "d"))
    again = exchange.diagram_of(rows)
    found = {r["part"]: r for r in exchange.differing(whole, again).collect()}
    assert found["records_Var"]["n"] > 0 and found["spans"]["n"] > 0
    assert not any(r["differing"] for r in found.values())
    one = {r["inst"]: json.loads(r["document"]) for r in rows.collect()}
    assert one["F02"]["interfaces"] == [] and one["F02"]["modules"]["unfilled"]["boundary"] == ["Y"]
    assert one["F01"]["modules"]["upstream"]["tables"]["Mech"]["m:X"] == {"code": "ID", "output": "X"}


def test_lines_roundtrip(spark, tmp_path):
    whole = fixtures.diagram(spark, ("F01", "F18"))
    exchange.write_lines(whole, str(tmp_path / "d"))
    assert not any(r["differing"] for r in exchange.differing(whole, exchange.read_lines(spark, str(tmp_path / "d"))).collect())


def test_certificates(spark):
    whole = fixtures.diagram(spark, ("F01", "F02", "F05", "F06"))
    glued = assembly.assemble(whole, deduplicate=True)
    one = {r["inst"]: json.loads(r["document"]) for r in exchange.certificates(whole, glued, fixtures.library(), "deduplicated").collect()}
    assert {i: c["valid"] for i, c in one.items()} == {"F01": True, "F02": False, "F05": False, "F06": False}
    found = one["F01"]
    assert sorted(found["rank"].values()) == list(range(6)) and len(found["tables"]["Mech"]) == 3 and found["witnesses"] == []
    assert found["forest"] == [{"sort": "Var", "a": "upstream|Y", "b": "downstream|Y", "evidence": {"kind": "interface", "interface": "i0", "record": "o:Var:Y"}}]
    mech = {m["rid"]: m["output"] for m in found["tables"]["Mech"]}
    assert all(found["rank"][x["var"]] < found["rank"][mech[x["mech"]]] for x in found["tables"]["Input"])
    assert one["F06"]["rank"] == {} and {x["kind"] for x in one["F06"]["issues"]} == {"cycle"}
    assert {i: [w["kind"] for w in one[i]["witnesses"]] for i in ("F02", "F05", "F06")} == {"F02": ["missing_owner"], "F05": ["duplicate_owner"], "F06": ["cycle"]}


def test_not_a_document(spark):
    rows = spark.createDataFrame([("a", "no document"), ("b", None), ("c", "{}")], "inst string, document string")
    assert sum(r["n"] for r in exchange.differing(exchange.diagram_of(rows), exchange.diagram_of(rows)).collect()) == 0


def test_library_roundtrip():
    assert exchange.library_of(exchange.library_document(Library())).codes == Library().codes


def test_csv_roundtrip(spark, tmp_path):
    rows = [(1, 'say "a, b"', 0.5), (2, "", None), (3, None, 1.0), (4, "two\nlines", 2.0)]
    schema = "n int, name string, x double"
    exchange.write_csv(spark.createDataFrame(rows, schema), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in exchange.read_csv(spark, str(tmp_path / "c"), schema, multiline=True).collect()) == [rows[0], (2, None, None), *rows[2:]]


def test_large_diagrams_go_in_volumes(spark):
    """No document holds more than its share, and nothing is lost or doubled; an instance of one volume stays one."""
    whole = derived.diagram(spark, "/root/testdata/sf0.001")
    rows = sum(t.count() for name, t in exchange.parts(whole).items() if name != "faces")
    texts = exchange.documents(exchange.in_volumes(whole, rows // 5)).cache()
    assert sorted(r["inst"] for r in texts.collect()) == [f"derived#{i}" for i in range(6)]
    sizes = [len(r["document"]) for r in texts.collect()]
    assert max(sizes) < sum(sizes) / 3
    back = exchange.from_volumes(exchange.diagram_of(texts))
    assert all(r["differing"] == 0 and r["n"] > 0 for r in exchange.differing(whole, back).collect())
    assert exchange.documents(exchange.in_volumes(whole)).count() == 1
