"""Evaluation without limits of width or depth, generated models, and the checks over them."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from causeway.functions.mechanisms import Library
from causeway.operators import assembly, evaluation, reports, semantics, topology, validation
from causeway.operators.diagram import from_equations
from causeway.plans.registry import EXOGENOUS
from causeway.sources import fixtures, generated

CODES = {"ZERO": 0, "ONE": 0, "ID": 1, "NOT": 1, "AND": 2, "OR": 2, "XOR": 2, "AND_NOT": 2, "XOR3": 3, "MAJ3": 3}


def model(spark, exogenous, equations):
    names = [f"U{i:02d}" for i in range(exogenous)]
    var = [("i", "g", v, "bool", "exo", False) for v in names] + [("i", "g", out, "bool", "endo", False) for out, _, _ in equations]
    rows = [("i", "g", out, code, args) for out, code, args in equations]
    tables = from_equations(spark.createDataFrame(var, "inst string, module string, rid string, type string, role string, is_boundary boolean"), spark.createDataFrame(rows, "inst string, module string, output string, code string, args array<string>"))
    return names, {s: t.drop("module") for s, t in tables.items()}


def plain(names, equations, assignment):
    known, codes = dict(zip(names, assignment)), Library().codes
    for out, code, args in equations:
        known[out] = codes[code][2][tuple(known[a] for a in args)]
    return known


@pytest.mark.parametrize(("exogenous", "rows"), [(6, 100_000), (6, 1), (7, 100_000), (7, 3), (10, 100_000)])
def test_many_assignments(spark, monkeypatch, exogenous, rows):
    monkeypatch.setattr(topology, "CELL_ROWS", rows)
    rng = random.Random(exogenous)
    names, equations = [f"U{i:02d}" for i in range(exogenous)], [("A", "ZERO", []), ("B", "ONE", [])]
    for i in range(12):
        code = rng.choice(list(CODES))
        equations.append((f"V{i}", code, [rng.choice([*names, *(e[0] for e in equations)]) for _ in range(CODES[code])]))
    _, tables = model(spark, exogenous, equations)
    got = {(r["var"], r["block"]): r["mask"] & (2**64 - 1) for r in evaluation.evaluate_tables(tables, Library()).where("value = 1").collect()}
    for a, digits in enumerate(product((0, 1), repeat=exogenous)):
        for v, x in plain(names, equations, digits[::-1]).items():
            assert got[v, a // 64] >> (a % 64) & 1 == x


@pytest.mark.parametrize("rows", [100_000, 1500])
def test_deep_chain(spark, monkeypatch, rows):
    """A chain of 10,000 negations is evaluated and ordered in one pass, or in a round for each cell."""
    monkeypatch.setattr(topology, "CELL_ROWS", rows)
    folds = []
    monkeypatch.setattr(topology, "fold_with", lambda *a, whole=topology.fold_with: folds.append(1) or whole(*a))
    equations = [("V0", "NOT", ["U00"]), *((f"V{i}", "NOT", [f"V{i - 1}"]) for i in range(1, 10_000))]
    _, tables = model(spark, 1, equations)
    got = {r["var"]: (r["mask"], r["level"]) for r in evaluation.evaluate_tables(tables, Library()).where("value = 1").collect()}
    assert all(got[f"V{i}"] == (1 if i % 2 == 0 else 2, i + 1) for i in range(10_000))
    assert len(folds) <= 1 if rows > 10_000 else 7 <= len(folds) <= 9
    ranks = validation.levels(validation.edges(tables, ["inst"]), tables["Var"].select("inst", "rid"), ["inst"])
    assert {r["rid"]: r["level"] for r in ranks.collect()} == {"U00": 0, **{f"V{i}": i + 1 for i in range(10_000)}}


@pytest.mark.parametrize("rows", [100_000, 2, 1])
def test_levels_in_cells(spark, monkeypatch, rows):
    monkeypatch.setattr(topology, "CELL_ROWS", rows)
    found = spark.createDataFrame([("i", "a", "b"), ("i", "b", "c"), ("i", "a", "c"), ("i", "d", "e"), ("i", "e", "d"), ("i", "e", "f"), ("i", "gone", "g"), ("i", "a", "nowhere"), (None, "a", "b")], "inst string, cause string, effect string")
    nodes = spark.createDataFrame([("i", x) for x in "abcdefg"] + [(None, "b"), (None, "a")], "inst string, rid string")
    want = {("i", "a"): 0, ("i", "b"): 1, ("i", "c"): 2, ("i", "g"): 0, (None, "a"): 0, (None, "b"): 1}
    assert {(r["inst"], r["rid"]): r["level"] for r in validation.levels(found, nodes, ["inst"]).collect()} == want


@pytest.mark.parametrize("rows", [100_000, 1])
def test_owners_that_come_late(spark, monkeypatch, rows):
    """Y owned by ZERO and by ID(B) two steps later: it has both values, and Z after it, wherever cells are cut and however rows lie."""
    monkeypatch.setattr(topology, "CELL_ROWS", rows)
    equations = [("Z", "ID", ["Y"]), ("Y", "ZERO", []), ("Y", "ID", ["B"]), ("B", "NOT", ["A"]), ("A", "ID", ["U00"]), ("W", "ID", ["X"]), ("X", "ONE", []), ("X", "ID", ["X2"]), ("X2", "ID", ["X2"])]
    for order in (equations, equations[::-1]):
        mech = spark.createDataFrame([("i", f"m{i}", code, out) for i, (out, code, _) in enumerate(order)], "inst string, rid string, code string, output string")
        slots = spark.createDataFrame([("i", f"m{i}", 1, a) for i, (_, _, args) in enumerate(order) for a in args], "inst string, mech string, pos int, var string")
        start = spark.createDataFrame([("i", "U00", 0, 1, 3), ("i", "U00", 1, 2, 3)], "inst string, var string, value int, mask long, everything long")
        got = {(r["var"], r["value"]): (r["mask"], r["level"]) for r in evaluation.evaluate(mech, slots, start, Library()).collect()}
        assert got[("B", 1)] == (1, 2) and got[("Y", 0)] == (3, 3) and got[("Y", 1)] == (1, 3)
        assert got[("Z", 0)] == (3, 4) and got[("Z", 1)] == (1, 4)
        assert not {v for v, _ in got} & {"X", "W", "X2"}  # an owner of X waits for a cycle


@pytest.mark.parametrize("rows", [100_000, 4])
def test_forced_values_and_faulty_owners_in_cells(spark, monkeypatch, rows):
    """Interventions on bits in models of any size; unknown codes, gaps and repeats in positions, blocks without values."""
    monkeypatch.setattr(topology, "CELL_ROWS", rows)
    rng = random.Random(3)
    names, equations = ["U00", "U01"], []
    for i in range(30):
        code = rng.choice(list(CODES))
        equations.append((f"V{i}", code, [rng.choice([*names, *(e[0] for e in equations[-4:])]) for _ in range(CODES[code])]))
    _, tables = model(spark, 2, equations)
    bad = [("i", "b1", "BOGUS", "X1"), ("i", "b2", "AND", "X2"), ("i", "b3", "AND", "X3"), ("i", "b4", "ID", "X4"), ("i", "b5", "NOT", "X5")]
    mech = tables["Mech"].select("inst", "rid", "code", "output").union(spark.createDataFrame(bad, "inst string, rid string, code string, output string"))
    more = [("i", "b2", 1, "U00"), ("i", "b2", 3, "U01"), ("i", "b3", 1, "U00"), ("i", "b3", 1, "U01"), ("i", "b4", 1, "X1"), ("i", "b5", 1, "U00")]
    slots = tables["Input"].select("inst", "mech", "pos", "var").union(spark.createDataFrame(more, "inst string, mech string, pos int, var string"))
    start = spark.createDataFrame([("i", 7, f"U0{i}", x, m, 15) for i, x, m in ((0, 0, 5), (0, 1, 10), (1, 0, 3), (1, 1, 12))], "inst string, block long, var string, value int, mask long, everything long")
    forced = spark.createDataFrame([("i", 7, "V5", 1, 6)], "inst string, block long, var string, value int, mask long")
    blocks = spark.createDataFrame([("i", 7, 15), ("i", 9, 15)], "inst string, block long, everything long")
    got = {(r["block"], r["var"]): r["mask"] for r in evaluation.evaluate(mech, slots, start, Library(), forced, blocks).where("value = 1").collect()}
    known, codes = {"U00": 10, "U01": 12}, Library().codes
    for out, code, args in equations:
        known[out] = sum(codes[code][2][tuple(known[a] >> u & 1 for a in args)] << u for u in range(4))
        if out == "V5":
            known[out] |= 6
    assert {v: m for (b, v), m in got.items() if b == 7} == known | {"X5": 5}
    constant = {v for v, _, args in equations if not args}
    assert constant <= {v for b, v in got if b == 9} and not {"U00", "X1", "X2", "X3", "X4", "X5"} & {v for b, v in got if b == 9}


def test_cycle_witness(spark):
    """A closed path, each edge of which its Input proves; no path where there is no cycle."""
    glued = assembly.assemble(fixtures.diagram(spark, ("F01", "F06")), deduplicate=True)
    (found,) = validation.cycle_witnesses(glued.tables, ["inst"]).collect()
    inputs = {r["rid"]: r for r in glued.tables["Input"].where("inst = 'F06'").collect()}
    mechs = {r["rid"]: r for r in glued.tables["Mech"].where("inst = 'F06'").collect()}
    assert found["inst"] == "F06" and len(found["path"]) == 3 and found["path"][0] == found["path"][-1]
    for a, b, i in zip(found["path"], found["path"][1:], found["inputs"]):
        assert inputs[i]["var"] == a and mechs[inputs[i]["mech"]]["output"] == b


def test_generated_diagrams(spark):
    """Owners are shared out evenly, copies are as many as asked, and modules and interfaces have no issues."""
    grid = reports.small_grid(spark).where("n = 8 AND seed < 2")
    diagram, origin = generated.fragmented(grid, generated.equations(grid, EXOGENOUS), EXOGENOUS)
    assert validation.diagram_issues(diagram, Library()).count() == 0
    held = origin["Mech"].join(grid, "inst").groupBy("inst", "m", "copies").agg(F.countDistinct("ground").alias("own"), F.count(F.lit(1)).alias("all"), F.countDistinct("module").alias("modules")).collect()
    assert len(held) == 24 and all(r["own"] == 8 and r["all"] == 8 + 8 * r["copies"] // 100 and r["modules"] == r["m"] for r in held)


def test_broken_module_alone(spark):
    """A structurally broken module doesn't silence the checks of another one of its instance."""
    whole = fixtures.diagram(spark, ("F02", "F05"))
    var = whole.records["Var"]
    extra = spark.createDataFrame([("F02", "broken", "x", None, "exo", False)], var.schema)
    found = validation.diagram_issues(type(whole)(whole.records | {"Var": var.unionByName(extra).unionByName(spark.createDataFrame([("F02", "alone", "y", "bool", "endo", False)], var.schema))}, whole.faces, whole.spans, whole.overlaps), Library())
    assert {(r["kind"], r["record"]) for r in found.collect()} == {("missing_attribute", "x.type"), ("missing_owner", "y")}


def test_shallow_models_are_folded_by_ranks(spark, monkeypatch):
    """Each item of a shallow model beyond a cell is folded in one round, its own, not in every round that has news for its cell; small models beside it stay whole."""
    monkeypatch.setattr(topology, "CELL_ROWS", 20)
    seen = []
    monkeypatch.setattr(topology, "filled", lambda rows, kind, whole=topology.filled: (kind == 1 and seen.append(rows.count())) or whole(rows, kind))
    rng = random.Random(5)
    names, equations = ["U00", "U01"], []
    for i in range(120):
        code = rng.choice(list(CODES))
        equations.append((f"V{i}", code, [rng.choice([*names, *(e[0] for e in equations)]) for _ in range(CODES[code])]))
    _, tables = model(spark, 2, equations[::-1])
    small = {s: t.withColumn("inst", F.lit("small")).where(F.regexp_extract("rid", r"V(\d+)", 1).try_cast("int").isNull() | (F.regexp_extract("rid", r"V(\d+)", 1).try_cast("int") < 10)) for s, t in tables.items()}
    both = {s: t.unionByName(small[s]) for s, t in tables.items()}
    got = {(r["inst"], r["var"]): r["mask"] for r in evaluation.evaluate_tables(both, Library()).where("value = 1").collect()}
    known, codes = {"U00": 10, "U01": 12}, Library().codes
    for out, code, args in equations:
        known[out] = sum(codes[code][2][tuple(known[a] >> u & 1 for a in args)] << u for u in range(4))
    want = {("i", v): m for v, m in known.items()} | {("small", v): m for v, m in known.items() if v[0] == "U" or int(v[1:]) < 10}
    assert got == want
    assert len(seen) > 3 and sum(seen) == 130


def test_all_blocks_of_a_model_are_folded_at_once(spark):
    """A row for each item, however many blocks: 2n + 1 scenarios of 16 assignments give what the fold of single blocks gives."""
    grid = spark.createDataFrame([(8, 2, 25, "chain", 1), (16, 2, 0, "layered", 2), (32, 4, 25, "random_acyclic", 3)], "n int, m int, copies int, family string, seed int")
    tables = generated.ground(generated.equations(grid, EXOGENOUS), EXOGENOUS, ("Mech", "Input"))
    models = grid.select(F.concat_ws("_", "family", "n", "seed").alias("inst"), "n")
    want = semantics.expected(tables, semantics.scenarios(models), EXOGENOUS, Library())
    got = semantics.expected_whole(tables, models, EXOGENOUS, Library())
    assert got.count() == 56 + 3 * EXOGENOUS
    blocks = got.select("inst", F.posexplode("bits").alias("block", "bits"), "ground").select("inst", F.col("block").cast("long"), "ground", "bits")
    assert blocks.exceptAll(want).count() == want.exceptAll(blocks).count() == 0


def test_variables_that_whole_folds_leave_out(spark):
    """Places out of order, a cycle and an unknown code leave a variable and what follows without a row; owners of a free variable don't count; two owners give both values; a forced variable is set where it is said."""
    mech = spark.createDataFrame([("i", f"m{v}", c, v) for v, c in (("A", "ID"), ("B", "ID"), ("C", "ID"), ("D", "ODD"), ("E", "NOT"), ("U", "ZERO"), ("Y", "ZERO"), ("Y2", "ID"))] + [("i", "again", "ONE", "Y")], "inst string, rid string, code string, output string")
    slots = spark.createDataFrame([("i", "mA", 2, "U"), ("i", "mB", 1, "C"), ("i", "mC", 1, "B"), ("i", "mE", 1, "U"), ("i", "mY2", 1, "Y")], "inst string, mech string, pos int, var string")
    spans = spark.createDataFrame([("i", [-1, 3])], "inst string, bits array<long>")
    given = spark.createDataFrame([("i", 0, "U", [1 << 62, 1], None), ("i", 2, "E", [0, 1], [-(1 << 63), 0])], "inst string, kind int, var string, bits array<long>, clear array<long>")
    got = {r["var"]: r["bits"] for r in evaluation.evaluate_whole(mech, slots, spans, given, Library()).collect()}
    assert got == {"U": [1 << 62, 1], "E": [(1 << 62) - 1, 3], "Y": [-1, 3], "Y2": [-1, 3]}
