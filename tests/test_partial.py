"""Libraries as tables: faults as rows, and evaluation where truth rows are missing."""

import random
from itertools import product

import pytest

from causeway.functions.mechanisms import Library
from causeway.functions.partial import LibraryTables, undefined
from causeway.operators import evaluation, topology
from tests.test_evaluation import CODES, model

GONE = {("AND", (1, 0)), ("XOR3", (1, 1, 1)), ("NOT", (0,)), ("ONE", ())}


def without(spark, gone):
    whole = LibraryTables.of(Library(), spark)
    rows = [(c, list(a), v) for c, (_, _, t) in Library().codes.items() for a, v in t.items() if (c, a) not in gone]
    return LibraryTables(whole.codes, whole.signatures, spark.createDataFrame(rows, "code string, args array<int>, value int"))


def test_whole_library_has_no_faults(spark):
    whole = LibraryTables.of(Library(), spark)
    assert whole.faults().count() == 0
    assert whole.library().codes == Library().codes


def test_faults(spark):
    got = {(r["kind"], r["code"], r["record"]) for r in without(spark, GONE).faults().collect()}
    assert got == {("missing_row", c, ",".join(map(str, a))) for c, a in GONE}
    whole = LibraryTables.of(Library(), spark)
    more = spark.createDataFrame([("ID", [1], 1), ("ID", [0], 1), ("AND", [1], 1), ("AND", None, 1), ("OR", [2, 0], 1), (None, [0], 0), ("X", [0], 0), ("X", [1], 0)], "code string, args array<int>, value int")
    twice = LibraryTables(whole.codes, whole.signatures, whole.truth.unionByName(more))
    got = sorted((r["kind"], str(r["code"]), r["record"]) for r in twice.faults().collect())
    assert got == [("conflicting_rows", "ID", "0"), ("foreign_row", "AND", ""), ("foreign_row", "AND", "1"), ("foreign_row", "OR", "2,0"), ("undeclared_code", "None", ""), ("undeclared_code", "X", "")]
    kept = twice.library().codes
    assert (0,) not in kept["ID"][2] and kept["ID"][2] == {(1,): 1} and {c: t for c, t in kept.items() if c != "ID"} == {c: t for c, t in Library().codes.items() if c != "ID"}
    empty = LibraryTables(whole.codes.limit(0), whole.signatures.limit(0), whole.truth.limit(0))
    assert empty.faults().count() == 0 and empty.library().codes == {}


@pytest.mark.parametrize(("exogenous", "rows"), [(4, 100_000), (7, 3)])
def test_partial_evaluation(spark, monkeypatch, exogenous, rows):
    """Values under a partial library against plain evaluation, in one cell and in many; who lacks a row of its own is told apart."""
    monkeypatch.setattr(topology, "CELL_ROWS", rows)
    rng = random.Random(exogenous)
    names, equations = [f"U{i:02d}" for i in range(exogenous)], [("A", "ZERO", []), ("B", "ONE", [])]
    for i in range(14):
        code = rng.choice(list(CODES))
        equations.append((f"V{i}", code, [rng.choice([*names, *(e[0] for e in equations)]) for _ in range(CODES[code])]))
    _, tables = model(spark, exogenous, equations)
    values = evaluation.evaluate_tables(tables, without(spark, GONE).library())
    spans = values.sparkSession.createDataFrame([("i", b, -1 if exogenous > 5 else (1 << 2**exogenous) - 1) for b in range(max(1, 2**exogenous // 64))], "inst string, block long, everything long")
    held = {(r["var"], r["block"], r["value"]): r["mask"] & (2**64 - 1) for r in values.collect()}
    found = {(r["var"], r["block"]): (r["lacking"] & (2**64 - 1), r["asked"] & (2**64 - 1)) for r in undefined(tables, values, spans).collect()}
    codes, lacked = Library().codes, 0
    for a, digits in enumerate(product((0, 1), repeat=exogenous)):
        known = dict(zip(names, digits[::-1]))
        for out, code, args in equations:
            given = tuple(known[x] for x in args)
            own = None not in given and (code, given) in GONE
            known[out] = None if None in given or own else codes[code][2][given]
            block, bit = divmod(a, 64)
            for x in (0, 1):
                assert (held.get((out, block, x), 0) >> bit & 1) == (known[out] == x)
            lacking, asked = found.get((out, block), (0, 0))
            assert (lacking >> bit & 1, asked >> bit & 1) == (known[out] is None, own)
            lacked += known[out] is None
    assert lacked
