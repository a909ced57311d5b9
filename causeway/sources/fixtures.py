"""Small diagnostic diagrams in equation form: instance ids F01 to F19, and the expected outcome of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from causeway.functions.mechanisms import Library
from causeway.operators.diagram import Diagram, common_spans, from_equations, overlaps_from_left
from causeway.plans.storage import literal, stored

ALL = ("Var", "Mech", "Input", "Dep")


def model(endo: str, equations: dict[str, tuple], exo: str = "", boundary: str = "", tri: str = "") -> dict:
    return {"exo": exo.split(), "endo": endo.split(), "eq": equations, "boundary": boundary.split(), "tri": tri.split()}


ID_U = model("Y", {"Y": ("ID", "U")}, "U")
AND_UW = model("Y", {"Y": ("AND", "u", "w")}, "u w")
DO_XY = model("X Y", {"X": ("DO::X::1",), "Y": ("DO::Y::0",)}, "U")

# Modules, interfaces (left, right, sorts by common ids, or pairs by sort), expected validity raw and
# deduplicated. F14 and F15 are given after the surgery that they are about.
SPECS: dict[str, tuple[dict[str, dict], list[tuple], bool, bool]] = {
    "F01": ({"upstream": model("X Y", {"X": ("ID", "UX"), "Y": ("XOR", "X", "UY")}, "UX UY"), "downstream": model("Y Z", {"Z": ("XOR", "Y", "UZ")}, "UZ", "Y")}, [("upstream", "downstream", ALL, {})], True, True),
    "F02": ({"unfilled": model("Y", {}, "", "Y")}, [], False, False),
    "F03": ({"a": model("Y", {"Y": ("ZERO",)}), "b": model("Y", {"Y": ("ZERO",)})}, [("a", "b", ("Var",), {})], False, True),
    "F04": ({"a": ID_U, "b": ID_U}, [("a", "b", ("Var", "Mech", "Dep"), {})], False, True),
    "F05": ({"a": ID_U, "b": model("Y", {"Y": ("NOT", "U")}, "U")}, [("a", "b", ("Var",), {})], False, False),
    "F06": ({"a": model("X Y", {"Y": ("ID", "X")}, "", "X"), "b": model("X Y", {"X": ("ID", "Y")}, "", "Y")}, [("a", "b", ("Var",), {})], False, False),
    "F07": ({"a": model("", {}, "x"), "b": model("", {}, "x", "", "x")}, [("a", "b", ("Var",), {})], False, False),
    "F08": ({"a": ID_U, "b": model("Y", {"Y": ("NOT", "U")}, "U")}, [("a", "b", ("Var", "Mech"), {})], False, False),
    "F09": ({"a": AND_UW, "b": AND_UW}, [("a", "b", ("Var", "Mech"), {"Input": [("p:Y:1", "p:Y:2")]})], False, False),
    "F10": ({"a": ID_U, "b": ID_U, "c": ID_U}, [("a", "b", ALL, {}), ("b", "c", ALL, {})], True, True),
    "F11": ({"local": model("C", {"C": ("AND", "a", "b")}, "a b"), "noise": model("", {}, "c")}, [("local", "noise", (), {"Var": [("a", "c")]}), ("local", "noise", (), {"Var": [("b", "c")]})], True, True),
    "F12": ({"repeat": model("Y", {"Y": ("XOR", "X", "X")}, "X")}, [], True, True),
    "F13": ({"ordered": model("Y", {"Y": ("AND_NOT", "X", "U")}, "X U")}, [], True, True),
    "F14": ({"a": DO_XY, "b": DO_XY}, [("a", "b", ALL, {})], True, True),
    "F15": ({"a": model("Y", {"Y": ("DO::Y::0",)}, "U"), "b": ID_U}, [("a", "b", ("Var", "Mech"), {})], False, False),
    "F16": ({"a": ID_U, "b": model("Y", {"Y": ("ID", "W")}, "W")}, [("a", "b", ("Var",), {})], False, False),
    "F17": ({"a": ID_U, "b": model("Y", {"Y": ("ID_ALIAS", "U")}, "U")}, [("a", "b", ("Var",), {})], False, False),
    "F18": ({"typed": model("Z W", {"Z": ("BOOL_TO_TRI", "B"), "W": ("TRI_ID", "T")}, "B T", "", "T Z W")}, [], True, True),
    "F19": ({"same": model("C", {"C": ("AND", "a", "b")}, "a b")}, [("same", "same", (), {"Var": [("a", "b")]})], True, True),
}


def library() -> Library:
    return Library().with_constants({"X": ("bool", 1)}).with_constants({"Y": ("bool", 0)})


def expected(spark: SparkSession) -> DataFrame:
    """fid, raw, deduplicated."""
    return literal(spark, [(f, raw, dedup) for f, (_, _, raw, dedup) in SPECS.items()], "fid string, raw boolean, deduplicated boolean")


def diagram(spark: SparkSession, only: tuple[str, ...] | None = None) -> Diagram:
    """All fixtures as one diagram with an instance each."""
    variables, equations, faces, allowed, given = [], [], [], [], []
    for fid, (modules, interfaces, _, _) in SPECS.items():
        if only and fid not in only:
            continue
        for name, m in modules.items():
            for role in ("exo", "endo"):
                variables += [(fid, name, v, "tri" if v in m["tri"] else "bool", role, v in m["boundary"]) for v in m[role]]
            equations += [(fid, name, out, code, list(args)) for out, (code, *args) in m["eq"].items()]
        for k, (left, right, sorts, pairs) in enumerate(interfaces):
            faces.append((fid, f"i{k}", left, right))
            allowed += [(fid, f"i{k}", s) for s in sorts]
            given += [(fid, f"i{k}", s, f"o:{s}:{a}", a, b) for s, ps in pairs.items() for a, b in ps]
    records = from_equations(
        literal(spark, variables, "inst string, module string, rid string, type string, role string, is_boundary boolean"),
        literal(spark, equations, "inst string, module string, output string, code string, args array<string>"),
    )
    records = {s: stored(t, s) for s, t in records.items()}
    face_table = literal(spark, faces, "inst string, iface string, left string, right string")
    spans = common_spans(records, face_table, literal(spark, allowed, "inst string, iface string, sort string"))
    spans = spans.unionByName(literal(spark, given, "inst string, iface string, sort string, rid string, left_rid string, right_rid string"))
    spans = stored(spans, "spans")
    return Diagram(records, face_table, spans, overlaps_from_left(records, face_table, spans))
