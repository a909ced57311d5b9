"""DuckDB SQL for the queries of the registry. Models are rebuilt and evaluated here by other means than in the operators:
variable by variable in the order of their indices, with lists of packed values."""

from __future__ import annotations

EQ = """
m AS (SELECT CAST(p_partkey AS BIGINT) AS k, CAST(p_size AS BIGINT) AS s, CAST(p_size % 10 AS INT) AS c FROM part),
eq AS (SELECT k, s, c, ['ZERO','ONE','ID','NOT','AND','OR','XOR','AND_NOT','XOR3','MAJ3'][c + 1] AS code, [0,0,1,1,2,2,2,2,3,3][c + 1] AS arity FROM m),
slot AS (SELECT k, c, code, p, (k * 31 + 17 + CASE WHEN k % 7 = 0 THEN 0 ELSE 17 * (p - 1) END + s * 7) % (4 + k) AS cause FROM eq, (VALUES (1), (2), (3)) t(p) WHERE p <= arity),
plan AS (SELECT eq.k, eq.c, max(cause) FILTER (WHERE p = 1) + 1 AS a1, max(cause) FILTER (WHERE p = 2) + 1 AS a2, max(cause) FILTER (WHERE p = 3) + 1 AS a3 FROM eq LEFT JOIN slot ON slot.k = eq.k GROUP BY eq.k, eq.c),
held AS (SELECT k, c, code, arity, CAST(k % 4 AS INT) AS o FROM eq UNION ALL SELECT k, c, code, arity, 1 FROM eq WHERE k % 12 = 0),
hslot AS (SELECT h.o, s.k, s.p, s.cause FROM held h JOIN slot s ON s.k = h.k),
hvar AS (SELECT o, v, max(own) AS own FROM (SELECT o, k + 4 AS v, 1 AS own FROM held UNION ALL SELECT o, cause, 0 FROM hslot UNION ALL SELECT 0, range, 0 FROM range(4)) GROUP BY o, v)
"""


def gate(kind: str, values: str) -> str:
    a, b, c = (f"{values}[plan.a{i}]" for i in (1, 2, 3))
    cases = ["0", "65535", a, f"xor({a}, 65535)", f"{a} & {b}", f"{a} | {b}", f"xor({a}, {b})", f"{a} & xor({b}, 65535)", f"xor(xor({a}, {b}), {c})", f"({a} & {b}) | ({a} & {c}) | ({b} & {c})"]
    return f"CASE {kind} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(cases)) + " END"


def run(name: str, forced: str = "") -> str:
    """A recursive table (n, vals) whose last row has every variable's packed value by index; forced is a CASE branch."""
    step = f"CASE {forced} ELSE {gate('plan.c', name + '.vals')} END" if forced else gate("plan.c", f"{name}.vals")
    return f"""{name}(n, vals) AS (
  SELECT CAST(0 AS BIGINT), [CAST(43690 AS BIGINT), 52428, 61680, 65280]
  UNION ALL SELECT n + 1, list_append(vals, CAST({step} AS BIGINT)) FROM {name} JOIN plan ON plan.k = n
), {name}_last AS (SELECT vals FROM {name} ORDER BY n DESC LIMIT 1)"""


NAME = "CASE WHEN i <= 4 THEN 'U' || (i - 1) ELSE 'V' || (i - 5) END"
OBS, DO0, DO1 = run("obs"), run("do0", "WHEN plan.k = 10 THEN 0"), run("do1", "WHEN plan.k = 10 THEN 65535")
LAWS = """laws AS (
  SELECT 'uniform' AS law, CAST(u AS INT) AS u_mask, CAST(1 AS BIGINT) AS num, CAST(16 AS BIGINT) AS den FROM range(16) t(u)
  UNION ALL SELECT 'product', CAST(u AS INT), CAST((CASE WHEN u & 1 > 0 THEN 1 ELSE 4 END) * (CASE WHEN u & 2 > 0 THEN 2 ELSE 3 END) * (CASE WHEN u & 4 > 0 THEN 3 ELSE 2 END) * (CASE WHEN u & 8 > 0 THEN 4 ELSE 1 END) AS BIGINT), 625 FROM range(16) t(u)
  UNION ALL SELECT 'correlated', CAST(u AS INT), CAST(CASE WHEN u IN (0, 15) THEN 1 ELSE 0 END AS BIGINT), 2 FROM range(16) t(u))"""


def fraction(num: str, den: str) -> str:
    n, d = f"CAST(({num}) // gcd({num}, {den}) AS BIGINT)", f"CAST(({den}) // gcd({num}, {den}) AS BIGINT)"
    return f"CASE WHEN {d} = 1 THEN CAST({n} AS VARCHAR) ELSE CAST({n} AS VARCHAR) || '/' || CAST({d} AS VARCHAR) END"


TRUTH = """truth AS (
  SELECT 'ZERO' AS code, '' AS sig, 'bool' AS out, NULL::INT AS a1, NULL::INT AS a2, NULL::INT AS a3, 0 AS value UNION ALL SELECT 'ONE', '', 'bool', NULL, NULL, NULL, 1
  UNION ALL SELECT code, 'bool', out, a, NULL, NULL, CASE code WHEN 'NOT' THEN 1 - a WHEN 'BOOL_TO_TRI' THEN 2 * a ELSE a END FROM (VALUES (0), (1)) x(a), (VALUES ('ID', 'bool'), ('NOT', 'bool'), ('ID_ALIAS', 'bool'), ('BOOL_TO_TRI', 'tri')) y(code, out)
  UNION ALL SELECT 'TRI_ID', 'tri', 'tri', a, NULL, NULL, a FROM (VALUES (0), (1), (2)) x(a)
  UNION ALL SELECT code, 'bool,bool', 'bool', a, b, NULL, CASE code WHEN 'AND' THEN a * b WHEN 'OR' THEN greatest(a, b) WHEN 'XOR' THEN (a + b) % 2 ELSE a * (1 - b) END FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES ('AND'), ('OR'), ('XOR'), ('AND_NOT')) z(code)
  UNION ALL SELECT code, 'bool,bool,bool', 'bool', a, b, c, CASE code WHEN 'XOR3' THEN (a + b + c) % 2 ELSE (a + b + c) // 2 END FROM (VALUES (0), (1)) x(a), (VALUES (0), (1)) y(b), (VALUES (0), (1)) z(c), (VALUES ('XOR3'), ('MAJ3')) w(code))"""

EXAMPLE = """ctx(context, d) AS (VALUES ('obs', NULL), ('do_y0', 0), ('do_y1', 1)),
vals AS (SELECT context, ux, uy, uz, ux AS x, coalesce(d, xor(ux, uy)) AS y FROM ctx, (VALUES (0), (1)) a(ux), (VALUES (0), (1)) b(uy), (VALUES (0), (1)) c(uz)),
full_vals AS (SELECT *, xor(y, uz) AS z FROM vals)"""

# Generated models: a draw is a part of an md5; indices are 1 to 4 for exogenous variables and 5 + k for V<k>.
DRAW = "CAST('0x' || substr(md5(family || '|' || n || '|' || seed || '|{}|' || {}), 1, 8) AS BIGINT)"
CFG = "cfg AS (SELECT DISTINCT ['chain', 'layered', 'random_acyclic'][s_nationkey % 3 + 1] AS family, CAST([8, 16, 32][(s_nationkey // 3) % 3 + 1] AS BIGINT) AS n, CAST(s_suppkey AS BIGINT) AS seed FROM supplier)"
MODELS = f"""
{CFG},
node AS (SELECT *, CASE WHEN family = 'chain' AND k > 0 THEN 2 + {DRAW.format('code', 'k')} % 8 ELSE {DRAW.format('code', 'k')} % 10 END AS c FROM (SELECT *, unnest(range(n)) AS k FROM cfg)),
gslot AS (SELECT family, n, seed, k, c, p, CASE WHEN family = 'chain' AND k > 0 AND p = 1 THEN k + 4
  ELSE 1 + {DRAW.format('arg', "k || '|' || p")} % (4 + CASE family WHEN 'chain' THEN 0 WHEN 'layered' THEN k - k % greatest(2, CAST(floor(sqrt(n)) AS BIGINT)) ELSE k END) END AS a
  FROM node, (VALUES (1), (2), (3)) t(p) WHERE p <= [0,0,1,1,2,2,2,2,3,3][c + 1]),
plan AS (SELECT node.family, node.n, node.seed, node.k, node.c, max(a) FILTER (WHERE p = 1) AS a1, max(a) FILTER (WHERE p = 2) AS a2, max(a) FILTER (WHERE p = 3) AS a3
  FROM node LEFT JOIN gslot USING (family, n, seed, k) GROUP BY node.family, node.n, node.seed, node.k, node.c)"""
STEP = "CASE WHEN scenario > 0 AND (scenario - 1) // 2 = i THEN CASE WHEN (scenario - 1) % 2 = 1 THEN 65535 ELSE 0 END ELSE {} END"

LOCAL = f"""swapped AS (SELECT k, c, [1,0,3,2,7,4,4,4,9,8][c + 1] AS c2 FROM eq WHERE k % 12 = 0),
own AS (SELECT plan.k, coalesce(w.c2, plan.c) AS c, plan.a1, plan.a2, plan.a3, h.k IS NOT NULL AS mine FROM plan LEFT JOIN (SELECT k FROM held WHERE o = 1) h ON h.k = plan.k LEFT JOIN swapped w ON w.k = plan.k),
f(n, vals) AS (SELECT CAST(0 AS BIGINT), [CAST(43690 AS BIGINT), 52428, 61680, 65280]
  UNION ALL SELECT n + 1, list_append(f.vals, CAST(CASE WHEN NOT plan.mine THEN obs_last.vals[n + 5] ELSE {gate('plan.c', 'f.vals')} END AS BIGINT)) FROM f JOIN own plan ON plan.k = n, obs_last),
d AS (SELECT unnest(range(len(a.vals))) AS v, unnest(a.vals) AS x, unnest(b.vals) AS y FROM obs_last a, (SELECT vals FROM f ORDER BY n DESC LIMIT 1) b)"""

SQL: dict[str, str] = {
    "running_example_values": f"WITH {EXAMPLE} SELECT context, ux, uy, uz, x, y, z FROM full_vals",
    "running_example_response": f"WITH {EXAMPLE}, s AS (SELECT context, CAST(sum(CASE WHEN z = 1 THEN CASE WHEN uz = 1 THEN 1 ELSE 4 END ELSE 0 END) AS BIGINT) AS n FROM full_vals GROUP BY context) SELECT context, {fraction('n', '20')} AS p_z1 FROM s",
    "truth_table": f"WITH {TRUTH} SELECT code, coalesce(a1, -1) AS a1, coalesce(a2, -1) AS a2, coalesce(a3, -1) AS a3, CAST(value AS INT) AS value FROM truth",
    "library_totality": f"WITH {TRUTH}, c AS (SELECT code, sig, count(*) AS rows FROM truth GROUP BY code, sig), e AS (SELECT code, CAST(CASE WHEN sig = '' THEN 0 ELSE len(string_split(sig, ',')) END AS INT) AS arity, rows, CASE sig WHEN '' THEN 1 WHEN 'bool' THEN 2 WHEN 'tri' THEN 3 WHEN 'bool,bool' THEN 4 ELSE 8 END AS expected FROM c) SELECT code, arity, rows, CAST(expected AS BIGINT) AS expected, rows = expected AS total FROM e",
    "conflict_codes": f"WITH {TRUTH}, t AS (SELECT code, sig, out, string_agg(value, '' ORDER BY a1, a2, a3) AS tab FROM truth GROUP BY ALL) SELECT a.code, min(b.code) AS replacement FROM t a JOIN t b ON a.sig = b.sig AND a.out = b.out AND a.tab <> b.tab AND b.code NOT LIKE '%\\_ALIAS' ESCAPE '\\' GROUP BY a.code",
    "model_sizes": f"WITH {EQ} SELECT 'Var' AS sort, 4 + count(*) AS n FROM eq UNION ALL SELECT 'Mech', count(*) FROM eq UNION ALL SELECT 'Input', count(*) FROM slot UNION ALL SELECT 'Dep', count(*) FROM slot",
    "module_records": f"WITH {EQ} SELECT 'm' || o AS module, 'Var' AS sort, count(*) AS n FROM hvar GROUP BY o UNION ALL SELECT 'm' || o, 'Mech', count(*) FROM held GROUP BY o UNION ALL SELECT 'm' || o, s, count(*) FROM hslot, (VALUES ('Input'), ('Dep')) t(s) GROUP BY o, s",
    "interface_pairs": f"""WITH {EQ}, r AS (SELECT o, 'Var' AS sort, CAST(v AS VARCHAR) AS id FROM hvar UNION ALL SELECT o, 'Mech', CAST(k AS VARCHAR) FROM held UNION ALL SELECT o, s, k || ':' || p FROM hslot, (VALUES ('Input'), ('Dep')) t(s))
SELECT 'm' || a.o || '-m' || b.o AS iface, a.sort, count(*) AS n FROM r a JOIN r b ON a.sort = b.sort AND a.id = b.id AND a.o < b.o GROUP BY a.o, b.o, a.sort""",
    "supplied_sizes": f"""WITH {EQ}, r AS (SELECT o, 'Var' AS sort, CAST(v AS VARCHAR) AS id FROM hvar UNION ALL SELECT o, 'Mech', CAST(k AS VARCHAR) FROM held UNION ALL SELECT o, s, k || ':' || p FROM hslot, (VALUES ('Input'), ('Dep')) t(s)),
c AS (SELECT (SELECT count(*) FROM r) AS records, (SELECT count(*) FROM r a JOIN r b ON a.sort = b.sort AND a.id = b.id AND a.o < b.o) AS pairs)
SELECT records + pairs AS n_rows, CAST(22 AS BIGINT) AS n_headers, records + pairs + 22 AS n, 2 * pairs AS r FROM c""",
    "levels": f"""WITH RECURSIVE {EQ}, f(n, lv) AS (SELECT CAST(0 AS BIGINT), [0, 0, 0, 0] UNION ALL SELECT n + 1, list_append(lv, CAST(CASE WHEN plan.a1 IS NULL THEN 0 ELSE 1 + greatest(lv[plan.a1], coalesce(lv[plan.a2], 0), coalesce(lv[plan.a3], 0)) END AS INT)) FROM f JOIN plan ON plan.k = n)
SELECT level, count(*) AS variables FROM (SELECT unnest(lv) AS level FROM (SELECT lv FROM f ORDER BY n DESC LIMIT 1)) GROUP BY level""",
    "evaluate_all": f"WITH RECURSIVE {EQ}, {OBS}, u AS (SELECT unnest(range(1, len(vals) + 1)) AS i, unnest(vals) AS bits FROM obs_last) SELECT {NAME} AS var, bits FROM u",
    "quotient_sizes": f"""WITH {EQ}, g AS (SELECT (SELECT count(*) FROM eq) AS n, (SELECT count(*) FROM held) AS h, (SELECT count(*) FROM slot) AS i, (SELECT count(*) FROM hslot) AS hi, (SELECT count(*) FROM (SELECT DISTINCT k, cause FROM slot)) AS d)
SELECT variant, sort, CASE sort WHEN 'Var' THEN 4 + n WHEN 'Mech' THEN CASE variant WHEN 'var_raw' THEN h ELSE n END WHEN 'Input' THEN CASE variant WHEN 'var_raw' THEN hi ELSE i END ELSE CASE variant WHEN 'var_raw' THEN hi WHEN 'full_raw' THEN i ELSE d END END AS n
FROM g, (VALUES ('full_raw'), ('full_dedup'), ('var_raw'), ('var_dedup')) v(variant), (VALUES ('Var'), ('Mech'), ('Input'), ('Dep')) s(sort)""",
    "fibers": f"WITH {EQ}, f AS (SELECT o, k, cause FROM hslot GROUP BY o, k, cause HAVING count(*) > 1) SELECT variant, 'Dep' AS sort, count(*) AS fibers FROM f, (VALUES ('full_dedup'), ('var_dedup')) v(variant) GROUP BY variant",
    "assembly_issues": f"WITH {EQ}, c AS (SELECT count(*) AS n FROM eq WHERE k % 12 = 0) SELECT variant, 'duplicate_owner' AS kind, n AS issues FROM c, (VALUES ('var_raw'), ('conflict_var_dedup')) v(variant) WHERE n > 0",
    "diagram_issues": f"WITH {EQ} SELECT 'conflict' AS diagram, 'interface' AS stage, 'attribute_mismatch' AS kind, count(*) AS issues FROM eq WHERE k % 12 = 0 HAVING count(*) > 0",
    "do_effects": f"""WITH RECURSIVE {EQ}, {OBS}, {DO0}, {DO1}, u AS (SELECT unnest(o.vals) AS o, unnest(a.vals) AS do0, unnest(b.vals) AS do1 FROM obs_last o, do0_last a, do1_last b)
SELECT scenario, CAST(sum(CASE WHEN (CASE scenario WHEN 'do0' THEN do0 ELSE do1 END) <> o THEN 1 ELSE 0 END) AS BIGINT) AS changed, count(*) AS variables FROM u, (VALUES ('do0'), ('do1')) s(scenario) GROUP BY scenario""",
    "surgery_sizes": f"""WITH {EQ}, s(scenario) AS (VALUES ('obs'), ('do1'))
SELECT scenario, 'Var' AS sort, 4 + count(*) AS n FROM eq, s GROUP BY scenario UNION ALL SELECT scenario, 'Mech', count(*) FROM eq, s GROUP BY scenario
UNION ALL SELECT scenario, t, count(*) FROM slot, s, (VALUES ('Input'), ('Dep')) x(t) WHERE scenario = 'obs' OR k <> 10 GROUP BY scenario, t""",
    "law_masses": f"WITH {LAWS} SELECT law, u_mask, num, den FROM laws",
    "pushforward": f"""WITH RECURSIVE {EQ}, {OBS}, {LAWS}, u AS (SELECT unnest(range(1, len(vals) + 1)) AS i, unnest(vals) AS bits FROM obs_last),
p AS (SELECT law, {NAME} AS var, CAST(sum(num) AS BIGINT) AS num, den FROM u, laws WHERE (bits >> u_mask) & 1 = 1 GROUP BY law, i, den) SELECT law, var, num, den, {fraction('num', 'den')} AS p FROM p""",
    "total_variation": f"""WITH RECURSIVE {EQ}, {OBS}, {DO0}, {DO1}, {LAWS},
st AS (SELECT law, den, num, md5(array_to_string(list_transform(o.vals, lambda x: (x >> u_mask) & 1), '')) AS obs, md5(array_to_string(list_transform(a.vals, lambda x: (x >> u_mask) & 1), '')) AS do0, md5(array_to_string(list_transform(b.vals, lambda x: (x >> u_mask) & 1), '')) AS do1 FROM laws, obs_last o, do0_last a, do1_last b),
w AS (SELECT pair, law, den, atom, sum(w) AS w FROM (
  SELECT pair, law, den, obs AS atom, num AS w FROM st, (VALUES ('obs_do0'), ('obs_do1'), ('obs_assembled')) t(pair) UNION ALL SELECT 'obs_do0', law, den, do0, -num FROM st UNION ALL SELECT 'obs_do1', law, den, do1, -num FROM st UNION ALL SELECT 'obs_assembled', law, den, obs, -num FROM st) GROUP BY pair, law, den, atom),
t AS (SELECT pair, law, 2 * den AS d, CAST(sum(abs(w)) AS BIGINT) AS n FROM w GROUP BY pair, law, den) SELECT pair, law, CASE WHEN n = 0 THEN '0' ELSE {fraction('n', 'd')} END AS tv FROM t""",
    "local_mismatches": f"""WITH RECURSIVE {EQ}, {OBS},
{LOCAL}
SELECT copies, 'm' || hvar.o AS module, count(*) AS variables, CAST(sum(CASE WHEN copies = 'conflict' AND hvar.o = 1 AND x <> y THEN 1 ELSE 0 END) AS BIGINT) AS mismatches FROM hvar JOIN d ON d.v = hvar.v, (VALUES ('identical'), ('conflict')) t(copies) GROUP BY copies, hvar.o""",
    "distribution_checks": f"""WITH RECURSIVE {EQ}, {OBS}, {LAWS},
{LOCAL},
st AS (SELECT copies, o, law, den, num, u_mask, string_agg((x >> u_mask) & 1, '' ORDER BY v) AS pulled, string_agg(((CASE WHEN copies = 'conflict' AND o = 1 THEN y ELSE x END) >> u_mask) & 1, '' ORDER BY v) AS own
  FROM hvar JOIN d USING (v), laws, (VALUES ('identical'), ('conflict')) t(copies) GROUP BY copies, o, law, den, num, u_mask),
w AS (SELECT copies, o, law, den, atom, sum(w) AS w FROM (SELECT copies, o, law, den, pulled AS atom, num AS w FROM st UNION ALL SELECT copies, o, law, den, own, -num FROM st) GROUP BY ALL),
t AS (SELECT copies, law, 2 * den AS d, CAST(sum(abs(w)) AS BIGINT) AS n FROM w GROUP BY copies, o, law, den),
g AS (SELECT copies, law, d, max(n) AS n, count(*) AS modules FROM t GROUP BY copies, law, d)
SELECT copies, law, modules, CASE WHEN n = 0 THEN '0' ELSE {fraction('n', 'd')} END AS max_local_tv FROM g""",
    "corrupted_issues": f"""WITH {EQ}, x AS (SELECT 'missing_attribute' AS kind FROM eq WHERE k % 89 = 2 UNION ALL SELECT 'variable_attribute' FROM eq WHERE k % 83 = 1 UNION ALL SELECT 'unknown_code' FROM eq WHERE k % 101 = 5
  UNION ALL SELECT 'structural_reference' FROM slot WHERE k % 97 = 3 AND p = 1 UNION ALL SELECT 'input_position' FROM slot WHERE k % 79 = 4 AND p = 2) SELECT kind, count(*) AS issues FROM x GROUP BY kind""",
    "corrupted_models": f"""WITH {EQ}, me AS (SELECT k, arity, 0 AS twin FROM eq WHERE k % 71 <> 3 UNION ALL SELECT k, arity, 1 FROM eq WHERE k % 67 = 2),
sl AS (SELECT k, p, cause FROM slot WHERE NOT (k % 61 = 7 AND p = 2) UNION ALL SELECT k, p, cause FROM slot WHERE k % 59 = 5 AND p = 1),
live AS (SELECT sl.* FROM sl JOIN (SELECT k FROM me WHERE twin = 0) USING (k)),
ps AS (SELECT k, count(DISTINCT p) AS n, min(p) AS lo, max(p) AS hi FROM sl GROUP BY k),
e AS (SELECT DISTINCT cause, k FROM live), d AS (SELECT DISTINCT cause, k FROM slot),
x AS (SELECT 'missing_owner' AS kind FROM eq LEFT JOIN me ON me.k = eq.k WHERE me.k IS NULL
  UNION ALL SELECT 'duplicate_owner' FROM me GROUP BY k HAVING count(*) > 1
  UNION ALL SELECT 'incomplete_signature' FROM me LEFT JOIN ps ON ps.k = me.k AND me.twin = 0 WHERE coalesce(n, 0) <> arity OR (arity > 0 AND (lo <> 1 OR hi <> arity))
  UNION ALL SELECT 'duplicate_input' FROM sl GROUP BY k, p HAVING count(*) > 1
  UNION ALL SELECT 'dependency_mismatch' WHERE EXISTS (SELECT * FROM d EXCEPT SELECT * FROM e) OR EXISTS (SELECT * FROM e EXCEPT SELECT * FROM d))
SELECT kind, count(*) AS issues FROM x GROUP BY kind""",
    "broken_diagram_issues": f"""WITH {EQ}, shared AS (SELECT a.v - 4 AS k, a.o AS l, b.o AS r FROM hvar a JOIN hvar b ON a.v = b.v AND a.o < b.o WHERE a.v >= 4),
x AS (SELECT 'owners' AS damage, 'local_module' AS stage, 'unexpected_owner' AS kind, count(*) AS n FROM hvar WHERE own = 0 AND v >= 4 AND (v - 4) % 40 = 1
  UNION ALL SELECT 'types', 'local_module', 'output_type', count(*) FROM held WHERE k % 45 = 3
  UNION ALL SELECT 'types', 'local_module', 'input_type', count(*) FROM hslot WHERE cause >= 4 AND (cause - 4) % 45 = 3
  UNION ALL SELECT 'roles', 'local_module', 'boundary_definition', count(*) FROM hvar WHERE own = 0 AND v >= 4 AND (v - 4) % 50 = 4
  UNION ALL SELECT 'roles', 'local_module', 'unexpected_owner', count(*) FROM held WHERE k % 50 = 4
  UNION ALL SELECT 'strays', 'local_module', 'boundary_definition', count(*) FROM held WHERE k % 60 = 5
  UNION ALL SELECT 'names', 'local_module', 'object_name', 1 UNION ALL SELECT 'repeated', 'interface', 'interface_name', 1
  UNION ALL SELECT 'targets', 'interface', 'interface_target', 1 UNION ALL SELECT 'sorts', 'interface', 'map_sorts', 1
  UNION ALL SELECT 'totality', 'interface', 'map_totality', CASE WHEN count(*) > 0 THEN 2 ELSE 0 END FROM shared WHERE l = 1 AND r = 2 AND k % 30 = 6
  UNION ALL SELECT 'injectivity', 'interface', 'map_injectivity', CASE WHEN count(*) > 1 AND count(*) FILTER (WHERE k % 30 = 7) > 0 THEN 1 ELSE 0 END FROM shared WHERE l = 2 AND r = 3 AND (k % 30 = 7 OR k = 3)
  UNION ALL SELECT 'references', 'interface', 'map_reference', count(*) FROM shared WHERE l = 1 AND r = 3 AND k % 30 = 8
  UNION ALL SELECT 'overlaps', 'interface', 'variable_attribute', count(*) FROM shared WHERE l = 0 AND r = 2 AND k % 30 = 9
  UNION ALL SELECT 'overlaps', 'interface', 'attribute_mismatch', 2 * count(*) FROM shared WHERE l = 0 AND r = 2 AND k % 30 = 9
  UNION ALL SELECT 'tables', 'local_module', 'entity_tables', 1)
SELECT damage, stage, kind, CAST(n AS BIGINT) AS issues FROM x WHERE n > 0""",
    "certificate_violations": f"""WITH {EQ}, moved AS (SELECT k + 4 AS v FROM eq WHERE k % 12 = 0),
c AS (SELECT (SELECT count(*) FROM moved) AS moved,
  (SELECT count(*) FROM hvar h JOIN moved ON moved.v = h.v WHERE h.o <> 1) AS pairs,
  (SELECT count(*) FROM hslot WHERE o = 1 AND cause IN (SELECT v FROM moved)) AS inputs,
  (SELECT count(*) FROM (SELECT DISTINCT k, cause FROM hslot WHERE o = 1 AND (k % 12 = 0 OR cause IN (SELECT v FROM moved)))) AS deps,
  (SELECT count(*) FROM eq WHERE k % 50 = 0) AS forged,
  (SELECT count(*) FROM eq WHERE k % 24 = 0) AS lost,
  (SELECT count(*) FROM (SELECT k, cause FROM slot GROUP BY k, cause HAVING count(*) > 1)) AS parallel)
SELECT certificate, "check", CAST(CASE certificate || '.' || "check"
  WHEN 'torn_class.classes_tabled' THEN moved WHEN 'torn_class.forest_generates' THEN moved WHEN 'torn_class.interfaces_respected' THEN pairs WHEN 'torn_class.rows_descend' THEN 2 * moved + inputs + deps
  WHEN 'forged_edge.forest_justified' THEN forged WHEN 'forged_edge.forest_generates' THEN CASE WHEN forged > 0 THEN 1 ELSE 0 END
  WHEN 'lost_edges.forest_generates' THEN lost WHEN 'unmerged.duplicates_merged' THEN parallel ELSE 0 END AS BIGINT) AS violations
FROM c, (VALUES ('sound'), ('torn_class'), ('forged_edge'), ('lost_edges'), ('unmerged')) x(certificate),
  (VALUES ('tags_total'), ('classes_tabled'), ('forest_justified'), ('forest_generates'), ('interfaces_respected'), ('duplicates_merged'), ('rows_descend'), ('ranks_ascend')) y("check")""",
    "failure_witness_checks": f"""WITH {EQ}, x AS (SELECT 'missing_owner' AS kind, count(*) AS n FROM eq WHERE k % 71 = 3
  UNION ALL SELECT 'duplicate_owner', count(*) FROM eq WHERE k % 67 = 2 AND k % 71 <> 3
  UNION ALL SELECT 'duplicate_input', count(*) FROM slot WHERE k % 59 = 5 AND p = 1 UNION ALL SELECT 'cycle', 1)
SELECT witness, kind, n AS witnesses, CASE witness WHEN 'found' THEN 0 ELSE n END AS refuted FROM x, (VALUES ('found'), ('forged')) w(witness) WHERE n > 0""",
    "interface_witness_checks": f"""WITH {EQ}, x AS (SELECT 'attribute_mismatch' AS kind, 'code' AS field, count(*) AS n FROM eq WHERE k % 12 = 0
  UNION ALL SELECT 'naturality', 'var', count(*) FROM slot WHERE k % 36 = 0 AND p = 1)
SELECT witness, kind, field, n AS witnesses, CASE witness WHEN 'found' THEN 0 ELSE n END AS refuted FROM x, (VALUES ('found'), ('swapped')) w(witness) WHERE n > 0""",
    "reconstruction_checks": f"""WITH {EQ}, x AS (SELECT 'Var' AS sort, 4 + count(*) AS n, 0 AS copied FROM eq UNION ALL SELECT 'Mech', count(*), count(*) FILTER (WHERE k % 12 = 0) FROM eq UNION ALL SELECT s, count(*), count(*) FILTER (WHERE k % 12 = 0) FROM slot, (VALUES ('Input'), ('Dep')) t(s) GROUP BY s),
par AS (SELECT count(*) AS pairs, coalesce(sum(n), 0) AS slots FROM (SELECT k, cause, count(*) AS n FROM slot GROUP BY k, cause HAVING count(*) > 1))
SELECT variant, sort, CAST(CASE WHEN variant = 'var_raw' THEN n + copied WHEN variant = 'var_dedup' AND sort = 'Dep' THEN n - par.slots + par.pairs ELSE n END AS BIGINT) AS classes, CAST(CASE WHEN variant = 'var_dedup' AND sort = 'Dep' THEN par.pairs ELSE 0 END AS BIGINT) AS ambiguous, CAST(CASE WHEN variant = 'var_raw' THEN copied ELSE 0 END AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS missing
FROM x, par, (VALUES ('full_raw'), ('var_raw'), ('var_dedup')) v(variant)""",
    "commutation": f"""WITH RECURSIVE {EQ}, {run('zero', 'WHEN plan.k = 12 THEN 0')}, {run('one', 'WHEN plan.k = 12 THEN 65535')},
moved AS (SELECT count(*) FILTER (WHERE x <> y) AS n FROM (SELECT unnest(a.vals) AS x, unnest(b.vals) AS y FROM zero_last a, one_last b)),
s(surgery, hit) AS (VALUES ('do_V10', 10), ('do_V12', 12), ('do_V25', 25), ('other_value', 12), ('one_copy', 12)),
c AS (SELECT surgery, hit, (SELECT 4 + count(*) FROM eq) AS var, (SELECT count(*) FROM eq) AS mech, (SELECT count(*) FROM slot WHERE k <> hit) AS inputs, (SELECT count(DISTINCT (k, cause)) FROM slot WHERE k <> hit) AS deps,
  (SELECT count(*) FROM slot WHERE k = hit) AS own, (SELECT count(DISTINCT cause) FROM slot WHERE k = hit) AS own_deps FROM s)
SELECT surgery, 'records' AS part, var + mech + inputs + deps AS compared, CAST(CASE surgery WHEN 'other_value' THEN 1 WHEN 'one_copy' THEN 1 + own + own_deps ELSE 0 END AS BIGINT) AS differing FROM c
UNION ALL SELECT surgery, 'values', var, CAST(CASE surgery WHEN 'other_value' THEN n ELSE 0 END AS BIGINT) FROM c, moved WHERE surgery <> 'one_copy'""",
    "exact_checks_summary": f"""WITH {CFG}, g AS (SELECT n FROM cfg, range(4) b),
s AS (SELECT CAST(n AS VARCHAR) AS n, count(*) AS diagrams, 16 * count(*) AS observational, CAST(sum(32 * n) AS BIGINT) AS interventional, CAST(sum(3 + 6 * n) AS BIGINT) AS law FROM g GROUP BY n),
t AS (SELECT * FROM s UNION ALL SELECT 'Total', CAST(sum(diagrams) AS BIGINT), CAST(sum(observational) AS BIGINT), CAST(sum(interventional) AS BIGINT), CAST(sum(law) AS BIGINT) FROM s)
SELECT n, diagrams, observational, interventional, 2 * (observational + interventional) AS route_checks, CAST(0 AS BIGINT) AS global_mismatches, CAST(0 AS BIGINT) AS local_mismatches, 2 * law AS law_cases, CAST(0 AS BIGINT) AS laws_apart FROM t""",
    "grid_instances": f"""WITH {CFG}, g AS (SELECT family || '_n' || n || '_m' || m || '_copy' || lpad(CAST(c AS VARCHAR), 2, '0') || '_seed' || seed AS inst FROM cfg, (VALUES (2), (4)) b(m), (VALUES (0), (25)) d(c)) SELECT inst, sha256(inst) AS sha256 FROM g""",
    "timing_summary": "SELECT event_type AS stage, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.75), 9) AS q75, min(value) AS least, max(value) AS most, count(value) AS runs FROM events GROUP BY event_type",
}

CODE_NAMES = "['ZERO','ONE','ID','NOT','AND','OR','XOR','AND_NOT','XOR3','MAJ3'][c + 1]"
ARGUMENT = "CASE WHEN a{0} IS NULL THEN NULL WHEN a{0} <= 4 THEN 'U' || (a{0} - 1) ELSE 'V' || (a{0} - 5) END"
SQL["generated_equations"] = f"WITH {MODELS} SELECT family, CAST(n AS INT) AS n, CAST(seed AS INT) AS seed, 'V' || k AS output, {CODE_NAMES} AS code, concat_ws(',', {', '.join(ARGUMENT.format(i) for i in (1, 2, 3))}) AS args FROM plan"
SQL["evaluation_checks"] = f"""WITH RECURSIVE {MODELS},
run AS (SELECT family, n, seed, scenario, CAST(0 AS BIGINT) AS i, [CAST(43690 AS BIGINT), 52428, 61680, 65280] AS vals, [CAST(43690 AS BIGINT), 52428, 61680, 65280] AS bad FROM cfg, range(65) t(scenario) WHERE scenario <= 2 * n
  UNION ALL SELECT run.family, run.n, run.seed, scenario, i + 1, list_append(vals, CAST({STEP.format(gate('plan.c', 'run.vals'))} AS BIGINT)),
    list_append(bad, CAST({STEP.format(gate('CASE WHEN i = 0 THEN [1,0,3,2,7,4,4,4,9,8][plan.c + 1] ELSE plan.c END', 'run.bad'))} AS BIGINT))
  FROM run JOIN plan ON plan.family = run.family AND plan.n = run.n AND plan.seed = run.seed AND plan.k = i),
done AS (SELECT family, n, scenario, list_sum(list_transform(list_zip(vals, bad), lambda x: bit_count(xor(x[1], x[2])))) AS apart FROM run WHERE i = n),
sums AS (SELECT family, n, CASE WHEN scenario = 0 THEN 'observational' ELSE 'interventional' END AS scope, 4 * 16 * CAST(sum(n + 4) AS BIGINT) AS coordinates, 4 * CAST(sum(apart) AS BIGINT) AS apart FROM done GROUP BY ALL)
SELECT family, CAST(n AS INT) AS n, route, scope, coordinates, CASE WHEN models = 'damaged' THEN apart ELSE 0 END AS mismatches, models FROM sums, (VALUES ('raw'), ('deduplicated')) r(route), (VALUES ('faithful'), ('damaged')) m(models)"""

# Sizes that gluing leaves, counted from equations and copies; a model is as its ground where its counts are.
DUPLICATION = f"""{MODELS},
turn AS (SELECT family, n, seed, k, row_number() OVER (PARTITION BY family, n, seed ORDER BY {DRAW.format('copy', 'k')}, k) <= n // 4 AS copied FROM node),
first_copy AS (SELECT family, n, seed, min('m:V' || k) AS hit FROM turn WHERE copied GROUP BY family, n, seed),
sized AS (SELECT t.family, t.n, t.seed, count(s.p) AS slots, count(s.p) FILTER (WHERE copied) AS copied_slots, count(s.p) FILTER (WHERE 'm:V' || t.k = hit) AS hit_slots, count(DISTINCT t.k || ':' || s.a) AS arcs, count(DISTINCT t.k) FILTER (WHERE copied) AS copied
  FROM turn t JOIN first_copy USING (family, n, seed) LEFT JOIN gslot s ON s.family = t.family AND s.n = t.n AND s.seed = t.seed AND s.k = t.k GROUP BY t.family, t.n, t.seed),
cases AS (SELECT *, family || '_n' || n || '_m' || m || '_copy' || lpad(CAST(copies AS VARCHAR), 2, '0') || '_seed' || seed AS inst, CASE WHEN copies = 0 THEN 0 ELSE 1 END AS has
  FROM sized, (VALUES (2), (4)) m(m), (VALUES (0), (25)) c(copies), (VALUES ('faithful', 0), ('equation_conflict', 1)) v(variant, bad), (VALUES ('raw', 1), ('deduplicated', 0)) w(mode, raw) WHERE copies > 0 OR bad = 0),
counted AS (SELECT *, CASE WHEN raw = 1 THEN has * copied ELSE bad END AS extra, CASE WHEN raw = 1 THEN has * copied_slots ELSE bad * hit_slots END AS extra_slots FROM cases),
compared AS (SELECT inst, copies, variant, mode, extra + extra_slots = 0 AND bad = 0 AS accepted, n + extra = n AND bad = 0 AS recovered, CAST(extra AS BIGINT) AS duplicate_owners, bad = 1 AS different_codes,
  CAST(n + 4 AS BIGINT) AS output_var, CAST(n + extra AS BIGINT) AS output_mech, CAST(slots + extra_slots AS BIGINT) AS output_input, CAST(CASE WHEN raw = 1 THEN slots + extra_slots ELSE arcs END AS BIGINT) AS output_dep FROM counted)"""
SQL["duplication_comparison"] = f"WITH {DUPLICATION} SELECT * EXCLUDE (copies) FROM compared"
SQL["duplication_summary"] = f"WITH {DUPLICATION} SELECT variant, CAST(copies AS INT) AS copies, mode, count(*) AS diagrams, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE recovered) AS recovered, count(*) FILTER (WHERE duplicate_owners > 0) AS owner_failures, count(*) FILTER (WHERE different_codes) AS conflict_witnesses FROM compared GROUP BY variant, copies, mode"
SQL["duplicate_acceptance"] = f"WITH {DUPLICATION} SELECT CASE WHEN variant = 'equation_conflict' THEN 'Conflicting codes' WHEN copies = 0 THEN 'No copies' ELSE 'Identical copies' END AS condition, count(*) FILTER (WHERE accepted AND mode = 'raw') AS raw, count(*) FILTER (WHERE accepted AND mode = 'deduplicated') AS deduplicated FROM compared GROUP BY condition"

# The known outcome of each fixture: kinds and stage, fibers and class counts, raw and deduplicated.
GOLDEN = [
    ("F01", "", "", 0, 0, "6/3/5/5", "6/3/5/5"), ("F02", "missing_owner", "assembled", 0, 0, "1/0/0/0", "1/0/0/0"),
    ("F05", "duplicate_owner", "assembled", 0, 0, "2/2/2/2", "2/2/2/1"), ("F06", "cycle", "acyclicity", 0, 0, "2/2/2/2", "2/2/2/2"),
    ("F07", "attribute_mismatch", "interface", 0, 0, "", ""), ("F08", "attribute_mismatch", "interface", 0, 0, "", ""), ("F09", "attribute_mismatch,naturality", "interface", 0, 0, "", ""),
    ("F10", "", "", 0, 0, "2/1/1/1", "2/1/1/1"), ("F11", "", "", 1, 2, "2/1/2/2", "2/1/2/1"), ("F12", "", "", 0, 1, "2/1/2/2", "2/1/2/1"), ("F13", "", "", 0, 0, "3/1/2/2", "3/1/2/2"),
    ("F14", "", "", 0, 0, "3/2/0/0", "3/2/0/0"), ("F15", "attribute_mismatch", "interface", 0, 0, "", ""), ("F16", "duplicate_owner", "assembled", 0, 0, "3/2/2/2", "3/2/2/2"),
    ("F17", "duplicate_owner", "assembled", 0, 0, "2/2/2/2", "2/2/2/1"), ("F18", "", "", 0, 0, "4/2/2/2", "4/2/2/2"), ("F19", "", "", 1, 2, "2/1/2/2", "2/1/2/1"),
]
GOLDEN_ROWS = [(f, m, kinds, stages, a if m == "raw" else b, x if m == "raw" else y) for f, kinds, stages, a, b, x, y in GOLDEN for m in ("raw", "deduplicated")]
GOLDEN_ROWS += [("F03", "raw", "duplicate_owner", "assembled", 0, "1/2/0/0"), ("F03", "deduplicated", "", "", 0, "1/1/0/0"), ("F04", "raw", "duplicate_input", "assembled", 0, "2/1/2/1"), ("F04", "deduplicated", "", "", 0, "2/1/1/1")]
SQL["diagnostics"] = "SELECT fixture, mode, kinds = '' AS valid, stages, kinds, CAST(fibers AS BIGINT) AS fibers, sizes FROM (VALUES " + ", ".join(map(str, GOLDEN_ROWS)) + ") t(fixture, mode, kinds, stages, fibers, sizes)"
SQL["diagnostic_summary"] = "WITH g AS (" + SQL["diagnostics"] + ") SELECT fixture, bool_or(valid) FILTER (WHERE mode = 'raw') AS raw, bool_or(valid) FILTER (WHERE mode = 'deduplicated') AS deduplicated, true AS as_expected, CASE WHEN CAST(substr(fixture, 2) AS INT) <= 15 THEN 'primary' ELSE 'supporting' END AS scope FROM g GROUP BY fixture"
SQL["json_roundtrip"] = f"WITH m AS ({SQL['module_records']}), x AS (SELECT count(*) AS changed FROM ({'WITH ' + EQ + 'SELECT * FROM held WHERE c = 8'})) SELECT document, sort, CAST(sum(n) AS BIGINT) AS n, CAST(CASE WHEN document = 'changed' AND sort = 'Mech' THEN 2 * any_value(changed) ELSE 0 END AS BIGINT) AS differing FROM m, x, (VALUES ('written'), ('changed')) d(document) GROUP BY document, sort"
SQL["components_checks"] = f"""WITH {EQ}, r AS (SELECT o, 'Var' AS sort, CAST(v AS VARCHAR) AS id FROM hvar UNION ALL SELECT o, 'Mech', CAST(k AS VARCHAR) FROM held UNION ALL SELECT o, s, k || ':' || p FROM hslot, (VALUES ('Input'), ('Dep')) t(s)),
shared AS (SELECT sort, id, count(*) AS n FROM r GROUP BY sort, id HAVING count(*) > 1), c AS (SELECT sort, CAST(sum(n) AS BIGINT) AS nodes, count(*) AS classes FROM shared GROUP BY sort)
SELECT claim, sort, nodes, classes, CASE WHEN claim = 'torn' AND sort = 'Var' THEN (SELECT CAST(coalesce(sum(CASE WHEN n = 2 THEN 2 ELSE 1 END), 0) AS BIGINT) FROM shared WHERE sort = 'Var' AND CAST(id AS BIGINT) >= 4 AND (CAST(id AS BIGINT) - 4) % 24 = 0) ELSE 0 END AS differing FROM c, (VALUES ('sound'), ('torn')) t(claim)"""
SQL["intervention_checks"] = f"""WITH RECURSIVE {MODELS},
run AS (SELECT family, n, seed, scenario, CAST(0 AS BIGINT) AS i, [CAST(43690 AS BIGINT), 52428, 61680, 65280] AS vals FROM cfg, range(1, 65) t(scenario) WHERE scenario <= 2 * n
  UNION ALL SELECT run.family, run.n, run.seed, scenario, i + 1, list_append(vals, CAST({STEP.format(gate('plan.c', 'run.vals'))} AS BIGINT))
  FROM run JOIN plan ON plan.family = run.family AND plan.n = run.n AND plan.seed = run.seed AND plan.k = i),
done AS (SELECT family, n, seed, scenario, vals FROM run WHERE i = n),
swaps AS (SELECT a.family, a.n, CAST(sum(list_sum(list_transform(list_zip(a.vals, b.vals), lambda x: bit_count(xor(x[1], x[2]))))) AS BIGINT) AS apart FROM done a JOIN done b ON a.family = b.family AND a.n = b.n AND a.seed = b.seed AND b.scenario = a.scenario + 1 WHERE a.scenario % 2 = 1 GROUP BY a.family, a.n)
SELECT family, CAST(n AS INT) AS n, m, copies, route, claim, 2 * models * n AS worlds,
  CASE claim WHEN 'sound' THEN 2 * models * n WHEN 'other_value' THEN 0 ELSE 2 * models * n - CASE WHEN copies > 0 THEN 2 * models * (n // 4) ELSE 0 END END AS isomorphic,
  CASE claim WHEN 'one_copy' THEN 0 ELSE 32 * models * n * (n + 4) END AS coordinates, CASE claim WHEN 'other_value' THEN 2 * apart ELSE 0 END AS mismatches
FROM swaps JOIN (SELECT family, n, count(*) AS models FROM cfg GROUP BY family, n) USING (family, n), (VALUES (2), (4)) a(m), (VALUES (0), (25)) b(copies), (VALUES ('raw'), ('deduplicated')) r(route), (VALUES ('sound'), ('other_value'), ('one_copy')) c(claim)"""
SQL["semantic_twins"] = f"""WITH RECURSIVE {MODELS},
run AS (SELECT family, n, seed, scenario, CAST(0 AS BIGINT) AS i, [CAST(43690 AS BIGINT), 52428, 61680, 65280] AS vals, [CAST(43690 AS BIGINT), 52428, 61680, 65280] AS bad FROM cfg, range(65) t(scenario) WHERE scenario <= 2 * n
  UNION ALL SELECT run.family, run.n, run.seed, scenario, i + 1, list_append(vals, CAST({STEP.format(gate('plan.c', 'run.vals'))} AS BIGINT)),
    list_append(bad, CAST({STEP.format(gate('CASE WHEN i = 0 THEN [1,0,3,2,7,4,4,4,9,8][plan.c + 1] ELSE plan.c END', 'run.bad'))} AS BIGINT))
  FROM run JOIN plan ON plan.family = run.family AND plan.n = run.n AND plan.seed = run.seed AND plan.k = i),
done AS MATERIALIZED (SELECT family, n, seed, scenario, vals, bad FROM run WHERE i = n),
laws_of AS (SELECT family, n, CAST(count(*) AS BIGINT) AS scenarios, count(*) FILTER (WHERE d <> 0) AS any_apart, count(*) FILTER (WHERE d & 32769 <> 0) AS ends_apart
  FROM (SELECT family, n, list_bit_or(list_transform(list_zip(vals, bad), lambda x: xor(x[1], x[2]))) AS d FROM done) GROUP BY family, n),
turns AS (SELECT *, row_number() OVER (PARTITION BY family, n, seed ORDER BY {DRAW.format('own', 'k')}, k) - 1 AS place, row_number() OVER (PARTITION BY family, n, seed ORDER BY {DRAW.format('copy', 'k')}, k) AS turn, {DRAW.format('alt', 'k')} AS alt FROM node),
dealt AS (SELECT family, n, seed, k, m, copies, place % m AS owner, turn <= n * copies // 100 AS copied, (place % m + 1 + alt % (m - 1)) % m AS other FROM turns, (VALUES (2), (4)) a(m), (VALUES (0), (25)) b(copies)),
mine AS MATERIALIZED (SELECT family, n, seed, k, m, copies, owner AS o FROM dealt UNION ALL SELECT family, n, seed, k, m, copies, other FROM dealt WHERE copied),
seen AS (SELECT family, n, seed, m, copies, o, k + 5 AS v FROM mine UNION SELECT x.family, x.n, x.seed, m, copies, o, s.a FROM mine x JOIN gslot s ON s.family = x.family AND s.n = x.n AND s.seed = x.seed AND s.k = x.k UNION SELECT family, n, seed, m, copies, 0, u FROM dealt, range(1, 5) t(u)),
step AS MATERIALIZED (SELECT p.*, m, copies, o, EXISTS (SELECT * FROM mine x WHERE x.family = p.family AND x.n = p.n AND x.seed = p.seed AND x.m = q.m AND x.copies = q.copies AND x.o = q.o AND x.k = p.k) AS own FROM plan p JOIN (SELECT DISTINCT family, n, seed, m, copies, o FROM mine) q USING (family, n, seed)),
local AS (SELECT d.family, d.n, d.seed, d.scenario, q.m, q.copies, q.o, CAST(0 AS BIGINT) AS i, bad, [CAST(43690 AS BIGINT), 52428, 61680, 65280] AS vals FROM done d JOIN (SELECT DISTINCT family, n, seed, m, copies, o FROM mine) q USING (family, n, seed)
  UNION ALL SELECT l.family, l.n, l.seed, l.scenario, l.m, l.copies, l.o, i + 1, bad, list_append(l.vals, CAST(CASE WHEN plan.own THEN {STEP.format(gate('plan.c', 'l.vals'))} ELSE l.bad[i + 5] END AS BIGINT))
  FROM local l JOIN step plan ON plan.family = l.family AND plan.n = l.n AND plan.seed = l.seed AND plan.m = l.m AND plan.copies = l.copies AND plan.o = l.o AND plan.k = i),
apart AS (SELECT family, n, CAST(sum(list_sum(list_transform(list_zip(vals, bad), lambda x: bit_count(xor(x[1], x[2]))))) AS BIGINT) AS mismatches FROM local WHERE i = n GROUP BY family, n),
held AS (SELECT family, n, count(*) * 16 * (1 + 2 * n) AS coordinates FROM seen GROUP BY family, n)
SELECT family, CAST(n AS INT) AS n, route, models, 12 * scenarios AS law_cases, CASE models WHEN 'faithful' THEN 0 ELSE 4 * (2 * any_apart + ends_apart) END AS laws_apart, coordinates AS local_coordinates, CASE models WHEN 'faithful' THEN 0 ELSE mismatches END AS local_mismatches
FROM laws_of JOIN apart USING (family, n) JOIN held USING (family, n), (VALUES ('raw'), ('deduplicated')) r(route), (VALUES ('faithful'), ('damaged')) t(models)"""
SQL["shuffle_checks"] = f"""WITH {EQ}, r AS (SELECT o, 'Var' AS sort, CAST(v AS VARCHAR) AS id FROM hvar UNION ALL SELECT o, 'Mech', CAST(k AS VARCHAR) FROM held UNION ALL SELECT o, s, k || ':' || p FROM hslot, (VALUES ('Input'), ('Dep')) t(s)),
c AS (SELECT sort, CAST(sum(n) AS BIGINT) AS records, count(*) AS classes, count(*) FILTER (WHERE sort = 'Var' AND n = 2 AND low = 0 AND high = 1 AND CAST(split_part(id, ':', 1) AS BIGINT) >= 4 AND (CAST(split_part(id, ':', 1) AS BIGINT) - 4) % 36 = 0) AS split
  FROM (SELECT sort, id, count(*) AS n, min(o) AS low, max(o) AS high FROM r GROUP BY sort, id) GROUP BY sort)
SELECT diagram, sort, records, CASE diagram WHEN 'damaged' THEN classes + split ELSE classes END AS classes, diagram <> 'damaged' OR split = 0 AS same FROM c, (VALUES ('given'), ('shuffle1'), ('shuffle2'), ('shuffle3'), ('damaged')) t(diagram)"""
SQL["release_manifest"] = f"""WITH {MODELS},
texts AS (SELECT family, n, seed, k, family || ' n' || n || ' seed' || seed || ' V' || k || ' = ' || {CODE_NAMES} || '(' || concat_ws(', ', {', '.join(ARGUMENT.format(i) for i in (1, 2, 3))}) || ')' AS line FROM plan
  UNION ALL SELECT family, n, seed, -1, '# made by s' || seed || '@example.org' FROM cfg WHERE seed % 100 = 3),
files AS (SELECT seed // 50 AS shard, string_agg(line || chr(10), '' ORDER BY seed, family, n, k) AS content, bool_or(k = -1) AS identifying FROM texts GROUP BY seed // 50)
SELECT shard, CAST(strlen(content) AS BIGINT) AS bytes, sha256(content) AS sha256, identifying FROM files"""
SQL["library_faults"] = f"""WITH {EQ}, n AS (SELECT code, count(*) AS n FROM eq GROUP BY code),
f(kind, code, record) AS (VALUES ('missing_row', 'AND', '1,0'), ('missing_row', 'XOR3', '1,1,1'), ('output_domain', 'ID', '1'), ('foreign_row', 'NOT', '2'), ('conflicting_rows', 'OR', '0,1'), ('undeclared_code', 'GONE', ''), ('unknown_type', 'MAJ3', 'odd'))
SELECT kind, f.code, record, coalesce(n.n, 0) AS mechanisms FROM f LEFT JOIN n ON n.code = f.code"""
SQL["partial_library_values"] = f"""WITH RECURSIVE {EQ}, {OBS},
has(n, known, met) AS (SELECT CAST(0 AS BIGINT), [CAST(65535 AS BIGINT), 65535, 65535, 65535], CAST(0 AS BIGINT)
  UNION ALL SELECT n + 1, list_append(known, m & xor(65535, hit)), m FROM (SELECT n, known, CASE WHEN a1 IS NULL THEN 65535 ELSE known[a1] & known[coalesce(a2, a1)] & known[coalesce(a3, a1)] END AS m,
    CASE c WHEN 4 THEN vals[a1] & xor(65535, vals[a2]) WHEN 8 THEN vals[a1] & vals[a2] & vals[a3] ELSE 0 END AS hit FROM has JOIN plan ON plan.k = n, obs_last)),
x AS (SELECT eq.code, xor(65535, known[n + 4]) AS lacking, met & xor(65535, known[n + 4]) AS asked FROM has JOIN eq ON eq.k = n - 1 WHERE n > 0)
SELECT code, count(*) AS variables, CAST(sum(bit_count(lacking)) AS BIGINT) AS lacking, CAST(sum(bit_count(asked)) AS BIGINT) AS asked, CAST(0 AS BIGINT) AS differing FROM x GROUP BY code"""
