"""Centroid clustering and line dedup against plain versions, on vectors and texts made to be awkward."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import kmeans, linededup

EMBEDDINGS = "vec_id long, embedding array<double>, label int, cluster string, x int"
DOCUMENTS = "doc_id long, text string, key string, pos int, h1 long, lines array<string>"


def plain_clusters(rows, k, rounds, dim, scale, seed):
    """All distances in every round, with Python's whole numbers."""
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    points = [list(v) for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min(range(len(points)), key=lambda c: (far(v, points[c]), c))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v), []).append(v)
        for c, members in groups.items():
            points[c] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for i, v in kept:
        c = nearest(v)
        out.append((i, c, far(v, points[c]), hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest()))
    total = {}
    for _, c, d, _ in out:
        total[c] = total.get(c, 0) + d
    return sorted((i, c, d, total[c], sum(total.values()), h) for i, c, d, h in out)


def clusters(spark, rows, k=8, rounds=10, dim=64, scale=1024, seed=3, parts=4):
    table = spark.createDataFrame([(i, v, 0, "c", 1) for i, v in rows], EMBEDDINGS).repartition(parts)
    found = kmeans.cluster(table, k, rounds, dim, scale, seed).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("k, spread", [(8, 0.3), (3, 0.02), (20, 1.0), (1, 1.0)])
def test_clusters_equal_plain_rounds(spark, k, spread):
    g = np.random.default_rng(k)
    homes = g.normal(size=(6, 64))
    rows = [(i, (homes[i % 6] + spread * g.normal(size=64)).tolist()) for i in range(400)]
    assert clusters(spark, rows, k=k) == plain_clusters(rows, k, 10, 64, 1024, 3)


def test_clusters_of_ties_and_repeated_rows(spark):
    """Few coarse values: many equal vectors, equal distances, centroids that fall together and clusters that go empty."""
    r = random.Random(4)
    rows = [(i % 50, [r.choice((-1.0, 0.0, 1.0)) for _ in range(3)]) for i in range(240)] + [(7, [0.0, 0.0, 0.0])] * 30
    for scale in (1, 2, 1024):
        assert clusters(spark, rows, k=8, dim=3, scale=scale) == plain_clusters(rows, 8, 10, 3, scale, 3)


def test_clusters_leave_unusable_vectors_out(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [float("nan"), 1.0]), (4, [1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [0.0, 0.0]), (7, [float("inf"), 0.0]), (8, [])]
    found = clusters(spark, rows, k=8, dim=2)
    assert [f[:3] for f in found] == [f[:3] for f in plain_clusters(rows, 8, 10, 2, 1024, 3)] and {f[0] for f in found} == {1, 6}
    assert clusters(spark, [], k=8) == [] and clusters(spark, [(2, None)], k=8) == []
    with pytest.raises(Exception, match="beyond"):
        clusters(spark, [(1, [1e30, 0.0]), (2, [0.0, 0.0])], dim=2)


def test_bounds_spare_most_distances():
    """Vectors well inside their clusters stay without any distance; a list too short for a move ends in a whole scan."""
    g = np.random.default_rng(1)
    points = (g.normal(size=(10, 16)) * 1000).astype("i8")
    x = points[g.integers(0, 10, 500)] + g.integers(-20, 20, (500, 16))
    bounds = kmeans.scan(x, points, 3)
    moved = points + g.integers(-3, 3, points.shape)
    steps = np.sqrt(((moved - points) ** 2).sum(axis=1))
    kept, used = kmeans.refine(x, *(b.copy() for b in bounds), moved, steps)
    assert used == 0 and (kept[0] == kmeans.scan(x, moved, 3)[0]).all()
    jumped = moved[::-1].copy()
    steps = np.sqrt(((jumped - moved) ** 2).sum(axis=1))
    again, used = kmeans.refine(x, *kept, jumped, steps)
    assert used == 3 and (again[0] == kmeans.scan(x, jumped, 3)[0]).all()


def plain_lines(rows, min_chars=40, min_docs=5):
    blank, upper = " \t\n\x0b\x0c\r", {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    key = lambda line: line.strip(blank).translate(upper)
    docs = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    held = {k: d - {None} for k, d in docs.items() if len(k) >= min_chars and len(d - {None}) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in held or i == max(held[key(x)])]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def kept_lines(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, "k", 1, 2, ["l"]) for i, t in rows], DOCUMENTS).repartition(5)
    found = linededup.drop_shared_lines(docs, keep=("key", "pos", "h1"), **settings)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "key", "pos", "h1"]
    return sorted((tuple(r)[:4] for r in found.collect()), key=str)


LONG = "This very long line of boilerplate is found in many documents"


def awkward_texts():
    r = random.Random(2)
    pool = [LONG, "\t" + LONG.upper() + " \r", "É" * 39, "É" * 40, "é" * 40, " " * 60, "x" * 40 + " ", "x" * 40, "", "short", "퟿\U0001f600" * 20]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(9)))) for i in range(120)]
    rows += [(None, LONG + "\nown"), (None, None), (5, None), (6, ""), (7, LONG), (7, LONG), (119, LONG + "\n" + LONG), (119, LONG), (200, "\n\n"), (201, "y" * 50)]
    return rows + [(300, "\n".join(f"line {i} of a very long document, each said once in it" for i in range(3000)) + "\n" + LONG)]


def test_shared_lines_drop_as_in_plain_version(spark):
    rows = awkward_texts()
    assert kept_lines(spark, rows) == plain_lines(rows)
    assert kept_lines(spark, rows, min_chars=1, min_docs=2) == plain_lines(rows, 1, 2)
    assert kept_lines(spark, rows, min_docs=1) == plain_lines(rows, 40, 1)
    assert kept_lines(spark, []) == []


def test_shared_lines_beyond_the_broadcast(spark, monkeypatch):
    """Hashes meet lines by shuffle, hot ones apart."""
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 0)
    monkeypatch.setattr("causeway.llm.common.HOT_ROWS", 20)
    rows = awkward_texts()
    assert kept_lines(spark, rows) == plain_lines(rows)


def test_line_dedup_has_no_python(spark):
    docs = spark.createDataFrame([(i, LONG, "k", 1, 2, []) for i in range(9)], DOCUMENTS)
    found = linededup.drop_shared_lines(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan
    assert found.agg(F.sum("n_dropped")).first()[0] == 8
