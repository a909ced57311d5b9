"""Corpus operators against brute force, on generated rows with nulls, empty and long texts, ties, repeats and clashing names."""

import random

import numpy as np
import pytest

from causeway.llm import ann, bpe, counts, htmltext, idfile, minhash, mixing, nndescent, toxicity, urlfilter
from causeway.operators.components import components
from causeway.llm.queries import BYTE_BPE, WORD_BPE, tokenizer
from tests.llm import brute

PIECES = ["the", "a", "ab", "'s", "'re", "ll", " ", "  ", "\n", "\t", "!", "12", "é", "<|endoftext|>", "\u2003", "aaaa", "\0", "日本", "\x1c", "Ǆ"]


def texts():
    rng = random.Random(5)
    made = ["".join(rng.choices(PIECES, k=rng.randint(0, 40))) for _ in range(120)]
    return [None, "", "x", *made, made[0], " ".join(rng.choices(["one", "two", "three"], k=20000)), "b" * 50000]


def docs(spark, rows=None):
    rows = list(enumerate(texts())) if rows is None else rows
    return spark.createDataFrame([(i, t, "n", "ids", None) for i, t in rows], "doc_id long, text string, n string, ids string, source string")


EMPTY: list = []


def test_bpe_roundtrip(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in bpe.digests(bpe.roundtrip(docs(spark), tokenizer(BYTE_BPE))).collect()}
    for (i, t), ids in zip(rows, brute.library_ids(BYTE_BPE, [t for _, t in rows])):
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), brute.sha(",".join(map(str, ids))))
        assert got[i]["decoded_sha256"] == brute.sha(t or "")
    assert bpe.roundtrip(docs(spark, EMPTY), tokenizer(BYTE_BPE)).count() == 0


def test_token_counts(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counts.token_counts(docs(spark), tokenizer(BYTE_BPE)).collect()}
    for (i, t), ids in zip(rows, brute.library_ids(BYTE_BPE, [t for _, t in rows])):
        assert got[i] == (len((t or "").encode()), len(ids), len(ids) > 1024)
    assert counts.token_counts(docs(spark, EMPTY), tokenizer(BYTE_BPE)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_packing(n):
    ranks = np.random.default_rng(n).integers(0, 1 << 32, n) >> np.random.default_rng(n + 1).integers(0, 32, n)
    control, data = idfile.pack(ranks.astype("u4"))
    assert len(control) == -(-n // 4) and (idfile.unpack(control, data, n) == ranks).all()


def test_token_files(spark):
    rows = list(enumerate(texts()))
    want = brute.token_file(rows, 1)
    from pyspark.sql import functions as F

    folder = idfile.write_ids(docs(spark), tokenizer(WORD_BPE), 1)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["c"]) for r in idfile.read_ids(spark, folder).withColumn("c", F.crc32("ids")).collect()}
    assert got == want
    assert idfile.read_ids(spark, idfile.write_ids(docs(spark, EMPTY), tokenizer(WORD_BPE), 1)).count() == 0


def test_token_files_of_repeated_and_missing_ids(spark):
    """Every row comes back, rows without id first, those of one id beside each other, each behind the ids before it."""
    from pyspark.sql import functions as F

    rows = [(i, t) for i, t in enumerate(texts()[:60])]
    rows += [(None, f"no id {i % 40} here") for i in range(300)] + [(7, "seven"), (7, "seven"), (7, None), (7, "seven again")]
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, data int").repartition(5)
    got = [(r["doc_id"], r["start"], r["n_tokens"], r["c"]) for r in idfile.read_ids(spark, idfile.write_ids(table, tokenizer(WORD_BPE), 1)).withColumn("c", F.crc32("ids")).collect()]
    alone = brute.token_file([(k, t) for k, (_, t) in enumerate(rows)], 1)
    assert sorted((str(i), n, c) for i, _, n, c in got) == sorted((str(i), *alone[k][1:]) for k, (i, _) in enumerate(rows))
    in_order = sorted(got, key=lambda r: r[1])
    assert [r[1] for r in in_order] == [sum(x[2] for x in in_order[:k]) for k in range(len(rows))]
    ids = [r[0] for r in in_order]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))


def test_other_vocabularies_are_encoded_whole():
    from causeway.llm.queries import BYTE_BPE

    made = [None, "", "two  words ", " a\n\nb, 's <|endoftext|>x", "x" * 500]
    encoder = idfile.LibraryEncoder(tokenizer(BYTE_BPE))
    assert not encoder.by_chunks and idfile.LibraryEncoder(tokenizer(WORD_BPE)).by_chunks
    assert encoder.encode(made) == [np.array(ids, "<u4").tobytes() for ids in brute.library_ids(BYTE_BPE, [t or "" for t in made])]


def test_library_encoder_on_odd_characters():
    rng = random.Random(9)
    odd = [*"abZ.,;:!?'0-_ \n\t\r\0\x01\x85", "\u0301", "\u0345", "é", "Å", "İ", "ß", "²", "½", "Ⅳ", "ª", "Ω", "中", "\u2028", "\u3000", "\u200b", "\ufeff", "<|endoftext|>"]
    made = ["".join(rng.choices(odd, k=rng.randint(0, 30))) for _ in range(5000)]
    encoder = idfile.LibraryEncoder(tokenizer(WORD_BPE))
    got = [x for i in range(0, len(made), 50) for x in encoder.encode(made[i : i + 50])]
    assert got == [np.array(ids, "<u4").tobytes() for ids in brute.library_ids(WORD_BPE, made)]


def near_rows():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    rows, i = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "\t\n ")], 5
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(5, 150))
        for _ in range(rng.choice([1, 1, 2, 5, 30])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((i, " ".join(copy)))
            i += 1
    return rows


@pytest.mark.parametrize("width", [4, 5])
def test_near_documents(spark, width):
    rows = near_rows()
    want = brute.near_documents(rows, width, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows), width=width).collect()}
    assert got == want


def test_near_documents_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = near_rows()
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(spark, rows), width=4).collect()}
    assert got == {i: c for i, (_, c) in brute.near_documents(rows, 4, 80).items()}


def test_near_documents_without_rows(spark):
    assert minhash.near_duplicates(docs(spark, EMPTY)).count() == 0
    assert [r["kept"] for r in minhash.near_duplicates(docs(spark, [(None, "a b c d e f")])).collect()] == [False]


def test_near_documents_of_large_groups(spark, monkeypatch):
    """Hot classes by broadcast, parts of a hot star, repeated rows, and an id with two texts."""
    monkeypatch.setattr("causeway.llm.common.HOT_ROWS", 20)
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(2)
    base, words = [f"b{i}" for i in range(120)], [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=60))) for i in range(40)]
    rows += [(100 + i, " ".join(base)) for i in range(60)]
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(120)] = rng.choice(words)
        rows.append((200 + i, " ".join(copy)))
    want = brute.near_documents(rows, 4, 80)
    table = docs(spark, [*rows, rows[3], rows[50], (None, rows[50][1]), (5, rows[6][1])])
    found = minhash.near_duplicates(table, width=4).collect()
    assert len(found) == len(rows) + 4
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None and r["doc_id"] not in (5, 6)}
    assert got == {i: x for i, x in want.items() if i not in (5, 6)}
    assert {r["component_id"] for r in found if r["doc_id"] in (5, 6)} == {5}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20}


def vectors():
    rng = np.random.default_rng(4)
    rows = [(0, None), (1, [0.0] * 8), (2, [float("nan")] * 8), (3, [None] * 8), (4, [float("inf")] + [1.0] * 7), (5, []), (6, [1.0, 2.0])]
    for _ in range(60):
        base = rng.normal(size=8)
        for _ in range(rng.choice([1, 2, 12])):
            rows.append((len(rows), (base + rng.normal(size=8) * rng.choice([0, 0.1])).tolist()))
    return rows


def test_near_vectors(spark):
    rows = vectors()
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, n int")
    exact = [(i, [float(np.float32(x)) for x in v] if v and None not in v else v) for i, v in rows if not v or len(v) != 2] + [(6, None)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(table).collect()}
    assert got == brute.near_vectors(exact, 0.95)
    assert nndescent.near_duplicates(table.limit(0)).count() == 0


def test_near_vectors_of_two_lobes(spark):
    """Lists of 192 hold no link between lobes of 400: each row's own lobe is nearer."""
    rng = np.random.default_rng(8)
    centres = np.zeros((2, 32))
    centres[:, 0], centres[0, 1], centres[1, 1] = np.cos(0.133), np.sin(0.133), -np.sin(0.133)
    made = np.repeat(centres, 400, axis=0) + rng.normal(size=(800, 32)) * 0.004
    unit = made / np.linalg.norm(made, axis=1)[:, None]
    across = unit[:400] @ unit[400:].T
    assert 0.95 < across.min() and across.max() < min((unit[:400] @ unit[:400].T).min(), (unit[400:] @ unit[400:].T).min())
    rows = list(enumerate(made.tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(table).collect()}
    assert got == brute.near_vectors(rows, 0.95) == {i: (799, 0) for i in range(800)}


def test_near_vectors_after_a_poor_descent(spark, monkeypatch):
    """The audit sees that a descent has found nothing; one from more projections follows, or an error."""
    first = nndescent.first_graph
    rng = np.random.default_rng(6)
    rows = list(enumerate((np.repeat(rng.normal(size=(15, 8)), 10, axis=0) + rng.normal(size=(150, 8)) * 0.1).tolist()))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(nndescent, "gathered", lambda rows, count, most: rows.selectExpr("id", "id AS leader", "0D AS angle"))
    monkeypatch.setattr(nndescent, "first_graph", lambda rows, count, tables, seed: first(rows, count, tables, seed).where(str(tables > nndescent.TABLES)))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(table).collect()}
    assert got == brute.near_vectors(rows, 0.95)
    monkeypatch.setattr(nndescent, "first_graph", lambda rows, count, tables, seed: first(rows, count, tables, seed).where("false"))
    monkeypatch.setattr(nndescent, "DESCENTS", 2)
    with pytest.raises(RuntimeError, match="links"):
        nndescent.near_duplicates(table)


def test_near_vectors_of_large_groups(spark):
    """Groups of 2,000 near and 500 exact copies in 256 dimensions among unlike vectors, repeated ids, tiny and huge values."""
    rng = np.random.default_rng(12)
    unlike, base = rng.normal(size=(700, 256)), rng.normal(size=(3, 256))
    near = base[0] + rng.normal(size=(2000, 256)) * 0.12
    wide = base[1] + rng.normal(size=(300, 256)) * np.linspace(0.05, 0.6, 300)[:, None]
    made = np.concatenate([unlike, near, wide, np.repeat(base[2:], 500, axis=0), unlike[:5] * 1e-200, unlike[:5] * 1e200])
    rows = list(enumerate(made.tolist()))
    table = spark.createDataFrame([*rows, rows[3], rows[900]], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(table).collect()}
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in rows]
    want = brute.near_vectors(scaled, 0.95)
    assert sum(got[i][0] for i in got) / sum(n for n, _ in want.values()) >= 0.99
    assert np.mean([got[i] == want[i] for i in want]) >= 0.99 and all(got[i][0] <= want[i][0] for i in want)


def test_near_vectors_of_dense_groups(spark, monkeypatch, caplog):
    """Groups about the threshold are neither cliques nor apart: tiles count their links, and no row stands for a link."""
    rng = np.random.default_rng(21)
    base = rng.normal(size=(3, 48))
    made = np.concatenate([base[i] + rng.normal(size=(n, 48)) * w for i, n, w in ((0, 700, 0.22), (1, 200, 0.3), (2, 60, 0.1))])
    made = np.concatenate([made, made[:20], rng.normal(size=(150, 48))])
    rows = list(enumerate(made.tolist()))
    monkeypatch.setattr(nndescent, "TILE_ROWS", 64)
    seen = []
    whole = nndescent.counted
    monkeypatch.setattr(nndescent, "counted", lambda met, least, theta: seen.append(met) or whole(met, least, theta))
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    with caplog.at_level("INFO"):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in nndescent.near_duplicates(table).collect()}
    want = brute.near_vectors(rows, 0.95)
    assert got == want and "recall of links 1.0" in caplog.text
    assert sum(n for n, _ in want.values()) > 50 * sum(m.count() for m in seen)


def test_nearest_hubs_are_audited(spark):
    """A graph without edges finds none of the nearest hubs, though no two are linked; the graph of nearest ones finds all."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 6))
    x /= np.linalg.norm(x, axis=1)[:, None]
    hubs = spark.createDataFrame([(i, 6, v.tolist(), 0.0) for i, v in enumerate(x)], "id long, dim int, vector array<double>, r double")
    far = nndescent.angles(x, x) + 9 * np.eye(40)
    graph = spark.createDataFrame([(i, int(far[i].argmin()), -float(far[i].min())) for i in range(40)], "u long, v long, s double")
    assert nndescent.nearest_found(hubs, graph, 40, 1, 0.6) == (1.0, 1.0)
    assert nndescent.nearest_found(hubs, graph.where("s < -0.6"), 40, 1, 0.6) == (0.0, (far.min(axis=1) > 0.6).mean())
    assert nndescent.nearest_found(hubs, graph, 40, 1, 0.0) == (None, 1.0)
    assert nndescent.nearest_found(hubs.limit(0), graph, 0, 1, 0.6) == (None, None)


def test_nearest_vectors(spark):
    rows = [r for r in vectors() if r[0] != 6]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int")
    want = brute.nearest(rows, [i for i, _ in rows], 10)
    found: dict = {}
    for r in ann.search(table, table).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(want)
    assert np.mean([len({i for _, i in want[q]} & {i for _, i, _ in found[q]}) / len(want[q]) for q in want]) >= 0.95
    assert all([p for p, _, _ in sorted(x)] == list(range(1, len(x) + 1)) for x in found.values())
    assert ann.search(table.limit(0), table).count() == 0


@pytest.mark.parametrize("spread", [0.3, 5.0])
def test_nearest_in_several_shards(spark, monkeypatch, spread):
    """Small shards and query blocks, clusters and none, repeated ids, ties: exact scores, ranks in order, recall of 0.95."""
    for name, value in (("SHARD_ROWS", 150), ("QUERY_BLOCK", 32), ("AUDITED", 40)):
        monkeypatch.setattr(ann, name, value)
    rng = np.random.default_rng(3)
    made = (np.repeat(rng.normal(size=(30, 24)) * 5, 50, axis=0) + rng.normal(size=(1500, 24)) * spread).round(2)
    made[100:140] = made[100]
    made[7] *= 1e25
    rows = list(enumerate(made.tolist()))
    table = spark.createDataFrame([*rows, rows[105], rows[105], (None, rows[0][1])], "vec_id long, embedding array<double>")
    asked = [i for i in range(0, 1500, 5)]
    want = brute.nearest(rows, asked, 10)
    found: dict = {}
    for r in ann.search(table, table.where("vec_id % 5 = 0")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == set(asked)
    recall = []
    for q in asked:
        got = [x[1:] for x in sorted(found[q])]
        assert got == sorted(got) and len({i for _, i in got}) == 10 and q not in {i for _, i in got}
        exact = np.sqrt(((made[[i for _, i in got]] - made[q]) ** 2).sum(axis=1))
        assert np.allclose([d for d, _ in got], exact, rtol=1e-12)
        recall.append(len({i for _, i in got} & {i for _, i in want[q]}) / 10)
    assert np.mean(recall) >= 0.95
    assert [i for _, i in sorted(x[1:] for x in found[110])] == [i for i in range(100, 111) if i != 110]


@pytest.mark.parametrize("jitter", [1e-3, 1e-4, 1e-5])
def test_nearest_in_tight_groups(jitter):
    """Rounding in the graph doesn't decide which near copies are found, wherever the group lies."""
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(32, 1.0) + rng.normal(size=(600, 32)) * jitter, rng.normal(size=(300, 32))])
    graph, hits = ann.Graph(x).build(), 0
    for i in range(0, 600, 10):
        exact = ((x - x[i]) ** 2).sum(axis=1)
        found = graph.ask(x[i], ann.ASK_BREADTH)
        assert len(found) >= ann.ASK_BREADTH
        hits += len(set(found[np.argsort(exact[found])][:11]) & set(np.argsort(exact)[:11]))
    assert hits >= 0.97 * 60 * 11


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) if i % 9 else None, rng.choice(["a", "b", "c", None, "tiny"] if i % 50 == 0 else ["a", "b", "c", None])) for i in range(400)]
    table = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "doc_id long, text string, source string, size string")
    got = mixing.mix(table).collect()
    total = sum(r["size"] for r in got)
    by: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by.setdefault(r["source"], [r["target"], 0, r["source_size"]])
        x[1] += r["taken"]
    assert abs(sum(x[0] for x in by.values()) - total) < 1e-6 * max(1, total)
    assert all(abs(x[1] - x[0]) <= 1 and x[0] <= 3 * x[2] for x in by.values())
    again = mixing.mix(table.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    drawn: dict = {}
    for r in mixing.draw(table).collect():
        drawn[r["doc_id"]] = drawn.get(r["doc_id"], 0) + 1
    assert drawn == {i: n for (i, _, _), n in zip(rows, brute.draw_mix([(i, t, s) for i, t, s in rows])) if n}
    assert mixing.mix(table.limit(0)).count() == 0 and mixing.draw(table.limit(0)).count() == 0


def test_mixing_of_missing_and_repeated_ids(spark, monkeypatch):
    """Rows without id spread over many keys, reruns agree, and budgets are met to a word."""
    rng = random.Random(4)
    rows = [(None if i % 2 else i // 6, " ".join([f"w{i}"] * rng.randint(0, 9)) or None, "ab"[i % 3 == 0]) for i in range(300)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    monkeypatch.setattr(mixing, "RANGE_ROWS", 10)
    keys = mixing.placed(table, (5, 2, 1), 3, "mix").where("doc_id IS NULL AND size > 0")
    assert keys.select("key").distinct().count() == keys.count() > 100
    got = mixing.mix(table).collect()
    by: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        x = by.setdefault(r["source"], [r["target"], 0])
        x[1] += r["taken"]
    assert len(got) == len(rows) and all(abs(target - taken) <= 1 for target, taken in by.values())
    key = lambda r: (str(r["doc_id"]), r["source"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(table.repartition(7)).collect()))
    drawn = sorted((str(r["doc_id"]), str(r["text"])) for r in mixing.draw(table).collect())
    assert drawn and drawn == sorted((str(r["doc_id"]), str(r["text"])) for r in mixing.draw(table.repartition(4)).collect())


URLS = [None, "", "no scheme", "http://EXAMPLE.org/es/x?y", "http://a.b.example.org/en/17", "https://x.com/fr/", "https://com/de/#q", "http://example.org", "http://notexample.org.net/es/", "http://example.org?/es/", "a://example.org/es", "http://" + "a." * 3000 + "com/de/" + "z" * 9000]


def test_url_rules(spark):
    rules = urlfilter.parse_rules(["allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/"])
    table = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, rule string")
    got = [(r["rule"], r["verdict"]) for r in urlfilter.judge(table, rules).orderBy("page_id").collect()]
    assert got == [(None, "allow")] * 3 + [("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("org/", "allow"), ("com/de/", "block")]
    assert urlfilter.judge(table.limit(0), rules).count() == 0 and urlfilter.judge(table, []).count() == len(URLS)


@pytest.mark.parametrize("bits", [3, 10])
def test_many_url_rules(spark, monkeypatch, bits):
    """Thousands of rules, also by filters so small that the cascade has many levels, against plain matching."""
    monkeypatch.setattr(urlfilter, "BITS_A_KEY", bits)
    rng = random.Random(4)
    hosts = [f"h{i}.d{i % 70}.org" for i in range(700)] + ["org"] + [f"d{i}.org" for i in range(70)]
    rules = {}
    for _ in range(600):
        key = (rng.choice(hosts), "/" + "".join(rng.choices("ab", k=rng.randint(0, 3))))
        rules[key] = rng.choice(["allow", "block"])
    urls = [f"http://{rng.choice(['', 'x.', 'y.x.'])}{rng.choice(hosts)}/{''.join(rng.choices('abc', k=rng.randint(0, 5)))}" for _ in range(600)]
    listed = urlfilter.parse_rules([f"{v} {h}{p}" for (h, p), v in rules.items()])
    got = [(r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), listed).orderBy("page_id").collect()]
    for (rule, verdict), url in zip(got, urls):
        host, slash, path = url[7:].partition("/")
        fits = [(len(h + p), h + p, v) for (h, p), v in rules.items() if (host == h or host.endswith("." + h)) and (slash + path).startswith(p)]
        want = max(fits) if fits else (0, None, "allow")
        assert (rule, verdict) == want[1:] or (fits and len(rule) == want[0] and verdict == rules[tuple(rule.split("/", 1)[0:1]) + ("/" + rule.split("/", 1)[1],)])


def test_url_filters_dont_grow_with_the_urls(spark):
    """Twenty times the URLs make each filter a few bits a rule larger, and later levels no larger; too many rules are an error."""
    rules = urlfilter.parse_rules([f"block h{i}.org/a" for i in range(2000)] + ["allow org/b"])
    sizes = []
    for n in (20_000, 400_000):
        urls = spark.range(n).selectExpr("concat('http://x', id, '.h', id, '.org/', substring('abc', 1 + id % 3, 2)) AS url")
        levels, blocking = urlfilter.build_cascades(urls, rules)
        sizes.append([level.size for level in levels])
        assert all(level.size * 64 <= 2 * urlfilter.LATER_BITS * 2001 for level in levels[1:]) and len(blocking) >= 1
    assert sizes[1][0] < 1.9 * sizes[0][0] and sum(sizes[1][1:]) < 2 * 2001 * urlfilter.LATER_BITS * 2 / 64
    got = urlfilter.judge(urls, rules).groupBy("verdict").count().collect()
    # Of h0 to h1999, those whose path begins with a.
    assert {r["verdict"]: r["count"] for r in got} == {"block": len([i for i in range(2000) if i % 3 == 0]), "allow": 400_000 - 667}
    with pytest.raises(ValueError, match="bytes"):
        urlfilter.build_level(urls, 0, 1 << 33, 10)


def test_html(spark):
    page = "<html><head><title>t</title></head><body><header>H</header><nav><a href=x>m</a></nav><div class='ad'>buy, now, here</div><article><h1>Title &amp; more</h1><p>One,\n two <b>three</b><br>four<p>Five</article><div id=comments><p>so, very, nice</p></div><footer>f</footer></body></html>"
    table = spark.createDataFrame([(1, "u", page, 0), (2, "u", None, 0), (3, None, "", 0), (4, "u", "<p>" + "x " * 200000, 0)], "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in htmltext.extract(table).collect()}
    assert got[1]["text"] == "Title & more\nOne, two three four\nFive" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == "" and got[4]["n_chars"] == 399999
    assert htmltext.extract(table.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(1)
    bad, good = ["grubfink", "snarlpot", "vexhag"], [f"w{i}ord" for i in range(300)]
    rows = []
    for i in range(600):
        words, toxic = rng.choices(good, k=rng.randint(3, 80)), i % 4 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(1000, None, "x"), (1001, "", "x"), (1002, "a grubfinks b", "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(table, model).collect()}
    held = {r["doc_id"] for r in table.where(toxicity.held_out(table["doc_id"])).collect()}
    right = [(got[i] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows if i in held]
    assert np.mean(right) > 0.95 and got[1000] == got[1001] < 0.7 < got[1002]
    assert all(0 <= s <= 1 for s in got.values())
    empty = toxicity.fit(table.limit(0), labels.limit(0))
    assert toxicity.score(table.limit(0), empty).count() == 0


@pytest.mark.parametrize("k", [1, 3, 8, 20, 200])
def test_html_of_long_articles(k):
    """However long one part of an article is, its other parts stay."""
    long = "".join(f"<p>{'word, ' * 3}{'word ' * 76}{i}</p>" for i in range(k))
    inner = f"<header><h1>Title</h1></header><h4>four</h4><section>{long}</section><section><p>Short part</p></section><figure><figcaption>Figure</figcaption></figure><dl><dt>Term</dt><dd>Meaning</dd></dl><details><summary>More</summary>hidden away</details>"
    page = "<body><nav><a href=x>m</a></nav>%s<footer>f</footer></body>"
    want = ["Title", "four", *(f"{'word, ' * 3}{'word ' * 76}{i}" for i in range(k)), "Short part", "Figure", "Term", "Meaning", "More", "hidden away"]
    assert htmltext.main_text(page % f"<article>{inner}</article>").split("\n") == want
    assert htmltext.main_text(page % f"<main><div>{inner}</div></main>").split("\n") == want
    assert htmltext.main_text(page % f"<main><article>{inner}</article><article><p>Next</p></article></main>").split("\n") == [*want, "Next"]
    assert htmltext.main_text(page % f"<div><h4>four</h4>Loose text<section>{long}</section><section><p>Short part</p></section></div>").split("\n") == ["four", "Loose text", *want[2:-5]]


def test_html_pages():
    """The pages of the smallest table against an extractor of another kind."""
    import pyarrow.parquet as pq

    pages = pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist()
    got = [htmltext.main_text(p) for p in pages]
    assert len(pages) and got == [brute.article_text(p) for p in pages] == [brute.text_without_parts(p) for p in pages]


HTML = [
    ("<p>\u0130</p><SCRIPT>x</SCRIPT><article><p>Hello, there</p></article>", "\u0130\nHello, there"),
    ("<article><div class='related-work'><p>Rel</p></div><p class='notice-of'>Not</p><p>z</p></article>", "Rel\nNot\nz"),
    ("<div>a<hr>b</div>", "a\nb"),
    ("<form><input><h1>T</h1><p>Text, more</p><select><option>x</select></form>", "T\nText, more"),
    ("<body><form>Search <input></form><p>Real</p></body>", "Real"),
    ("<article><p>Main</p><div class='ad-box'>Buy</div></article><div id=comments><p>so, very, very, long a comment</p></div>", "Main"),
    ("<article><p title='a hidden > thing'>Seen</p><p hidden>Unseen</p></article>", "Seen"),
    ("a < b <c", "a < b <c"),
    ("<p>&amp;lt; &#65;&nbsp;B\n C", "&lt; A B C"),
    ("<p>one<p>two<div>three</div>four</b>", "one\ntwo\nthree\nfour"),
    ("<article class='post has-sidebar tag-cookies'><p>Main, text</p><div class=cookie-recipe><p>Bake</p></div></article>", "Main, text\nBake"),
    ("<article><p>Main, text</p><section class=discussion><h2>Discussion</h2><p>We found, in short, this.</p></section></article>", "Main, text\nDiscussion\nWe found, in short, this."),
    ("<div class=sidebar-layout><article><p>Main, text</p></article></div><div class=sidebar-layout><p>Side</p></div>", "Main, text"),
    ("<div class=page-header><h1>Title</h1></div><article><p>Main, text</p></article>", "Main, text"),
    ("<main><div class=page-header><h1>Title</h1></div><article><p>Main, text</p></article></main>", "Title\nMain, text"),
    ("<main><article class='sponsored'><p>All, there, is</p></article></main>", "All, there, is"),
]
COMMENTS = "<div class=c1><p>I think, as others do, that this is, well, fine.</p></div>" * 5
LEFT_OUT = ["comment-thread", "comment-body", "discussion", "fb-comments", "FBComments", "reader-comments-2"]
INSIDE = ["advert-300x250", "google-ad", "ad-leaderboard", "cookie-policy", "privacy-notice", "promo-x", "share-this", "newsletter-signup-v2", "taboola", "inline-ad", "comment-list"]


@pytest.mark.parametrize("name", LEFT_OUT)
def test_html_comments_beside_the_article(name):
    part = f"<section class='{name}'>{COMMENTS}</section>"
    post = "<h1>Title</h1><p>Main, text, of the page.</p><p>More, text.</p>"
    want = "Title\nMain, text, of the page.\nMore, text."
    for page in (f"<main><article>{post}</article>{part}</main>", f"<body><div class=post>{post}</div>{part}</body>", f"<article>{post}</article>{part}", f"<body>{part}<div class=post>{post}</div></body>"):
        assert htmltext.main_text(page) == want, page
    by_article = "".join(f"<article><p>I think, {k}, that it is, well, fine, and so on, and on.</p></article>" for k in range(4))
    assert htmltext.main_text(f"<main><div class=post>{post}</div><section class='{name}'>{by_article}</section></main>") == want


@pytest.mark.parametrize("name", INSIDE)
def test_html_parts_inside_the_article(name):
    page = f"<main><article><h1>Title</h1><p>Main, text</p><div class='{name}'><h2>More</h2><p>Buy, or read, this.</p></div><p>End</p></article><div class='{name}'><h1>Also</h1><p>Other, things</p></div></main>"
    assert htmltext.main_text(page) == "Title\nMain, text\nEnd"


def test_html_parts_known_by_content():
    """Headings, repeated parts, links and calls tell where no name does."""
    post = "<h1>Title</h1><p>Main, text, of the page.</p><p>More, text.</p>"
    want = "Title\nMain, text, of the page.\nMore, text."
    for part in (f"<section><h3>12 comments</h3>{COMMENTS}</section>", "<div><h4>Related articles</h4><ul><li><a href=x>One, two</a></li><li><a href=y>Three</a></li></ul></div>", "<div class=feedback-x><p>Subscribe now</p></div>"):
        assert htmltext.main_text(f"<main><article>{post}</article>{part}</main>") == want
        assert htmltext.main_text(f"<article>{post}{part}</article>") == want
    kept = "<section><h3>Comments</h3><p>On method, and on data.</p></section>"
    assert htmltext.main_text(f"<article>{post}{kept}</article>") == f"{want}\nComments\nOn method, and on data."


@pytest.mark.parametrize(("page", "text"), HTML)
def test_html_probes(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize("made", [lambda n: "<a " * n, lambda n: "<div>x" * n, lambda n: '<a "' * n + ">", lambda n: "<b>" * n + "<h1>x</h1>" * n, lambda n: "<div>" * n + "</section>" * n, lambda n: "<i><div>" + "<b>" * n + "</i>" * n, lambda n: "<a " + "a" * n + ">", lambda n: "<!--" * n, lambda n: "<title>" * n, lambda n: "<" * n + ">"])
def test_html_in_linear_time(made):
    import time

    took = []
    for n in (10_000, 80_000):
        began = time.perf_counter()
        htmltext.main_text(made(n))
        took.append(time.perf_counter() - began)
    assert took[1] < 0.5 + 24 * took[0]


def small_model(width=2):
    rng = np.random.default_rng(3)
    return toxicity.Model(rng.normal(size=(toxicity.BUCKETS, 4)), rng.normal(size=(4, 2)), rng.normal(size=2), width)


def test_toxicity_gradient():
    """Gradients by differences: of weights, bias and n-gram vectors, over documents of no, one and several words."""
    model, words = small_model(), ["alpha", "beta", "gamma", "be"]
    flat, first = toxicity.gram_lists(words)
    docs = [np.array(d, "i4") for d in ([0, 1, 2, 1], [], [3], [2, 3])]
    wrong = np.array([0.5, -1.0, 2.0, 0.25])
    batch = toxicity.Batch(docs, flat, first, model.width)
    loss = lambda: float(wrong @ batch.forward(model))
    loss()
    by_weights, by_bias, hit, by_vectors = batch.backward(model, wrong)
    places = [(model.weights, (1, 0), by_weights[1, 0]), (model.weights, (2, 1), by_weights[2, 1]), (model.bias, (0,), by_bias[0]), (model.bias, (1,), by_bias[1])]
    places += [(model.vectors, (hit[i], d), by_vectors[i, d]) for i in (0, len(hit) // 2, len(hit) - 1) for d in range(4)]
    for value, at, got in places:
        old = value[at]
        value[at] = old + 1e-5
        up = loss()
        value[at] = old - 1e-5
        down = loss()
        value[at] = old
        assert abs((up - down) / 2e-5 - got) < 1e-6 * max(1, abs(got))


@pytest.mark.parametrize("width", [1, 2, 5])
def test_toxicity_scores(width):
    model = small_model(width)
    made = ["", None, "one", "One, two!", "a b c d e f g h", "word " * 30, "x \u0130 \ud55c"]
    scorer = toxicity.Scorer(*model.table(), width)
    assert np.allclose(scorer.scores(made), [brute.toxic_score(t, model) for t in made], atol=1e-9)


def test_toxicity_of_long_texts(spark):
    """However often a clean text is repeated its score stays; one bad word counts in a long text wherever it stands; ties and repeated rows are kept."""
    rng = random.Random(1)
    bad, good = ["grubfink", "snarlpot", "vexhag"], [f"w{i}ord" for i in range(300)]
    texts = []
    for i in range(400):
        words = rng.choices(good, k=rng.randint(3, 80))
        if i % 4 == 0:
            words[rng.randrange(len(words))] = rng.choice(bad)
        texts.append(" ".join(words))
    model = toxicity.train(texts, [int(i % 4 == 0) for i in range(400)])
    scorer = toxicity.Scorer(*model.table(), model.width)
    clean = " ".join(rng.choices(good, k=200))
    long = rng.choices(good, k=200_000)
    scores = [float(scorer.scores([t])[0]) for t in (clean, " ".join([clean] * 100), " ".join([clean] * 1000), " ".join(long))]
    assert max(scores) < 0.1 and max(scores[:3]) - min(scores[:3]) < 0.01
    marked = rng.choices(good, k=5000)
    for at in (0, 1, 2, 3333, 4999):
        assert scorer.scores([" ".join([*marked[:at], "grubfink", *marked[at:]])])[0] >= toxicity.THRESHOLD
    rows = spark.createDataFrame([(1, clean, "a"), (1, clean, "b"), (2, clean, "a"), (None, clean, "a")], "doc_id long, text string, __text string")
    got = [r["score"] for r in toxicity.score(rows, model).collect()]
    assert len(got) == 4 and len(set(got)) == 1
    twice = toxicity.fit(rows.union(rows), spark.createDataFrame([(1, 0), (2, 1), (2, 1)], "doc_id long, toxic int"))
    assert isinstance(twice, toxicity.Model)


def test_toxicity_is_fitted_in_a_task(spark, monkeypatch):
    """The driver never holds the sample, so training in its process is an error."""
    import os

    here, driver = toxicity.train, os.getpid()

    def elsewhere(texts, labels):
        assert os.getpid() != driver
        return here(texts, labels)

    monkeypatch.setattr(toxicity, "train", elsewhere)
    rows = [(i, "vile slur" if i % 2 else "kind word") for i in range(40)]
    table, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    assert model.vectors.shape == (toxicity.BUCKETS, toxicity.DIMENSIONS)
    assert all((r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in toxicity.score(table, model).collect())


def test_marks_behind_words_are_learnt_apart():
    """A word is learnt once whatever ASCII marks follow it; chunks of added tokens stay whole. Ids are the library's."""
    import public_tokenizers

    encoder, learnt = idfile.LibraryEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    real = encoder.learn
    encoder.learn = lambda chunks: learnt.extend(chunks) or real(chunks)
    marks = ["%%%", "&&", "$", "###", ")", '"]', "=", "-", "/", "@", "^", "`", "~", "\\", "}", "*_*", "+", "%'s", "'", "'s", ">", "|>", "<"]
    texts = ["Grubfink" + m + " é" + m + " 7" + m for m in marks] + ["<|endoftext|> x<|endoftext|> <|endoftext|>, ≠ a≠ a= ̸", None, ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [encoder.ids(t or "").tolist() for t in texts]
    assert learnt.count("Grubfink") == 1 and not any(c in learnt for c in ("Grubfink%%%", "Grubfink&&", "Grubfink)"))
    assert "<|endoftext|>" in learnt


def test_bpe_steps_are_asked_once(monkeypatch):
    """Suffixes that are tokens are looked for once for each step of the walk, not at each byte of each word, and bounds on what is kept change no ids."""
    from tokenizers import Tokenizer

    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 12))) for _ in range(3000)})
    library = Tokenizer.from_file(tokenizer(BYTE_BPE))
    for kept in (bpe.ANSWERS, 3):
        monkeypatch.setattr(bpe, "ANSWERS", kept)
        vocab, calls = bpe.Vocabulary(tokenizer(BYTE_BPE)), []
        monkeypatch.setattr(bpe.Vocabulary, "ends", lambda self, tail, whole=bpe.Vocabulary.ends: calls.append(tail) or whole(self, tail))
        got = bpe.encode_words(vocab, [w.encode() for w in words])
        assert all(got[w.encode()] == library.encode(w, add_special_tokens=False).ids for w in words)
        if kept > 3:
            assert len(calls) < len(words)  # each has several bytes of its own
