"""Each stage of the pipeline and its whole against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest

import corpus_pipeline as pipeline
from causeway.llm import toxicity
from causeway.llm.queries import BYTE_BPE
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(6)
    words, bad = [f"w{i}ord" for i in range(300)], ["grubfink", "snarlpot", "vexhag"]
    texts = []
    for i in range(260):
        text = rng.choices(words, k=rng.randint(5, 90))
        if i % 5 == 0:
            text[rng.randrange(len(text))] = rng.choice(bad)
        texts.append(text)
    made = [(i, " ".join(t), int(i % 5 == 0)) for i, t in enumerate(texts)]
    for i in range(40):
        copy = list(texts[i % 12])
        if i % 2:
            copy[rng.randrange(len(copy))] = "other"
        made.append((1000 + i, " ".join(copy), None))
    made += [(2000, None, None), (2001, "", 0), (2002, " \t", None), (2003, " ".join(rng.choices(words, k=20_000)), 0)]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], len(t or "")) for i, t, _ in made]
    labels = [(i, 1, y) for i, _, y in made if y is not None]
    return [*rows, rows[7]], labels


@pytest.fixture(scope="module")
def case(spark, tmp_path_factory):
    rows, labels = documents()
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def clean(spark, folder, rows):
    model = toxicity.fit(spark.createDataFrame(rows, SCHEMA), spark.read.parquet(f"{folder}/labels.parquet"))
    return [r for r in rows if brute.toxic_score(r[1], model) < toxicity.THRESHOLD]


def distinct(rows):
    found = brute.near_documents([(r[0], r[1]) for r in rows], 5, 80)
    return [r for r in rows if found[r[0]][1] == r[0]]


def mixed(rows):
    return [r for r, n in zip(rows, brute.draw_mix([(r[0], r[1], r[3]) for r in rows])) for _ in range(n)]


def encoded(rows):
    ids = brute.library_ids(BYTE_BPE, [r[1] for r in rows])
    library = brute.library(BYTE_BPE)
    return [(r[0], r[3], len(x), brute.sha(",".join(map(str, x))), brute.sha(library.decode(x, skip_special_tokens=False))) for r, x in zip(rows, ids)]


def same(got, want):
    order = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert order(got) == order(want)


def test_stages(spark, case):
    folder, rows = case
    first = clean(spark, folder, rows)
    assert 200 < len(first) < 270
    same(pipeline.drop_toxic(spark, spark.createDataFrame(rows, SCHEMA), folder).collect(), first)
    second = distinct(first)
    assert len(second) < len(first) - 20
    wider = spark.createDataFrame([(*r, 1, "x", b"") for r in first], SCHEMA + ", n int, set string, key binary")
    same(pipeline.drop_near_copies(spark, wider, folder).collect(), second)
    third = mixed(second)
    same(pipeline.mix_sources(spark, spark.createDataFrame([(*r, 1) for r in second], SCHEMA + ", size int"), folder).collect(), third)
    got = pipeline.encode(spark, spark.createDataFrame(third, SCHEMA), folder).select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")
    same(got.collect(), encoded(third))


def test_run(spark, case):
    folder, rows = case
    got = pipeline.run(spark, folder)
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "source_mixing", "bpe_encoding"]
    same(got.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256").collect(), encoded(mixed(distinct(clean(spark, folder, rows)))))


def test_without_rows_or_ids(spark, case):
    folder, _ = case
    none = spark.createDataFrame([], SCHEMA)
    for name, stage in pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0
        if name != "bpe_encoding":
            assert out.columns == list(pipeline.COLUMNS)
    rows = [(None, "one two three four five six", None, None, None)] * 2
    table = spark.createDataFrame(rows, SCHEMA)
    same(pipeline.drop_near_copies(spark, table, folder).collect(), rows)
    same(pipeline.mix_sources(spark, table, folder).collect(), rows)
    assert pipeline.encode(spark, table, folder).count() == 2
