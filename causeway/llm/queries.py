"""One query for each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import ann, bpe, counts, htmltext, idfile, kmeans, linededup, minhash, mixing, nndescent, toxicity, urlfilter

#: Rules judged by op4_url_filter.
RULES = ("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")
#: Vocabularies; <|endoftext|> is id 1 in the id file's contract.
BYTE_BPE, WORD_BPE, END_ID = "byte_bpe_50k.json", "word_bpe_49k.json", 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages"))


def op3_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.roundtrip(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE)))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), urlfilter.parse_rules(list(RULES)))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = idfile.write_ids(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), END_ID)
    return idfile.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE), limit=1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).select("doc_id", "size", "source_size", "target", "taken")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = kmeans.cluster(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64, scale=1024, seed=3)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_shared_lines(table(spark, sf_dir, "documents"), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ann_search, op2_html_extraction, op3_bpe_roundtrip, op4_url_filter, op5_token_files, op6_token_counts, op7_toxicity, op8_source_mixing, op9_embedding_dedup, op10_minhash_dedup, op11_centroid_clustering, op12_line_dedup)
}

OP4_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path
  FROM cut
), rules(verdict, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fitting AS (
  SELECT page_id, host, path, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS r
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE r = 1
"""

# Targets are found here by raising bounds round by round, not by running sums as in the operator.
OP8_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n FROM sized GROUP BY source
), placed AS (
  SELECT source, n, CAST(CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w FROM totals
), filling AS (
  SELECT 0 AS i, source, n, w, false AS bound, CAST((SELECT sum(n) FROM totals) AS BIGINT) AS rest, CAST((SELECT sum(w) FROM placed) AS BIGINT) AS share FROM placed
  UNION ALL
  SELECT i + 1, source, n, w, now, CAST(total - 3 * coalesce(sum(n) FILTER (WHERE now) OVER (), 0) AS BIGINT), CAST(coalesce(sum(w) FILTER (WHERE NOT now) OVER (), 0) AS BIGINT)
  FROM (SELECT *, bound OR w * rest > 3 * n * share AS now, (SELECT CAST(sum(n) AS BIGINT) FROM totals) AS total, count(*) FILTER (WHERE NOT bound AND w * rest > 3 * n * share) OVER () AS more FROM filling)
  WHERE more > 0
), targets AS (
  SELECT source, n, CASE WHEN n = 0 THEN 0.0 WHEN bound THEN CAST(3 * n AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / share END AS target
  FROM filling WHERE i = (SELECT max(i) FROM filling)
), running AS (
  SELECT s.doc_id, s.size, t.n AS source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS words,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.size, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE CAST(size * (words // source_size) + greatest(0, least(size, words % source_size - before)) AS BIGINT) END AS taken
FROM running
"""


def op11_sql(k: int = 8, rounds: int = 10) -> str:
    """Plain rounds of assignment and update, component by component; a table for each."""
    apart = "CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT)"

    def assigned(r: int) -> str:
        far = f"SELECT v.vec_id, c.n, {apart} AS d FROM long v JOIN c{r} c ON c.j = v.j GROUP BY v.vec_id, c.n"
        return f"a{r} AS MATERIALIZED (SELECT vec_id, n, d FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, n) AS o FROM ({far})) WHERE o = 1)"

    def updated(r: int) -> str:
        sums = f"SELECT a.n, v.j, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS m FROM a{r} a JOIN long v ON v.vec_id = a.vec_id GROUP BY a.n, v.j"
        mean = "CASE WHEN s.m IS NULL THEN c.x ELSE (s.s - ((s.s % s.m) + s.m) % s.m) // s.m END"
        return f"c{r + 1} AS MATERIALIZED (SELECT c.n, c.j, CAST({mean} AS BIGINT) AS x FROM c{r} c LEFT JOIN ({sums}) s ON s.n = c.n AND s.j = c.j)"

    steps = ",\n".join(f"{assigned(r)},\n{updated(r)}" for r in range(rounds))
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64
), long AS MATERIALIZED (
  SELECT vec_id, unnest(range(1, 65)) AS j, unnest(v) AS x FROM kept
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS n FROM kept QUALIFY n < {k}
), c0 AS MATERIALIZED (
  SELECT n, j, x FROM first JOIN long USING (vec_id)
),
{steps},
{assigned(rounds)},
digest AS (
  SELECT n, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS centroid_sha256 FROM c{rounds} GROUP BY n
)
SELECT vec_id, CAST(n AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY n) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN digest USING (n)
"""


OP12_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM rows
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM each
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.keeper AS gone FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

SQL: dict[str, str] = {"op4_url_filter": OP4_SQL, "op8_source_mixing": OP8_SQL, "op11_centroid_clustering": op11_sql(), "op12_line_dedup": OP12_SQL}
