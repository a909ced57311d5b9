"""The jobs as queries: each runs twice into a new folder beside the checkpoints and gives its output as read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.plans.oracle import LAWS, STEP, fraction, gate
from causeway.plans.storage import shared_dir
from jobs import model_release, text_laws
from jobs.common import default_config


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_model_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with their glued records counted and, where released, their responses."""
    folder, settings = new_folder(spark, "job1"), default_config(model_release.__file__)
    for _ in range(2):
        model_release.run(spark, f"{sf_dir}/part.parquet", folder, settings)
    models, records, responses = (spark.read.parquet(f"{folder}/{t}") for t in ("models", "records", "responses"))
    counts = records.groupBy("shard", "inst").agg(F.count(F.lit(1)).alias("records"))
    found = models.join(counts, ["shard", "inst"], "left").join(responses, ["shard", "inst"], "left")
    return found.select(F.col("shard").cast("long").alias("shard"), "inst", "equations", "given", "glued", "issues", "released", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("outcome", F.lit("")).alias("outcome"), F.coalesce("target", F.lit("")).alias("target"), F.coalesce("value", F.lit(-1)).alias("value"), F.coalesce("p", F.lit("")).alias("p"))


def job2_text_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact shares of texts by source, variable and intervention, after a run over all files and one that finds nothing new."""
    folder, settings = new_folder(spark, "job2"), default_config(text_laws.__file__)
    for _ in range(2):
        text_laws.run(spark, f"{sf_dir}/documents*.parquet", f"{folder}/output", f"{folder}/checkpoint", settings)
    return spark.read.parquet(f"{folder}/output/answers").select("scenario", "grp", "var", "texts", "ones", "p")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_model_release, job2_text_laws)}

JOB1_SQL = f"""
WITH RECURSIVE keyed AS (
  SELECT CAST(p_partkey AS BIGINT) AS key, CAST(min(p_size) AS BIGINT) AS s FROM part WHERE p_partkey >= 0 AND p_size >= 0 GROUP BY p_partkey
), eq AS (
  SELECT key // 16 AS b, row_number() OVER (PARTITION BY key // 16 ORDER BY key) - 1 AS k, s, CAST(s % 10 AS INT) AS c FROM keyed
), slot AS (
  SELECT b, k, p, (k * 31 + 17 * p + s * 7) % (k + 4) AS cause FROM eq, (VALUES (1), (2), (3)) t(p) WHERE p <= [0,0,1,1,2,2,2,2,3,3][c + 1]
), plan AS (
  SELECT eq.b, eq.k, eq.c, max(cause) FILTER (WHERE p = 1) + 1 AS a1, max(cause) FILTER (WHERE p = 2) + 1 AS a2, max(cause) FILTER (WHERE p = 3) + 1 AS a3
  FROM eq LEFT JOIN slot ON slot.b = eq.b AND slot.k = eq.k GROUP BY eq.b, eq.k, eq.c
), held AS (
  SELECT b, k, k % 3 AS o, false AS conflict FROM eq UNION ALL SELECT b, k, (k + 1) % 3, s % 11 = 0 FROM eq WHERE s % 3 = 0
), hslot AS (
  SELECT h.b, h.o, h.k, s.p, s.cause, h.conflict FROM held h JOIN slot s ON s.b = h.b AND s.k = h.k
), hvar AS (
  SELECT b, o, k + 4 AS v FROM held UNION SELECT b, o, cause FROM hslot UNION SELECT b, 0, v FROM eq, range(4) t(v)
), models AS (
  SELECT b, n, nv + nh + 2 * ns AS given, 4 + n + n + bad + slots + bad_slots + arcs AS glued, bad FROM
    (SELECT b, count(*) AS n FROM eq GROUP BY b) JOIN (SELECT b, count(*) AS nv FROM hvar GROUP BY b) USING (b)
    JOIN (SELECT b, count(*) AS nh, count(*) FILTER (WHERE conflict) AS bad FROM held GROUP BY b) USING (b)
    JOIN (SELECT eq.b, count(slot.p) AS slots, count(DISTINCT (slot.k, slot.cause)) FILTER (WHERE slot.p IS NOT NULL) AS arcs FROM eq LEFT JOIN slot ON slot.b = eq.b AND slot.k = eq.k GROUP BY eq.b) USING (b)
    JOIN (SELECT eq.b, count(h.p) AS ns, count(h.p) FILTER (WHERE h.conflict) AS bad_slots FROM (SELECT DISTINCT b FROM eq) eq LEFT JOIN hslot h ON h.b = eq.b GROUP BY eq.b) USING (b)
), run AS (
  SELECT b, n, scenario, CAST(0 AS BIGINT) AS i, [CAST(43690 AS BIGINT), 52428, 61680, 65280] AS vals FROM models, range(33) t(scenario) WHERE bad = 0 AND scenario <= 2 * n
  UNION ALL SELECT run.b, run.n, scenario, i + 1, list_append(vals, CAST({STEP.format(gate('plan.c', 'run.vals'))} AS BIGINT)) FROM run JOIN plan ON plan.b = run.b AND plan.k = i
), {LAWS}, response AS (
  SELECT b, scenario, CAST(sum(num * ((vals[-1] >> u_mask) & 1)) AS BIGINT) AS num, any_value(den) AS den FROM run, laws WHERE i = n AND law = 'product' GROUP BY b, scenario
)
SELECT m.b // 64 AS shard, 'b' || m.b AS inst, n AS equations, CAST(given AS BIGINT) AS given, CAST(glued AS BIGINT) AS glued, CASE WHEN bad > 0 THEN 'duplicate_owner' ELSE '' END AS issues, bad = 0 AS released,
       CAST(CASE WHEN bad > 0 THEN 0 ELSE glued END AS BIGINT) AS records, CASE WHEN bad > 0 THEN '' ELSE 'V' || (n - 1) END AS outcome,
       CASE WHEN coalesce(scenario, 0) = 0 THEN '' ELSE 'V' || ((scenario - 1) // 2) END AS target, CAST(CASE WHEN coalesce(scenario, 0) = 0 THEN -1 ELSE (scenario - 1) % 2 END AS INT) AS value,
       CASE WHEN bad > 0 THEN '' ELSE {fraction('num', 'den')} END AS p
FROM models m LEFT JOIN response r ON r.b = m.b
"""

JOB2_SQL = rf"""
WITH facts AS (
  SELECT source AS grp, CASE WHEN regexp_matches(text, '[0-9]') THEN 1 ELSE 0 END AS u0,
         CASE WHEN len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) >= 100 THEN 1 ELSE 0 END AS u1,
         CASE WHEN length(text) - length(replace(text, chr(10), '')) >= 9 THEN 1 ELSE 0 END AS u2,
         CASE WHEN len(list_distinct(string_split(text, chr(10)))) < len(string_split(text, chr(10))) THEN 1 ELSE 0 END AS u3
  FROM documents
), scenarios(scenario, dx, dy) AS (
  VALUES ('observed', NULL, NULL), ('do_X_0', 0, NULL), ('do_X_1', 1, NULL), ('do_Y_0', NULL, 0), ('do_Y_1', NULL, 1)
), first_values AS (
  SELECT *, coalesce(dx, u1 * (1 - u3)) AS x, coalesce(dy, greatest(u0, u2)) AS y FROM facts, scenarios
), all_values AS (
  SELECT *, (x + y + u2) // 2 AS z FROM first_values
), long AS (
  SELECT scenario, grp, unnest(['X', 'Y', 'Z', 'W']) AS var, unnest([x, y, z, (z + u3) % 2]) AS value FROM all_values
), summed AS (
  SELECT scenario, grp, var, count(*) AS texts, CAST(sum(value) AS BIGINT) AS ones FROM long GROUP BY scenario, grp, var
)
SELECT scenario, grp, var, texts, ones, {fraction('ones', 'texts')} AS p FROM summed
"""

SQL: dict[str, str] = {"job1_model_release": JOB1_SQL, "job2_text_laws": JOB2_SQL}
