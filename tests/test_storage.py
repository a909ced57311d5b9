"""Tables between steps: what their joins send through the driver."""

import pytest
from pyspark.sql import functions as F

from causeway.operators.components import components
from causeway.plans import storage
from causeway.plans.storage import stored


def last_plan(spark) -> str:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    return runs.last().physicalPlanDescription()


def test_sides_with_many_rows_are_not_broadcast(spark):
    """Both files are under 10 MB, at which Spark would send all rows of one through the driver."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    one, other = (stored(spark.range(0, 100_000, 1, 1).selectExpr("id", f"sha2(string(id + {i}), 256) AS {c}"), c) for i, c in enumerate("ab"))
    stored(one.join(other, "id"), "both")
    assert "BroadcastHashJoin" not in last_plan(spark)
    few = stored(other.where("id < 10"), "few")
    assert stored(one.join(few, "id"), "both").count() == 10
    stored(one.join(few, "id"), "both")
    assert "BroadcastHashJoin" in last_plan(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


def test_steps_that_run_together_leave_the_settings_as_they_were(spark):
    """Each step marks broadcasts for itself; the last one out sets them back, whatever the order they end in."""
    before = {key: spark.conf.get(key, None) for key in storage.GUESSES}
    found = storage.together(spark, {i: lambda i=i: storage.stored(spark.range(10 ** (i % 3 + 1)), "rows").count() for i in range(9)})
    assert found == {i: 10 ** (i % 3 + 1) for i in range(9)}
    assert {c: t.count() for c, t in storage.stored_all({"x": spark.range(3), "y": spark.range(4)}, "t").items()} == {"x": 3, "y": 4}
    with pytest.raises(ZeroDivisionError):
        storage.together(spark, {"bad": lambda: 1 / 0, "good": lambda: spark.range(2).count()})
    assert {key: spark.conf.get(key, None) for key in storage.GUESSES} == before and not storage.MARKED


def test_instances_in_buckets_are_joined_where_they_lie(spark):
    """Tables that were stored by instance are joined, grouped, put together and stored again without a shuffle; only the way in has one."""
    before = {key: spark.conf.get(key) for key in storage.IN_PLACE}
    rows = spark.range(3000).selectExpr("concat('i', id % 70) AS inst", "sha2(string(id), 256) AS x", "id AS n")
    with storage.gathered(spark, 3):
        one, other = stored(rows, "one"), stored(rows.selectExpr("inst", "x", "n * 2 AS m"), "other")
        both = stored(one.withColumn("m", F.lit(0).cast("long")).unionByName(one.join(other.hint("merge"), ["inst", "x"])), "both")
        assert "Exchange" not in last_plan(spark)
        found = storage.together(spark, {"sum": lambda: stored(both.groupBy("inst", "x").agg(F.sum("m").alias("m")), "sum")})["sum"]
        assert "Exchange" not in last_plan(spark)
        folded = components(one.select("inst", F.lit("a").alias("a"), "x"), "a", "x", within=("inst",))
        assert folded.groupBy("inst").agg(F.countDistinct("component").alias("n"), F.count("node").alias("m")).where("n = 1").agg(F.sum("m")).first()[0] == 3070
    assert {key: spark.conf.get(key) for key in storage.IN_PLACE} == before and not storage.GATHERED
    assert found.agg(F.sum("m")).first()[0] == 2999 * 3000 and found.count() == 3000
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("causeway")]
    plain = stored(one.join(other, ["inst", "x"]), "plain")
    assert plain.count() == 3000 and plain.columns == ["inst", "x", "n", "m"]


def test_diagrams_of_the_grid_are_glued_where_they_lie(spark, monkeypatch):
    """Class maps of many small diagrams are made from stored tables without a shuffle, and their identifications are closed once for both modes."""
    from causeway.plans import registry

    plans, real = [], storage.written

    def seen(df, label):
        out = real(df, label)
        if label == "qmap":
            plans.append(last_plan(spark))
        return out

    monkeypatch.setattr(storage, "written", seen)
    assert registry.QUERIES["duplication_summary"](spark, "/root/testdata/sf0.001").count() == 6
    assert len(plans) == 3 and not [p for p in plans if "hashpartitioning" in p]


def test_labelled_diagrams_are_folded_where_they_lie(spark, monkeypatch):
    """Kinds and routes get their labels once rows are joined: what is compared afterwards moves only what tasks of Python gave."""
    from causeway.plans import registry

    plans, real = {}, storage.written

    def seen(df, label):
        out = real(df, label)
        if label in ("pulled", "qmap", "named", "laws"):
            plans.setdefault(label, []).append(last_plan(spark))
        return out

    monkeypatch.setattr(storage, "written", seen)
    assert registry.QUERIES["semantic_twins"](spark, "/root/testdata/sf0.001").count() == 28
    assert set(plans) == {"pulled", "qmap", "named", "laws"} and not [p for found in plans.values() for p in found if "hashpartitioning" in p]
