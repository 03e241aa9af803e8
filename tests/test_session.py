"""Written tables, their removal, and the join by weight."""

import os
import random

from lexflume import session


def test_join_by_weight_equals_a_plain_join(spark, rows, monkeypatch):
    rng = random.Random(1)
    facts = spark.createDataFrame([("hot" if rng.random() < 0.5 else f"k{rng.randint(0, 300)}", i) for i in range(2000)] + [(None, -1)], "k string, i long")
    stats = session.materialize(facts.where("k IS NOT NULL").groupBy("k").count())
    wanted = rows(facts.join(stats, "k").select("k", "i", "count"))
    assert rows(session.join_by_weight(facts, stats, "k", "count").select("k", "i", "count")) == wanted
    monkeypatch.setattr(session, "maybe_broadcast", lambda df: df)
    monkeypatch.setattr(session, "HEAVY_PARTS", 20)
    assert rows(session.join_by_weight(facts, stats, "k", "count").select("k", "i", "count")) == wanted
    assert session.join_by_weight(facts.limit(0), stats.limit(0), "k", "count").count() == 0


def test_release_removes_what_was_written(spark):
    plain = session.materialize(spark.range(10))
    laid = session.materialize(spark.range(10).withColumnRenamed("id", "node"), "node", 4)
    places = [f._written_at.removeprefix("file:") for f in (plain, laid)]
    assert all(os.path.isdir(p) for p in places) and plain.count() == laid.count() == 10
    session.release(plain, laid, spark.range(3))
    assert not any(os.path.exists(p) for p in places)


def test_bucketed_tables_join_without_moving_rows(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a, b = (session.materialize(spark.range(100).selectExpr("id AS node", f"id * {k} AS v{k}"), "node", 4) for k in (2, 3))
        joined = a.join(b, "node").groupBy("node").sum("v2")
        assert joined.count() == 100
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
