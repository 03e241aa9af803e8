"""Rounding of recalls and repeated judgments."""

from math import nextafter

from pyspark.sql import functions as F

from lexflume.operators import evaluate


def test_tenths_are_those_of_the_exact_value(spark):
    halves = [(2 * k + 1) / 20 for k in range(10)]
    values = [*halves, *(nextafter(h, 0) for h in halves), *(nextafter(h, 1) for h in halves), 0.0, 1.0, 1 / 3, 2 / 3, *(k / 7 for k in range(8))]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "v double").select(evaluate.tenth(F.col("v")).alias("t")).collect()]
    assert got == [round(round(v, 1) * 10) for v in values]
    assert got[:10] == [1, 1, 2, 3, 5, 6, 7, 8, 8, 9]


def test_the_last_judgment_counts_and_totals_take_all(spark):
    qrels = spark.createDataFrame([("1", "a", 2, 0), ("1", "a", 0, 1), ("1", "b", 1, 2), ("1", "b", 1, 3), ("1", None, 4, 4)], "query_id string, doc_id string, grade int, at int")
    run = spark.createDataFrame([("1", "a", 1, 2.0), ("1", "b", 2, 1.0)], "query_id string, doc_id string, rank int, score double")
    graded = evaluate.evaluate_graded(run, qrels, order="at").first()
    assert (graded.num_rel, graded.num_rel_ret, graded.ap) == (4.0, 1.0, 0.125)
    binary = evaluate.evaluate_binary(run, qrels).first()
    assert (binary.n_rel, binary.rel_ret) == (3, 2)
    assert evaluate.evaluate_graded(run, qrels.limit(0), order="at").count() == 0
