"""The registered pairs take in all documents of a run up to the thousandth of label 0."""

from lexflume.plans import evaluation


def test_pairs_go_beyond_sixty(spark, tmp_path):
    for name, n in ((evaluation.BM25, 200), (evaluation.TFIDF, 50)):
        rows = [("1", k, float(1000 - k)) for k in range(n)]
        spark.createDataFrame(rows, "query_id string, doc_id long, score double").coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    pairs = {(r.doc_id, r.label) for r in evaluation.QUERIES["ltr_pairs"](spark, str(tmp_path)).collect()}
    assert pairs == {(k, int(k < 10)) for k in range(200)}
