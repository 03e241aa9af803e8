"""Incremental indexing equals indexing in one go."""

from lexflume.operators.index import SearchIndex
from lexflume.streaming.ingest import ingest, merged_index


def test_ingest(spark, rows, tmp_path):
    docs = spark.createDataFrame([(1, "red storm"), (2, "calm red sea"), (3, None), (4, "storm storm")], "doc_id long, text string")
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for condition in ("doc_id <= 2", "doc_id > 2"):
        docs.where(condition).coalesce(1).write.mode("append").parquet(folder)
        query = ingest(spark, folder, docs.schema, out, checkpoint)
        query.awaitTermination()
    whole = SearchIndex.build(docs)
    merged = merged_index(spark, out)
    assert rows(merged.postings) == rows(whole.postings) and rows(merged.stats) == rows(whole.stats)
