"""The registered queries return whole runs."""

import pytest

from lexflume.plans import retrieval


@pytest.mark.parametrize("name", ["okapi_tf", "okapi_tf_zero_fill"])
def test_searches_go_beyond_the_first_hundred(spark, tmp_path, name):
    spark.createDataFrame([(i, "storm coast" if i % 2 else "calm sea") for i in range(300)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "storm")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    run = retrieval.QUERIES[name](spark, str(tmp_path)).collect()
    odd, even = list(range(1, 300, 2)), list(range(0, 300, 2))
    assert [r.doc_id for r in sorted(run, key=lambda r: r["rank"])] == odd + (even if name.endswith("fill") else [])
