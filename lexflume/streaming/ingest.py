"""Incremental indexing: new documents of a growing folder become partial postings, which a merge unites with the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexflume.functions.analysis import Analyzer
from lexflume.operators.index import SearchIndex, merge_postings, postings


def ingest(spark: SparkSession, folder: str, schema: StructType | str, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer | None = None, files_per_batch: int = 1000) -> StreamingQuery:
    """Index the Parquet files of `folder` that earlier calls with this checkpoint haven't seen, and stop.

    Each micro-batch writes its postings and document ids to a folder named by the batch, overwriting it if the batch is
    run again, so a restart neither loses nor doubles documents.
    """
    own = analyzer or Analyzer()

    def write(batch: DataFrame, number: int) -> None:
        ids = batch.select(F.col(id_col).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        postings(own.tokens(batch, id_col, text_col)).write.mode("overwrite").parquet(f"{out}/postings/batch={number}")
        ids.write.mode("overwrite").parquet(f"{out}/docs/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_index(spark: SparkSession, out: str) -> SearchIndex:
    """The index of all batches so far."""
    post = merge_postings(spark.read.parquet(f"{out}/postings").drop("batch"))
    return SearchIndex.of(spark.read.parquet(f"{out}/docs").select("doc_id").distinct(), post)
