"""The positional inverted index and its statistics, as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflume.functions.analysis import Analyzer
from lexflume.session import materialize


def postings(tokens: DataFrame, positions: bool = True) -> DataFrame:
    """(term, doc_id, tf, positions) from (doc_id, pos, term): one shuffle by (term, doc_id), so frequent terms spread. Without
    positions (left empty) tasks send counts only."""
    if not positions:
        return tokens.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf")).withColumn("positions", F.array().cast("array<int>"))
    return tokens.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def term_stats(post: DataFrame) -> DataFrame:
    """(term, df, ttf)."""
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("ttf"))


def doc_stats(post: DataFrame) -> DataFrame:
    """(doc_id, dl) of documents that have terms."""
    return post.groupBy("doc_id").agg(F.sum("tf").cast("long").alias("dl"))


def collection_stats(docs: DataFrame, post: DataFrame, approximate: bool = False) -> DataFrame:
    """One row (n, avgdl, v, sum_ttf): documents with an id (empty ones included), mean length, vocabulary size, tokens."""
    size = F.approx_count_distinct("term") if approximate else F.count_distinct("term")
    tokens = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).cast("long").alias("sum_ttf"), size.cast("long").alias("v"))
    n = docs.where("doc_id IS NOT NULL").agg(F.count_distinct("doc_id")).scalar()
    return tokens.withColumn("n", n).select("n", F.when(F.col("n") > 0, F.col("sum_ttf") / F.col("n")).alias("avgdl"), "v", "sum_ttf")


def merge_postings(*parts: DataFrame) -> DataFrame:
    """One posting table from partial ones over disjoint or equal documents: positions of the same (term, doc) are united."""
    united = parts[0].select("term", "doc_id", "positions")
    for part in parts[1:]:
        united = united.unionByName(part.select("term", "doc_id", "positions"))
    merged = united.groupBy("term", "doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("positions")))).alias("positions"))
    return merged.select("term", "doc_id", F.size("positions").alias("tf"), "positions")


@dataclass
class SearchIndex:
    """docs (doc_id), postings, term_stats, doc_stats, collection_stats; everything is lazy until written."""

    docs: DataFrame
    postings: DataFrame
    term_stats: DataFrame
    doc_stats: DataFrame
    stats: DataFrame

    @classmethod
    def of(cls, docs: DataFrame, post: DataFrame, approximate: bool = False) -> SearchIndex:
        return cls(docs, post, term_stats(post), doc_stats(post), collection_stats(docs, post, approximate))

    @classmethod
    def build(cls, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", analyzer: Analyzer | None = None, keep: bool = False, positions: bool = True) -> SearchIndex:
        """Index a collection. Empty and null texts count as documents without terms; repeated ids are one document.

        `keep` writes the postings and their statistics to the shared folder once, so that searches read them instead of the texts.
        Only the proximity model and merges need `positions`.
        """
        ids = docs.select(F.col(id_col).alias("doc_id")).where("doc_id IS NOT NULL").distinct()
        post = postings((analyzer or Analyzer()).tokens(docs, id_col, text_col), positions)
        if not keep:
            return cls.of(ids, post)
        built = cls.of(materialize(ids), materialize(post))
        return cls(built.docs, built.postings, materialize(built.term_stats), materialize(built.doc_stats), materialize(built.stats))

    @classmethod
    def from_vectors(cls, vectors: DataFrame, doc_col: str = "doc_id", term_col: str = "term", freq_col: str = "term_freq") -> SearchIndex:
        """An index without positions from flattened term vectors; statistics are counted anew from the rows."""
        rows = vectors.select(F.col(doc_col).alias("doc_id"), F.col(term_col).alias("term"), F.col(freq_col).cast("int").alias("tf"))
        post = rows.where("doc_id IS NOT NULL AND term IS NOT NULL AND tf >= 1").groupBy("term", "doc_id").agg(F.max("tf").alias("tf")).withColumn("positions", F.array().cast("array<int>"))
        return cls.of(post.select("doc_id").distinct(), post)

    def merge(self, other: SearchIndex) -> SearchIndex:
        return SearchIndex.of(self.docs.unionByName(other.docs).distinct(), merge_postings(self.postings, other.postings))

    def write(self, path: str, buckets: int | None = None, codec: str = "zstd") -> None:
        """Write all parts; postings are laid out by term, so a term lookup reads few row groups. With `buckets` they
        become a bucketed table (named like the last part of `path`) that joins on term without a shuffle."""
        for name, part in (("docs", self.docs), ("term_stats", self.term_stats), ("doc_stats", self.doc_stats), ("stats", self.stats)):
            part.write.mode("overwrite").option("compression", codec).parquet(f"{path}/{name}")
        if buckets:
            table = path.rstrip("/").rsplit("/", 1)[-1] + "_postings"
            self.postings.write.mode("overwrite").option("path", f"{path}/postings").option("compression", codec).bucketBy(buckets, "term").sortBy("term").saveAsTable(table)
        else:
            self.postings.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("compression", codec).parquet(f"{path}/postings")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> SearchIndex:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in ("docs", "postings", "term_stats", "doc_stats", "stats")))

    def with_stats(self, rows: DataFrame) -> DataFrame:
        """The rows with n, avgdl, v and sum_ttf, from one scalar subquery."""
        row = self.stats.select(F.struct("n", "avgdl", "v", "sum_ttf")).scalar()
        return rows.withColumn("_stats", row).select("*", "_stats.n", "_stats.avgdl", "_stats.v", "_stats.sum_ttf").drop("_stats")

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of some terms; the filter reaches the Parquet scan."""
        return self.postings.where(F.col("term").isin(terms))
