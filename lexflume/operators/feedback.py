"""Query expansion from feedback documents and from significant terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.operators.index import SearchIndex


def _top(rows: DataFrame, score: str, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc(score), F.asc("term"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def feedback_terms(index: SearchIndex, run: DataFrame, docs: int = 1, size: int | None = None) -> DataFrame:
    """(query_id, term, score): the terms of the first `docs` documents of each query, by log2(1 + tf) ln(size / df), the
    highest over the documents. size: the collection size in the idf, by default the index's."""
    n = F.lit(size) if size else F.col("n")
    rows = index.with_stats(run.where(F.col("rank") <= docs).select("query_id", "doc_id").join(index.postings, "doc_id").join(index.term_stats, "term"))
    return rows.groupBy("query_id", "term").agg(F.max(F.round(F.log2(1 + F.col("tf")) * F.ln(n / F.col("df")), 9)).alias("score"))


def prepended(queries: DataFrame, added: DataFrame, keep_others: bool = True) -> DataFrame:
    """(query_id, terms): the added terms (query_id, term, rank) before the query's own, in rank order.
    keep_others: queries without additions stay as they are; else they are left out."""
    own = queries.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("qpos", "term"))), lambda x: x["term"]).alias("own"))
    new = added.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("new"))
    both = own.join(new, "query_id", "left" if keep_others else "inner")
    return both.select("query_id", F.concat(F.coalesce("new", F.array().cast("array<string>")), "own").alias("terms"))


def expand(index: SearchIndex, run: DataFrame, queries: DataFrame, docs: int = 1, terms: int = 2, size: int | None = None) -> DataFrame:
    """(query_id, terms): each query with the best `terms` feedback terms in front, those left out that it already has."""
    best = _top(feedback_terms(index, run, docs, size), "score", terms)
    fresh = best.join(queries.select("query_id", "term").distinct(), ["query_id", "term"], "left_anti")
    return prepended(queries, fresh)


def significant_terms(index: SearchIndex, queries: DataFrame, least_docs: int = 3, top: int = 10) -> DataFrame:
    """(query_id, source_term, term, foreground, score): for each query word the terms that are unusually frequent in
    the documents that hold it, by (fg - bg) fg / bg, where fg and bg are shares of documents."""
    words = queries.select("query_id", F.col("term").alias("source_term")).distinct()
    # the significance of a term for a word doesn't depend on the query: work on distinct words
    distinct = words.select("source_term").distinct()
    post = index.postings.select("term", "doc_id")
    held = distinct.join(post.withColumnRenamed("term", "source_term"), "source_term")
    sizes = index.term_stats.select(F.col("term").alias("source_term"), F.col("df").alias("source_df"))
    both = held.join(post, "doc_id").groupBy("source_term", "term").agg(F.count("*").alias("foreground")).where(F.col("foreground") >= least_docs)
    rated = index.with_stats(both.join(sizes, "source_term").join(index.term_stats.select("term", "df"), "term"))
    fg, bg = F.col("foreground") / F.col("source_df"), F.col("df") / F.col("n")
    scored = rated.where(fg > bg).withColumn("score", F.round((fg - bg) * (fg / bg), 9))
    order = W.partitionBy("source_term").orderBy(F.desc("score"), F.asc("term"))
    kept = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return words.join(kept, "source_term").select("query_id", "source_term", "term", "foreground", "score")


def expand_significant(index: SearchIndex, queries: DataFrame, stopwords: frozenset[str] = frozenset(), candidates: int = 2, terms: int = 1, unseen_df: int = 100, keep_others: bool = False, **options) -> DataFrame:
    """(query_id, terms): the terms that most query words propose, without stop words, the best by ln(n / df), in front.
    A proposed term comes in even if the query already has it. Queries without candidates are left out unless keep_others."""
    proposed = significant_terms(index, queries, **options).groupBy("query_id", "term").agg(F.count("*").alias("votes"))
    few = _top(proposed, "votes", candidates).drop("rank")
    if stopwords:
        few = few.where(~F.col("term").isin(sorted(stopwords)))
    idf = index.with_stats(few.join(index.term_stats, "term", "left")).withColumn("idf", F.round(F.ln(F.col("n") / F.coalesce("df", F.lit(unseen_df))), 9))
    return prepended(queries, _top(idf, "idf", terms), keep_others)
