"""Term statistics over records: frequency of every distinct term, and how distinctive a term is per record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.session import join_by_weight, materialize


def counting_rows(vectors: DataFrame, doc_col: str = "doc_id", term_col: str = "term", freq_col: str = "term_freq") -> DataFrame:
    """(doc, term, tf): each record's terms once.

    Rows without a record, a term or a frequency of at least 1 don't count; of repeated (record, term) rows the
    highest frequency counts, once. Other columns (such as stale collection statistics) aren't read.
    """
    rows = vectors.select(F.col(doc_col).alias("doc"), F.col(term_col).alias("term"), F.col(freq_col).cast("long").alias("tf"))
    return rows.where("doc IS NOT NULL AND term IS NOT NULL AND term <> '' AND tf >= 1").groupBy("doc", "term").agg(F.max("tf").alias("tf"))


def term_frequencies(vectors: DataFrame, least_docs: int = 3, most_share: float = 0.5, **columns: str) -> DataFrame:
    """(term, occurrences, docs, mark): how often and in how many records each term occurs.

    mark is 'rare' for terms in fewer than `least_docs` records, 'common' for terms in more than `most_share` of the
    records that have a counting row, else null; rare goes before common in tiny collections. Per-record counts are
    combined by hash before the shuffle, so frequent terms arrive as one partial sum per task. Which rows count:
    `counting_rows`. Empty input gives an empty result.
    """
    rows = counting_rows(vectors, **columns)
    total = rows.agg(F.count_distinct("doc")).scalar()
    counted = rows.groupBy("term").agg(F.sum("tf").alias("occurrences"), F.count("*").alias("docs")).withColumn("total", total)
    mark = F.when(F.col("docs") < least_docs, "rare").when(F.col("docs") > most_share * F.col("total"), "common")
    return counted.select("term", "occurrences", "docs", mark.alias("mark"))


def term_divergence(vectors: DataFrame, mu: float = 100.0, least_docs: int = 2, **columns: str) -> DataFrame:
    """(doc, term, tf, docs, divergence): each term's contribution p(t|d) log2(p(t|d) / p(t|C)) to the relative entropy
    between the record's Dirichlet-smoothed distribution p(t|d) = (tf + mu p(t|C)) / (|d| + mu) and the collection's.

    Terms in fewer than `least_docs` records don't come out, but count in record and collection lengths. Record and
    collection statistics are counted from the rows (see `counting_rows`). Empty input gives an empty result.
    """
    # written once: read for the statistics of terms and of records and for the scores
    rows = materialize(counting_rows(vectors, **columns))
    terms = materialize(rows.groupBy("term").agg(F.sum("tf").alias("ttf"), F.count("*").alias("docs")))
    lengths = materialize(rows.groupBy("doc").agg(F.sum("tf").alias("length"), F.count("*").alias("terms")))
    size = lengths.agg(F.sum("length")).scalar()
    background = F.col("ttf") / F.col("size")
    own = (F.col("tf") + mu * background) / (F.col("length") + mu)
    scored = join_by_weight(join_by_weight(rows, terms, "term", "docs").where(F.col("docs") >= least_docs), lengths, "doc", "terms")
    return scored.withColumn("size", size).select("doc", "term", "tf", "docs", (own * F.log2(own / background)).alias("divergence"))


def leading_terms(vectors: DataFrame, top: int = 1, **options) -> DataFrame:
    """(doc, term, divergence, rank): the `top` most distinctive terms of each record, ties (to 9 digits) by term."""
    order = W.partitionBy("doc").orderBy(F.desc(F.round("divergence", 9)), F.asc("term"))
    return term_divergence(vectors, **options).select("doc", "term", "divergence", F.row_number().over(order).alias("rank")).where(F.col("rank") <= top)
