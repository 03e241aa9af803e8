"""Ranking models over an index: one matched set, one expression per model, one window for the cut.

The weight of a sparse model is a product of a part that belongs to the query's term and a part that belongs to the posting.
Each part is computed where its rows are few, once per term and once per posting; a match is a multiplication. The terms of
the queries are written down and counted first: up to a bound they are sent to the tasks that read the postings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.operators.index import SearchIndex
from lexflume.session import materialize, maybe_broadcast

DIGITS = 6


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) from (query_id, qpos, term)."""
    return queries.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def _okapi() -> Column:
    return F.col("tf") / (F.col("tf") + 0.5 + 1.5 * F.col("dl") / F.col("avgdl"))


Parts = tuple[Column, Column]


def okapi_tf() -> Parts:
    """(part of the query's term by qtf, df and n; part of the posting by tf, dl and avgdl); so for all sparse models."""
    return F.col("qtf"), _okapi()


def tf_idf() -> Parts:
    return F.col("qtf") * F.log2(F.col("n") / F.col("df")), _okapi()


def bm25_index(k1: float = 1.5, k2: float = 1.2, b: float = 0.5) -> Parts:
    """Over distinct query words; the idf may be negative."""
    idf = F.log2((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    own = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return idf * F.col("qtf") * (k2 + 1) / (F.col("qtf") + k2), own


def bm25_vectors(k1: float = 1.2, k2: float = 1.2, b: float = 0.75) -> Parts:
    """Summed over word occurrences, so qtf counts on top of its own factor."""
    idf = F.log2((F.col("n") + 0.5) / (F.col("df") + 0.5))
    own = (F.col("tf") + k1 * F.col("tf")) / (F.col("tf") + k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl")))
    return F.col("qtf") * idf * (F.col("qtf") + k2 * F.col("qtf")) / (F.col("qtf") + k2), own


def match_builtin(k1: float = 1.2, b: float = 0.75) -> Parts:
    """The published BM25 with a positive idf, as search services use it."""
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.col("qtf") * idf, F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


SPARSE: dict[str, Callable[..., Parts]] = {"okapi_tf": okapi_tf, "tfidf": tf_idf, "bm25_index": bm25_index, "bm25_vectors": bm25_vectors, "match": match_builtin}


def sparse_scores(index: SearchIndex, queries: DataFrame, parts: Parts) -> DataFrame:
    """(query_id, doc_id, score) of matching documents."""
    of_term, of_posting = parts
    terms = index.with_stats(query_terms(queries).join(index.term_stats, "term")).select("query_id", "term", of_term.alias("of_term"))
    terms = maybe_broadcast(materialize(terms))
    post = index.with_stats(index.postings.select("term", "doc_id", "tf").join(index.doc_stats, "doc_id")).select("term", "doc_id", of_posting.alias("of_posting"))
    return post.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("of_term") * F.col("of_posting")).alias("score"))


def _dense(index: SearchIndex, queries: DataFrame, part: Column, constants: DataFrame, constant: Column, first: DataFrame) -> DataFrame:
    """Scores of a model that gives every document with terms a score: a constant by query and length, plus the matched part (at
    least 0). Of the documents that don't match only `first` (doc_id, dl) can rank, so documents never multiply with queries:
    a document outside of them stands behind k documents of `first` whether these match or not."""
    constants = materialize(constants)
    ids = constants.groupBy("query_id").agg(F.sum("qtf").alias("qlen"), F.sum("base").alias("base"))
    parts = matched_with(index, queries, constants).select("query_id", "doc_id", part.alias("part"))
    others = ids.select("query_id").crossJoin(F.broadcast(first.select("doc_id"))).withColumn("part", F.lit(0.0))
    got = parts.unionByName(others).groupBy("query_id", "doc_id").agg(F.sum("part").alias("part"))
    rows = index.with_stats(got.join(ids, "query_id").join(index.doc_stats, "doc_id"))
    return rows.select("query_id", "doc_id", (constant + F.col("part")).alias("score"))


def _shortest(index: SearchIndex, k: int, digits: int | None) -> DataFrame:
    """(doc_id, dl): the documents that can be among the first `k` of a query by length, the shorter the better, ties by
    doc_id. Rounded scores of neighbouring lengths may be equal, so longer documents within the rounding come along, the first
    `k` of each length. There are at most k of these for each length in question."""
    docs = index.doc_stats.where("dl > 0")
    last = docs.orderBy("dl", "doc_id").limit(k).agg(F.max("dl")).first()[0] or 0
    v = index.stats.first()["v"] or 0
    within = last if digits is None else last + (last + v) * 2 * 10.0**-digits + 1
    place = F.row_number().over(W.partitionBy("dl").orderBy("doc_id"))
    return docs.where(F.col("dl") <= within).withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def matched_with(index: SearchIndex, queries: DataFrame, constants: DataFrame) -> DataFrame:
    return index.postings.select("term", "doc_id", "tf").join(maybe_broadcast(constants.select("query_id", "term", "qtf", "c")), "term").join(index.doc_stats, "doc_id")


def laplace_scores(index: SearchIndex, queries: DataFrame, k: int = 1000, digits: int | None = DIGITS) -> DataFrame:
    """Laplace-smoothed unigram model: sum over words of ln((tf + 1) / (dl + v)), of all documents that match and of those
    others that can be among the first `k`.

    Factorised: sum over matches of qtf ln(tf + 1), minus |q| ln(dl + v).
    """
    constants = query_terms(queries).withColumns({"c": F.lit(0.0), "base": F.lit(0.0)})
    return _dense(index, queries, F.col("qtf") * F.ln(F.col("tf") + 1), constants, -F.col("qlen") * F.ln(F.col("dl") + F.col("v")), _shortest(index, k, digits))


def jelinek_mercer_scores(index: SearchIndex, queries: DataFrame, k: int = 1000, lam: float = 1.1, unseen_ttf: int = 100) -> DataFrame:
    """Jelinek-Mercer model (lam above 1): sum over words of ln(lam tf / dl + (lam - 1) ttf / v), of all documents that match
    and of those others that can be among the first `k`: they all have the same score, so the first by doc_id.

    Factorised with c = (lam - 1) ttf / v: sum of qtf ln c for the query, plus qtf ln(1 + lam tf / (dl c)) for each match.
    """
    terms = index.with_stats(query_terms(queries).join(index.term_stats, "term", "left"))
    c = F.try_divide((lam - 1) * F.coalesce("ttf", F.lit(unseen_ttf)), F.col("v"))
    constants = terms.select("query_id", "term", "qtf", c.alias("c")).withColumn("base", F.col("qtf") * F.ln("c"))
    first = index.doc_stats.where("dl > 0").orderBy("doc_id").limit(k)
    return _dense(index, queries, F.col("qtf") * F.ln(1 + lam * F.col("tf") / (F.col("dl") * F.col("c"))), constants, F.col("base"), first)


def zero_filled(scores: DataFrame, index: SearchIndex, queries: DataFrame, k: int) -> DataFrame:
    """Scores with zeros for documents that don't match, for queries with fewer than `k` matches; at most `k` zeros are
    needed for a query, taken in document order."""
    short = queries.select("query_id").distinct().join(scores.groupBy("query_id").agg(F.count("*").alias("have")), "query_id", "left").where(F.coalesce("have", F.lit(0)) < k)
    # only the first documents in order can fill up; a query with m < k matches needs k - m of the first k
    fill = index.docs.orderBy("doc_id").limit(k)
    zeros = short.select("query_id").crossJoin(F.broadcast(fill)).join(scores.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("score", F.lit(0.0))
    return scores.unionByName(zeros.select("query_id", "doc_id", "score"))


def ranked(scores: DataFrame, k: int = 1000, digits: int | None = DIGITS) -> DataFrame:
    """(query_id, doc_id, rank, score): the first `k` of each query, ties by doc_id. Scores are rounded first (if
    `digits`), so that ranks don't depend on the order of summation. The window keeps k rows before the shuffle."""
    score = F.round("score", digits) if digits is not None else F.col("score")
    rows = scores.withColumn("score", score)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


def search(index: SearchIndex, queries: DataFrame, model: str = "bm25_vectors", k: int = 1000, zero_fill: bool = False, digits: int | None = DIGITS, **parameters) -> DataFrame:
    """A run of the named model: okapi_tf, tfidf, bm25_index, bm25_vectors, match, laplace, jm or proximity."""
    if model == "laplace":
        scores = laplace_scores(index, queries, k, digits)
    elif model == "jm":
        scores = jelinek_mercer_scores(index, queries, k, **parameters)
    elif model == "proximity":
        from lexflume.operators.proximity import proximity_scores

        scores = proximity_scores(index, queries, **parameters)
    else:
        scores = sparse_scores(index, queries, SPARSE[model](**parameters))
    if zero_fill:
        scores = zero_filled(scores, index, queries, k)
    return ranked(scores, k, digits)


def collapse_hosts(run: DataFrame, host: str = "host") -> DataFrame:
    """The best hit of every host of each query."""
    best = W.partitionBy("query_id", host).orderBy(F.desc("score"), F.asc("doc_id"))
    return run.withColumn("_best", F.row_number().over(best)).where("_best = 1").drop("_best")
