"""Evaluation of runs against judgments: a binary evaluator by rank and a graded one by score."""

from __future__ import annotations

from math import nextafter

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CUTS = (5, 10, 20, 50, 100)
GRADED_CUTS = (5, 10, 15, 20, 30, 100, 200, 500, 1000)


def _usable(qrels: DataFrame) -> DataFrame:
    return qrels.where("query_id IS NOT NULL AND doc_id IS NOT NULL AND grade IS NOT NULL")


def last_judgments(qrels: DataFrame, order: str | None = None) -> DataFrame:
    """(query_id, doc_id, grade): a repeated judgment once, the last one by the column `order` (of equal places, and without
    an order, the highest grade)."""
    last = F.max_by("grade", F.struct(order, "grade")) if order else F.max("grade")
    return _usable(qrels).groupBy("query_id", "doc_id").agg(last.alias("grade"))


def labelled(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, doc_id, rank, rel, n_rel, rr, precision, recall, f1) in rank order; rel is 1 for documents with a grade
    other than 0, n_rel the number of such judgments of the query (a repeated one counts as often as it stands)."""
    judged = _usable(qrels).where("grade <> 0")
    counts = judged.groupBy("query_id").agg(F.count("*").alias("n_rel"))
    relevant = judged.select("query_id", "doc_id", F.lit(1).alias("rel")).distinct()
    rows = run.select("query_id", "doc_id", "rank").join(relevant, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    place = W.partitionBy("query_id").orderBy("rank", "doc_id")
    rows = rows.withColumns({"rank": F.row_number().over(place), "rr": F.sum("rel").over(place.rowsBetween(W.unboundedPreceding, 0))})
    rows = rows.join(counts, "query_id", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    rows = rows.withColumns({"precision": F.col("rr") / F.col("rank"), "recall": F.when(F.col("n_rel") > 0, F.col("rr") / F.col("n_rel")).otherwise(0.0)})
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(F.col("rr") > 0, 2 * p * r / (p + r)).otherwise(0.0))


def evaluate_binary(run: DataFrame, qrels: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """One row per query of the run: retrieved, n_rel, rel_ret, ap, r_precision, ndcg and p/recall/f1 at the cuts.

    A query with fewer results keeps dividing by the cut (as if padded with others); one without relevant documents
    has zeros. nDCG is rel_1 + sum of rel_i / ln(i), over the same for the retrieved labels in the best order; as
    1 / ln(2) > 1 it can exceed 1.
    """
    rows = labelled(run, qrels)
    gain = F.when(F.col("rank") == 1, F.col("rel")).otherwise(F.col("rel") / F.ln("rank"))
    ideal = F.when(F.col("rel") == 1, F.when(F.col("rr") == 1, 1.0).otherwise(1 / F.ln("rr"))).otherwise(0.0)
    n, hits = F.first("n_rel"), F.sum("rel")
    found = {}
    for k in cuts:
        within = F.sum(F.when(F.col("rank") <= k, F.col("rel")).otherwise(0))
        found[f"p_{k}"] = within / k
        found[f"recall_{k}"] = F.when(n > 0, within / n).otherwise(0.0)
        found[f"f1_{k}"] = F.when(within > 0, 2 * within / (F.lit(k) + n)).otherwise(0.0)
    return rows.groupBy("query_id").agg(
        F.count("*").alias("retrieved"), n.alias("n_rel"), hits.alias("rel_ret"),
        F.when(n > 0, F.sum(F.when(F.col("rel") == 1, F.col("precision"))) / n).otherwise(0.0).alias("ap"),
        F.coalesce(F.max(F.when(F.col("rank") == F.col("n_rel"), F.col("rr") / F.col("n_rel"))), F.lit(0.0)).alias("r_precision"),
        F.when(hits > 0, F.sum(gain) / F.sum(ideal)).otherwise(0.0).alias("ndcg"),
        *(v.alias(k) for k, v in found.items()),
    ).withColumn("ap", F.coalesce("ap", F.lit(0.0)))


def mean_over_queries(per_query: DataFrame) -> DataFrame:
    """One row: the number of queries and the mean of every measure but counts, which are summed."""
    counts = [c for c in ("retrieved", "n_rel", "rel_ret", "num_rel", "num_rel_ret") if c in per_query.columns]
    means = [c for c in per_query.columns if c not in counts and c != "query_id"]
    return per_query.agg(F.count("*").alias("queries"), *(F.sum(c).alias(c) for c in counts), *(F.avg(c).alias(c) for c in means))


def pr_points(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(query_id, rank, recall, precision) at every relevant result."""
    return labelled(run, qrels).where("rel = 1 AND n_rel > 0").select("query_id", "rank", "recall", "precision")


def tenth(value: Column) -> Column:
    """A share from 0 to 1 as a number of tenths, rounded as its exact binary value, halves to the even one: 0.05 and 0.45
    lie above the half and go up, 0.15 and 0.85 lie below it. The value is compared with the least doubles that go up."""
    halves = [(2 * k + 1) / 20 for k in range(10)]
    ups = [h if round(h, 1) > h else nextafter(h, 1.0) for h in halves]
    return sum(((value >= up).cast("int") for up in ups), F.lit(0))


def interpolated_curve(points: DataFrame, queries: int | None = None, unreached: float = 0.0) -> DataFrame:
    """(level, precision): eleven-point curve. A point's recall goes to the nearest level (see `tenth`); of several points
    at a level the one of the highest rank counts; each level takes the best of itself and those above, or `unreached`;
    queries are averaged (over `queries` of them, by default those with points)."""
    level = tenth(F.col("recall"))
    at = points.groupBy("query_id", level.alias("level")).agg(F.max_by("precision", "rank").alias("precision"))
    grid = points.select("query_id").distinct().select("query_id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("level"))
    full = grid.join(at, ["query_id", "level"], "left")
    above = W.partitionBy("query_id").orderBy("level").rowsBetween(0, W.unboundedFollowing)
    full = full.withColumn("precision", F.coalesce(F.max("precision").over(above), F.lit(float(unreached))))
    mean = F.sum("precision") / F.lit(queries) if queries else F.avg("precision")
    return full.groupBy("level").agg(mean.alias("precision")).select((F.col("level") / 10).alias("level"), "precision")


def evaluate_graded(run: DataFrame, qrels: DataFrame, depth: int = 1000, cuts: tuple[int, ...] = GRADED_CUTS, order: str | None = None) -> DataFrame:
    """One row per judged query with relevant documents: num_ret, num_rel (sum of grades), num_rel_ret, ap, r_precision,
    p_k at the cuts and ip_0 ... ip_10, the interpolated precision at recall levels 0 to 1.

    Results are ordered by score, then document, both descending, and cut at `depth`. A relevant result adds its grade
    times (1 + grades retrieved before it) / rank to the average precision. Of repeated judgments the last by the column
    `order` is a document's grade (`last_judgments`), while num_rel sums the grades of all rows.
    """
    judged = last_judgments(qrels, order)
    counts = _usable(qrels).groupBy("query_id").agg(F.sum("grade").cast("double").alias("num_rel")).where("num_rel > 0")
    place = W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("doc_id"))
    rows = run.where("score IS NOT NULL").join(counts, "query_id").withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= depth)
    rows = rows.join(judged, ["query_id", "doc_id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)).cast("double"))
    ranks = W.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("upto", F.sum("grade").over(ranks.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumns({"before": F.col("upto") - F.col("grade"), "precision": F.col("upto") / F.col("rank"), "recall": F.col("upto") / F.col("num_rel")})
    total, got, found = F.first("num_rel"), F.coalesce(F.sum("grade"), F.lit(0.0)), F.count("*")
    per = rows.groupBy("query_id").agg(
        found.alias("num_ret"), total.alias("num_rel"), got.alias("num_rel_ret"),
        (F.sum(F.when(F.col("grade") > 0, F.col("grade") * (1 + F.col("before")) / F.col("rank")).otherwise(0.0)) / total).alias("ap"),
        *((F.sum(F.when(F.col("rank") <= k, F.col("grade")).otherwise(0.0)) / k).alias(f"p_{k}") for k in cuts),
        *(F.coalesce(F.max(F.when(F.col("recall") >= level / 10, F.col("precision"))), F.lit(0.0)).alias(f"ip_{level}") for level in range(11)),
        F.sum(F.when(F.col("rank") <= F.floor("num_rel"), F.col("grade")).otherwise(0.0)).alias("_upto_floor"),
        F.sum(F.when(F.col("rank") <= F.floor("num_rel") + 1, F.col("grade")).otherwise(0.0)).alias("_upto_next"),
    )
    # between two ranks (a fractional sum of grades) the counts are interpolated; beyond the results all that was found counts
    share = F.col("num_rel") - F.floor("num_rel")
    at = F.col("_upto_floor") + share * (F.col("_upto_next") - F.col("_upto_floor"))
    exact = F.when(F.col("num_rel") > F.col("num_ret"), F.col("num_rel_ret")).otherwise(at) / F.col("num_rel")
    ordered = [c for c in per.columns if not c.startswith("_")]
    return per.withColumn("r_precision", exact).select(*ordered, "r_precision")


def append_judgments(qrels: DataFrame, new: DataFrame) -> DataFrame:
    """Judgments with new ones (query_id, assessor, doc_id, grade) added, blanks in assessors' names as underscores; a later judgment of the same assessor replaces an earlier one."""
    rows = qrels.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    rows = rows.withColumn("assessor", F.regexp_replace("assessor", " ", "_"))
    return rows.groupBy("query_id", "assessor", "doc_id").agg(F.max_by("grade", F.struct("_at", "grade")).alias("grade"))
