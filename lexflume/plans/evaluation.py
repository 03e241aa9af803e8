"""Queries of the evaluators: the BM25 run against judgments made of the tf-idf run (its first ten documents grade 2, up to fifty grade 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflume.operators import evaluate, ltr, ranking
from lexflume.session import materialize, table

BM25, JM, TFIDF = "results_okapibm25_aggs_new", "results_jm_aggs", "results_tfidf_aggs"


def best(spark: SparkSession, sf_dir: str, name: str, k: int = 1000) -> DataFrame:
    """(query_id, doc_id, rank, score) of a run table: usable scores, repeated documents once, ranked anew."""
    rows = table(spark, sf_dir, name).where("score IS NOT NULL AND NOT isnan(score)")
    return ranking.ranked(rows.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), k, digits=None)


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best(spark, sf_dir, TFIDF, 50).select("query_id", F.lit("run").alias("assessor"), "doc_id", F.when(F.col("rank") <= 10, 2).otherwise(1).alias("grade"))


def repeated_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judgments as lines of a file (`at`), in which every third document of a query is judged again further down, with another grade."""
    first = best(spark, sf_dir, TFIDF, 50).select("query_id", F.lit("run").alias("assessor"), "doc_id", F.when(F.col("rank") <= 10, 2).otherwise(1).alias("grade"), F.col("rank").cast("long").alias("at"))
    again = first.where("at % 3 = 0").select("query_id", F.lit("second").alias("assessor"), "doc_id", F.when(F.col("at") % 2 == 0, 0).otherwise(3 - F.col("grade")).alias("grade"), (F.col("at") + 100).alias("at"))
    return first.unionByName(again)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes))


def eval_binary_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluate_binary(best(spark, sf_dir, BM25), judgments(spark, sf_dir)))


def eval_binary_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.mean_over_queries(evaluate.evaluate_binary(best(spark, sf_dir, BM25), judgments(spark, sf_dir))))


def eval_graded_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluate_graded(best(spark, sf_dir, BM25), judgments(spark, sf_dir)))


def eval_graded_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.mean_over_queries(evaluate.evaluate_graded(best(spark, sf_dir, BM25), judgments(spark, sf_dir))))


def eval_graded_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluate_graded(best(spark, sf_dir, BM25), repeated_judgments(spark, sf_dir), order="at"))


def eval_binary_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.evaluate_binary(best(spark, sf_dir, BM25), repeated_judgments(spark, sf_dir)))


def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.pr_points(best(spark, sf_dir, BM25), judgments(spark, sf_dir)))


def pr_curve_11pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.interpolated_curve(evaluate.pr_points(best(spark, sf_dir, BM25), judgments(spark, sf_dir))))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = judgments(spark, sf_dir).withColumn("grade", F.col("grade") - 1)
    return ltr.label_pairs(qrels, best(spark, sf_dir, BM25), exclude_relevant=True)


def ltr_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ltr.feature_frame(_pairs(spark, sf_dir), {"bm25": best(spark, sf_dir, BM25), "jm": best(spark, sf_dir, JM), "tfidf": best(spark, sf_dir, TFIDF)})


def ltr_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


def ltr_robust_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(ltr.robust_scaled(_features(spark, sf_dir), ["bm25", "jm", "tfidf"])).withColumn("label", F.col("label").cast("int"))


def ltr_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ltr.query_folds(_pairs(spark, sf_dir)).groupBy("fold", "label").agg(F.count("*").alias("pairs"), F.count_distinct("query_id").alias("queries"))


def ltr_cross_validated(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = ltr.robust_scaled(materialize(_features(spark, sf_dir)), ["bm25", "jm", "tfidf"])
    return ltr.cross_validated(scaled, ["bm25", "jm", "tfidf"])


QUERIES = {f.__name__: f for f in (eval_binary_per_query, eval_binary_mean, eval_graded_per_query, eval_graded_mean, eval_graded_repeated, eval_binary_repeated, pr_points, pr_curve_11pt, ltr_pairs, ltr_features, ltr_robust_scaled, ltr_folds, ltr_cross_validated)}


def best_sql(name: str, k: int) -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
      SELECT query_id, doc_id, max(score) AS score FROM {name} WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, doc_id)) WHERE rank <= {k}"""


_INPUT = f"""run AS ({best_sql(BM25, 1000)}), qrels AS (SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN 2 ELSE 1 END AS grade FROM ({best_sql(TFIDF, 50)}))"""
_BINARY = f"""{_INPUT},
  cnt AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id),
  lab AS (SELECT run.query_id, run.doc_id, rank, CASE WHEN qrels.doc_id IS NULL THEN 0 ELSE 1 END AS rel, coalesce(n, 0) AS n
          FROM run LEFT JOIN qrels ON qrels.query_id = run.query_id AND qrels.doc_id = run.doc_id LEFT JOIN cnt ON cnt.query_id = run.query_id),
  x AS (SELECT *, sum(rel) OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS rr FROM lab)"""
_CUTS = ", ".join(
    f"coalesce(sum(rel) FILTER (rank <= {k}), 0) / {k}.0::DOUBLE AS p_{k}, CASE WHEN max(n) > 0 THEN coalesce(sum(rel) FILTER (rank <= {k}), 0) / max(n)::DOUBLE ELSE 0.0 END AS recall_{k}, 2.0 * coalesce(sum(rel) FILTER (rank <= {k}), 0) / ({k} + max(n))::DOUBLE AS f1_{k}"
    for k in evaluate.CUTS
)
_BINARY_ROWS = f"""
  SELECT query_id, count(*) AS retrieved, max(n) AS n_rel, sum(rel)::BIGINT AS rel_ret,
    CASE WHEN max(n) > 0 THEN coalesce(sum(rr / rank::DOUBLE) FILTER (rel = 1), 0) / max(n) ELSE 0.0 END AS ap,
    coalesce(max(rr / n::DOUBLE) FILTER (rank = n), 0.0) AS r_precision,
    CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rank = 1 THEN rel ELSE rel / ln(greatest(rank, 2)) END) / sum(CASE WHEN rel = 0 THEN 0.0 WHEN rr = 1 THEN 1.0 ELSE 1 / ln(greatest(rr, 2)) END) ELSE 0.0 END AS ndcg,
    {_CUTS} FROM x GROUP BY query_id"""
_BINARY_MEASURES = ["ap", "r_precision", "ndcg", *(f"{m}_{k}" for k in evaluate.CUTS for m in ("p", "recall", "f1"))]
_GRADED = f"""{_INPUT},
  cnt AS (SELECT query_id, sum(grade)::DOUBLE AS num_rel FROM qrels GROUP BY query_id),
  g AS (SELECT run.query_id, run.doc_id, num_rel, coalesce(grade, 0)::DOUBLE AS grade, row_number() OVER (PARTITION BY run.query_id ORDER BY score DESC, run.doc_id DESC) AS rank
        FROM run JOIN cnt ON cnt.query_id = run.query_id LEFT JOIN qrels ON qrels.query_id = run.query_id AND qrels.doc_id = run.doc_id),
  x AS (SELECT *, sum(grade) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM g)"""
#: The judgment file with repeated lines: the last line is a document's grade, the totals take all lines.
LINES_SQL = f"""lines AS (SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN 2 ELSE 1 END AS grade, rank AS at_ FROM ({best_sql(TFIDF, 50)})
    UNION ALL SELECT query_id, doc_id, CASE WHEN rank % 2 = 0 THEN 0 WHEN rank <= 10 THEN 1 ELSE 2 END, rank + 100 FROM ({best_sql(TFIDF, 50)}) WHERE rank % 3 = 0)"""
_GRADED_REPEATED = _GRADED.replace(_INPUT, f"run AS ({best_sql(BM25, 1000)}), {LINES_SQL}, qrels AS (SELECT query_id, doc_id, arg_max(grade, at_) AS grade FROM lines GROUP BY query_id, doc_id)").replace("AS num_rel FROM qrels", "AS num_rel FROM lines")
_BINARY_REPEATED = _BINARY.replace(_INPUT, f"run AS ({best_sql(BM25, 1000)}), {LINES_SQL}, qrels AS (SELECT DISTINCT query_id, doc_id FROM lines WHERE grade <> 0)").replace("count(*) AS n FROM qrels", "count(*) AS n FROM lines WHERE grade <> 0")
_GRADED_ROWS = f"""
  SELECT query_id, count(*) AS num_ret, max(num_rel) AS num_rel, sum(grade) AS num_rel_ret,
    sum(grade * (1 + upto - grade) / rank) / max(num_rel) AS ap,
    {", ".join(f"coalesce(sum(grade) FILTER (rank <= {k}), 0) / {k} AS p_{k}" for k in evaluate.GRADED_CUTS)},
    {", ".join(f"coalesce(max(upto / rank) FILTER (upto / num_rel >= {level} / 10.0::DOUBLE), 0.0) AS ip_{level}" for level in range(11))},
    CASE WHEN max(num_rel) > count(*) THEN sum(grade) ELSE coalesce(sum(grade) FILTER (rank <= num_rel), 0) END / max(num_rel) AS r_precision
  FROM x GROUP BY query_id"""
_GRADED_MEASURES = ["ap", *(f"p_{k}" for k in evaluate.GRADED_CUTS), *(f"ip_{level}" for level in range(11)), "r_precision"]
_rounds = lambda names, f="{}": ", ".join(f"round({f.format(c)}, 6) AS {c}" for c in names)
_POINTS = "SELECT query_id, rank, rr / n::DOUBLE AS recall, rr / rank::DOUBLE AS precision FROM x WHERE rel = 1 AND n > 0"
#: Where a recall's exact binary value rounds to the next tenth: from the half on where the half's double lies above it (or the tenth is even), else behind it.
_TENTH = "(" + " + ".join(f"(recall::DOUBLE {op} {half}::DOUBLE)::INT" for half, op in (("0.05", ">="), ("0.15", ">"), ("0.25", ">"), ("0.35", ">"), ("0.45", ">="), ("0.55", ">="), ("0.65", ">="), ("0.75", ">="), ("0.85", ">"), ("0.95", ">"))) + ")"
_PAIRS = f"""{_INPUT}, judged AS (SELECT query_id, doc_id, (grade - 1)::INT AS label FROM qrels),
  have AS (SELECT query_id, count(*) AS have FROM judged WHERE label = 0 GROUP BY query_id),
  fresh AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) AS place FROM run
            WHERE query_id IN (SELECT query_id FROM judged) AND NOT EXISTS (SELECT 1 FROM judged j WHERE j.query_id = run.query_id AND j.doc_id = run.doc_id)),
  pairs AS (SELECT * FROM judged UNION ALL SELECT query_id, doc_id, 0 FROM fresh LEFT JOIN have USING (query_id) WHERE place <= 1000 - coalesce(have, 0))"""
_FEATURES = f"""{_PAIRS}, feats AS (SELECT pairs.query_id, pairs.doc_id, label, coalesce(run.score, 0.0) AS bm25, coalesce(j.score, -5000.0) AS jm, coalesce(t.score, 0.0) AS tfidf
  FROM pairs LEFT JOIN run USING (query_id, doc_id) LEFT JOIN ({best_sql(JM, 1000)}) j USING (query_id, doc_id) LEFT JOIN ({best_sql(TFIDF, 1000)}) t USING (query_id, doc_id))"""
_SCALED = ", ".join(f"round(({c} - quantile_cont({c}, 0.5) OVER ()) / CASE WHEN quantile_cont({c}, 0.75) OVER () = quantile_cont({c}, 0.25) OVER () THEN 1 ELSE quantile_cont({c}, 0.75) OVER () - quantile_cont({c}, 0.25) OVER () END, 6) AS {c}" for c in ("bm25", "jm", "tfidf"))

ORACLE = {
    "eval_binary_per_query": f"WITH {_BINARY} SELECT query_id, retrieved, n_rel, rel_ret, {_rounds(_BINARY_MEASURES)} FROM ({_BINARY_ROWS})",
    "eval_binary_mean": f"WITH {_BINARY} SELECT count(*) AS queries, sum(retrieved)::BIGINT AS retrieved, sum(n_rel)::BIGINT AS n_rel, sum(rel_ret)::BIGINT AS rel_ret, {_rounds(_BINARY_MEASURES, 'avg({})')} FROM ({_BINARY_ROWS})",
    "eval_graded_per_query": f"WITH {_GRADED} SELECT query_id, num_ret, num_rel, num_rel_ret, {_rounds(_GRADED_MEASURES)} FROM ({_GRADED_ROWS})",
    "eval_graded_mean": f"WITH {_GRADED} SELECT count(*) AS queries, avg(num_ret) AS num_ret, sum(num_rel) AS num_rel, sum(num_rel_ret) AS num_rel_ret, {_rounds(_GRADED_MEASURES, 'avg({})')} FROM ({_GRADED_ROWS})".replace("avg(num_ret) AS num_ret", "round(avg(num_ret), 6) AS num_ret"),
    "eval_graded_repeated": f"WITH {_GRADED_REPEATED} SELECT query_id, num_ret, num_rel, num_rel_ret, {_rounds(_GRADED_MEASURES)} FROM ({_GRADED_ROWS})",
    "eval_binary_repeated": f"WITH {_BINARY_REPEATED} SELECT query_id, retrieved, n_rel, rel_ret, {_rounds(_BINARY_MEASURES)} FROM ({_BINARY_ROWS})",
    "pr_points": f"WITH {_BINARY} SELECT query_id, rank::BIGINT AS rank, round(recall, 6) AS recall, round(precision, 6) AS precision FROM ({_POINTS})",
    "pr_curve_11pt": f"""WITH {_BINARY}, p AS ({_POINTS}),
      at_ AS (SELECT query_id, {_TENTH} AS level, arg_max(precision, rank) AS precision FROM p GROUP BY ALL),
      grid AS (SELECT query_id, unnest(range(11))::INT AS level FROM (SELECT DISTINCT query_id FROM p)),
      f AS (SELECT query_id, level, coalesce(max(precision) OVER (PARTITION BY query_id ORDER BY level ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0.0) AS precision FROM grid LEFT JOIN at_ USING (query_id, level))
      SELECT round(level / 10.0::DOUBLE, 6) AS level, round(avg(precision), 6) AS precision FROM f GROUP BY level""",
    "ltr_pairs": f"WITH {_PAIRS} SELECT query_id, doc_id, label FROM pairs",
    "ltr_features": f"WITH {_FEATURES} SELECT * FROM feats",
    "ltr_robust_scaled": f"WITH {_FEATURES} SELECT query_id, doc_id, label, {_SCALED} FROM feats",
    "ltr_folds": f"""WITH {_PAIRS}, ids AS (SELECT query_id, row_number() OVER (ORDER BY query_id) - 1 AS at_, count(*) OVER () AS n FROM (SELECT DISTINCT query_id FROM pairs)),
      f AS (SELECT query_id, floor(at_ * 5 / n::DOUBLE)::INT AS fold FROM ids)
      SELECT fold, label, count(*) AS pairs, count(DISTINCT query_id) AS queries FROM pairs JOIN f USING (query_id) GROUP BY fold, label""",
}
