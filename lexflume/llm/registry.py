"""Queries of the training-data problems and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflume.llm import boilerplate, encode, leakage, near_dup, rank_fusion, terms, top_items, truncation
from lexflume.session import table

RUNS = ("results_okapibm25_aggs_new", "results_jm_aggs", "results_tfidf_aggs")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, members = near_dup.near_duplicates(table(spark, sf_dir, "hurricane_index"), "page_id", "content", shingle=3, similarity=0.5)
    return near_dup.expand_pairs(links, members)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [table(spark, sf_dir, name) for name in RUNS]
    return rank_fusion.fuse_rankings(runs, "query_id", "doc_id", top=3, least_items=40).select(F.col("grp").alias("query_id"), F.col("item").alias("doc_id"))


def p2_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [table(spark, sf_dir, name) for name in RUNS]
    return rank_fusion.fuse_rankings(runs, "query_id", "doc_id").select(F.col("grp").alias("query_id"), F.col("item").alias("doc_id"), F.round("share", 9).alias("share"), "rank")


_PAGE = ("page_id", "url", "host", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.furniture_lines(table(spark, sf_dir, "hurricane_index"), *_PAGE).select(F.col("page").alias("page_id"), "line_no")


def p3_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.main_content(table(spark, sf_dir, "hurricane_index"), *_PAGE).select(F.col("page").alias("page_id"), "content")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.leading_terms(table(spark, sf_dir, "term_vectors_new")).select(F.col("doc").alias("doc_id"), "term")


def p4_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = terms.term_divergence(table(spark, sf_dir, "term_vectors_new"))
    return scored.select(F.col("doc").alias("doc_id"), "term", F.col("tf").alias("term_freq"), F.col("docs").alias("doc_freq"), F.round("divergence", 6).alias("divergence"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_items.top_per_group(table(spark, sf_dir, RUNS[0]), "query_id", "doc_id", "score", 10).select(F.col("grp").alias("query_id"), F.col("item").alias("doc_id"))


def p6_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = top_items.top_per_group(table(spark, sf_dir, RUNS[0]), "query_id", "doc_id", "score", 10)
    return best.select(F.col("grp").alias("query_id"), F.col("item").alias("doc_id"), "score", "rank")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf_dir, "term_vectors_new")).where("mark IS NOT NULL").select("term", "mark")


def p7_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.term_frequencies(table(spark, sf_dir, "term_vectors_new"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).groupBy(F.col("item").alias("item_id")).agg(F.count_distinct("doc").alias("docs"), F.max("words").alias("longest"))


def p9_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf_dir, "documents"), "doc_id", _leaks(spark, sf_dir)).select("doc_id", "source")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judged(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir).where("cut").select(F.col("doc").alias("doc_id"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncation_rates(_judged(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (p1_found, p2_found, p2_ranking, p3_found, p3_content, p4_found, p4_divergence, p6_found, p6_ranked, p7_found, p7_frequencies, p8_ids, p9_found, p9_leaked_items, p9_clean, p10_found, p10_rates)
    return {f.__name__: f for f in named}


_TERM_ROWS = """
  SELECT doc_id, term, max(term_freq) AS tf FROM term_vectors_new
  WHERE doc_id IS NOT NULL AND term IS NOT NULL AND term <> '' AND term_freq >= 1 GROUP BY doc_id, term"""
_DIVERGENCE = f"""
  rows AS ({_TERM_ROWS}), size AS (SELECT sum(tf)::DOUBLE AS c FROM rows),
  terms AS (SELECT term, sum(tf)::DOUBLE AS ttf, count(*) AS docs FROM rows GROUP BY term HAVING count(*) >= 2),
  lengths AS (SELECT doc_id, sum(tf)::DOUBLE AS n FROM rows GROUP BY doc_id),
  parts AS (SELECT doc_id, term, tf, docs, ttf / c AS bg, (tf + 100.0 * (ttf / c)) / (n + 100.0) AS own
            FROM rows JOIN terms USING (term) JOIN lengths USING (doc_id), size),
  scored AS (SELECT doc_id, term, tf, docs, own * log2(own / bg) AS divergence FROM parts)"""
_BEST = """
  SELECT query_id, doc_id, max(score) AS score FROM results_okapibm25_aggs_new
  WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY query_id, doc_id"""
_TOP = f"""
  SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM ({_BEST}) QUALIFY rank <= 10"""


def _grams(key: str, text: str, size: int, name: str) -> str:
    return f"""
  SELECT {key} AS id, unnest(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i + {size} - 1], ' '))) AS g
  FROM (SELECT {key}, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}) WHERE len(w) >= {size}"""


_LEAKS = f"""
  d AS ({_grams('doc_id', 'text', 12, 'documents')}), b AS ({_grams('item_id', 'text', 12, 'benchmark')}),
  leaks AS (SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM d JOIN b USING (g))"""


def _placed(key: str, name: str) -> str:
    """Every run of twelve words with its place."""
    return f"""
  SELECT {key} AS id, at_, array_to_string(w[at_:at_ + 11], ' ') AS g
  FROM (SELECT {key}, w, unnest(range(1, len(w) - 10)) AS at_ FROM (SELECT {key}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {name}) WHERE len(w) >= 12)"""


def _walk(rounds: int) -> str:
    """The chain's shares after so many rounds, each a sum over all items ranked no higher."""
    runs = range(len(RUNS))
    best = [f"b{k} AS (SELECT query_id, doc_id, max(score) AS s{k} FROM {name} WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY ALL)" for k, name in enumerate(RUNS)]
    reached = ", ".join(f"count(*) OVER (PARTITION BY query_id ORDER BY s{k} DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c{k}" for k in runs)
    step = " + ".join(f"sum(share / c{k}) OVER (PARTITION BY query_id ORDER BY s{k} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)" for k in runs)
    names = ", ".join(f"s{k}, c{k}" for k in runs)
    steps = [f"w0 AS MATERIALIZED (SELECT *, 1 / n::DOUBLE AS share FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, {reached} FROM b0 JOIN b1 USING (query_id, doc_id) JOIN b2 USING (query_id, doc_id)))"]
    steps += [f"w{r} AS MATERIALIZED (SELECT query_id, doc_id, {names}, n, 0.5 / n + 0.5::DOUBLE / {len(RUNS)} * ({step}) AS share FROM w{r - 1})" for r in range(1, rounds + 1)]
    rank = f"ranked AS (SELECT query_id, doc_id, n, share, row_number() OVER (PARTITION BY query_id ORDER BY round(share * n, 9) DESC, doc_id)::INT AS rank FROM w{rounds})"
    return ",\n  ".join([*best, *steps, rank])


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH {_walk(46)} SELECT query_id, doc_id FROM ranked WHERE n >= 40 AND rank <= 3",
        "p2_ranking": f"WITH {_walk(46)} SELECT query_id, doc_id, round(share, 9) AS share, rank FROM ranked",
        "p9_leaked_items": f"""
            WITH d AS ({_placed('doc_id', 'documents')}), b AS ({_placed('item_id', 'benchmark')}),
            m AS (SELECT d.id AS doc, b.id AS item, d.at_ AS at_, d.at_ - b.at_ AS diagonal FROM d JOIN b USING (g)),
            runs AS (SELECT doc, item, diagonal, at_ - row_number() OVER (PARTITION BY doc, item, diagonal ORDER BY at_) AS run FROM (SELECT DISTINCT * FROM m)),
            lengths AS (SELECT doc, item, count(*) + 11 AS words FROM runs GROUP BY doc, item, diagonal, run)
            SELECT item AS item_id, count(DISTINCT doc) AS docs, max(words) AS longest FROM lengths GROUP BY item""",
        "p1_found": f"""
            WITH s AS (SELECT DISTINCT id, hash(g) AS g FROM ({_grams('page_id', 'content', 3, 'hurricane_index')})),
            n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
            o AS (SELECT a.id AS page_a, b.id AS page_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL)
            SELECT page_a, page_b FROM o JOIN n x ON x.id = page_a JOIN n y ON y.id = page_b WHERE k >= 0.5 * (x.n + y.n - k)""",
        "p4_found": f"WITH {_DIVERGENCE} SELECT doc_id, term FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(divergence, 9) DESC, term) = 1",
        "p4_divergence": f"WITH {_DIVERGENCE} SELECT doc_id, term, tf AS term_freq, docs AS doc_freq, round(divergence, 6) AS divergence FROM scored",
        "p6_found": f"SELECT query_id, doc_id FROM ({_TOP})",
        "p6_ranked": _TOP,
        "p7_found": f"""
            WITH rows AS ({_TERM_ROWS}), n AS (SELECT count(DISTINCT doc_id) AS n FROM rows)
            SELECT term, CASE WHEN count(*) < 3 THEN 'rare' ELSE 'common' END AS mark FROM rows, n GROUP BY term, n HAVING count(*) < 3 OR count(*) > 0.5 * n""",
        "p7_frequencies": f"""
            WITH rows AS ({_TERM_ROWS}), n AS (SELECT count(DISTINCT doc_id) AS n FROM rows)
            SELECT term, sum(tf)::BIGINT AS occurrences, count(*) AS docs,
                   CASE WHEN count(*) < 3 THEN 'rare' WHEN count(*) > 0.5 * n THEN 'common' END AS mark FROM rows, n GROUP BY term, n""",
        "p9_found": f"WITH {_LEAKS} SELECT doc_id, item_id FROM leaks",
        "p9_clean": f"WITH {_LEAKS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
    }
