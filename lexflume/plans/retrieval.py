"""Queries over the text collection: analysis, index, ranking, feedback. The queries are the benchmark's items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.functions.analysis import Analyzer, clean_words, not_stopped_substring, porter_stem, stop_set, word_list
from lexflume.operators import feedback, ranking
from lexflume.operators.index import SearchIndex, merge_postings, postings
from lexflume.session import table
from lexflume.sources.sinks import run_lines

STOPWORDS = stop_set(("the", "of", "and", "a", "in", "to", "at", "was", "by", "for"))
#: Documents of a run.
DEPTH = 1000
ANALYZER = Analyzer(stopwords=STOPWORDS)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def index_of(spark: SparkSession, sf_dir: str, keep: bool = False, positions: bool = True) -> SearchIndex:
    return SearchIndex.build(_docs(spark, sf_dir), analyzer=ANALYZER, keep=keep, positions=positions)


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ANALYZER.queries(table(spark, sf_dir, "benchmark"), "item_id", "text")


def tokenize_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analyzer().tokens(_docs(spark, sf_dir), "doc_id", "text").withColumn("pos", F.col("pos").cast("long"))


def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).doc_stats


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_stats


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).stats.withColumn("avgdl", F.round("avgdl", 6))


def postings_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def vocab_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _docs(spark, sf_dir).select(F.explode(word_list(F.lower("text"))).alias("term"))
    return words.agg(F.count_distinct("term").alias("v"), F.count("*").alias("tokens"))


def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Analyzer(positional=False, stopwords=STOPWORDS).tokens(_docs(spark, sf_dir), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("kept"))


def stopword_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Analyzer(positional=False).tokens(_docs(spark, sf_dir), "doc_id", "text")
    return rows.where(not_stopped_substring(F.col("term"), "\n".join(sorted(STOPWORDS)))).groupBy("doc_id").agg(F.count("*").alias("kept"))


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", clean_words(F.lower("text")).alias("clean"))


def stem_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stemmed index; SQL has no stemmer, so its totals are compared with the unstemmed ones in the tests."""
    index = SearchIndex.build(_docs(spark, sf_dir), analyzer=Analyzer(stopwords=STOPWORDS, stem=True))
    return index.term_stats


#: Words and their stems as published with the algorithm (fixed values).
STEMS = (
    "caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, "
    "hopping hop, tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, digitizer digit, "
    "operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, triplicate triplic, formative form, formalize formal, electrical electr, hopeful hope, goodness good, "
    "revival reviv, allowance allow, inference infer, airliner airlin, gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, "
    "adoption adopt, communism commun, activate activ, homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll"
)


def porter_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stems of the published words; every document is stemmed by the same function in `stem_postings`."""
    words = [(pair.split()[0],) for pair in STEMS.split(", ")]
    return spark.createDataFrame(words, "word string").select("word", porter_stem("word").alias("stem"))


def index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial indexes of each language merged; equal to the index in one go."""
    docs = table(spark, sf_dir, "documents").withColumn("part", F.coalesce(F.lower("lang") == "en", F.lit(False)))
    parts = [postings(ANALYZER.tokens(docs.where(F.col("part") == p), "doc_id", "text")) for p in (True, False)]
    return merge_postings(*parts).select("term", "doc_id", "tf", F.array_join("positions", ",").alias("positions"))


def _run(model: str, **options):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ranking.search(index_of(spark, sf_dir, keep=True, positions=model == "proximity"), _queries(spark, sf_dir), model, DEPTH, **options)

    return query


RUNS = {
    "okapi_tf": _run("okapi_tf"),
    "okapi_tf_zero_fill": _run("okapi_tf", zero_fill=True),
    "tfidf": _run("tfidf"),
    "bm25_index": _run("bm25_index"),
    "bm25_vectors": _run("bm25_vectors"),
    "match_builtin": _run("match"),
    "laplace_lm": _run("laplace"),
    "jm_lm": _run("jm"),
    "proximity_bm25": _run("proximity"),
}


def vector_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over the news collection's term vectors; the queries are the three terms with the longest posting lists of each partial index of the catalog."""
    index = SearchIndex.from_vectors(table(spark, sf_dir, "term_vectors_new"))
    longest = table(spark, sf_dir, "full_catalog").where("term IS NOT NULL AND length IS NOT NULL").groupBy("group_no", "term").agg(F.max("length").alias("length"))
    place = F.row_number().over(W.partitionBy("group_no").orderBy(F.desc("length"), "term")) - 1
    queries = longest.withColumn("qpos", place).where("qpos < 3").select(F.col("group_no").cast("string").alias("query_id"), "qpos", "term")
    return ranking.search(index, queries, "bm25_vectors", DEPTH)


def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = table(spark, sf_dir, "results_okapibm25_aggs_new").where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return run_lines(run)


def prf_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, queries = index_of(spark, sf_dir, keep=True, positions=False), _queries(spark, sf_dir)
    run = ranking.search(index, queries, "bm25_vectors", 10)
    return feedback.expand(index, run, queries).select("query_id", F.array_join("terms", " ").alias("terms"))


def significant_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feedback.significant_terms(index_of(spark, sf_dir, keep=True, positions=False), _queries(spark, sf_dir))
    return rows.select("query_id", "source_term", "term", "foreground", "score")


def prf_aggs_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = feedback.expand_significant(index_of(spark, sf_dir, keep=True, positions=False), _queries(spark, sf_dir), STOPWORDS)
    return rows.select("query_id", F.array_join("terms", " ").alias("terms"))


QUERIES = {f.__name__: f for f in (tokenize_positions, doc_lengths, term_stats, collection_stats, postings_list, vocab_exact, stopword_filter, stopword_substring, clean_text, stem_postings, porter_stems, index_merge, vector_bm25, run_file, prf_expand, significant_terms, prf_aggs_expand)} | RUNS

# --- DuckDB twins -----------------------------------------------------------------------------------------------------

_STOPPED = ", ".join(f"'{w}'" for w in sorted(STOPWORDS))
_SPACE = r"\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}"
_PATTERN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_SPACE}]|[\n\r]+"


def _tokens(name: str, key: str) -> str:
    return f"""
  SELECT {key}, pos, term FROM (
    SELECT {key}, unnest(range(len(w))) AS pos, unnest(w) AS term FROM (SELECT {key}, regexp_extract_all(lower(text), '{_PATTERN}') AS w FROM {name}))
  WHERE regexp_matches(term, '^[\\p{{L}}\\p{{N}}]+$')"""


INDEX_SQL = f"""
  tok AS ({_tokens('documents', 'doc_id')} AND term NOT IN ({_STOPPED})),
  post AS (SELECT term, doc_id, count(*)::INT AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM tok GROUP BY term, doc_id),
  terms AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM post GROUP BY term),
  docs AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM post GROUP BY doc_id),
  stats AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n, count(DISTINCT term) AS v, sum(tf)::BIGINT AS sum_ttf,
            sum(tf)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) AS avgdl FROM post)"""
_QUERIES = f"""
  qtok AS ({_tokens('benchmark', 'item_id')} AND term NOT IN ({_STOPPED})),
  q AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS qtf FROM qtok GROUP BY item_id, term)"""
_MATCHED = "m AS (SELECT query_id, doc_id, qtf, tf, dl, df, ttf, n, avgdl, v FROM q JOIN post USING (term) JOIN terms USING (term) JOIN docs USING (doc_id), stats)"


def _rank(scores: str, k: int = DEPTH) -> str:
    return f"""SELECT query_id, doc_id, score, rank FROM (
    SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
    FROM (SELECT query_id, doc_id, round(score, 6) AS score FROM ({scores}))) WHERE rank <= {k}"""


def _sparse(weight: str) -> str:
    return f"SELECT query_id, doc_id, sum({weight}) AS score FROM m GROUP BY query_id, doc_id"


_OKAPI = "tf / (tf + 0.5 + 1.5 * dl / avgdl)"
_VECTORS = "qtf * log2((n + 0.5) / (df + 0.5)) * (tf + 1.2 * tf) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * (qtf + 1.2 * qtf) / (qtf + 1.2)"
_WEIGHTS = {
    "okapi_tf": f"qtf * {_OKAPI}",
    "tfidf": f"qtf * {_OKAPI} * log2(n / df)",
    "bm25_index": "log2((n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.5 + 0.5 * dl / avgdl)) * qtf * 2.2 / (qtf + 1.2)",
    "bm25_vectors": _VECTORS,
    "match_builtin": "qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))",
}
_BASE = f"WITH {INDEX_SQL}, {_QUERIES}, {_MATCHED}"
#: The naive form of the dense models: every query word against every document.
_DENSE = f"""WITH {INDEX_SQL}, {_QUERIES},
  grid AS (SELECT query_id, term, qtf, doc_id, dl FROM q, docs),
  full_ AS (SELECT query_id, grid.doc_id, qtf, dl, coalesce(tf, 0) AS tf, coalesce(ttf, 100) AS ttf, v
            FROM grid LEFT JOIN post ON post.term = grid.term AND post.doc_id = grid.doc_id LEFT JOIN terms ON terms.term = grid.term, stats)"""
_FEEDBACK = f"""{_BASE},
  run AS ({_rank(_sparse(_VECTORS), 10)}),
  words AS (SELECT query_id, term, max(round(log2(1 + tf) * ln(n / df), 9)) AS score FROM run JOIN post USING (doc_id) JOIN terms USING (term), stats WHERE rank <= 1 GROUP BY query_id, term),
  best AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) AS place FROM words QUALIFY place <= 2),
  fresh AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = best.query_id AND q.term = best.term))"""
_OWN = "own AS (SELECT item_id AS query_id, string_agg(term, ' ' ORDER BY pos) AS own FROM qtok GROUP BY item_id)"
_SIGNIFICANT = f"""WITH {INDEX_SQL}, {_QUERIES},
  sources AS (SELECT DISTINCT term AS source_term FROM q),
  pairs AS (SELECT source_term, b.term, count(*) AS foreground FROM sources JOIN post a ON a.term = source_term JOIN post b ON b.doc_id = a.doc_id GROUP BY source_term, b.term HAVING count(*) >= 3),
  shares AS (SELECT source_term, pairs.term, foreground, foreground / s.df AS fg, t.df / n AS bg FROM pairs JOIN terms s ON s.term = source_term JOIN terms t ON t.term = pairs.term, stats),
  rated AS (SELECT source_term, term, foreground, round((fg - bg) * (fg / bg), 9) AS score FROM shares WHERE fg > bg),
  kept AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY source_term ORDER BY score DESC, term) <= 10),
  sig AS (SELECT query_id, source_term, kept.term, foreground, score FROM q JOIN kept ON kept.source_term = q.term)"""

#: The pairs the walk visits, without the walk: a position counts once for each other word that follows within two places, the
#: last position of a word once more for each such place.
_PROXIMITY = f"""{_BASE},
  qp AS (SELECT query_id, doc_id, term, tf, unnest(string_split(positions, ',')::INT[]) AS pos FROM q JOIN post USING (term)),
  ends AS (SELECT query_id, doc_id, term, max(pos) AS last_pos FROM qp GROUP BY ALL),
  near AS (SELECT a.query_id, a.doc_id, a.term AS one, b.term AS two, a.tf AS tf_v, b.tf AS tf_w, a.pos FROM (SELECT *, unnest([1, 2]) AS d FROM qp) a
           JOIN qp b ON b.query_id = a.query_id AND b.doc_id = a.doc_id AND b.pos = a.pos + a.d WHERE a.term <> b.term),
  dir AS (SELECT query_id, doc_id, one, two, tf_v, tf_w, count(DISTINCT pos) + count(*) FILTER (pos = last_pos) AS close FROM near JOIN ends USING (query_id, doc_id) WHERE ends.term = one GROUP BY ALL),
  both_ AS (SELECT query_id, doc_id, one, tf_v, tf_w, close FROM dir UNION ALL SELECT query_id, doc_id, two, tf_w, tf_v, close FROM dir),
  acc AS (SELECT query_id, doc_id, one, tf_v, sum(CASE WHEN n - tf_w + 1 > 0 THEN close * log2((n - tf_w + 1) / (tf_w + 0.5::DOUBLE)) / 4 ELSE 0 END) AS acc FROM both_, stats GROUP BY ALL),
  bonus AS (SELECT query_id, doc_id, sum(CASE WHEN n - tf_v + 1 > 0 THEN least(log2((n - tf_v + 1) / (tf_v + 0.5::DOUBLE)), 1) ELSE 0 END * acc * 2.5 / (acc + 1.5 * (0.6 + 0.4 * dl / avgdl))) AS bonus
            FROM acc JOIN docs USING (doc_id), stats WHERE acc <> 0 GROUP BY query_id, doc_id)"""

ORACLE = {
    "proximity_bm25": f"{_PROXIMITY} {_rank('SELECT query_id, doc_id, score + coalesce(bonus, 0) AS score FROM (' + _sparse(_WEIGHTS['bm25_index']) + ') LEFT JOIN bonus USING (query_id, doc_id)')}",
    "porter_stems": f"SELECT * FROM (VALUES {', '.join(str(tuple(pair.split())) for pair in STEMS.split(', '))}) t(word, stem)",
    "tokenize_positions": _tokens("documents", "doc_id"),
    "doc_lengths": f"WITH {INDEX_SQL} SELECT doc_id, dl FROM docs",
    "term_stats": f"WITH {INDEX_SQL} SELECT term, df, ttf FROM terms",
    "collection_stats": f"WITH {INDEX_SQL} SELECT n, round(avgdl, 6) AS avgdl, v, sum_ttf FROM stats",
    "postings_list": f"WITH {INDEX_SQL} SELECT term, doc_id, tf, positions FROM post",
    "index_merge": f"WITH {INDEX_SQL} SELECT term, doc_id, tf, positions FROM post",
    "vocab_exact": r"SELECT count(DISTINCT t) AS v, count(*) AS tokens FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS t FROM documents)",
    "stopword_filter": rf"SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM documents) WHERE t NOT IN ({_STOPPED}) GROUP BY doc_id",
    "stopword_substring": rf"SELECT doc_id, count(*) AS kept FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS t FROM documents) WHERE NOT contains(array_to_string([{_STOPPED}], chr(10)), t) GROUP BY doc_id",
    "clean_text": r"SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda t: regexp_matches(t, '^\p{L}+$')), ' ') AS clean FROM documents",
    **{name: f"{_BASE} {_rank(_sparse(weight))}" for name, weight in _WEIGHTS.items()},
    "okapi_tf_zero_fill": f"""{_BASE}, hit AS ({_sparse(_WEIGHTS['okapi_tf'])}),
      filled AS (SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM q) CROSS JOIN (SELECT DISTINCT doc_id FROM documents) LEFT JOIN hit USING (query_id, doc_id))
      {_rank('SELECT * FROM filled')}""",
    "laplace_lm": f"{_DENSE} {_rank('SELECT query_id, doc_id, sum(qtf * ln((tf + 1) / (dl + v))) AS score FROM full_ GROUP BY query_id, doc_id')}",
    "jm_lm": f"{_DENSE} {_rank('SELECT query_id, doc_id, sum(qtf * ln(1.1 * tf / dl + (1.1::DOUBLE - 1) * ttf / v)) AS score FROM full_ GROUP BY query_id, doc_id')}",
    "prf_expand": f"{_FEEDBACK}, {_OWN}, new AS (SELECT query_id, string_agg(term, ' ' ORDER BY place) AS new FROM fresh GROUP BY query_id) SELECT query_id, CASE WHEN new IS NULL THEN own ELSE new || ' ' || own END AS terms FROM own LEFT JOIN new USING (query_id)",
    "significant_terms": f"{_SIGNIFICANT} SELECT query_id, source_term, term, foreground, score FROM sig",
    "prf_aggs_expand": f"""{_SIGNIFICANT}, {_OWN},
      votes AS (SELECT query_id, term, count(*) AS n_votes FROM sig GROUP BY query_id, term),
      few AS (SELECT query_id, term FROM votes QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY n_votes DESC, term) <= 2),
      best AS (SELECT query_id, term FROM few LEFT JOIN terms USING (term), stats WHERE term NOT IN ({_STOPPED})
               QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(ln(n / coalesce(df, 100)), 9) DESC, term) <= 1)
      SELECT query_id, term || ' ' || own AS terms FROM own JOIN best USING (query_id)""",
    "vector_bm25": f"""
      WITH q AS (SELECT group_no::VARCHAR AS query_id, term, 1.0::DOUBLE AS qtf FROM (SELECT group_no, term, max(length) AS length FROM full_catalog WHERE term IS NOT NULL AND length IS NOT NULL GROUP BY ALL)
                 QUALIFY row_number() OVER (PARTITION BY group_no ORDER BY length DESC, term) <= 3),
      post AS (SELECT term, doc_id, max(term_freq) AS tf FROM term_vectors_new WHERE doc_id IS NOT NULL AND term IS NOT NULL AND term_freq >= 1 GROUP BY term, doc_id),
      terms AS (SELECT term, count(*) AS df, sum(tf) AS ttf FROM post GROUP BY term), docs AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY doc_id),
      stats AS (SELECT count(*) AS n, avg(dl) AS avgdl, 0 AS v FROM docs), {_MATCHED} {_rank(_sparse(_VECTORS))}""",
    "run_file": """
      SELECT query_id, rank, concat_ws(' ', query_id, 'Q0', doc_id, rank, score, 'Exp') AS value FROM (
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM (
          SELECT query_id, doc_id, max(score) AS score FROM results_okapibm25_aggs_new WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY query_id, doc_id))
      WHERE rank <= 1000""",
}
