"""Queries of the readers and sinks: tables are written in the text formats of the field and read back; and the crawl's rules over supplied pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflume.operators import crawl, evaluate
from lexflume.operators.index import SearchIndex
from lexflume.plans import evaluation, retrieval
from lexflume.session import scratch, table
from lexflume.sources import readers, sinks


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hurricane_index")


def trec_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_documents(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("url"), F.lit("t").alias("title"), "text"), path)
    return readers.read_trec(spark, path, charset="UTF-8")


def crawl_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawls in page order: the last one of a URL counts."""
    path = scratch(spark)
    pages = _pages(spark, sf_dir).where("url IS NOT NULL").repartitionByRange("page_id").sortWithinPartitions("page_id")
    sinks.write_documents(pages.select("url", F.coalesce("author", F.lit("")).alias("title"), F.col("content").alias("text")), path)
    return readers.read_crawl_documents(spark, path)


def link_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    pages = _pages(spark, sf_dir).where("url IS NOT NULL").repartitionByRange("page_id").sortWithinPartitions("page_id")
    sinks.write_links(pages, path, "url", "inlinks")
    return readers.read_link_json(spark, path).select("url", F.array_join("links", " ").alias("links"))


def adjacency_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and the parts of their lines, as lines of a node and its neighbours; every seventh order stands alone."""
    path = scratch(spark)
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("node")).agg(F.array_sort(F.collect_list("l_partkey")).alias("parts"))
    parts = F.when(F.col("node") % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.col("parts"))
    lists.select(F.array_join(F.concat(F.array(F.col("node").cast("string")), parts.cast("array<string>")), "  ")).write.text(path)
    return readers.read_adjacency(spark, path).select("node", F.array_join("neighbours", " ").alias("neighbours"))


def query_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    text = F.regexp_replace("text", r"[\r\n]+", " ")
    table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select(F.concat_ws("", F.col("item_id").cast("string"), F.lit(".  "), text)).write.text(path)
    return readers.read_queries(spark, path)


def stopword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "full_catalog").where("term IS NOT NULL").select(F.concat(F.lit(" "), "term", F.lit("  "))).write.text(path)
    return readers.read_stopwords(spark, path)


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_run(evaluation.best(spark, sf_dir, evaluation.BM25), path)
    return readers.read_run(spark, path)


def qrel_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary judgments out of two appended files."""
    path = scratch(spark)
    judged = evaluation.judgments(spark, sf_dir).withColumn("assessor", F.lit("first reader"))
    for part in (0, 1):
        sinks.write_qrels(judged.withColumn("grade", F.greatest(F.lit(0), F.col("grade") - part)), path)
    return readers.read_qrels(spark, path, binary=True)


def qrel_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = evaluation.repeated_judgments(spark, sf_dir).drop("at")
    old, new = lines.where("assessor = 'run'"), lines.where("assessor = 'second'")
    return evaluate.append_judgments(old.withColumn("assessor", F.lit("a b")), new.withColumn("assessor", F.lit("a b"))).withColumn("grade", F.col("grade").cast("int"))


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index written and read again: statistics of all terms, from its postings and as stored."""
    path = scratch(spark)
    retrieval.index_of(spark, sf_dir).write(path)
    index = SearchIndex.read(spark, path)
    counted = index.postings.groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("places"))
    return index.term_stats.join(counted, "term", "full")


def index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    retrieval.index_of(spark, sf_dir).write(path)
    return SearchIndex.read(spark, path).lookup(["storm", "coast", "harbour"]).select("term", "doc_id", F.array_join("positions", ",").alias("positions"))


def feature_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    rows = evaluation.QUERIES["ltr_features"](spark, sf_dir)
    sinks.write_features(rows, path)
    return spark.read.option("header", True).schema(rows.schema).csv(path)


def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred best scores as a file of lines."""
    path = scratch(spark)
    best = evaluation.best(spark, sf_dir, evaluation.TFIDF, 1)
    sinks.write_scores(best.select(F.concat_ws("/", "query_id", "doc_id").alias("node"), "score"), path, 100)
    parts = F.split("value", "\t")
    return spark.read.text(path).select(parts[0].alias("node"), parts[1].cast("double").alias("score"))


def page_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.write_pages(_pages(spark, sf_dir).where("url IS NOT NULL"), path, "url", "content")
    return spark.read.text(path).select(F.explode(F.from_json("value", "map<string,string>")).alias("url", "html"))


def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots files made for each host by the length of its name: a closed archive with a delay, a refusal, or none."""
    pages = _pages(spark, sf_dir).where("url IS NOT NULL AND host IS NOT NULL").select("url", F.col("host").alias("domain")).distinct()
    kind = F.length("domain") % 4
    robots = pages.select("domain").distinct().where(kind < 3).select(
        "domain", F.when(kind == 0, F.concat(F.lit("User-agent: *\nDisallow: /archive\nCrawl-delay: "), F.length("domain").cast("string"))).alias("body"), F.when(kind == 0, 200).when(kind == 1, 403).otherwise(404).alias("status")
    )
    return crawl.robots_rules(robots, pages).distinct()


def fetch_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    kind = F.col("page_id") % 5
    return crawl.fetchable(pages.select("page_id", F.when(kind == 0, 404).when(kind < 4, 200).alias("status"), F.when(kind == 1, "Text/HTML; charset=utf-8").when(kind == 2, "application/pdf").alias("content_type"))).select("page_id")


def redirect_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose number ends in 3 have moved to their host's front page."""
    pages = _pages(spark, sf_dir).where("url IS NOT NULL")
    moved = pages.where("page_id % 10 = 3").select("url", F.concat(F.lit("http://"), "host", F.lit("/")).alias("final")).distinct()
    return crawl.merge_redirects(pages.select("url", "inlinks"), moved).select("url", F.size("inlinks").alias("n"), F.array_join("inlinks", " ").alias("inlinks"))


QUERIES = {f.__name__: f for f in (
    trec_documents, crawl_documents, link_lines, adjacency_lines, query_lines, stopword_lines, run_lines, qrel_lines, qrel_append, index_files, index_lookup, feature_csv, score_lines, page_json,
    robots_rules, fetch_gate, redirect_merge,
)}

_ONE_LINE = r"trim(regexp_replace(regexp_replace({}, '\r\n?', chr(10), 'g'), '\n+', ' ', 'g'))"
_INDEX = f"WITH {retrieval.INDEX_SQL}"
_BEST = evaluation.best_sql

ORACLE = {
    "trec_documents": f"SELECT doc_id::VARCHAR AS doc_id, {_ONE_LINE.format('coalesce(text, chr(0))').replace('chr(0)', repr(''))} AS text FROM documents",
    "crawl_documents": f"SELECT url, trim(coalesce(author, '')) AS title, {_ONE_LINE.format(repr('') + ' || coalesce(content, ' + repr('') + ')')} AS text FROM (SELECT * FROM hurricane_index WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1 ORDER BY page_id LIMIT 40000)",
    "link_lines": "SELECT url, array_to_string(coalesce(inlinks, []), ' ') AS links FROM hurricane_index WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1",
    "adjacency_lines": "SELECT l_orderkey::VARCHAR AS node, CASE WHEN l_orderkey % 7 = 0 THEN '' ELSE string_agg(DISTINCT l_partkey::VARCHAR, ' ' ORDER BY l_partkey) END AS neighbours FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) GROUP BY l_orderkey".replace("string_agg(DISTINCT ", "string_agg("),
    "query_lines": r"SELECT item_id::VARCHAR AS query_id, trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS text FROM benchmark WHERE text IS NOT NULL",
    "stopword_lines": "SELECT DISTINCT trim(term) AS word FROM full_catalog WHERE trim(term) <> ''",
    "run_lines": f"SELECT query_id, 'Q0' AS q0, doc_id, rank, score, 'Exp' AS tag FROM ({_BEST(evaluation.BM25, 1000)})",
    "qrel_lines": f"WITH j AS (SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN 2 ELSE 1 END AS grade FROM ({_BEST(evaluation.TFIDF, 50)})) SELECT query_id, 'first_reader' AS assessor, doc_id, grade::INT AS grade FROM j UNION ALL SELECT query_id, 'first_reader', doc_id, (grade - 1)::INT FROM j WHERE grade > 1",
    "qrel_append": f"WITH {evaluation.LINES_SQL} SELECT query_id, 'a_b' AS assessor, doc_id, arg_max(grade, at_)::INT AS grade FROM lines GROUP BY query_id, doc_id",
    "index_files": f"{_INDEX} SELECT term, df, ttf, df AS docs, ttf AS places FROM terms",
    "index_lookup": f"{_INDEX} SELECT term, doc_id, positions FROM post WHERE term IN ('storm', 'coast', 'harbour')",
    "feature_csv": evaluation.ORACLE["ltr_features"],
    "score_lines": f"SELECT query_id || '/' || doc_id AS node, score FROM ({_BEST(evaluation.TFIDF, 1)}) ORDER BY score DESC, node LIMIT 100",
    "page_json": "SELECT url, coalesce(content, '') AS html FROM hurricane_index WHERE url IS NOT NULL",
    "robots_rules": r"""SELECT DISTINCT url, CASE length(host) % 4 WHEN 0 THEN NOT starts_with(regexp_extract(url, '^[^/]*//[^/]*(/.*)$', 1), '/archive') WHEN 1 THEN false ELSE true END AS allowed,
      CASE WHEN length(host) % 4 = 0 THEN least(length(host), 3)::DOUBLE ELSE 1.0::DOUBLE END AS delay FROM hurricane_index WHERE url IS NOT NULL AND host IS NOT NULL""",
    "fetch_gate": "SELECT page_id FROM hurricane_index WHERE page_id % 5 IN (1, 3, 4)",
    "redirect_merge": """WITH p AS (SELECT * FROM hurricane_index WHERE url IS NOT NULL), moved AS (SELECT DISTINCT url, 'http://' || host || '/' AS final FROM p WHERE page_id % 10 = 3),
      x AS (SELECT coalesce(final, p.url) AS url, unnest(inlinks) AS l FROM p LEFT JOIN moved USING (url))
      SELECT url, count(DISTINCT l)::INT AS n, string_agg(DISTINCT l, ' ' ORDER BY l) AS inlinks FROM x WHERE l IS NOT NULL GROUP BY url""",
}
