"""Writers of the text formats of the field; each has a function that gives the lines as a DataFrame, and one that writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def run_lines(run: DataFrame, tag: str = "Exp", k: int = 1000) -> DataFrame:
    """(query_id, rank, value): 'query Q0 document rank score tag', ranks from 1 by score (ties by document), at most `k` per query."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id")))
    rows = run.withColumn("rank", rank).where(F.col("rank") <= k)
    return rows.select("query_id", "rank", F.concat_ws(" ", "query_id", F.lit("Q0"), "doc_id", "rank", "score", F.lit(tag)).alias("value"))


def write_run(run: DataFrame, path: str, tag: str = "Exp", k: int = 1000) -> None:
    run_lines(run, tag, k).repartitionByRange("query_id", "rank").sortWithinPartitions("query_id", "rank").select("value").write.mode("overwrite").text(path)


def qrel_lines(qrels: DataFrame) -> DataFrame:
    return qrels.select(F.concat_ws(" ", "query_id", F.regexp_replace("assessor", " ", "_"), "doc_id", "grade").alias("value"))


def write_qrels(qrels: DataFrame, path: str, append: bool = True) -> None:
    qrel_lines(qrels).write.mode("append" if append else "overwrite").text(path)


def document_lines(docs: DataFrame) -> DataFrame:
    """Crawled documents (url, title, text) in TREC markup, one value per document."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), F.coalesce(c, F.lit("")), F.lit(f"</{name}>"))
    return docs.select(F.concat(F.lit("<DOC>\n"), tag("DOCNO", "url"), F.lit("\n<HEAD>"), tag("TITLE", "title"), F.lit("</HEAD>\n<TEXT>\n"), F.coalesce("text", F.lit("")), F.lit("\n</TEXT>\n</DOC>")).alias("value"))


def write_documents(docs: DataFrame, path: str) -> None:
    document_lines(docs).write.mode("overwrite").text(path)


def link_lines(links: DataFrame, key: str = "url", column: str = "links") -> DataFrame:
    """Lines of {"url": [links]}."""
    return links.select(F.to_json(F.create_map(F.col(key), F.coalesce(F.col(column), F.array().cast("array<string>")))).alias("value"))


def page_lines(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Lines of {"url": "raw HTML"}."""
    return pages.select(F.to_json(F.create_map(F.col(key), F.coalesce(F.col(html), F.lit("")))).alias("value"))


def write_pages(pages: DataFrame, path: str, key: str = "url", html: str = "html") -> None:
    page_lines(pages, key, html).write.mode("overwrite").text(path)


def write_links(links: DataFrame, path: str, key: str = "url", column: str = "links") -> None:
    link_lines(links, key, column).write.mode("overwrite").text(path)


def score_lines(scores: DataFrame) -> DataFrame:
    """'node<TAB>score', with '<TAB>outlinks: n<TAB>inlinks: m' where the degrees are known."""
    parts = ["node", "score"]
    if "outlinks" in scores.columns:
        parts += [F.concat(F.lit("outlinks: "), "outlinks"), F.concat(F.lit("inlinks: "), "inlinks")]
    return scores.orderBy(F.desc("score"), "node").select(F.concat_ws("\t", *parts).alias("value"))


def write_scores(scores: DataFrame, path: str, k: int | None = 500) -> None:
    """The `k` best scores as one file, or (None) all of them as files in order."""
    best = scores if k is None else scores.orderBy(F.desc("score"), "node").limit(k)
    lines = score_lines(best)
    (lines if k is None else lines.coalesce(1)).write.mode("overwrite").text(path)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_svmlight(rows: DataFrame, path: str) -> None:
    """Rows (label, features vector) in LIBSVM format."""
    rows.select(F.col("label").cast("double").alias("label"), "features").write.mode("overwrite").format("libsvm").save(path)
