"""Readers of the text formats of the field, as lazy DataFrames with declared schemas."""

from __future__ import annotations

import email
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RUN = "query_id STRING, q0 STRING, doc_id STRING, rank INT, score DOUBLE, tag STRING"
QRELS = "query_id STRING, assessor STRING, doc_id STRING, grade INT"


def _files(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _records(spark: SparkSession, path: str, glob: str | None = None, end: str | None = None) -> DataFrame:
    """(path, at, value) of the records of text files that end with `end` (by default lines), as bytes. Files are split
    among tasks; `at` orders the records of a file."""
    reader = spark.read if glob is None else spark.read.option("pathGlobFilter", glob)
    rows = (reader if end is None else reader.option("lineSep", end)).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return rows.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), F.col("value").cast("binary").alias("value"))


def _documents(spark: SparkSession, path: str, glob: str | None, charset: str) -> DataFrame:
    """(path, at, body) of every <DOC> ... </DOC> block."""
    rows = _records(spark, path, glob, "</DOC>").where(~F.lower("path").rlike(r"/readme$"))
    blocks = rows.select("path", "at", F.regexp_replace(F.decode("value", charset), "\r\n?", "\n").alias("body")).where(F.contains("body", F.lit("<DOCNO>")))
    return blocks.withColumn("body", F.element_at(F.split("body", "<DOC>"), -1))


def _docno(body: Column) -> Column:
    return F.trim(F.regexp_extract(body, r"(?s)<DOCNO>(.*?)</DOCNO>", 1))


def read_trec(spark: SparkSession, path: str, glob: str | None = None, charset: str = "ISO-8859-1", last_text: bool = False, keep_markup_tail: bool = False) -> DataFrame:
    """(doc_id, text) of a TREC collection; files named readme are left out.

    The text is that of the first <TEXT> block with its lines joined by blanks, or of the last one (`last_text`).
    `keep_markup_tail` keeps the word of the closing mark, as parsers that read to the end of a document do.
    """
    rows = _documents(spark, path, glob, charset)
    texts = F.regexp_extract_all("body", F.lit(r"(?s)<TEXT>(.*?)</TEXT>"), 1)
    text = F.when(F.size(texts) == 0, "").otherwise(F.element_at(texts, -1 if last_text else 1))
    text = F.trim(F.regexp_replace(text, r"\n+", " "))
    if keep_markup_tail:
        text = F.concat(text, F.lit(" </TEXT>"))
    return rows.select(_docno(F.col("body")).alias("doc_id"), text.alias("text"))


def read_crawl_documents(spark: SparkSession, path: str, glob: str | None = None, budget: int = 40_000) -> DataFrame:
    """(url, title, text) of crawled documents in the same markup (UTF-8). Of repeated URLs the last one counts; at most `budget` documents, the first in file order."""
    rows = _documents(spark, path, glob, "UTF-8").withColumn("url", _docno(F.col("body")))
    last = W.partitionBy("url").orderBy(F.desc("path"), F.desc("at"))
    kept = rows.withColumn("n", F.row_number().over(last)).where("n = 1").orderBy("path", "at").limit(budget)
    return kept.select("url", F.trim(F.regexp_extract("body", r"(?s)<TITLE>(.*?)</TITLE>", 1)).alias("title"), F.trim(F.regexp_replace(F.regexp_extract("body", r"(?s)<TEXT>(.*?)</TEXT>", 1), r"\n+", " ")).alias("text"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, at, value): the lines of the files, in the order of `at` within each."""
    return _records(spark, path).withColumn("value", F.decode("value", "UTF-8"))


def read_link_json(spark: SparkSession, path: str) -> DataFrame:
    """(url, links) from lines of {"url": [links]}; of repeated URLs the last line counts."""
    rows = _lines(spark, path).where(F.trim("value") != "").select("path", "at", F.explode(F.from_json("value", "map<string,array<string>>")).alias("url", "links"))
    return rows.groupBy("url").agg(F.max_by("links", F.struct("path", "at")).alias("links"))


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """(node, neighbours) from lines 'node neighbour ...'; a node alone has none; of repeated nodes the last line counts; repeated neighbours count once."""
    rows = _lines(spark, path).withColumn("parts", F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")).where(F.size("parts") > 0)
    rows = rows.select("path", "at", F.col("parts")[0].alias("node"), F.array_distinct(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0)))).alias("neighbours"))
    return rows.groupBy("node").agg(F.max_by("neighbours", F.struct("path", "at")).alias("neighbours"))


def read_queries(spark: SparkSession, path: str, stop_at_blank: bool = False) -> DataFrame:
    """(query_id, text) from lines 'id. text'; `stop_at_blank` ends at a file's first blank line."""
    rows = _lines(spark, path)
    if stop_at_blank:
        blank = rows.where(F.trim("value") == "").groupBy("path").agg(F.min("at").alias("end"))
        rows = rows.join(blank, "path", "left").where(F.col("end").isNull() | (F.col("at") < F.col("end")))
    found = rows.select(F.regexp_extract("value", r"^\s*(\w+)\.", 1).alias("query_id"), F.trim(F.regexp_extract("value", r"^\s*\w+\.(.*)$", 1)).alias("text"))
    return found.where("query_id <> ''")


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").distinct()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """Runs of six fields; any white space separates them."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(*(F.col("p")[i].try_cast(t).alias(n) for i, (n, t) in enumerate(x.split(" ") for x in RUN.split(", "))))


def read_qrels(spark: SparkSession, path: str, binary: bool = False, numbered: bool = False) -> DataFrame:
    """Judgments of four fields; `binary` keeps those with a grade other than 0; `numbered` adds `at`, which orders all
    lines of all files, so that the last of repeated judgments can be told."""
    rows = _lines(spark, path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("p"), F.struct("path", "at").alias("at"))
    rows = rows.select(*(F.col("p")[i].try_cast(t).alias(n) for i, (n, t) in enumerate(x.split(" ") for x in QRELS.split(", "))), *(["at"] if numbered else []))
    return rows.where("grade <> 0") if binary else rows


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(data)


def _body(message) -> str:
    """The text of a message: its parts one after the other, plain as they are, HTML without tags."""
    if isinstance(message, str):
        return message
    if message.is_multipart():
        return "".join(_body(part) for part in message.get_payload())
    payload = message.get_payload()
    if not isinstance(payload, str):
        return ""
    kind = message.get_content_type()
    if kind == "text/html":
        parser = _Text()
        parser.feed(payload)
        return "".join(parser.parts)
    return payload if kind == "text/plain" else ""


def parse_mail(raw: str) -> tuple[str | None, str]:
    message = email.message_from_string(raw)
    subject = message["Subject"]
    return (str(subject) if subject is not None else None), _body(message)


def mail_parts(mails: DataFrame, id_col: str, raw_col: str) -> DataFrame:
    """(id, subject, body) of raw messages; nulls give nulls."""
    rows = mails.select(F.col(id_col).alias("id"), F.col(raw_col).alias("raw"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse_mail(x) if x is not None else (None, None) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], ["id", "subject", "body"])

    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, subject string, body string")


def read_mail_corpus(spark: SparkSession, index_path: str, mail_path: str, glob: str = "inmail.*") -> DataFrame:
    """(doc_id, label, subject, body) of an index of lines 'label path' and the message files it names (ISO-8859-1)."""
    index = spark.read.text(index_path).select(F.split(F.trim("value"), r"\s+").alias("p")).select(F.col("p")[0].alias("label"), F.regexp_extract(F.col("p")[1], r"inmail\.(.*)$", 1).alias("doc_id"))
    files = _files(spark, mail_path, glob).select(F.regexp_extract("path", r"inmail\.(.*)$", 1).alias("doc_id"), F.decode("content", "ISO-8859-1").alias("raw"))
    return index.join(mail_parts(files, "doc_id", "raw").withColumnRenamed("id", "doc_id"), "doc_id")

