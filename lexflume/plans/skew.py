"""Queries of problem 5: a few keys holding most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexflume.operators import skew
from lexflume.session import table


def _lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "full_catalog").select("group_no", "term", "byte_offset", "length").where("length IS NOT NULL").distinct()


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = skew.key_totals(skew.link_entries(table(spark, sf_dir, "hurricane_index")), "key", "entries")
    lengths = skew.key_totals(_lengths(spark, sf_dir), "term", "length")
    both = [d.select(F.lit(name).alias("source_field"), F.col("key").alias("key_text"), "total", "heavy") for name, d in (("inlinks", links), ("length", lengths))]
    return both[0].unionByName(both[1])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = skew.heavy_keys(skew.link_entries(table(spark, sf_dir, "hurricane_index")), "key", "entries")
    lengths = skew.heavy_keys(_lengths(spark, sf_dir), "term", "length")
    both = [d.select(F.lit(name).alias("source_field"), F.col("key").alias("key_text")) for name, d in (("inlinks", links), ("length", lengths))]
    return both[0].unionByName(both[1])


def p5_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _totals(spark, sf_dir)


def p5_length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_quantiles(_lengths(spark, sf_dir), "term", "length", (0.5, 0.9, 0.99)).select(F.col("key").alias("term"), "p", F.col("value").alias("length"))


def p5_inlink_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per linking URL, quantiles of the number of in-links of the pages it links to."""
    pages = table(spark, sf_dir, "hurricane_index")
    rows = pages.select(F.explode("inlinks").alias("url"), F.size("inlinks").alias("inlinks")).where("url IS NOT NULL").select(skew.link_key(F.col("url")).alias("key"), "inlinks")
    return skew.key_quantiles(rows, "key", "inlinks", (0.25, 0.5, 0.75)).select(F.col("key").alias("url"), "p", F.col("value").alias("inlinks"))


QUERIES = {f.__name__: f for f in (p5_found, p5_totals, p5_length_quantiles, p5_inlink_quantiles)}

_LINK = r"""
  CASE WHEN regexp_matches(bare, '^https?://', 'i')
  THEN 'http://' || regexp_replace(lower(regexp_extract(bare, '^https?://([^/?#]*)', 1, 'i')), ':(80|443)$', '') || regexp_replace(bare, '^https?://[^/?#]*', '', 'i')
  ELSE bare END"""
_LINKS = f"""
  SELECT {_LINK} AS k, n FROM (
    SELECT regexp_replace(u, '#.*$', '') AS bare, n FROM (SELECT unnest(inlinks) AS u, len(inlinks) AS n FROM hurricane_index) WHERE u IS NOT NULL)"""
_LENGTHS = "SELECT DISTINCT group_no, term, byte_offset, length FROM full_catalog WHERE length IS NOT NULL"
_TOTALS = f"""
  SELECT 'inlinks' AS source_field, k AS key_text, count(*) AS total, count(*) >= 0.01 * sum(count(*)) OVER () AS heavy FROM ({_LINKS}) GROUP BY k
  UNION ALL
  SELECT 'length', term, sum(length)::BIGINT, sum(length) >= 0.01 * sum(sum(length)) OVER () FROM ({_LENGTHS}) WHERE term IS NOT NULL GROUP BY term"""


def _quantiles(rows: str, key: str, value: str, shares: str) -> str:
    return f"""
  SELECT {key}, p, min(v)::{{kind}} AS {value} FROM (
    SELECT {key}, v, row_number() OVER (PARTITION BY {key} ORDER BY v) AS i, count(*) OVER (PARTITION BY {key}) AS n FROM ({rows})),
    (SELECT unnest([{shares}]::DOUBLE[]) AS p)
  WHERE i >= greatest(1, ceil(p * n)) GROUP BY {key}, p"""


ORACLE = {
    "p5_found": f"SELECT source_field, key_text FROM ({_TOTALS}) WHERE heavy",
    "p5_totals": _TOTALS,
    "p5_length_quantiles": _quantiles(f"SELECT term, length AS v FROM ({_LENGTHS}) WHERE term IS NOT NULL", "term", "length", "0.5, 0.9, 0.99").format(kind="BIGINT"),
    "p5_inlink_quantiles": _quantiles(f"SELECT k AS url, n AS v FROM ({_LINKS})", "url", "inlinks", "0.25, 0.5, 0.75").format(kind="INT"),
}
