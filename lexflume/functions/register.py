"""The engine's functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lexflume.functions.analysis import porter_stem
from lexflume.functions.urls import index_key
from lexflume.operators.proximity import visited_close_pairs


def register_functions(spark: SparkSession) -> None:
    """porter_stem(term), index_key(url), visited_close(positions, positions, window) as vectorised functions; word_list(text), url_domain(url) and url_host(url) as SQL expressions."""
    spark.udf.register("porter_stem", porter_stem)
    spark.udf.register("index_key", index_key)
    spark.udf.register("visited_close", visited_close_pairs)
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION word_list(text STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(text, r'[\p{L}\p{N}_]+', 0)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION url_domain(url STRING) RETURNS STRING RETURN regexp_extract(url, r'//([^/]*[\p{L}\p{N}_])', 1)")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION url_host(url STRING) RETURNS STRING RETURN regexp_extract(url, r'^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)")
