"""The crawl as relations over supplied pages: admission, link harvest, redirects, and the next wave of the frontier."""

from __future__ import annotations

import urllib.robotparser
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexflume.functions import html as H
from lexflume.functions import urls as U

#: Topic words in URLs that bring a page forward (fixed values).
KEYWORDS = (
    "Hurricane Sandy", "hurricane", "storm", "flood", "damage", "FEMA", "evacuation", "power outage", "emergency response",
    "disaster relief", "New York", "east coast", "relief efforts",
)
MOST_DELAY, DEFAULT_DELAY = 3.0, 1.0


def frontier_score(url: Column, inlinks: Column, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """exp(-keywords in the URL) + exp(-number of in-links); lower is better."""
    hits = sum((F.lower(url).contains(w.lower()).cast("int") for w in keywords), F.lit(0))
    return F.exp(-hits.cast("double")) + F.exp(-inlinks.cast("double"))


def robots_rules(robots: DataFrame, urls: DataFrame, agent: str = "*") -> DataFrame:
    """(url, allowed, delay) of `urls` (url, domain) by robots files (domain, body, status): 401 and 403 deny all, other
    errors and missing files allow all; the delay is 1 s by default and at most 3 s."""
    rows = urls.select("url", "domain").join(robots.select("domain", "body", "status"), "domain", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules: dict[tuple, urllib.robotparser.RobotFileParser] = {}
        for batch in batches:
            allowed, delays = [], []
            for _, url, body, status in zip(*(batch.column(i).to_pylist() for i in range(4))):
                parser = rules.get((body, status))
                if parser is None:
                    if len(rules) > 10_000:
                        rules.clear()
                    parser = rules[body, status] = urllib.robotparser.RobotFileParser()
                    if status in (401, 403):
                        parser.disallow_all = True
                    elif body is None or (status or 0) >= 400:
                        parser.allow_all = True
                    else:
                        parser.parse(body.splitlines())
                        parser.modified()
                allowed.append(parser.can_fetch(agent, url or ""))
                delay = parser.crawl_delay(agent) if not (parser.allow_all or parser.disallow_all) else None
                delays.append(min(float(delay), MOST_DELAY) if delay is not None else DEFAULT_DELAY)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(allowed), pa.array(delays)], ["url", "allowed", "delay"])

    return rows.mapInArrow(run, "url string, allowed boolean, delay double")


def fetchable(pages: DataFrame) -> DataFrame:
    """Pages (status, content_type) that aren't missing and are HTML; a missing type counts as HTML."""
    return pages.where((F.coalesce("status", F.lit(200)) != 404) & F.contains(F.lower(F.coalesce("content_type", F.lit("text/html"))), F.lit("text/html")))


def merge_redirects(inlinks: DataFrame, redirects: DataFrame) -> DataFrame:
    """(url, inlinks) with in-links (url, inlinks) of redirected pages (url, final) united under the final URL."""
    moved = inlinks.join(redirects.select("url", "final"), "url", "left").select(F.coalesce("final", "url").alias("url"), F.explode("inlinks").alias("source"))
    return moved.groupBy("url").agg(F.array_sort(F.collect_set("source")).alias("inlinks"))


def harvest(pages: DataFrame, url_col: str = "url", html_col: str = "html", resolve_relative: bool = False) -> DataFrame:
    """(src, place, dst): the canonical out-links of each page in document order, repeated ones kept, empty ones left out."""
    rows = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("src"), F.posexplode(H.links(F.col(html_col))).alias("place", "link"))
    return rows.select("src", "place", U.canonicalize(F.col("src"), F.col("link"), resolve_relative).alias("dst")).where("dst <> ''")


def next_wave(links: DataFrame, known: DataFrame, wave: int, budget: int = 40_000, keywords: tuple[str, ...] = KEYWORDS) -> DataFrame:
    """(url, wave, inlinks, score): pages linked from `links` (src, dst) that aren't `known` (url), best score first, at most `budget`."""
    counts = links.groupBy(F.col("dst").alias("url")).agg(F.count_distinct("src").alias("inlinks"))
    fresh = counts.join(known.select("url"), "url", "left_anti").withColumn("wave", F.lit(wave))
    return fresh.withColumn("score", frontier_score(F.col("url"), F.col("inlinks"), keywords)).orderBy(F.round("score", 12), "url").limit(budget).select("url", "wave", "inlinks", "score")


def upsert_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """(url, author, content, inlinks, outlinks): pages of both tables by URL. Link lists are united in first-seen order,
    a different new author is appended with a comma, the new content replaces the old. URLs are unique in each table."""
    a, b = (d.select("url", "author", "content", "inlinks", "outlinks") for d in (old, new))
    both = a.alias("a").join(b.alias("b"), "url", "full_outer")
    none = F.array().cast("array<string>")
    author = F.when(F.col("a.author").isNull(), F.col("b.author")).when(F.col("b.author").isNull() | (F.col("a.author") == F.col("b.author")), F.col("a.author")).otherwise(F.concat_ws(", ", "a.author", "b.author"))
    union = lambda c: F.array_union(F.coalesce(f"a.{c}", none), F.coalesce(f"b.{c}", none)).alias(c)
    return both.select("url", author.alias("author"), F.coalesce("b.content", "a.content").alias("content"), union("inlinks"), union("outlinks"))
