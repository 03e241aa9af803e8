"""Queries over the web index: link graph, PageRank, HITS, HTML, URLs, crawl waves, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.functions import html as H
from lexflume.functions import urls as U
from lexflume.functions.analysis import Analyzer
from lexflume.operators import crawl, graph
from lexflume.operators.index import SearchIndex
from lexflume.operators.ranking import collapse_hosts, search
from lexflume.session import table

D = 0.85


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hurricane_index")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_from_lists(_pages(spark, sf_dir), "url", "outlinks")


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(F.col("url").alias("node")).where("node IS NOT NULL").distinct()


def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.edges_from_lists(_pages(spark, sf_dir), "url", "inlinks", incoming=True)


def link_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_edges(spark, sf_dir))


def pagerank_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_edges(spark, sf_dir), _nodes(spark, sf_dir), D, iterations=4).select("node", F.round("score", 10).alias("score"))


def pagerank_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.pagerank(_edges(spark, sf_dir), _nodes(spark, sf_dir), D).select("node", F.round("score", 10).alias("score"))


def pagerank_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _edges(spark, sf_dir)
    top = graph.top_scores(graph.pagerank(edges, _nodes(spark, sf_dir), D, iterations=4).withColumn("score", F.round("score", 10)), "score", 500, edges)
    return top


def hits_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = graph.hits(_edges(spark, sf_dir), _nodes(spark, sf_dir), iterations=3)
    return scores.select("node", F.round("authority", 9).alias("authority"), F.round("hub", 9).alias("hub"))


def hits_converged(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = graph.hits(_edges(spark, sf_dir), _nodes(spark, sf_dir), tolerance=1e-7)
    return scores.select("node", F.round("authority", 9).alias("authority"), F.round("hub", 9).alias("hub"))


def hits_base_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of expansion from the pages with the most in-links, without a bound that would need draws."""
    root = _pages(spark, sf_dir).where(F.size("inlinks") >= 20).select(F.col("url").alias("node"))
    return graph.expand_base(_edges(spark, sf_dir), root, least=1 << 40, most_inlinks=1 << 30, most_rounds=2)


def hits_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authorities for a topic: the pages that match it best, their base set, HITS, the first 500 with their degrees."""
    pages, edges = _pages(spark, sf_dir), _edges(spark, sf_dir)
    latest = pages.where("url IS NOT NULL").groupBy("url").agg(F.max_by("content", "page_id").alias("content"))
    index = SearchIndex.build(latest, "url", "content", Analyzer(positional=False), keep=True)
    topic = spark.createDataFrame([("t", 0, "storm"), ("t", 1, "surge"), ("t", 2, "harbour")], "query_id string, qpos int, term string")
    root = search(index, topic, "match", 1000).select(F.col("doc_id").alias("node"))
    return graph.top_scores(graph.hits(edges, graph.expand_base(edges, root), tolerance=1e-6), "authority", 500, edges)


def _html(pages: DataFrame) -> DataFrame:
    """The pages as HTML: every line of the content a paragraph, every out-link an anchor."""
    anchors = F.array_join(F.transform(F.coalesce("outlinks", F.array().cast("array<string>")), lambda u: F.concat(F.lit('<a class="x" href="'), u, F.lit('">more</a>'))), "\n")
    lang = F.when(F.col("author").isNull(), "").otherwise(' lang="en-GB"')
    page = F.concat(F.lit("<html"), lang, F.lit("><head><title>"), F.col("url"), F.lit("</title></head><body><p>"), F.replace(F.replace("content", F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("</p>\n<p class='t'>")), F.lit("</p>"), anchors, F.lit("</body></html>"))
    return pages.where("content IS NOT NULL AND url IS NOT NULL").select("page_id", "url", page.alias("html"))


def html_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html(_pages(spark, sf_dir)).select("page_id", H.paragraphs(F.col("html")).alias("text"))


def html_title_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("html")
    return _html(_pages(spark, sf_dir)).select("page_id", H.title(page).alias("title"), H.language(page).alias("lang"), H.admitted(H.language(page), F.col("url")).alias("admitted"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.harvest(_html(_pages(spark, sf_dir)).select("url", "html")).select("src", F.col("place").cast("long").alias("place"), "dst").distinct()


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select(F.explode("inlinks").alias("url")).where("url IS NOT NULL").distinct()


def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", U.canonicalize(F.lit("http://base.example/a/b"), F.col("url")).alias("canonical"))


def url_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", U.domain(F.col("url")).alias("domain"), U.host(F.col("url")).alias("host"))


def url_index_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urls(spark, sf_dir).select("url", U.index_key("url").alias("key"))


def host_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of each host and author with the most in-links."""
    hits = _pages(spark, sf_dir).where("author IS NOT NULL").select(F.col("author").alias("query_id"), F.col("page_id").alias("doc_id"), "host", F.coalesce(F.size("inlinks"), F.lit(0)).alias("score"))
    return collapse_hosts(hits.withColumn("score", F.greatest("score", F.lit(0)))).select("query_id", "host", "doc_id", "score")


def frontier_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pages(spark, sf_dir).where("url IS NOT NULL")
    return rows.select("page_id", F.round(crawl.frontier_score(F.col("url"), F.greatest(F.coalesce(F.size("inlinks"), F.lit(0)), F.lit(0))), 9).alias("score"))


def next_wave(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _nodes(spark, sf_dir).withColumnRenamed("node", "url")
    return crawl.next_wave(_edges(spark, sf_dir), known, 1).select("url", "wave", "inlinks", F.round("score", 9).alias("score"))


def author_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first crawl of each URL, updated with its last one."""
    pages = _pages(spark, sf_dir).where("url IS NOT NULL")
    ends = {name: pages.withColumn("n", F.row_number().over(W.partitionBy("url").orderBy(order))).where("n = 1") for name, order in (("old", F.asc("page_id")), ("new", F.desc("page_id")))}
    rows = crawl.upsert_pages(ends["old"], ends["new"])
    joined = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
    return rows.select("url", "author", "content", joined("inlinks"), joined("outlinks"))


QUERIES = {f.__name__: f for f in (link_edges, link_degrees, pagerank_fixed, pagerank_converged, pagerank_top, hits_fixed, hits_converged, hits_topic, hits_base_expand, html_paragraphs, html_title_lang, page_links, url_canonical, url_domain, url_index_key, host_collapse, frontier_score, next_wave, author_upsert)}

_EDGES = "edges AS (SELECT DISTINCT url AS src, l AS dst FROM (SELECT url, unnest(outlinks) AS l FROM hurricane_index WHERE url IS NOT NULL) WHERE l IS NOT NULL)"
_NODES = "nodes AS (SELECT DISTINCT url AS node FROM hurricane_index WHERE url IS NOT NULL)"
_DEGREES = "degrees AS (SELECT node, sum(i)::BIGINT AS inlinks, sum(o)::BIGINT AS outlinks FROM (SELECT dst AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT src, 0, 1 FROM edges) GROUP BY node)"


def _pagerank(rounds: int) -> str:
    steps = [f"{_EDGES}, {_NODES}, n AS (SELECT count(*)::DOUBLE AS n FROM nodes), outs AS (SELECT src, count(*) AS o FROM edges GROUP BY src)", "r0 AS MATERIALIZED (SELECT node, 1 / n AS score FROM nodes, n)"]
    for k in range(1, rounds + 1):
        steps.append(f"""g{k} AS (SELECT dst AS node, sum(score / o) AS given FROM edges JOIN outs USING (src) JOIN r{k - 1} ON r{k - 1}.node = edges.src GROUP BY dst),
  s{k} AS (SELECT coalesce(sum(score), 0) AS lost FROM r{k - 1} WHERE node NOT IN (SELECT src FROM outs)),
  r{k} AS MATERIALIZED (SELECT nodes.node, (1 - {D}::DOUBLE) / n + {D} * lost / n + {D} * coalesce(given, 0) AS score FROM nodes LEFT JOIN g{k} USING (node), n, s{k})""")
    return ",\n  ".join(steps)


def _hits(rounds: int) -> str:
    steps = [f"{_EDGES}, {_NODES}, e AS (SELECT src, dst FROM edges WHERE src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes))", "h0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE AS authority, 1.0::DOUBLE AS hub FROM nodes)"]
    for k in range(1, rounds + 1):
        steps.append(f"""u{k} AS (SELECT dst AS node, sum(hub) AS a FROM e JOIN h{k - 1} ON node = src GROUP BY dst), d{k} AS (SELECT src AS node, sum(authority) AS h FROM e JOIN h{k - 1} ON node = dst GROUP BY src),
  w{k} AS (SELECT node, CASE WHEN coalesce(a, 0) = 0 THEN 1 ELSE a END AS a, CASE WHEN coalesce(h, 0) = 0 THEN 1 ELSE h END AS h FROM nodes LEFT JOIN u{k} USING (node) LEFT JOIN d{k} USING (node)),
  h{k} AS MATERIALIZED (SELECT node, a / sqrt((SELECT sum(a * a) FROM w{k})) AS authority, h / sqrt((SELECT sum(h * h) FROM w{k})) AS hub FROM w{k})""")
    return ",\n  ".join(steps)


def _pagerank_converged(most: int) -> str:
    """The scores of the round in which the perplexity has changed by less than 1 for the fourth time."""
    every = " UNION ALL ".join(f"SELECT {k} AS round_, node, score FROM r{k}" for k in range(most + 1))
    return f"""{_pagerank(most)}, every AS ({every}),
  p AS (SELECT round_, pow(2, sum(-score * log2(score))) AS p FROM every WHERE score > 0 GROUP BY round_),
  calm AS (SELECT round_, sum((abs(p - before) < 1)::INT) OVER (ORDER BY round_) AS calm FROM (SELECT round_, p, lag(p) OVER (ORDER BY round_) AS before FROM p) WHERE before IS NOT NULL)"""


def _hits_converged(most: int) -> str:
    """The scores of the first round that moves no score by more than the tolerance, or of the last one."""
    every = " UNION ALL ".join(f"SELECT {k} AS round_, node, authority, hub FROM h{k}" for k in range(most + 1))
    return f"""{_hits(most)}, every AS MATERIALIZED ({every}),
  moved AS (SELECT b.round_, max(greatest(abs(a.authority - b.authority), abs(a.hub - b.hub))) AS moved FROM every a JOIN every b ON b.node = a.node AND b.round_ = a.round_ + 1 GROUP BY b.round_)"""


_HTML = """html AS (SELECT page_id, url, '<html' || CASE WHEN author IS NULL THEN '' ELSE ' lang="en-GB"' END || '><head><title>' || url || '</title></head><body><p>'
  || replace(replace(content, chr(13), ''), chr(10), '</p>' || chr(10) || '<p class=''t''>') || '</p>'
  || array_to_string(list_transform(coalesce(outlinks, []), lambda u: '<a class="x" href="' || u || '">more</a>'), chr(10)) || '</body></html>' AS html
  FROM hurricane_index WHERE content IS NOT NULL AND url IS NOT NULL)"""
_P = r"""list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>', 1),
  lambda p: regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(p, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10), ''), ' {2,}', ' ', 'g')), lambda p: p <> '')"""


def _canonical(url: str) -> str:
    plain = rf"regexp_replace(regexp_replace(regexp_replace({url}, '\\+', '/', 'g'), '[\n\t ]', '', 'g'), '#.*$', '')"
    bad = " OR ".join([rf"NOT regexp_matches(p, '[\p{{L}}\p{{N}}_]')", *(f"contains(lower(p), '{w}')" for w in U.UNWANTED)])
    port = "CASE WHEN starts_with(lower(p), 'https') THEN replace(p, ':443', '') WHEN starts_with(lower(p), 'http') THEN replace(p, ':80', '') ELSE p END"
    slashes = rf"regexp_replace(regexp_replace({port}, '(?i)https', 'http', 'g'), '([\p{{L}}\p{{N}}_])//+', '\1/', 'g')"
    return rf"""(SELECT CASE WHEN {bad} OR lead = '' THEN '' ELSE lower(lead) || substr(s, length(lead) + 1) END FROM
      (SELECT p, s, regexp_extract(s, '^([^/]*//[^/]*)', 1) AS lead FROM (SELECT p, {slashes} AS s FROM (SELECT {plain} AS p))))"""


_HITS_OF = " + ".join(f"contains(lower(url), '{w.lower()}')::INT" for w in crawl.KEYWORDS)
_BLOCKED = " AND ".join(f"NOT contains(lower(url), '{w}')" for w in H.BLOCKED)
_URLS = "urls AS (SELECT DISTINCT u AS url FROM (SELECT unnest(inlinks) AS u FROM hurricane_index) WHERE u IS NOT NULL)"

ORACLE = {
    "link_edges": "SELECT DISTINCT l AS src, url AS dst FROM (SELECT url, unnest(inlinks) AS l FROM hurricane_index WHERE url IS NOT NULL) WHERE l IS NOT NULL",
    "link_degrees": f"WITH {_EDGES}, {_DEGREES} SELECT * FROM degrees",
    "pagerank_fixed": f"WITH {_pagerank(4)} SELECT node, round(score, 10) AS score FROM r4",
    "pagerank_converged": f"WITH {_pagerank_converged(40)} SELECT node, round(score, 10) AS score FROM every WHERE round_ = (SELECT min(round_) FROM calm WHERE calm >= 4)",
    "hits_converged": f"WITH {_hits_converged(100)} SELECT node, round(authority, 9) AS authority, round(hub, 9) AS hub FROM every WHERE round_ = coalesce((SELECT min(round_) FROM moved WHERE moved <= 1e-7), 100)",
    "pagerank_top": f"""WITH {_pagerank(4)}, {_DEGREES}, top AS (SELECT node, round(score, 10) AS score FROM r4 ORDER BY round(score, 10) DESC, node LIMIT 500)
      SELECT node, score, coalesce(inlinks, 0) AS inlinks, coalesce(outlinks, 0) AS outlinks FROM top LEFT JOIN degrees USING (node)""",
    "hits_fixed": f"WITH {_hits(3)} SELECT node, round(authority, 9) AS authority, round(hub, 9) AS hub FROM h3",
    "hits_base_expand": f"""WITH {_EDGES}, b0 AS (SELECT DISTINCT url AS node FROM hurricane_index WHERE url IS NOT NULL AND len(inlinks) >= 20),
      b1 AS MATERIALIZED (SELECT node FROM b0 UNION SELECT dst FROM edges JOIN b0 ON src = node UNION SELECT src FROM edges JOIN b0 ON dst = node)
      SELECT node FROM b1 UNION SELECT dst FROM edges JOIN b1 ON src = node UNION SELECT src FROM edges JOIN b1 ON dst = node""",
    "html_paragraphs": f"WITH {_HTML} SELECT page_id, array_to_string(list_transform({_P}, lambda p: p || ' '), '') AS text FROM html",
    "html_title_lang": f"WITH {_HTML}, t AS (SELECT page_id, url, url AS title, CASE WHEN contains(html, ' lang=\"en-GB\"') THEN 'en-GB' ELSE 'en' END AS lang FROM html) SELECT page_id, title, lang, contains(lower(lang), 'en') AND {_BLOCKED} AS admitted FROM t",
    "page_links": f"SELECT DISTINCT src, place, dst FROM (SELECT url AS src, place, {_canonical('l')} AS dst FROM (SELECT url, unnest(outlinks) AS l, unnest(range(len(outlinks))) AS place FROM hurricane_index WHERE url IS NOT NULL AND content IS NOT NULL)) WHERE dst <> ''",
    "url_canonical": f"WITH {_URLS} SELECT url, {_canonical('url')} AS canonical FROM urls",
    "url_index_key": r"""WITH u AS (SELECT DISTINCT u AS url, trim(u) AS t FROM (SELECT unnest(inlinks) AS u FROM hurricane_index) WHERE u IS NOT NULL),
      p AS (SELECT url, regexp_extract(t, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#:]*)(?::[0-9]*)?([^?#]*)([?][^#]*)?', ['scheme', 'host', 'path', 'query']) AS x FROM u),
      s AS (SELECT url, x, list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(regexp_replace(x.path, '/+', '/', 'g'), '/'), lambda y: [y])),
            lambda stack, y: CASE WHEN y[1] = '..' THEN CASE WHEN len(stack) > 1 THEN stack[1:len(stack) - 1] ELSE stack END WHEN y[1] = '.' THEN stack ELSE list_append(stack, y[1]) END) AS stack FROM p)
      SELECT url, lower(x.scheme) || '://' || lower(x.host) || array_to_string(stack, '/') || x.query AS key FROM s""",
    "url_domain": rf"WITH {_URLS} SELECT url, regexp_extract(url, '//([^/]*[\p{{L}}\p{{N}}_])', 1) AS domain, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS host FROM urls",
    "host_collapse": "SELECT author AS query_id, host, page_id AS doc_id, coalesce(len(inlinks), 0)::INT AS score FROM hurricane_index WHERE author IS NOT NULL QUALIFY row_number() OVER (PARTITION BY author, host ORDER BY coalesce(len(inlinks), 0) DESC, page_id) = 1",
    "frontier_score": f"SELECT page_id, round(exp(-({_HITS_OF})) + exp(-coalesce(len(inlinks), 0)), 9) AS score FROM hurricane_index WHERE url IS NOT NULL",
    "next_wave": f"""WITH {_EDGES}, c AS (SELECT dst AS url, count(DISTINCT src) AS inlinks FROM edges GROUP BY dst), f AS (SELECT url, inlinks, exp(-({_HITS_OF})) + exp(-inlinks) AS score FROM c WHERE url NOT IN (SELECT url FROM hurricane_index WHERE url IS NOT NULL))
      SELECT url, 1 AS wave, inlinks, round(score, 9) AS score FROM f ORDER BY round(f.score, 12), url LIMIT 40000""",
    "author_upsert": """WITH o AS (SELECT * FROM hurricane_index WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1),
      n AS (SELECT * FROM hurricane_index WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id DESC) = 1)
      SELECT url, CASE WHEN o.author IS NULL THEN n.author WHEN n.author IS NULL OR n.author = o.author THEN o.author ELSE o.author || ', ' || n.author END AS author, coalesce(n.content, o.content) AS content,
      array_to_string(list_sort(list_distinct(list_concat(coalesce(o.inlinks, []), coalesce(n.inlinks, [])))), ' ') AS inlinks, array_to_string(list_sort(list_distinct(list_concat(coalesce(o.outlinks, []), coalesce(n.outlinks, [])))), ' ') AS outlinks
      FROM o JOIN n USING (url)""",
}
