"""Link analysis on edge DataFrames (src, dst): PageRank and HITS by joins, with lineage cut every round.

The edges are shuffled once, into buckets by the node they are joined on; the scores are written in the same buckets each
round, so a round moves only partial sums. The scores of a finished round are removed once the next ones are written.
"""

from __future__ import annotations

from math import isfinite

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.session import materialize, release

EDGES_PER_BUCKET = 4_000_000
LEAST_BUCKETS = 8


def _buckets(edges: int) -> int:
    return max(LEAST_BUCKETS, -(-edges // EDGES_PER_BUCKET))


def edges_from_lists(rows: DataFrame, node: str, links: str, incoming: bool = False) -> DataFrame:
    """Distinct (src, dst) from link lists; with `incoming` the lists name the sources. Null and empty lists give none."""
    pairs = rows.where(F.col(node).isNotNull()).select(F.col(node).alias("a"), F.explode(links).alias("b")).where("b IS NOT NULL")
    return (pairs.select(F.col("b").alias("src"), F.col("a").alias("dst")) if incoming else pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, inlinks, outlinks) of all nodes of the edges, in one pass."""
    both = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return both.groupBy("x.node").agg(F.sum("x.i").alias("inlinks"), F.sum("x.o").alias("outlinks"))


def perplexity(ranks: DataFrame, column: str = "score") -> float:
    """2 to the entropy of the scores (in log space; infinite if out of range)."""
    bits = ranks.where(F.col(column) > 0).agg(F.sum(-F.col(column) * F.log2(column))).first()[0] or 0.0
    return 2.0**bits if bits < 1023 else float("inf")


def pagerank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, iterations: int | None = None, quiet: int = 4, threshold: float = 1.0, most: int = 200) -> DataFrame:
    """(node, score) of `nodes` (column node).

    Each round: (1 - d) / n + d sinks / n + d sum of score(q) / out(q) over the sources q of a node. out(q) counts all
    links of q, also those to pages that aren't nodes (their mass leaks); sources that aren't nodes are left out; nodes
    without links are sinks. Stops after `iterations` rounds, or when the perplexity has changed by less than
    `threshold` in `quiet` rounds (not necessarily in a row). Nulls are ignored; no nodes give an empty result.
    """
    nodes = materialize(nodes.select("node").where("node IS NOT NULL").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("score", F.lit(0.0))
    links = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    nodes = nodes.join(out.select(F.col("src").alias("node"), F.lit(False).alias("sink")), "node", "left").withColumn("sink", F.coalesce("sink", F.lit(True)))
    inside = materialize(links.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").join(out, "src"))
    buckets = _buckets(max(n, inside.count()))
    links = materialize(inside, "src", buckets)
    release(inside)
    nodes = materialize(nodes, "node", buckets)
    ranks = materialize(nodes.withColumn("score", F.lit(1.0 / n)), "node", buckets)
    calm, before = 0, float(n)
    for _ in range(iterations if iterations is not None else most):
        lost = ranks.where("sink").agg(F.sum("score")).first()[0] or 0.0
        given = links.join(ranks.select(F.col("node").alias("src"), "score"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("score") / F.col("out")).alias("given"))
        base = (1 - damping) / n + damping * lost / n
        new = materialize(nodes.join(given, "node", "left").select("node", "sink", (base + damping * F.coalesce("given", F.lit(0.0))).alias("score")), "node", buckets)
        release(ranks)
        ranks = new
        if iterations is None:
            now = perplexity(ranks)
            calm += abs(now - before) < threshold
            before = now
            if calm >= quiet:
                break
    release(links, nodes)
    return ranks.select("node", "score")


def expand_base(edges: DataFrame, root: DataFrame, least: int = 10_000, most_inlinks: int = 200, seed: int = 0, most_rounds: int = 20) -> DataFrame:
    """(node): the base set of HITS. Round by round the links of the newest nodes are added, and the pages that link to
    them, at most `most_inlinks` for each node (drawn by a seeded hash), until there are `least` nodes or nothing is new."""
    base = materialize(root.select("node").where("node IS NOT NULL").distinct())
    newest = base
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL").select("src", "dst").distinct()
    for _ in range(most_rounds):
        if base.count() >= least:
            break
        ahead = links.join(newest.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
        behind = links.join(newest.withColumnRenamed("node", "dst"), "dst", "left_semi")
        drawn = W.partitionBy("dst").orderBy(F.xxhash64("src", F.lit(seed)), "src")
        behind = behind.withColumn("place", F.row_number().over(drawn)).where(F.col("place") <= most_inlinks).select(F.col("src").alias("node"))
        newest = materialize(ahead.unionByName(behind).distinct().join(base, "node", "left_anti"))
        if not newest.take(1):
            break
        base = materialize(base.unionByName(newest))
    return base


def hits(edges: DataFrame, base: DataFrame, iterations: int | None = None, tolerance: float = 1e-9, most: int = 100, by_perplexity: bool = False) -> DataFrame:
    """(node, authority, hub) over the base set. Both updates read the previous scores; a score of 0 becomes 1 before the
    scores are divided by their norm. Links count once each way they stand in `edges` (repeated rows count repeatedly).

    Stops after `iterations` rounds, when no score moves by more than `tolerance`, or (by_perplexity) when the perplexities
    of both change by less than 1.
    """
    nodes = materialize(base.select("node").where("node IS NOT NULL").distinct())
    inside = edges.select("src", "dst").join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").join(nodes.withColumnRenamed("node", "dst"), "dst", "left_semi")
    counted = materialize(inside.groupBy("src", "dst").agg(F.count("*").alias("times")))
    buckets = _buckets(max(nodes.count(), counted.count()))
    links, back = materialize(counted, "src", buckets), materialize(counted, "dst", buckets)
    release(counted)
    scores = materialize(nodes.withColumns({"authority": F.lit(1.0), "hub": F.lit(1.0)}), "node", buckets)
    before = None
    for _ in range(iterations if iterations is not None else most):
        up = links.join(scores.select(F.col("node").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("hub") * F.col("times")).alias("a"))
        down = back.join(scores.select(F.col("node").alias("dst"), "authority"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("authority") * F.col("times")).alias("h"))
        filled = lambda c: F.when(F.coalesce(c, F.lit(0.0)) == 0, 1.0).otherwise(F.col(c))
        raw = materialize(scores.select("node", F.col("authority").alias("old_a"), F.col("hub").alias("old_h")).join(up, "node", "left").join(down, "node", "left").select("node", "old_a", "old_h", filled("a").alias("a"), filled("h").alias("h")), "node", buckets)
        norm = raw.agg(F.sqrt(F.sum(F.col("a") ** 2)), F.sqrt(F.sum(F.col("h") ** 2))).first()
        if norm[0] is None:
            return scores
        release(scores)
        # divided when they are read, so a round writes one table
        scores = raw.select("node", (F.col("a") / norm[0]).alias("authority"), (F.col("h") / norm[1]).alias("hub"), "old_a", "old_h")
        scores._written_at = raw._written_at
        if iterations is None:
            if by_perplexity:
                now = perplexity(scores, "authority"), perplexity(scores, "hub")
                done = before is not None and all(isfinite(x) and abs(x - y) < 1 for x, y in zip(now, before))
                before = now
            else:
                done = (scores.agg(F.max(F.greatest(F.abs(F.col("authority") - F.col("old_a")), F.abs(F.col("hub") - F.col("old_h"))))).first()[0] or 0.0) <= tolerance
            if done:
                break
    release(links, back)
    return scores.select("node", "authority", "hub")


def top_scores(scores: DataFrame, column: str, k: int = 500, edges: DataFrame | None = None) -> DataFrame:
    """The `k` nodes of the highest score, ties by node, with their degrees if edges are given."""
    best = scores.select("node", F.col(column).alias("score")).orderBy(F.desc("score"), F.asc("node")).limit(k)
    return best.join(degrees(edges), "node", "left").na.fill(0, ["inlinks", "outlinks"]) if edges is not None else best
