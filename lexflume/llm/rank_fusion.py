"""One ranking from several differently-scaled scores, by a rank-walk Markov chain.

A walker on an item picks one of the scores at random and moves to an item drawn uniformly from those that this score
ranks at least as high (the item itself and ties included). With probability 1 - damping it starts again anywhere.
Items are ordered by the share of time the walker spends on them. Only orders enter, so every score has the same say
whatever its range.

One step is, for each score, a sum over all items ranked no higher: prefix sums in sorted order. Groups of up to
`whole` items are worked on side by side in numpy; larger groups (found by exact counts) are range-sorted into chunks
over the cluster, and a step is then a window sum inside the chunks plus the totals of the chunks below.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.session import materialize, release

DAMPING = 0.5
#: A walk has settled when no share moves by more than this part of its group's mean share.
TOLERANCE = 1e-12
MOST_STEPS = 200
RELATIVE_DIGITS = 9
WHOLE = 400_000


def usable(score: str) -> F.Column:
    return F.col(score).isNotNull() & ~F.isnan(score)


def fused_input(runs: list[DataFrame], group_col: str, item_col: str, score_col: str) -> DataFrame:
    """(grp, item, s0, s1, ...) of the items that have a score in every run; the highest counts where a run repeats an item."""
    one = reduce(
        DataFrame.unionByName,
        [r.where(usable(score_col)).select(F.col(group_col).alias("grp"), F.col(item_col).alias("item"), F.lit(k).cast("tinyint").alias("run"), F.col(score_col).cast("double").alias("score")) for k, r in enumerate(runs)],
    ).where("grp IS NOT NULL AND item IS NOT NULL")
    names = [f"s{k}" for k in range(len(runs))]
    wide = one.groupBy("grp", "item").agg(*(F.max(F.when(F.col("run") == k, F.col("score"))).alias(n) for k, n in enumerate(names)))
    return wide.dropna(subset=names)


def stationary(scores: np.ndarray, starts: np.ndarray, damping: float = DAMPING, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS) -> np.ndarray:
    """Stationary shares of the items of several groups at once. scores: items x runs; starts: first item of each group, and the end.
    Each step shrinks what is off by the damping at least; a walk not settled after `most_steps` is an error."""
    n, runs = scores.shape
    sizes = np.diff(starts)
    group = np.repeat(np.arange(len(sizes)), sizes)
    first, last = starts[:-1][group], starts[1:][group]
    plans = []
    for k in range(runs):
        order = np.lexsort((-scores[:, k], group))
        value, at = scores[order, k], group[order]
        begins = np.ones(n, bool)
        begins[1:] = (value[1:] != value[:-1]) | (at[1:] != at[:-1])
        tie = np.cumsum(begins) - 1
        tie_start = np.flatnonzero(begins)
        tie_end = np.append(tie_start[1:], n)
        plans.append((order, (tie_end[tie] - first).astype(float), tie_start[tie]))
    share = 1.0 / sizes[group]
    rest = (1 - damping) * share
    for _ in range(most_steps):
        new = np.zeros(n)
        for order, reached, tie_start in plans:
            above = np.zeros(n + 1)
            above[:-1] = np.cumsum((share[order] / reached)[::-1])[::-1]
            new[order] += above[tie_start] - above[last]
        new = rest + damping / runs * new
        change = (np.abs(new - share) * sizes[group]).max() if n else 0.0
        share = new
        if change < tolerance:
            return share
    raise RuntimeError(f"the walk has not settled in {most_steps} steps")


def _walk_batches(runs: int, top: int | None, damping: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            starts = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.slice(int(starts[0]), int(starts[-1] - starts[0]))
            starts = starts - starts[0]
            items = flat.field(0)
            scores = np.column_stack([flat.field(1 + k).to_numpy(zero_copy_only=False) for k in range(runs)])
            share = stationary(scores, starts, damping)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            names = np.array(items.to_pylist(), object)
            # equal shares may differ in the last bits, so ties are decided on rounded values, relative to the group's mean share
            order = np.lexsort((names.astype(str), -np.round(share * np.diff(starts)[group], RELATIVE_DIGITS), group))
            rank = np.arange(len(order)) - starts[group[order]] + 1
            if top:
                order, rank = order[rank <= top], rank[rank <= top]
            take = pa.array(order)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(group[order])), items.take(take), pa.array(share[order]), pa.array(rank.astype(np.int32))], ["grp", "item", "share", "rank"])

    return run


def _hot_walk(items: DataFrame, runs: int, damping: float, tolerance: float, most_steps: int) -> DataFrame:
    """(grp, item, share, by) of groups too large for a task: the same walk in relational steps. `by` is the share for ordering."""
    spark = items.sparkSession
    key = ["grp", "run", "chunk"]
    long = items.select("grp", "item", F.posexplode(F.array(*(f"s{k}" for k in range(runs)))).alias("run", "score"))
    parts = max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # equal scores stay together in a range partition, so a tie never crosses chunks
    long = materialize(long.repartitionByRange(parts, "grp", "run", F.desc("score")).withColumn("chunk", F.spark_partition_id()))
    inside = W.partitionBy(*key).orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, 0)
    earlier = W.partitionBy("grp", "run").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    sizes = long.groupBy(*key).count().withColumn("before", F.coalesce(F.sum("count").over(earlier), F.lit(0))).drop("count")
    long = materialize(long.withColumn("own", F.count("*").over(inside)).join(sizes, key).select(*key, "item", "score", (F.col("own") + F.col("before")).alias("reached")))
    total = items.groupBy("grp").count()
    state = materialize(items.select("grp", "item").join(total, "grp").select("grp", "item", "count", (1 / F.col("count")).alias("share")))
    upto = W.partitionBy(*key).orderBy("score").rangeBetween(W.unboundedPreceding, 0)
    later = W.partitionBy("grp", "run").orderBy("chunk").rowsBetween(1, W.unboundedFollowing)
    for _ in range(most_steps):
        sent = long.join(state.select("grp", "item", "count", "share"), ["grp", "item"]).withColumn("sent", F.col("share") / F.col("reached"))
        below = sent.groupBy(*key).agg(F.sum("sent").alias("own")).withColumn("below", F.coalesce(F.sum("own").over(later), F.lit(0.0))).drop("own")
        got = sent.withColumn("got", F.sum("sent").over(upto)).join(below, key).groupBy("grp", "item").agg(F.sum(F.col("got") + F.col("below")).alias("got"), F.first("share").alias("old"), F.first("count").alias("count"))
        new = materialize(got.select("grp", "item", "count", "old", ((1 - damping) / F.col("count") + damping / runs * F.col("got")).alias("share")))
        change = new.agg(F.max(F.abs(F.col("share") - F.col("old")) * F.col("count"))).first()[0] or 0.0
        release(state)
        state = new
        if change < tolerance:
            release(long)
            return state.select("grp", "item", "share", F.round(F.col("share") * F.col("count"), RELATIVE_DIGITS).alias("by"))
    raise RuntimeError(f"the walk has not settled in {most_steps} steps")


def fuse_rankings(
    runs: list[DataFrame], group_col: str, item_col: str, score_col: str = "score", top: int | None = None, least_items: int = 1,
    whole: int = WHOLE, damping: float = DAMPING, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS,
) -> DataFrame:
    """(grp, item, share, rank): one ranking per group from the scores of several runs; a higher score is better in each.

    Only items with a score in every run compete, and only groups with at least `least_items` of them come out. Null
    and NaN scores are none; null groups or items are ignored; an item repeated in a run counts once with its highest
    score. Equal shares (to 9 digits of the group's mean share) are ordered by item. Empty runs give an empty result. Other columns aren't read.
    `top` keeps the first so many of each group.
    """
    items = materialize(fused_input(runs, group_col, item_col, score_col))
    names = [f"s{k}" for k in range(len(runs))]
    counts = items.groupBy("grp").count().where(F.col("count") >= least_items)
    hot = materialize(counts.where(F.col("count") > whole).select("grp"))
    any_hot = bool(hot.take(1))
    cold = items.join(hot, "grp", "left_anti") if any_hot else items
    lists = cold.groupBy("grp").agg(F.collect_list(F.struct("item", *names)).alias("items")).where(F.size("items") >= least_items)
    kind = dict(items.dtypes)
    schema = f"grp {kind['grp']}, item {kind['item']}, share double, rank int"
    ranked = lists.mapInArrow(_walk_batches(len(runs), top, damping), schema)
    if any_hot:
        shares = _hot_walk(items.join(hot, "grp", "left_semi"), len(runs), damping, tolerance, most_steps)
        if top is None:
            from lexflume.llm.top_items import global_ranks

            ranked_hot = global_ranks(shares, "grp", "item", "by").select("grp", "item", "share", "rank")
        else:
            from lexflume.llm.top_items import top_per_group

            best = top_per_group(shares, "grp", "item", "by", top, keep=["share"])
            ranked_hot = best.select("grp", "item", "share", "rank")
        ranked = ranked.unionByName(ranked_hot)
    return ranked
