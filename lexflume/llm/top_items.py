"""Top N items within every group, by a hot-cold split.

Exact group counts tell heavy groups from light ones. Light groups go through an ordinary window. The rows of heavy
groups are salted by score range (and, inside a range, by item, against masses of equal scores): every salt gives its
first N, which a last window merges; ranges that can't reach the first N by the exact counts above them are
left out before sorting. Both results are united.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.operators.numbering import numbered
from lexflume.session import materialize, maybe_broadcast

HEAVY = 100_000
RANGES = 256
SALTS = 16


def best_scores(df: DataFrame, group_col: str, item_col: str, score_col: str, keep: list[str] | None = None) -> DataFrame:
    """(grp, item, score, kept columns): repeated items once, with their highest score; null and NaN scores, groups and items are left out."""
    rows = df.where(F.col(score_col).isNotNull() & ~F.isnan(F.col(score_col).cast("double")) & F.col(group_col).isNotNull() & F.col(item_col).isNotNull())
    named = rows.select(F.col(group_col).alias("grp"), F.col(item_col).alias("item"), F.col(score_col).alias("score"), *(F.col(c).alias(f"kept_{c}") for c in keep or []))
    return named.groupBy("grp", "item").agg(F.max("score").alias("score"), *(F.max_by(f"kept_{c}", "score").alias(f"kept_{c}") for c in keep or []))


def _ranges(heavy: DataFrame) -> DataFrame:
    """The rows with `part`, the score range of the group (0 is the highest)."""
    bounds = heavy.groupBy("grp").agg(F.min("score").alias("least"), F.max("score").alias("most"))
    width = (F.col("most") - F.col("least")).cast("double")
    part = F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("most") - F.col("score")).cast("double") / width * RANGES))).otherwise(0)
    # infinite scores make the width infinite: they share the first or the last range
    part = F.when(width == float("inf"), F.when(F.col("score") == F.col("most"), 0).otherwise(F.when(F.col("score") == F.col("least"), RANGES - 1).otherwise(1))).otherwise(part)
    return heavy.join(bounds, "grp").withColumn("part", part.cast("int")).drop("least", "most")


def top_per_group(df: DataFrame, group_col: str, item_col: str, score_col: str, n: int, heavy: int = HEAVY, keep: list[str] | None = None) -> DataFrame:
    """(grp, item, score, rank, kept columns): the `n` items of the highest score of each group, ties by item ascending.

    Null and NaN scores are none; a null group or item is ignored; an item repeated in a group counts once with its
    highest score; groups with fewer items give all. Empty input gives an empty result. `keep` names further columns
    to carry along (from the row with the highest score); others aren't read, so names can't clash.
    """
    rows = materialize(best_scores(df, group_col, item_col, score_col, keep))
    hot = materialize(rows.groupBy("grp").agg(F.count("*").alias("members")).where(F.col("members") > heavy).select("grp"))
    order = [F.desc("score"), F.asc("item")]
    ordinary = lambda part: part.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(*order))).where(F.col("rank") <= n)
    kept = {f"kept_{c}": c for c in keep or []}
    if not hot.take(1):
        return ordinary(rows).withColumnsRenamed(kept)
    # more than `heavy` of the rows each, so there are fewer of them than rows / heavy
    hot = maybe_broadcast(hot)
    light = ordinary(rows.join(hot, "grp", "left_anti"))
    parted = _ranges(rows.join(hot, "grp", "left_semi"))
    above = W.partitionBy("grp").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    needed = parted.groupBy("grp", "part").count().withColumn("above", F.coalesce(F.sum("count").over(above), F.lit(0))).where(F.col("above") < n).select("grp", "part")
    salted = parted.join(needed, ["grp", "part"], "left_semi").withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(W.partitionBy("grp", "part", "salt").orderBy(*order))).where(F.col("rank") <= n).drop("part", "salt", "rank")
    return light.unionByName(ordinary(first)).withColumnsRenamed(kept)


def global_ranks(df: DataFrame, group_col: str, item_col: str, score_col: str) -> DataFrame:
    """All rows with `rank` in their group (score descending, item ascending), for groups of any size: range-sorted
    partitions are numbered on their own and shifted by the counts of those before."""
    order = [F.desc(score_col), F.asc(item_col)]
    laid = materialize(numbered(df, "_n", group_col, *order))
    starts = maybe_broadcast(materialize(laid.groupBy(group_col).agg(F.min("_n").alias("_start"))))
    return laid.join(starts, group_col).withColumn("rank", (F.col("_n") - F.col("_start") + 1).cast("int")).drop("_n", "_start")
