"""Per-key results where a few keys hold most rows, by distributed exact selection.

Values are counted in histograms of mergeable counts: tasks combine their rows by bucket before the shuffle, so a hot key
arrives as a few numbers from each task. The buckets that hold a wanted rank are split again and again, with counts only,
until they hold one value; the values of a key never meet in one place.

Quantiles of a key select ranks among its values. Heavy keys are found by the same selection: all rows are laid out in
the order of a hash of their keys; a key with a share s of the total weight then covers one of the ranks s, 2s, 3s, ... of
the total, so the keys at these ranks are all that can be heavy, and the refined bucket holds their exact total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexflume.session import materialize, maybe_broadcast, release

BUCKETS = 64
FIRST_BITS, ROUND_BITS = 12, 8
RANKS_SENT = 500_000
SALTS = 64


def value_histogram(rows: DataFrame, key: str, value: str, times: str | None = None) -> DataFrame:
    """(key, bucket, rows, total, least, most): values by sign and power of two, as mergeable counts; a row stands for `times` rows."""
    v, n = F.col(value), F.col(times).cast("long") if times else F.lit(1).cast("long")
    bucket = F.when(v == 0, 0).otherwise(F.signum(v) * (F.floor(F.least(F.log2(F.abs(v)), F.lit(2000.0))) + 1100)).cast("int")
    return rows.select(F.col(key).alias("key"), v.alias("value"), bucket.alias("bucket"), n.alias("times")).groupBy("key", "bucket").agg(
        F.sum("times").alias("rows"), (F.sum(F.col("value") * F.col("times")) if times else F.sum("value")).alias("total"), F.min("value").alias("least"), F.max("value").alias("most")
    )


def key_totals(rows: DataFrame, key: str, value: str, heavy_share: float = 0.01) -> DataFrame:
    """(key, rows, total, heavy): per-key row counts and totals of `value`, and whether the key holds at least `heavy_share` of the grand total.

    Rows with a null key or value don't count. Empty input gives an empty result. Other columns aren't read.
    """
    kept = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    histogram = value_histogram(kept, key, value)
    grand = kept.agg(F.sum(value)).scalar()
    totals = histogram.groupBy("key").agg(F.sum("rows").alias("rows"), F.sum("total").alias("total"))
    return totals.withColumn("grand", grand).select("key", "rows", "total", (F.col("total") >= heavy_share * F.col("grand")).alias("heavy"))


def heavy_keys(rows: DataFrame, key: str, weight: str, share: float = 0.01) -> DataFrame:
    """(key, total): the keys that hold at least `share` (above 0) of the sum of all weights, with their exact totals.

    Rows with a null key and weights that are null, NaN or not above 0 don't count. Empty input gives an empty result.
    Other columns aren't read. There are at most 1 / share open buckets a round, of 2 ** ROUND_BITS parts each.
    """
    w = F.col(weight)
    kept = rows.where(F.col(key).isNotNull() & w.isNotNull() & ~F.isnan(w.cast("double")) & (w > 0)).select(F.col(key).alias("key"), w.alias("w"))
    kept = materialize(kept)
    kept = kept.withColumn("at", F.xxhash64("key"))
    total = kept.agg(F.sum("w")).first()[0]
    if not total:
        return kept.select("key", F.col("w").alias("total")).limit(0)
    step = float(share) * float(total)
    prefix = lambda bits: F.shiftrightunsigned(F.col("at").bitwiseXOR(F.lit(-1 << 63)), 64 - bits)
    open_, bits, found = None, FIRST_BITS, None
    while True:
        inside = kept.withColumn("part", prefix(bits))
        if open_ is None:
            inside = inside.withColumns({"outer": F.lit(0).cast("long"), "before": F.lit(0.0)})
        else:
            inside = inside.withColumn("outer", prefix(bits - ROUND_BITS)).join(maybe_broadcast(open_.select(F.col("part").alias("outer"), "before"), RANKS_SENT), "outer")
        counted = inside.groupBy("outer", "part").agg(F.sum("w").cast("double").alias("own"), F.min("at").alias("least"), F.max("at").alias("most"), F.first("before").alias("before"))
        upto = W.partitionBy("outer").orderBy("part").rowsBetween(W.unboundedPreceding, 0)
        ranked = counted.withColumn("end", F.col("before") + F.sum("own").over(upto)).withColumn("begin", F.col("end") - F.col("own"))
        # a wanted rank lies in (begin, end]; sums of doubles may be off by their last digits, so the borders are widened
        slack = F.lit(1e-9) * F.col("end")
        held = materialize(ranked.where((F.col("own") >= step * (1 - 1e-9)) & (F.floor((F.col("end") + slack) / step) > F.floor((F.col("begin") - slack) / step))).select("part", F.col("begin").alias("before"), "least", "most"))
        done = held.where("least = most").select(F.col("least").alias("at"))
        found = done if found is None else found.unionByName(done)
        open_ = held.where("least < most")
        if bits >= 64 or not open_.take(1):
            break
        bits = min(64, bits + ROUND_BITS)
    exact = kept.join(maybe_broadcast(found, RANKS_SENT), "at", "left_semi").groupBy("key").agg(F.sum("w").alias("total"))
    return exact.where(F.col("total").cast("double") >= step)


def key_quantiles(rows: DataFrame, key: str, value: str, probabilities: tuple[float, ...], most_rounds: int = 64) -> DataFrame:
    """(key, p, value): for each key the exact quantiles of its values: the smallest value v so that at least a share p
    of the key's values are <= v (for p = 0 the smallest value).

    Rows with a null key or value, and NaN values, don't count. Empty input gives an empty result.

    First every key's values are counted by power of two; each wanted rank falls into one bucket. Then, round by round,
    the rows inside the wanted buckets alone are counted in BUCKETS equal parts of the bucket (from its least to its
    most value), until a bucket's least and most value are equal. Rows carry no value further than the partial counts:
    equal values of a key are combined first, and where the open ranks are too many to be sent to all tasks, the rows
    meet them by key and salt, so that a hot key is spread over SALTS tasks.
    """
    kind = dict(rows.dtypes)[value]
    kept = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(key).alias("key"), F.col(value).cast("double").alias("value"))
    kept = materialize(kept.groupBy("key", "value").agg(F.count("*").alias("times")))
    ranks = F.explode(F.array(*(F.struct(F.lit(float(p)).alias("p"), F.lit(k).alias("slot")) for k, p in enumerate(probabilities))))
    first = value_histogram(kept, "key", "value", "times").select("key", "bucket", "rows", "least", "most")
    sizes = W.partitionBy("key")
    wanted = first.withColumn("n", F.sum("rows").over(sizes)).withColumn("want", ranks).select("*", "want.p", "want.slot").drop("want")
    open_ = materialize(_narrow(wanted.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n")))).drop("n")))
    done = None
    for _ in range(most_rounds):
        finished = open_.where("least = most").select("key", "p", F.col("least").alias("value"))
        done = finished if done is None else done.unionByName(finished)
        active = open_.where("least < most").withColumnsRenamed({"least": "low", "most": "high"})
        some = active.limit(RANKS_SENT + 1).count()
        if not some:
            break
        if some <= RANKS_SENT:
            inside = kept.join(F.broadcast(active), "key")
        else:
            salted = active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            inside = kept.withColumn("salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"])
        inside = inside.where("value >= low AND value <= high")
        part = F.least(F.lit(BUCKETS - 1), F.floor((F.col("value") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS)).cast("int")
        # an infinite or vanishing width: the least value on its own against the rest
        part = F.when(F.col("value") == F.col("low"), -1).otherwise(F.coalesce(F.when(F.col("high") - F.col("low") < float("inf"), part), F.when(F.col("value") == F.col("high"), BUCKETS).otherwise(F.signum("value").cast("int"))))
        counted = inside.groupBy("key", "slot", part.alias("bucket")).agg(F.sum("times").alias("rows"), F.min("value").alias("least"), F.max("value").alias("most"), F.first("p").alias("p"), F.first("rank").alias("rank"))
        open_ = materialize(_narrow(counted))
    else:
        raise RuntimeError(f"ranks not resolved in {most_rounds} rounds")
    return done.select("key", "p", F.col("value").cast(kind).alias("value"))


def _narrow(counted: DataFrame) -> DataFrame:
    """For each (key, slot) the bucket that holds the rank, with the rank inside it. A key has at most some hundred buckets."""
    order = W.partitionBy("key", "slot").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    upto = counted.withColumn("upto", F.sum("rows").over(order))
    held = upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("rows") < F.col("rank")))
    return held.select("key", "slot", "p", (F.col("rank") - F.col("upto") + F.col("rows")).alias("rank"), "least", "most")


def link_key(url: Column) -> Column:
    """A linking URL as a key: scheme http, host in lower case, no port 80 or 443, no fragment. Others than http(s) URLs only lose the fragment."""
    whole = r"(?i)^https?://([^/?#]*)"
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, whole, 1)), ":(80|443)$", "")
    return F.when(bare.rlike(whole), F.concat(F.lit("http://"), host, F.regexp_replace(bare, whole, ""))).otherwise(bare)


def link_entries(pages: DataFrame, links_col: str = "inlinks") -> DataFrame:
    """(key, entries): the entries of a link array column by canonical URL and partial counts; raw spellings are counted
    first, so only distinct ones are parsed. Null arrays, empty arrays and null entries add nothing."""
    raw = pages.select(F.explode(links_col).alias("url")).where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("entries"))
    return raw.select(link_key(F.col("url")).alias("key"), "entries")
