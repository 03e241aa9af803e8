"""Heavy keys and quantiles by distributed selection against brute force."""

import random
from collections import Counter, defaultdict
from math import ceil

import pytest

from lexflume.operators import skew


@pytest.mark.parametrize("share", [0.01, 0.05, 0.4])
def test_heavy_keys_equal_brute_force(spark, share):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.35 else f"k{int(rng.paretovariate(0.7))}", rng.choice([1, 1, 2, 7, 0, None])) for _ in range(6000)]
    rows += [(None, 900), ("gone", None), ("negative", -5), ("edge", 0)]
    df = spark.createDataFrame(rows, "k string, w long").selectExpr("*", "1 AS key", "2 AS at", "3 AS part")
    sums = Counter()
    for k, w in rows:
        if k is not None and (w or 0) > 0:
            sums[k] += w
    wanted = {(k, n) for k, n in sums.items() if n >= share * sum(sums.values())}
    assert {tuple(r) for r in skew.heavy_keys(df, "k", "w", share).collect()} == wanted
    assert skew.heavy_keys(df.limit(0), "k", "w").count() == 0


def test_a_key_at_the_border_is_heavy(spark):
    df = spark.createDataFrame([(k, 1.0) for k in range(100)] + [(k, float("nan")) for k in range(100)], "k int, w double")
    assert skew.heavy_keys(df, "k", "w", 0.01).count() == 100
    assert skew.heavy_keys(df, "k", "w", 0.0101).count() == 0


@pytest.mark.parametrize("sent", [0, 500_000])
def test_quantiles_of_hot_keys_with_and_without_sending_the_ranks(spark, monkeypatch, sent):
    monkeypatch.setattr(skew, "RANKS_SENT", sent)
    rng = random.Random(6)
    rows = [("hot", rng.randint(-500, 90_000)) for _ in range(3000)] + [(f"k{rng.randint(0, 40)}", rng.randint(0, 30)) for _ in range(600)] + [("one", 5)] * 9
    values = defaultdict(list)
    for k, v in rows:
        values[k].append(v)
    wanted = {(k, p, sorted(v)[max(1, ceil(p * len(v))) - 1]) for k, v in values.items() for p in (0.1, 0.5, 0.99)}
    got = skew.key_quantiles(spark.createDataFrame(rows, "k string, v long"), "k", "v", (0.1, 0.5, 0.99))
    assert {tuple(r) for r in got.collect()} == wanted
