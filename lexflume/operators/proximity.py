"""Proximity ranking: BM25 plus a bonus for query words that stand close together.

The bonus comes from a walk over the sorted positions of two words. At each step the pair in hand adds to the sum if
its distance is at most the window; then the pointer of the smaller position moves on. Once a list ends, the pair
in hand is taken again and the rest of the other list is compared with the last position of the ended one. What is
visited depends on the walk; `close_pairs` says it for all words of a batch of documents at once, without walking.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexflume.operators.index import SearchIndex
from lexflume.operators.ranking import bm25_index, query_terms, sparse_scores
from lexflume.session import materialize, maybe_broadcast


def visited_close(left: list[int], right: list[int], window: int) -> int:
    """How many visited pairs are at most `window` apart."""
    i = j = close = 0
    while i < len(left) and j < len(right):
        close += abs(left[i] - right[j]) <= window
        if left[i] < right[j]:
            i += 1
        else:
            j += 1
    close += sum(abs(p - right[-1]) <= window for p in left[i:]) if i < len(left) else 0
    return close + (sum(abs(p - left[-1]) <= window for p in right[j:]) if j < len(right) else 0)


@F.pandas_udf(LongType())
def visited_close_pairs(left: pd.Series, right: pd.Series, window: pd.Series) -> pd.Series:
    """`visited_close` of two sorted position lists; null for a null, 0 for an empty list."""
    some = lambda a, b: a is not None and b is not None
    found = [None if not some(a, b) else visited_close(list(a), list(b), int(w)) if len(a) and len(b) else 0 for a, b, w in zip(left, right, window)]
    return pd.Series(found, dtype="Int64")


def accumulate(words: list[list[int]], n: int, window: int = 2) -> list[float]:
    """For each word (its sorted positions in a document) the sum over its close pairs with the other words:
    log2((n - t + 1) / (t + 0.5)) / window^2 each, t the other word's positions in the document.

    Only words with positions within the window of each other are walked; no others can have a close pair.
    """
    out = [0.0] * len(words)
    flat = sorted((p, w) for w, own in enumerate(words) for p in own)
    near = set()
    for i, (p, w) in enumerate(flat):
        for q, v in flat[i + 1 :]:
            if q - p > window:
                break
            if v != w:
                near.add((min(v, w), max(v, w)))
    for v, w in near:
        close = visited_close(words[v], words[w], window)
        for own, other in ((v, len(words[w])), (w, len(words[v]))):
            if n - other + 1 > 0:
                out[own] += close * log2((n - other + 1) / (other + 0.5)) / window**2
    return out


def close_pairs(lists: pa.ListArray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row_of, counts, own, other, times) for list<list<int>>: the row and the number of positions of every word, and for
    every ordered pair of words of a row how many close pairs the walk visits.

    Positions differ, so the walk's pair in hand is always a position and the next one of the other word: each position
    counts once if the other word follows within the window, and the last position of a word once more for every
    position of the other word that follows within the window.
    """
    words = lists.flatten()
    per_row = np.diff(lists.offsets.to_numpy())
    counts = np.diff(words.offsets.to_numpy())
    row_of = np.repeat(np.arange(len(per_row)), per_row)
    position = words.flatten().to_numpy(zero_copy_only=False)
    word = np.repeat(np.arange(len(counts)), counts)
    row = row_of[word]
    last = np.zeros(len(position), bool)
    last[np.cumsum(counts)[counts > 0] - 1] = True
    order = np.lexsort((position, row))
    position, row, word, last = position[order], row[order], word[order], last[order]
    at, to = [], []
    for step in range(1, window + 1):
        close = np.flatnonzero((row[step:] == row[:-step]) & (position[step:] - position[:-step] <= window) & (word[step:] != word[:-step]))
        at.append(close)
        to.append(close + step)
    at, to = np.concatenate(at), np.concatenate(to)
    follows = np.unique(np.stack([at, word[to]]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
    behind = last[at]
    own = np.concatenate([word[follows[0]], word[at[behind]]]).astype(np.int64)
    other = np.concatenate([follows[1], word[to[behind]]]).astype(np.int64)
    size = max(1, len(counts))
    pairs, times = np.unique(np.concatenate([own * size + other, other * size + own]), return_counts=True)
    return row_of, counts, pairs // size, pairs % size, times


def _near_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(1)
            flat = words.flatten()
            positions = pa.ListArray.from_arrays(pa.array(words.offsets.to_numpy() - words.offsets[0].as_py(), pa.int32()), flat.field(1))
            row_of, counts, own, other, times = close_pairs(positions, window)
            terms = flat.field(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row_of[own])), terms.take(pa.array(own)), terms.take(pa.array(other)), pa.array(counts[own].astype(np.int64)), pa.array(counts[other].astype(np.int64)), pa.array(times)],
                ["doc_id", "term", "other", "tf", "other_tf", "times"],
            )

    return run


def proximity_scores(index: SearchIndex, queries: DataFrame, k1: float = 1.5, b: float = 0.4, window: int = 2) -> DataFrame:
    """(query_id, doc_id, score): BM25 (index form) plus, for each distinct query word in the document,
    min(log2((n - tf + 1) / (tf + 0.5)), 1) acc (k1 + 1) / (acc + k1 ((1 - b) + b dl / avgdl)).

    Which words stand close together is found once for each document, among the words of all queries; positions never
    multiply with queries.
    """
    base = sparse_scores(index, queries, bm25_index())
    terms = maybe_broadcast(materialize(query_terms(queries).select("query_id", "term")))
    held = index.postings.join(terms.select("term").distinct(), "term", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("term", "positions")).alias("words"))
    near = held.where(F.size("words") > 1).mapInArrow(_near_batches(window), f"doc_id {dict(held.dtypes)['doc_id']}, term string, other string, tf long, other_tf long, times long")
    asked = near.join(terms, "term").join(terms.withColumnRenamed("term", "other"), ["query_id", "other"], "left_semi")
    rarity = lambda tf: F.when(F.col("n") - F.col(tf) + 1 > 0, F.log2((F.col("n") - F.col(tf) + 1) / (F.col(tf) + 0.5)))
    weighed = index.with_stats(asked).withColumn("amount", F.col("times") * F.coalesce(rarity("other_tf"), F.lit(0.0)) / window**2)
    acc = weighed.groupBy("query_id", "doc_id", "term").agg(F.sum("amount").alias("acc"), F.first("tf").alias("tf")).where("acc <> 0")
    rows = index.with_stats(acc.join(index.doc_stats, "doc_id"))
    own = F.least(F.coalesce(rarity("tf"), F.lit(0.0)), F.lit(1.0)) * F.col("acc") * (k1 + 1) / (F.col("acc") + k1 * ((1 - b) + b * F.col("dl") / F.col("avgdl")))
    extra = rows.groupBy("query_id", "doc_id").agg(F.sum(own).alias("bonus"))
    return base.join(extra, ["query_id", "doc_id"], "left").select("query_id", "doc_id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
