"""Evaluation texts inside training texts, by suffix arrays over shards of the training texts.

A shard is a run of documents of bounded size. Its words become numbers; only stretches of words that occur in test
items, long enough for a match, need to be indexed (no match can leave them). Their suffixes are sorted by prefix
doubling up to the length of the longest item, then every suffix of every test item is searched by bisection: the
interval found holds all places that share its first `least` words. From the places where a match begins, it is
extended to the longest verbatim match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lexflume.functions.arrow import text_slices
from lexflume.functions.words import words

BLOCK_CHARS = 8_000_000
HITS_AT_ONCE = 4_000_000


class TestSuffixes:
    """The test items of one block as numbers, ready to be searched."""

    __test__ = False

    def __init__(self, items: list[tuple[object, str]], least: int) -> None:
        self.least = least
        self.number: dict[bytes, int] = {}
        codes, starts, owners, self.longest = [], [], [], 0
        at = 0
        self.ids = [i for i, _ in items]
        for k, (_, text) in enumerate(items):
            own = [self.number.setdefault(w, len(self.number) + 1) for w in words(text)]
            if len(own) >= least:
                starts.extend(range(at, at + len(own) - least + 1))
                owners.extend([k] * (len(own) - least + 1))
                self.longest = max(self.longest, len(own))
            codes.extend([*own, -1])
            at += len(own) + 1
        # -1 behind an item and `longest` more at the end: a match never runs out of an item
        self.codes = np.array([*codes, *[-1] * (self.longest + 1)], np.int32)
        self.starts, self.owners = np.array(starts, np.int64), np.array(owners, np.int64)
        self.first = np.array([s == 0 or self.codes[s - 1] == -1 for s in starts], bool)


def suffix_array(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of `codes` sorted by the next `depth` symbols at least (prefix doubling; stops when all are told apart)."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
    order, reach = np.argsort(rank, kind="stable"), 1
    while reach < depth:
        second = np.full(n, -1, np.int64)
        second[: max(0, n - reach)] = rank[reach:]
        key = rank * (n + 1) + (second + 1)
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) if n else ordered
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        reach *= 2
        if n and fresh[-1] == n - 1:
            break
    return order


def _bisect(codes: np.ndarray, order: np.ndarray, wanted: np.ndarray, after: bool) -> np.ndarray:
    """For each row of `wanted`, the first index in `order` whose suffix is not below (after: is above) it on the row's length."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(order), np.int64)
    span = np.arange(wanted.shape[1])
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) >> 1
        there = codes[order[middle][:, None] + span]
        differs = there != wanted[open_]
        at = differs.argmax(axis=1)
        rows = np.arange(len(open_))
        below = there[rows, at] < wanted[open_][rows, at]
        below |= after & ~differs[rows, at]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]


def shard_matches(texts: list[str | None], tests: TestSuffixes) -> tuple[np.ndarray, ...]:
    """(text index, item index, matched words, first word in the text, first word in the item) of all maximal matches of at least `least` words."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    if not len(tests.starts):
        return nothing
    known = tests.number.get
    kept, owner, place = [], [], []
    for i, text in enumerate(texts):
        if not text:
            continue
        codes = np.array([known(w, 0) for w in words(text)], np.int32)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes > 0).astype(np.int8), [0]])))
        for a, b in zip(edges[::2], edges[1::2]):
            if b - a >= tests.least:
                kept += [codes[a:b], np.zeros(1, np.int32)]
                owner += [i] * (b - a + 1)
                place += range(a, b + 1)
    if not kept:
        return nothing
    text_codes = np.concatenate([*kept, np.zeros(tests.longest + 1, np.int32)])
    used = len(owner)
    order = suffix_array(text_codes[:used], tests.longest)
    wanted = tests.codes[tests.starts[:, None] + np.arange(tests.least)]
    low, high = _bisect(text_codes, order, wanted, False), _bisect(text_codes, order, wanted, True)
    many = high - low
    # a repetitive text may have every test suffix at every place: the hits are extended a part at a time
    ends = np.cumsum(many)
    cuts = np.unique(np.searchsorted(ends, np.arange(0, int(ends[-1]) + HITS_AT_ONCE, HITS_AT_ONCE), "left"))
    bounds = [0, *(int(c) for c in cuts if 0 < c < len(many)), len(many)]
    parts = [_extended(text_codes, order, low[a:b], many[a:b], np.arange(a, b), tests) for a, b in zip(bounds[:-1], bounds[1:])]
    which, at, length = (np.concatenate(x) for x in zip(*parts))
    item_start = np.concatenate([[0], np.flatnonzero(tests.codes == -1) + 1])
    begins = tests.starts[which]
    return np.array(owner)[at], tests.owners[which], length, np.array(place)[at], begins - item_start[np.searchsorted(item_start, begins, "right") - 1]


def _extended(text_codes: np.ndarray, order: np.ndarray, low: np.ndarray, many: np.ndarray, suffixes: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, place in the shard, words) of the maximal matches among the hits of some test suffixes."""
    which = np.repeat(np.arange(len(many)), many)
    at = order[np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))]
    which = suffixes[which]
    begins = tests.starts[which]
    maximal = tests.first[which] | (at == 0) | (text_codes[at - 1] != tests.codes[begins - 1])
    which, at, begins = which[maximal], at[maximal], begins[maximal]
    length = np.full(len(at), tests.least, np.int64)
    going = np.arange(len(at))
    while len(going):
        going = going[text_codes[at[going] + length[going]] == tests.codes[begins[going] + length[going]]]
        length[going] += 1
    return which, at, length


def find_leaks(docs: DataFrame, doc_col: str, text_col: str, items: DataFrame, item_col: str, item_text_col: str, least: int = 12) -> DataFrame:
    """(doc, item, words, doc_word, item_word): every maximal run of at least `least` consecutive words that a document shares with a test item.

    Words are runs of letters and digits of the lower-cased text; doc_word and item_word count words from 0. Null and
    empty texts and items of fewer than `least` words match nothing; rows without an id are ignored; repeated rows
    give repeated matches. Empty tables give an empty result. Other columns aren't read.

    All test items are searched in all documents. They are sent to the executors in blocks of at most about BLOCK_CHARS
    characters, with one pass over the documents for each block.
    """
    spark = docs.sparkSession
    tests = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    chars = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(chars // BLOCK_CHARS) + 1
    rows = docs.select(F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL AND text <> ''")
    doc_kind, item_kind = (f.schema[0].dataType for f in (rows, tests))
    item_type = to_arrow_type(item_kind)
    found = None
    for block in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast(TestSuffixes([tuple(r) for r in own.collect()], least))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted = sent.value
            ids = pa.array(wanted.ids, item_type)
            for batch in batches:
                for part, texts in text_slices(batch):
                    text, item, length, doc_word, item_word = shard_matches(texts, wanted)
                    if len(text):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), ids.take(pa.array(item)), pa.array(length), pa.array(doc_word.astype(np.int64)), pa.array(item_word)], ["doc", "item", "words", "doc_word", "item_word"])

        part = rows.mapInArrow(run, f"doc {doc_kind.simpleString()}, item {item_kind.simpleString()}, words long, doc_word long, item_word long")
        found = part if found is None else found.unionByName(part)
    return found


def without_leaks(docs: DataFrame, doc_col: str, leaks: DataFrame) -> DataFrame:
    """The documents that have no match (those with a null id included)."""
    return docs.join(leaks.select(F.col("doc").alias(doc_col)).distinct(), doc_col, "left_anti")
